"""A Spark-native engine for scene data: repeated geometry, bounding boxes, tiles, levels of detail."""
