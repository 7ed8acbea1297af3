"""The whole run that settings describe: files in, models, tilesets and reports out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.config import Settings, log
from mosaiq.functions.boxes import Box, tileset_error
from mosaiq.operators import quadtree, reconcile
from mosaiq.operators.steps import written as stored
from mosaiq.plans import instancing, levels, semantic_levels
from mosaiq.sinks import assembly
from mosaiq.sinks import models as sink
from mosaiq.sinks import reports, tilesets
from mosaiq.sources import lists, scenes, semantics


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file wherever Spark can write."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _flat(placed: DataFrame, models: DataFrame, uri: str) -> str | None:
    """A tileset of one file around placements; None if they have no box."""
    boxes = scenes.mesh_boxes(scenes.primitives(models))
    row = scenes.scene_box(placed.withColumn("all", F.lit(1)), boxes, ["all"]).select(Box.named().oriented(z_up=True).alias("box"), tileset_error(Box.named().diagonal()).alias("error")).first()
    return tilesets.flat([(uri, list(row.box), row.error)], list(row.box)) if row and row.box else None


def run(spark: SparkSession, settings: Settings) -> list[str]:
    """All that the settings ask for; the names of what was written below ``output_directory``."""
    s, out, written = settings, settings.output_directory.rstrip("/"), []
    # Files are read and parsed once; every later step reads the tables of what they hold.
    files = scenes.discover(spark, s.input_directory)
    read = stored(scenes.read_scenes(files, s.normal_tolerance), "scenes")
    for r in read.filter("error IS NOT NULL").select("path", "error").toLocalIterator():
        log.error("%s: %s", r.path, r.error)
    models = stored(scenes.models(read), "models")
    contents = models.select("path", "model_id").join(files.select("path", "content"), "path")
    found = instancing.detect(models, s.tolerance, s.instance_limit, s.skip_attribute_data_hash)
    found = instancing.Instancing(stored(found.groups, "groups"), stored(found.members, "members"), stored(found.left, "left"))

    def listed(names: list[str], folder: str) -> list[str]:
        written.extend(f"{folder.removeprefix(out + '/')}/{n}" if folder != out else n for n in names)
        return names

    def save(df: DataFrame, folder: str, name: str = "name") -> list[str]:
        return listed([r.name for r in sink.save(df, folder, name).collect()], folder)  # names of files

    def put_models(drawn: DataFrame, folder: str, name: Column, of: DataFrame | None = None) -> DataFrame:
        saved = stored(assembly.save_models(drawn, contents if of is None else of, folder, name), "saved")
        listed([r.name for r in saved.select("name").toLocalIterator()], folder)
        return saved

    def put(name: str, text: str | None) -> None:
        if text is not None:
            put_text(spark, f"{out}/{name}", text)
            written.append(name)

    drawn = instancing.to_draw(found).withColumn("name", F.when(F.col("instanced"), "instanced.glb").otherwise("non_instanced.glb"))
    names = {r.name for r in put_models(drawn, out, F.col("name")).select("name").collect()}  # two at most
    for name, placed in (("instanced", found.members), ("non_instanced", found.left)):
        if f"{name}.glb" in names:
            put(f"tileset_{name}.json", _flat(placed, models, f"{name}.glb"))
    if len(names) == 2:
        put("tileset.json", tilesets.wrapper(["tileset_instanced.json", "tileset_non_instanced.json"]))
    reports.instancing_csv(instancing.report(models, found), f"{out}/instancing_analysis.csv")
    written.append("instancing_analysis.csv")
    put("instancing_report.txt", reports.text(found.groups, found.left))
    if s.merge_all_glb:
        merged = contents.withColumn("name", F.lit("merged.glb"))
        save(sink.merge_models(merged, ["name"]), out)
    prims = scenes.primitives(models)
    if s.mesh_segmentation:
        stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("stem")
        named = prims.groupBy("model_id", "mesh_ix").agg(F.min("mesh_name").alias("mesh_name")).join(models.select("model_id", stem), "model_id")
        put_models(sink.segments(scenes.placements(models), named), f"{out}/segments", F.col("file_name"))
    if s.csv_directory:
        left = found.left.join(prims.select("model_id", "mesh_ix", F.col("mesh_name").alias("name")).distinct(), ["model_id", "mesh_ix"]).filter("name IS NOT NULL")
        ids = lists.read_id_lists(spark, s.csv_directory)
        for r in ids.select("list").distinct().toLocalIterator():
            rows = reconcile.reconcile(ids.filter(F.col("list") == r.list), left)
            reports.csv(rows.orderBy("part", "name", "component_id").drop("part"), f"{out}/{r.list}_processed.csv", quote=True)
            written.append(f"{r.list}_processed.csv")
    if s.enable_lod_generation:
        folder = f"{out}/instancing_lod_output"
        what = semantics.read_semantics(spark, s.semantic_data_path) if s.semantic_data_path else spark.createDataFrame([], "actor_hash string, category string, family string, type string")
        of_level = semantic_levels.build(found, models, what, s.lod4_size_tolerance, s.lod3_aspect_ratio_tolerance)
        drawn = reduce(DataFrame.unionByName, [semantic_levels.to_draw(x) for x in of_level])
        saved = put_models(drawn, folder, F.col("name"), semantic_levels.with_cube(spark, contents))
        reports.csv(semantic_levels.analysis(of_level, saved, files, models), f"{folder}/lod_analysis.csv")
        written.append("instancing_lod_output/lod_analysis.csv")
        there = {r.name for r in saved.select("name").collect()}  # one per level
        chain = [(f"LOD{x.level}.glb", x.error) for x in reversed(of_level) if f"LOD{x.level}.glb" in there]
        put("instancing_lod_output/tileset.json", tilesets.chain(chain))
    if s.enable_lod_generation or s.enable_non_instanced_lod_generation:
        put_levels(spark, settings, files, save, put)
    if s.enable_hlod:
        drawn, roots = levels.tile_members(models, s.quadtree_max_depth, s.quadtree_max_objects_per_tile)
        tiles = put_models(drawn, f"{out}/tiles", quadtree.tile_name(F.col("level"), F.col("x"), F.col("y")))
        reports.csv(semantic_levels.tile_analysis(tiles), f"{out}/hlod_analysis.csv")
        written.append("hlod_analysis.csv")
        # Each is written whole by an executor; the root's is the one without a name.
        save(roots.select(F.coalesce("uri", F.lit("tileset.json")).alias("name"), F.col("json").cast("binary").alias("glb")), f"{out}/tiles")
    return written


def put_levels(spark: SparkSession, s: Settings, files: DataFrame, save, put) -> None:
    """Models of every level, a tileset of levels for each file, and instancing detected anew in each level."""
    out, count = f"{s.output_directory.rstrip('/')}/levels", s.non_instanced_lod_level_count
    made = levels.level_models(files, count, s.non_instanced_lod_ratio, s.non_instanced_min_simplify_index_count)
    made = stored(made, "levels")
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    named = made.withColumn("name", F.concat(stem, F.lit("_"), F.substring(F.sha2("path", 256), 1, 8), F.lit("_lod"), F.col("level").cast("string"), F.lit(".glb")))
    save(named, out)
    for r in named.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("level", "name", "error"))).alias("of")).toLocalIterator():
        put(f"levels/{r.of[0].name.removesuffix('_lod0.glb')}.json", levels.level_tileset([(x.name, x.error) for x in r.of]))
    reports.csv(levels.level_report(made), f"{out}/level_report.csv")
    if s.enable_lod_generation:
        chain = []
        for one in levels.instanced_levels(made, count, s.tolerance, s.instance_limit, s.skip_attribute_data_hash, s.normal_tolerance):
            glbs = one.models.withColumn("name", F.concat("part", F.lit(f"_lod{one.level}.glb")))
            uris = sorted(save(glbs, out))
            reports.instancing_csv(one.report, f"{out}/instancing_lod{one.level}.csv")
            if uris:
                chain.append((16.0 * 2 ** (one.level - 1), uris))
        put("levels/instanced_levels.json", levels.instanced_level_tileset(chain))
