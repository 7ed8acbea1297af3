"""Id lists: text files of ``name,id`` lines with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``lines`` with ``name`` and ``component_id``: split at the first comma, both trimmed.

    Quotes mean nothing. Lines without a comma, without a name or with nothing behind the
    comma are left out, as blank ones are.
    """
    parts = F.split(F.regexp_replace(value, "\r$", ""), ",", 2)
    named = lines.withColumns({"name": F.trim(F.get(parts, F.lit(0))), "component_id": F.trim(F.get(parts, F.lit(1)))})
    return named.filter("name <> '' AND component_id <> ''").drop(value)


def read_id_lists(spark: SparkSession, folder: str) -> DataFrame:
    """(list, name, component_id) of every ``*_IDExport.csv`` in a folder, not in those below it; ``list`` is the file's stem."""
    rows = spark.read.option("pathGlobFilter", "*_IDExport.csv").text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1).alias("list"), F.split("value", "\n").alias("lines"))
    # The header goes with its file's first line; a list is a small file.
    return parse_lines(rows.select("list", F.explode(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1)))).alias("value")))
