"""Semantics of meshes from XML, read line by line as its writer lays it out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the three properties.
KEYS = {"Element_Category": "category", "Element_Family": "family", "Element_Type": "type"}


def parse(text: str) -> list[dict[str, str]]:
    """Blocks in order: actor_hash, category, family, type. One construct counts per line, and entities stay as they are.

    A block without category and family is left out.
    """
    out: list[dict[str, str]] = []
    now: dict[str, str] | None = None
    for line in text.splitlines():
        if "<MetaData" in line:
            m = re.search(r'reference="Actor\.([^"]*)"', line)
            now = {"actor_hash": m[1], "category": "", "family": "", "type": ""} if m else None
        elif "</MetaData>" in line:
            if now and (now["category"] or now["family"]):
                out.append(now)
            now = None
        elif now is not None and "<KeyValueProperty" in line:
            name, val = re.search(r'name="([^"]*)"', line), re.search(r'val="([^"]*)"', line)
            if name and val and name[1] in KEYS:
                now[KEYS[name[1]]] = val[1]
    return out


def read_semantics(spark: SparkSession, path: str) -> DataFrame:
    """(actor_hash, category, family, type), the last block of a hash counting, by file and place."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"path": p, "ix": i} | r for p, content in zip(b["path"], b["content"]) for i, r in enumerate(parse(bytes(content).decode("utf-8", "replace")))]
            yield pd.DataFrame(rows, columns=["path", "ix", "actor_hash", "category", "family", "type"])

    rows = files.mapInPandas(run, "path string, ix long, actor_hash string, category string, family string, type string")
    return last_blocks(rows)


def last_blocks(blocks: DataFrame) -> DataFrame:
    """(actor_hash, category, family, type): of each hash the last block in the order of path and ix."""
    last = F.max_by(F.struct("category", "family", "type"), F.struct("path", "ix"))
    return blocks.groupBy("actor_hash").agg(last.alias("x")).select("actor_hash", "x.*")


def with_semantics(meshes: DataFrame, semantics: DataFrame, name: str = "mesh_name") -> DataFrame:
    """``meshes`` with category, family and type; null where there are none."""
    return meshes.join(semantics.withColumnRenamed("actor_hash", name), name, "left")
