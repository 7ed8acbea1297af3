"""Reports as CSV and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.reports import INSTANCING, top


def csv(df: DataFrame, path: str, quote: bool = False) -> None:
    """A report with its header; ``quote`` puts every field in quotes."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", quote).csv(path)


def instancing_csv(report: DataFrame, path: str) -> None:
    """The instancing report under its own column names, percentages with two places."""
    texts = [F.format_string("%.2f", F.col(c)) if t == "double" else F.col(c) for c, t in report.dtypes]
    csv(report.select(*[x.alias(n) for x, n in zip(texts, INSTANCING)]), path)


def text(groups: DataFrame, left: DataFrame, most: int = 50) -> str:
    """Groups, then the first of what is left over and how many more there are."""
    lines = [f"Group {r.signature}: {r.n} instances" for r in top(groups, [F.col("signature")], most)[0].collect()]
    shown, more = top(left, [F.col("model_id"), F.col("mesh_ix"), F.col("node_ix")], most)
    lines += [f"Model {r.model_id}, mesh {r.mesh_ix}, node {r.node_ix}" for r in shown.collect()]
    return "\n".join([*lines, *([f"... and {more} more"] if more else [])])
