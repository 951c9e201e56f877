"""Comment markers: one type a line, priorities by the file's references, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans.graph import CodeGraph

#: Markers in the order in which they are looked for.
TYPES = ("TODO", "FIXME", "HACK", "XXX", "NOTE", "OPTIMIZE", "DEPRECATED")


def markers(lines: DataFrame) -> DataFrame:
    pattern = lambda t: rf"(?i)(?://|#|/\*)\s*{t}:?\s*(.+)"
    kind = text = F.lit(None).cast("string")
    for t in reversed(TYPES):
        hit = F.col("line").rlike(pattern(t))
        kind, text = F.when(hit, t).otherwise(kind), F.when(hit, F.regexp_extract("line", pattern(t), 1)).otherwise(text)
    return lines.select("file_path", "line_no", kind.alias("type"), F.trim(F.regexp_replace(F.trim(text), r"\*/.*$", "")).alias("text")).where("type is not null")


def by_type(found: DataFrame) -> DataFrame:
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_path").alias("files"))


def priorities(found: DataFrame, g: CodeGraph, k: int = 20) -> DataFrame:
    n, t = F.coalesce("connections", F.lit(0)), F.col("type")
    score = F.when(t == "FIXME", F.when(n > 10, 4).when(n > 5, 3).otherwise(2)).when(t == "TODO", F.when(n > 10, 3).when(n > 5, 2).otherwise(1)).otherwise(F.when(n > 10, 3).otherwise(2))
    name = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), F.col("score"))
    shown = found.where(t.isin("TODO", "FIXME", "HACK")).join(g.edge_degree.select("file_path", "connections"), "file_path", "left").withColumns({"connections": n, "score": score})
    return shown.withColumn("priority", name).orderBy(F.desc("score"), F.desc("connections"), "file_path", "line_no").limit(k)


def completeness(found: DataFrame, g: CodeGraph) -> DataFrame:
    """Per directory its files, those in progress (over a tenth of a TODO a symbol), and the share that is complete."""
    todo = found.where("type in ('TODO', 'FIXME')").groupBy("file_path").agg(F.count(F.lit(1)).alias("open"))
    f = g.files.join(todo, "file_path", "left").withColumn("busy", F.coalesce("open", F.lit(0)) / F.col("symbols") > 0.1)
    return f.groupBy(X.dirname(F.col("file_path")).alias("dir")).agg(F.count(F.lit(1)).alias("files"), F.count_if("busy").alias("in_progress")).withColumn("percent", F.round(100.0 * (F.col("files") - F.col("in_progress")) / F.col("files"), 2))
