"""Health scoring: six dimensions of one row each, their weighted sum, and the history of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans.graph import CodeGraph
from .traverse import cycle_count, longest_path

#: Dimension and weight.
WEIGHTS = {"coupling": 0.25, "cohesion": 0.20, "cycles": 0.20, "god_files": 0.15, "orphans": 0.10, "depth": 0.10}


def _row(name: str, score: Column, value: Column) -> list[Column]:
    return [F.lit(name).alias("dimension"), score.cast("int").alias("score"), F.lit(WEIGHTS[name]).alias("weight"), X.grade(score).alias("grade"), F.round(value.cast("double"), 6).alias("value")]


def coupling(g: CodeGraph) -> DataFrame:
    across = X.first_dir(F.col("source_file")) != X.first_dir(F.col("target_file"))
    e = g.fp.agg(F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"), F.coalesce(F.sum(F.when(across, F.col("edges"))), F.lit(0)).alias("across"))
    top = g.edge_degree.agg(F.coalesce(F.max("connections"), F.lit(0)).alias("top"))
    files = g.files.agg(F.count(F.lit(1)).alias("files"))
    mean = F.col("edges") / F.greatest("files", F.lit(1))
    score = X.band(mean, [(3, 100), (6, 80), (10, 60), (15, 40)], 20) - F.when(F.col("top") > mean * 3, 10).otherwise(0) - F.when(F.col("across") / F.greatest("edges", F.lit(1)) > 0.7, 10).otherwise(0)
    score = F.when(F.col("files") == 0, 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score)))
    return e.crossJoin(top).crossJoin(files).select(*_row("coupling", score, mean))  # one row each


def cohesion(g: CodeGraph) -> DataFrame:
    s, t = X.dirname(F.col("source_file")), X.dirname(F.col("target_file"))
    per = g.fp.groupBy(s.alias("dir")).agg(F.sum("edges").alias("n"), F.sum(F.when(s == t, F.col("edges")).otherwise(0)).alias("own"))
    mean = F.coalesce(F.sum(F.col("own") / F.col("n")) / F.count(F.lit(1)), F.lit(1.0))
    return per.agg(mean.alias("mean")).select(*_row("cohesion", X.band(F.col("mean"), [(0.7, 100), (0.5, 80), (0.3, 60), (0.1, 40)], 20, at_most=False), F.col("mean")))


def circular(g: CodeGraph) -> DataFrame:
    n = F.col("cycles")
    return cycle_count(g).select(*_row("cycles", X.band(n, [(0, 100), (2, 80), (5, 60), (10, 40)], 20), n))


def god_files(g: CodeGraph) -> DataFrame:
    mean = g.edge_degree.agg(F.avg("connections").alias("mean"))  # one row a file; the pairs below it are read, not made again, where they are written
    n = g.edge_degree.crossJoin(F.broadcast(mean)).agg(F.count_if(F.col("connections") > 3 * F.col("mean")).alias("n"))
    return n.select(*_row("god_files", X.band(F.col("n"), [(0, 100), (1, 80), (3, 60), (5, 40)], 20), F.col("n")))


def orphans(g: CodeGraph) -> DataFrame:
    files = g.files.select("file_path").join(g.edge_degree, "file_path", "left").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("connections").isNull()).alias("alone"))
    symbols = g.nodes.select("id").join(g.in_degree, "id", "left").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("dependents").isNull()).alias("dead"))
    share = (100 * F.col("alone") / F.greatest("files", F.lit(1)) + 100 * F.col("dead") / F.greatest("symbols", F.lit(1))) / 2
    return files.crossJoin(symbols).select(*_row("orphans", X.band(share, [(0, 100), (5, 80), (10, 60), (20, 40)], 20), share))


def depth(g: CodeGraph) -> DataFrame:
    n = g.nodes.sparkSession.range(1).select(F.lit(longest_path(g.fp)).alias("n"))
    return n.select(*_row("depth", X.band(F.col("n"), [(4, 100), (6, 80), (8, 60), (12, 40)], 20), F.col("n")))


def dimensions(g: CodeGraph) -> DataFrame:
    out = coupling(g)
    for f in (cohesion, circular, god_files, orphans, depth):
        out = out.unionByName(f(g))
    return out


def overall(parts: DataFrame) -> DataFrame:
    """Score, grade and summary of dimension rows."""
    score = F.floor(F.sum(F.col("score") * F.col("weight")) + 0.5).cast("int")
    told = F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 80, "good").when(F.col("score") >= 70, "fair").when(F.col("score") >= 60, "poor").otherwise("critical")
    return parts.agg(score.alias("score")).select("score", X.grade(F.col("score")).alias("grade"), told.alias("summary"))


def recommendations(parts: DataFrame, most: int = 6) -> DataFrame:
    return parts.where("score < 80").orderBy("score", F.desc("weight"), "dimension").limit(most)


def append_history(history: DataFrame, entry: DataFrame, keep: int = 50) -> DataFrame:
    """The newest ``keep`` entries (timestamp, score, ...)."""
    return history.unionByName(entry).orderBy(F.desc("timestamp")).limit(keep)


def trend(history: DataFrame) -> DataFrame:
    # a history has at most some dozens of rows
    return history.withColumn("delta", F.col("score") - F.lag("score").over(Window.orderBy("timestamp")))
