"""Commit sampling, snapshots, their differences, and history documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans.graph import CodeGraph
from .rollup import pair_weights

one = lambda name: F.count(F.lit(1)).alias(name)


def _numbered(commits: DataFrame) -> DataFrame:
    """Places from 0 in log order, newest first. A log is far smaller than a corpus; the window is over it alone."""
    return commits.withColumn("i", F.row_number().over(Window.orderBy("seq")) - 1)


def sample_evenly(commits: DataFrame, k: int) -> DataFrame:
    n = commits.count()
    if k >= n:
        return commits
    places = sorted({int(i * (n - 1) / (k - 1) + 0.5) for i in range(k)}) if k > 1 else [0]
    return _numbered(commits).where(F.col("i").isin(places)).drop("i")


def week_key(date: Column) -> Column:
    """Calendar year and ISO week, so the first days of a year may be in week 53 of that year."""
    return F.concat(F.year(date).cast("string"), F.lit("-W"), F.weekofyear(date).cast("string"))


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def sample_buckets(commits: DataFrame, k: int, key: Column) -> DataFrame:
    """The last listed commit of each bucket; if these are more than k, every so many of them between first and last."""
    rest = [c for c in commits.columns if c != "seq"]
    per = commits.groupBy(key.alias("bucket")).agg(F.max_by(F.struct("seq", *rest), "seq").alias("c"), F.min("seq").alias("place"))
    n = per.count()
    buckets = per.withColumn("i", F.row_number().over(Window.orderBy("place")) - 1)
    if n <= k or k < 3:
        return buckets.select("c.*")
    step = (n - 2) // (k - 2)
    places = {min(i * step, n - 2) for i in range(1, k - 1)}
    picked = buckets.where(F.col("i").isin(sorted(places))).select("c.*")
    ends = commits.agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    first_last = commits.crossJoin(F.broadcast(ends)).where("seq = a or seq = b").select("seq", *rest)
    return first_last.unionByName(picked).dropDuplicates(["seq"])


def snapshot(g: CodeGraph, commit: dict) -> DataFrame:
    """One row for a commit: totals, languages, files and weighted file pairs."""
    files = g.files.join(g.edge_degree, "file_path", "left").select(F.struct("file_path", "symbols", F.coalesce("connections", F.lit(0)).alias("connections")).alias("f"), X.language(F.col("file_path")).alias("language"))
    langs = files.groupBy("language").agg(one("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))
    listed = files.agg(one("total_files"), F.coalesce(F.sum("f.symbols"), F.lit(0)).alias("total_symbols"), F.array_sort(F.collect_list("f")).alias("files"))
    pairs = pair_weights(g).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("total_edges"), F.array_sort(F.collect_list(F.struct("file_a", "file_b", "weight"))).alias("edges"))
    return listed.crossJoin(langs).crossJoin(pairs).withColumns({k: F.lit(v) for k, v in commit.items()})  # one row each


def missing(commits: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Commits without a stored snapshot."""
    return commits.join(snapshots.select("hash"), "hash", "left_anti")


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """What each snapshot adds to and takes from that before it."""
    w = Window.orderBy("date", "hash")  # one row a sampled commit
    paths = lambda c: F.transform(c, lambda f: f["file_path"])
    ends = lambda c: F.transform(c, lambda e: F.concat(e["file_a"], F.lit(" "), e["file_b"]))
    none = F.array().cast("array<string>")
    rows = snapshots.select("hash", "date", "total_files", "total_symbols", "total_edges", paths(F.col("files")).alias("f"), ends(F.col("edges")).alias("e"))
    rows = rows.withColumns({"pf": F.coalesce(F.lag("f").over(w), none), "pe": F.coalesce(F.lag("e").over(w), none), "i": F.row_number().over(w) - 1})
    delta = lambda c: (F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias("d_" + c)
    return rows.select("i", F.substring("hash", 1, 8).alias("hash"), "date", F.array_except("f", "pf").alias("files_added"), F.array_except("pf", "f").alias("files_removed"), F.array_except("e", "pe").alias("edges_added"), F.array_except("pe", "e").alias("edges_removed"), delta("total_files"), delta("total_symbols"), delta("total_edges"))


def growth(snapshots: DataFrame) -> DataFrame:
    """First and last totals, the largest jump in files (the earliest of equals) and the trend."""
    w = Window.orderBy("date", "hash")
    rows = snapshots.select("hash", "date", "total_files", "total_symbols", "total_edges", F.row_number().over(w).alias("i"), (F.col("total_files") - F.lag("total_files").over(w)).alias("jump"))
    a = rows.agg(F.min_by("total_files", "i").alias("first_files"), F.max_by("total_files", "i").alias("last_files"), F.max("jump").alias("largest_jump"), F.max_by("hash", F.struct("jump", -F.col("i"))).alias("jump_hash"))
    return a.withColumn("trend", F.when(F.col("last_files") > F.col("first_files"), "growing").when(F.col("last_files") < F.col("first_files"), "shrinking").otherwise("stable"))


def timeline(commits: DataFrame) -> DataFrame:
    a = commits.agg(F.min("date").alias("first"), F.max("date").alias("last"), one("commits"))
    days = F.floor((F.unix_timestamp("last") - F.unix_timestamp("first")) / 86400).cast("long")
    months = F.floor(days / 30).cast("long")
    return a.select(F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"), "commits", days.alias("days"), months.alias("months"), F.round(F.when(months > 0, F.col("commits") / months).otherwise(F.col("commits").cast("double")), 1).alias("per_month"))


#: Words of a message by commit type; the first type that has one counts.
TYPES = {"features": ("feat", "add", "new", "implement", "create"), "fixes": ("fix", "bug", "patch", "resolve"), "refactors": ("refactor", "cleanup", "restructure", "improve")}


def commit_types(commits: DataFrame) -> DataFrame:
    low, out = F.lower("message"), F.lit("other")
    for kind, words in reversed(TYPES.items()):
        out = F.when(low.rlike("|".join(words)), kind).otherwise(out)
    return commits.groupBy(out.alias("type")).agg(one("n")).withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def contributors(commits: DataFrame, k: int = 10) -> DataFrame:
    n = commits.groupBy("author").agg(one("commits")).withColumn("percent", F.round(100.0 * F.col("commits") / F.sum("commits").over(Window.partitionBy()), 4))
    return n.orderBy(F.desc("commits"), "author").limit(k)


def churn(changes: DataFrame, g: CodeGraph | None = None, k: int = 20) -> DataFrame:
    """(hash, file_path) rows to the most changed files, with their references and a risk band."""
    top = changes.groupBy("file_path").agg(one("changes")).orderBy(F.desc("changes"), "file_path").limit(k)
    if g is not None:
        top = top.join(g.edge_degree.select("file_path", "connections"), "file_path", "left").withColumn("connections", F.coalesce("connections", F.lit(0)))
    else:
        top = top.withColumn("connections", F.lit(0).cast("long"))
    return top.withColumn("risk", F.when((F.col("changes") > 20) & (F.col("connections") > 10), "high").when((F.col("changes") > 10) | (F.col("connections") > 10), "medium").otherwise("low"))


def file_ages(changes: DataFrame, k: int = 5) -> DataFrame:
    """(file_path, date) rows to the oldest and newest files by their first change."""
    first = changes.groupBy("file_path").agg(F.min("date").alias("added"))
    old = first.orderBy("added", "file_path").limit(k).withColumn("end", F.lit("oldest"))
    return old.unionByName(first.orderBy(F.desc("added"), "file_path").limit(k).withColumn("end", F.lit("newest")))
