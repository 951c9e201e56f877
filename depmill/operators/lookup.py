"""Symbol search, neighbourhood and file context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import CodeGraph


def find_symbols(g: CodeGraph, query: str) -> DataFrame:
    """Symbols with this id, else with this name in any case; most used first."""
    nodes = g.with_dependents()
    if "::" in query:
        exact = nodes.where(F.col("id") == query)
        if exact.take(1):
            return exact
    return nodes.where(F.lower("name") == query.lower()).orderBy(F.desc("dependents"), "seq")


def search_symbols(g: CodeGraph, query: str) -> DataFrame:
    return g.with_dependents().where(F.lower("name").contains(query.lower()))


def ranked_search(g: CodeGraph, query: str, limit: int = 20) -> DataFrame:
    """Exact names, then prefixes, then the rest, alphabetically; total is the number of all matches."""
    q, name = query.lower(), F.lower("name")
    found = search_symbols(g, query).withColumn("match", F.when(name == q, 0).when(name.startswith(q), 1).otherwise(2))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy("match", name, "seq").limit(limit).crossJoin(F.broadcast(total))  # one row


def symbol_info(g: CodeGraph, query: str, suggestions: int = 10) -> tuple[DataFrame, bool]:
    """The symbols found, or suggestions and True."""
    found = find_symbols(g, query)
    return (found, False) if found.take(1) else (search_symbols(g, query).orderBy("seq").limit(suggestions), True)


def disambiguation(g: CodeGraph, query: str) -> DataFrame:
    """The matches of a name, the first with a hint if others depend on it."""
    place = F.row_number().over(Window.orderBy(F.desc("dependents"), "seq"))
    return find_symbols(g, query).limit(1000).withColumn("hint", (place == 1) & (F.col("dependents") > 0))


def dependencies(g: CodeGraph, symbol: str) -> DataFrame:
    edges = g.edges.where(F.col("source") == symbol).select(F.col("target").alias("id"), F.col("kind").alias("relation"), "line", F.col("seq").alias("edge_seq"))
    return edges.join(g.nodes, "id")


def dependents(g: CodeGraph, symbol: str) -> DataFrame:
    edges = g.edges.where(F.col("target") == symbol).select(F.col("source").alias("id"), F.col("kind").alias("relation"), "line", F.col("seq").alias("edge_seq"))
    return edges.join(g.nodes, "id")


def by_relation(found: DataFrame) -> DataFrame:
    """Dependencies or dependents grouped by edge kind."""
    return found.groupBy("relation").agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list(F.struct("edge_seq", "id", "name", "file_path", "line"))).alias("symbols"))


def file_symbols(g: CodeGraph, path: str) -> DataFrame:
    return g.nodes.where(F.col("file_path") == path)


def file_imports(g: CodeGraph, path: str) -> DataFrame:
    """Files that a file refers to and the distinct names it uses of each."""
    names = g.nodes.select(F.col("id").alias("target"), "name")
    return g.xf.where(F.col("source_file") == path).join(names, "target").groupBy(F.col("target_file").alias("file_path")).agg(F.sort_array(F.collect_set("name")).alias("names"))


def file_imported_by(g: CodeGraph, path: str) -> DataFrame:
    names = g.nodes.select(F.col("id").alias("target"), "name")
    return g.xf.where(F.col("target_file") == path).join(names, "target").groupBy(F.col("source_file").alias("file_path")).agg(F.sort_array(F.collect_set("name")).alias("names"))


def by_file(symbols: DataFrame, path: str | None) -> DataFrame:
    """Symbols of a path, or of paths that end with it."""
    return symbols if path is None else symbols.where((F.col("file_path") == path) | F.col("file_path").endswith(path))


def same_file(column: str, path: str):
    """Whether two paths mean one file: equal, or one the other's end, without './' and a trailing '/'."""
    plain = F.regexp_replace(F.col(column), r"^(\./)+|/+$", "")
    want = path.removeprefix("./").rstrip("/")
    return (plain == want) | plain.endswith("/" + want) | F.lit("/" + want).endswith(F.concat(F.lit("/"), plain))
