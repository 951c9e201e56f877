"""The property graph as two DataFrames, with the derived relations that most operators start from."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYMBOL = "id string, name string, kind string, file_path string, start_line int, end_line int, exported boolean, scope string, seq long"
REFERENCE = "source string, target string, kind string, file_path string, line int, seq long"
PSEUDO = "__file__"


@dataclass
class CodeGraph:
    """nodes: one row per symbol id; edges: one row per (source, target). Both carry seq, their place in extraction order."""

    nodes: DataFrame
    edges: DataFrame

    @cached_property
    def ef(self) -> DataFrame:
        """Edges with the files at both ends."""
        n = self.nodes.select("id", "file_path")
        s, t = n.select(F.col("id").alias("source"), F.col("file_path").alias("source_file")), n.select(F.col("id").alias("target"), F.col("file_path").alias("target_file"))
        return self.edges.join(s, "source").join(t, "target").select("source", "target", "kind", "line", "seq", "source_file", "target_file")

    @cached_property
    def xf(self) -> DataFrame:
        return self.ef.where("source_file <> target_file")

    @cached_property
    def pairs(self) -> DataFrame:
        """References counted by the files at both ends and by kind, with the first one's place."""
        return self.ef.groupBy("source_file", "target_file", "kind").agg(F.count(F.lit(1)).alias("edges"), F.min("seq").alias("seq"))

    @cached_property
    def fp(self) -> DataFrame:
        """Distinct pairs of files with a reference between them, and the first reference's place."""
        return self.pairs.where("source_file <> target_file").groupBy("source_file", "target_file").agg(F.min("seq").alias("seq"), F.sum("edges").alias("edges"))

    @cached_property
    def neighbours(self) -> DataFrame:
        """Distinct files on either side of each file, and references across, both ends in one pass over the pairs."""
        n, none = F.col("edges"), F.lit(0).cast("long")
        end = lambda side, i, o, into, out: F.struct(F.col(side).alias("file_path"), F.lit(i).alias("i"), F.lit(o).alias("o"), into.alias("into"), out.alias("out"))
        both = self.fp.select(F.explode(F.array(end("source_file", 0, 1, none, n), end("target_file", 1, 0, n, none))).alias("e")).select("e.*")
        return both.groupBy("file_path").agg(F.sum("i").alias("files_in"), F.sum("o").alias("files_out"), F.sum("into").alias("incoming"), F.sum("out").alias("outgoing"))

    @cached_property
    def files(self) -> DataFrame:
        return self.nodes.groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols"), F.min("seq").alias("seq"))

    @cached_property
    def edge_degree(self) -> DataFrame:
        """Cross-file references of each file, both ends counted."""
        return self.neighbours.select("file_path", "outgoing", "incoming", (F.col("outgoing") + F.col("incoming")).alias("connections"))

    @cached_property
    def in_degree(self) -> DataFrame:
        return self.edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("dependents"))

    def at_files(self, files: list[str]) -> DataFrame:
        """References, as in ``ef``, that start or end in these files; two filters, which go down to the ends' tables."""
        from_, to = F.col("source_file").isin(files), F.col("target_file").isin(files)
        return self.ef.where(from_).unionByName(self.ef.where(to & ~from_))

    def ids_at_files(self, files: list[str]) -> DataFrame:
        """(id) of both ends of these references, each once."""
        return self.at_files(files).select(F.explode(F.array("source", "target")).alias("id")).distinct()

    def with_dependents(self) -> DataFrame:
        return self.nodes.join(self.in_degree, "id", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)).cast("long"))

    def persist(self) -> CodeGraph:
        self.nodes.persist()
        self.edges.persist()
        return self

    def where_edges(self, condition: Column) -> CodeGraph:
        return CodeGraph(self.nodes, self.edges.where(condition))


def first_by_id(symbols: DataFrame) -> DataFrame:
    """Of symbols with one id the first extracted stays."""
    rest = [c for c in symbols.columns if c != "id"]
    return symbols.groupBy("id").agg(F.min_by(F.struct(*rest), "seq").alias("s")).select("id", "s.*")


def upsert(refs: DataFrame) -> DataFrame:
    """One edge per (source, target): later attributes win, the place is that of the first."""
    rest = [c for c in refs.columns if c not in ("source", "target", "seq")]
    merged = refs.groupBy("source", "target").agg(F.max_by(F.struct(*rest), "seq").alias("a"), F.min("seq").alias("first"))
    return merged.select("source", "target", "a.*", F.col("first").alias("seq"))


def build_graph(symbols: DataFrame, refs: DataFrame) -> CodeGraph:
    """First-wins nodes, pseudo-nodes for file endpoints, upserted edges whose ends both exist."""
    nodes = first_by_id(symbols)
    ends = refs.select(F.explode(F.array("source", "target")).alias("id"), "seq").where(F.col("id").endswith("::" + PSEUDO))
    pseudo = ends.groupBy("id").agg(F.min("seq").alias("seq")).join(nodes.select("id"), "id", "left_anti")
    made = {"name": F.lit(PSEUDO), "kind": F.lit("import"), "file_path": F.expr(f"left(id, length(id) - {len(PSEUDO) + 2})"), "start_line": F.lit(1), "end_line": F.lit(1), "exported": F.lit(False), "scope": F.lit(None).cast("string")}
    nodes = nodes.unionByName(pseudo.withColumns(made), allowMissingColumns=True)
    ids = nodes.select("id")
    known = refs.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return CodeGraph(nodes, upsert(known))


def add_edges(graph: CodeGraph, extra: DataFrame) -> CodeGraph:
    """Edges whose ends exist; attributes that an extra edge lacks stay."""
    ids = graph.nodes.select("id")
    known = extra.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    attributes = [c for c in dict.fromkeys([*graph.edges.columns, *known.columns]) if c not in ("source", "target", "seq")]
    both = graph.edges.unionByName(known, allowMissingColumns=True)
    merged = both.groupBy("source", "target").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in attributes], F.min("seq").alias("seq"))
    return CodeGraph(graph.nodes, merged)


def remove_files(graph: CodeGraph, files: list[str]) -> CodeGraph:
    """The graph without these files' symbols and all edges at them."""
    nodes = graph.nodes.where(~F.col("file_path").isin(files))
    gone = graph.nodes.where(F.col("file_path").isin(files)).select("id")
    edges = graph.edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return CodeGraph(nodes, edges)


def replace_files(graph: CodeGraph, files: list[str], symbols: DataFrame, refs: DataFrame) -> CodeGraph:
    """Deletes files and inserts what was extracted anew."""
    rest = remove_files(graph, files)
    return build_graph(rest.nodes.unionByName(symbols, allowMissingColumns=True), rest.edges.unionByName(refs, allowMissingColumns=True))


def ranked(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
