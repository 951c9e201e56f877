"""Live updates: file changes as a stream, applied to a graph that is kept as tables; windowed commit activity."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..plans.graph import CodeGraph, build_graph, remove_files
from ..plans.scratch import written
from ..sources.scan import MOST_BYTES, STRIDE, extracted, graph_of, list_files, load_graph, package_imports, save_graph

CHANGE = "file_path string, event string, mtime double, language string, content string"
#: Seconds that a file must rest before its change counts.
SETTLED = 0.3
#: What marks a generation of a stored graph as whole.
COMPLETE = "complete"


class FileChanges(DataSource):
    """Additions, changes and removals of source files below option("path"); Spark's own file source sees no removals."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return CHANGE

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return ChangeReader(self.options["path"])


class ChangeReader(SimpleDataSourceStreamReader):
    """The offset is the state: each path's time of change."""

    def __init__(self, root: str) -> None:
        self.root = root

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _now(self) -> dict[str, float]:
        now = {}
        for path, _, size in list_files(self.root):
            mtime = os.path.getmtime(os.path.join(self.root, path))
            if size <= MOST_BYTES and time.time() - mtime >= SETTLED:
                now[path] = mtime
        return now

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before, now = json.loads(start["files"]), self._now()
        return self._changes(before, now), {"files": json.dumps(now, sort_keys=True)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._changes(json.loads(start["files"]), json.loads(end["files"]))

    def _changes(self, before: dict[str, float], now: dict[str, float]) -> Iterator[tuple]:
        languages = {p: lang for p, lang, _ in list_files(self.root)}
        rows = []
        for path, mtime in now.items():
            if before.get(path) != mtime and path in languages:
                with open(os.path.join(self.root, path), errors="replace") as f:
                    rows.append((path, "change" if path in before else "add", mtime, languages[path], f.read()))
        rows += [(p, "unlink", t, None, None) for p, t in before.items() if p not in now]
        return iter(rows)


def changes(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(FileChanges)
    return spark.readStream.format("file_changes").option("path", root).load()


def latest(batch: DataFrame) -> DataFrame:
    """The last event of each path."""
    return batch.groupBy("file_path").agg(F.max_by(F.struct("event", "language", "content"), "mtime").alias("e")).select("file_path", "e.*")


def applied(g: CodeGraph, batch: DataFrame, all_files: DataFrame) -> CodeGraph:
    """The graph after a batch. Rows of changed files are extracted anew against all known paths, behind all earlier ones."""
    last = written(latest(batch), "changes")
    paths = [r[0] for r in last.select("file_path").collect()]  # files of one micro-batch
    rest = remove_files(g, paths)
    base = (max([r[0] or 0 for r in (g.nodes.agg(F.max("seq")).first(), g.edges.agg(F.max("seq")).first())]) // STRIDE) + 1
    fresh = last.where("event <> 'unlink'").withColumn("place", F.row_number().over(Window.orderBy("file_path")).cast("long") + base)  # of one micro-batch
    others = all_files.withColumn("content", F.lit("")).withColumn("event", F.lit("")).join(fresh.select("file_path"), "file_path", "left_anti")
    rows = extracted(fresh.unionByName(others, allowMissingColumns=True)).where(F.col("file_path").isin(paths))
    rows = written(rows, "extracted")
    new = graph_of(rows)
    refs = rows.where("rec = 'ref'").select("source", "target", "kind", "file_path", "line", "seq")
    nodes = rest.nodes.unionByName(new.nodes, allowMissingColumns=True)
    edges = rest.edges.unionByName(package_imports(refs, all_files.select("file_path")), allowMissingColumns=True)
    return build_graph(nodes, edges.select(*g.edges.columns))


def generation_before(spark: SparkSession, store: str, number: int) -> str:
    """The folder of the last stored generation below this one; the first is named start."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(path)]
    done = lambda n: files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/{n}/{COMPLETE}"))
    earlier = [int(n) for n in names if n.isdigit() and int(n) < number and done(n)]
    return f"{store}/{max(earlier) if earlier else 'start'}"


def keep_updated(spark: SparkSession, root: str, store: str, checkpoint: str, on_refresh: Callable[[CodeGraph], None] | None = None):
    """A query that applies changes to the graph stored as generations of tables.

    A batch reads the last complete generation below its number and writes its own, so a batch that runs again, a batch
    without rows and a writer that broke off lose nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        if not batch.take(1):
            return
        old = load_graph(spark, generation_before(spark, store, number))
        files = spark.createDataFrame([(p, lang, 0) for p, lang, _ in list_files(root)], "file_path string, language string, place long")
        save_graph(applied(old, batch, files), f"{store}/{number}")
        spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("overwrite").parquet(f"{store}/{number}/{COMPLETE}")
        if on_refresh:
            on_refresh(load_graph(spark, f"{store}/{number}"))

    return changes(spark, root).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()


# --- beyond the file watcher: windows over a stream of commits or events ----------------------------------------------


def activity(stream: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours", time_column: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts in tumbling or sliding windows of event time; rows later than ``late`` are left out of a running stream."""
    window = F.window(time_column, width, slide) if slide else F.window(time_column, width)
    return stream.withWatermark(time_column, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time_column: str = "ts", key: str = "user_id") -> DataFrame:
    return stream.withWatermark(time_column, late).groupBy(F.session_window(time_column, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
