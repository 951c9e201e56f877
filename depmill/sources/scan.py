"""Sources and sinks: source trees, git history, graphs as JSON or Parquet, snapshots, audits, SARIF."""

from __future__ import annotations

import fnmatch
import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import LANGUAGES
from ..plans.graph import CodeGraph, build_graph
from .aliases import Aliases, path_aliases
from .extract import ROW, extract, frame

#: What a scan leaves out, and the build files that it takes.
SKIPPED = ("node_modules", "vendor", "dist", "build")
BUILD_FILES = ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "CMakeLists.txt", "conanfile.txt", "vcpkg.json")
MARKERS = ("package.json", "tsconfig.json", "pyproject.toml", "setup.py", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts", "CMakeLists.txt", "composer.json", "Makefile", "requirements.txt", ".git")
MOST_BYTES = 1_000_000
#: Places of a file's rows in extraction order.
STRIDE = 1_000_000
FILES = "file_path string, language string, size long, place long"


def language_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    if name in BUILD_FILES or name.endswith(".csproj"):
        return "build"
    if name.endswith((".d.ts", "_test.go")):
        return None
    return LANGUAGES.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def list_files(root: str, exclude: tuple[str, ...] = ()) -> Iterator[tuple[str, str, int]]:
    """(path, language, size) in the order of paths; links, dot entries and skipped folders stay out."""
    top = Path(root).resolve()
    for folder, names, files in os.walk(top):
        names[:] = sorted(n for n in names if not n.startswith(".") and n not in SKIPPED and not os.path.islink(f"{folder}/{n}"))
        for n in sorted(files):
            full = Path(folder, n)
            path = full.relative_to(top).as_posix()
            lang = language_of(path)
            if lang and not n.startswith(".") and not full.is_symlink() and not any(fnmatch.fnmatch(n, g) or fnmatch.fnmatch(path, g) for g in exclude):
                yield path, lang, full.stat().st_size


def project_root(start: str, levels: int = 10) -> str:
    """The nearest folder above that looks like a project's."""
    here = Path(start).resolve()
    for folder in [here, *here.parents][: levels + 1]:
        if any((folder / m).exists() for m in MARKERS):
            return str(folder)
    return str(here)


def scan_files(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    rows = [(*x, i) for i, x in enumerate(sorted(list_files(root, exclude)))]
    return spark.createDataFrame(rows, FILES).where(F.col("size") <= MOST_BYTES)


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Reads the files on the executors; the root is a folder that all of them see."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(content=[Path(root, p).read_text(errors="replace") for p in f["file_path"]])

    return files.mapInPandas(read, FILES + ", content string")


def extracted(files: DataFrame, aliases: Aliases = ()) -> DataFrame:
    """Rows of symbols, references and errors of (file_path, language, place, content); aliases: of import paths."""
    spark = files.sparkSession
    paths = frozenset(r[0] for r in files.select("file_path").toLocalIterator())  # the names of one project's files
    held = spark.sparkContext.broadcast(paths | {p.rsplit("/", 1)[0] + "/" for p in paths if "/" in p})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held.value.__contains__
        for f in frames:
            rows = [r for p, lang, place, text in zip(f["file_path"], f["language"], f["place"], f["content"], strict=True) for r in extract(p, text, _header(p, lang, text), known, int(place) * STRIDE, aliases)]
            if rows:
                yield frame(rows)

    return files.select("file_path", "language", "place", "content").mapInPandas(run, ROW)


def _header(path: str, language: str, text: str) -> str:
    """A .h file is C++ if it speaks it."""
    import re

    return "cpp" if path.endswith(".h") and re.search(r"\b(class|namespace|template|public:|private:|virtual|constexpr|nullptr)\b", text) else language


def parse_project(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    return extracted(with_content(scan_files(spark, root, exclude), root), path_aliases(root))


def graph_of(rows: DataFrame) -> CodeGraph:
    symbols = rows.where("rec = 'sym'").select("id", "name", "kind", "file_path", "start_line", "end_line", "exported", "scope", "seq")
    refs = rows.where("rec = 'ref'").select("source", "target", "kind", "file_path", "line", "seq")
    return build_graph(symbols, package_imports(refs, rows.select("file_path").distinct()))


def package_imports(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References as they are, but for an import of a Go package: it is one of each of the package's files."""
    package = F.col("target").rlike(r"/::__file__$")
    into = refs.where(package).withColumn("folder", F.regexp_extract("target", r"^(.*)/::", 1))
    members = files.select(F.col("file_path").alias("member"), F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("folder"))
    spread = into.join(members.where(F.col("member").endswith(".go")), "folder").withColumn("target", F.concat("member", F.lit("::__file__"))).select(*refs.columns)
    return refs.where(~package).unionByName(spread)


def lines_of(files: DataFrame) -> DataFrame:
    """(file_path, line_no, line) of files with content."""
    return files.select("file_path", F.posexplode(F.split("content", "\n")).alias("p", "line")).select("file_path", (F.col("p") + 1).alias("line_no"), "line")


def commits_of(spark: SparkSession, repo: str, limit: int | None = None) -> DataFrame:
    """The git log (its newest ``limit`` commits, if given), newest first, its fields apart whatever the subject holds."""
    out = subprocess.run(["git", "-C", repo, "log", *([f"-n{limit}"] if limit else []), "--format=%H%x1f%aI%x1f%s%x1f%an"], capture_output=True, text=True, check=True, timeout=60).stdout
    rows = [(*x.split("\x1f"), i) for i, x in enumerate(out.splitlines()) if x.count("\x1f") == 3]
    df = spark.createDataFrame(rows, "hash string, iso string, message string, author string, seq long")
    return df.select("hash", F.to_timestamp("iso").alias("date"), "message", "author", "seq")


def changes_of(spark: SparkSession, repo: str) -> DataFrame:
    """(hash, date, file_path) of all commits."""
    out = subprocess.run(["git", "-C", repo, "log", "--no-merges", "--name-only", "--format=%x1e%H%x1f%aI"], capture_output=True, text=True, check=True, timeout=60).stdout
    rows = [(h, d, p) for block in out.split("\x1e")[1:] for head, *paths in [block.strip().split("\n")] for h, d in [head.split("\x1f")] for p in paths if p]
    return spark.createDataFrame(rows, "hash string, iso string, file_path string").select("hash", F.to_timestamp("iso").alias("date"), "file_path")


def files_at(spark: SparkSession, repo: str, commit: str) -> DataFrame:
    """The files of a commit with content, read from the object store; the working tree stays as it is."""
    listed = subprocess.run(["git", "-C", repo, "ls-tree", "-r", "-l", "--full-tree", commit], capture_output=True, text=True, check=True, timeout=60).stdout
    rows = []
    for x in listed.splitlines():
        meta, path = x.split("\t", 1)
        size = meta.split()[3]
        lang = language_of(path)
        if lang and size.isdigit() and not any(p.startswith(".") or p in SKIPPED for p in path.split("/")):
            rows.append((path, lang, int(size)))
    files = spark.createDataFrame([(*r, i) for i, r in enumerate(sorted(rows))], FILES).where(F.col("size") <= MOST_BYTES)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            show = lambda p: subprocess.run(["git", "-C", repo, "show", f"{commit}:{p}"], capture_output=True, check=True).stdout.decode(errors="replace")
            yield f.assign(content=[show(p) for p in f["file_path"]])

    return files.mapInPandas(read, FILES + ", content string")


def connect(source: str, into: str) -> str:
    """A local folder for a local path or a remote repository (a shallow clone)."""
    if os.path.isdir(source):
        return project_root(source)
    target = os.path.join(into, source.rstrip("/").rsplit("/", 1)[-1].removesuffix(".git"))
    if os.path.isdir(target):
        subprocess.run(["git", "-C", target, "pull", "--ff-only"], check=True, timeout=300)
    else:
        subprocess.run(["git", "clone", "--depth", "1", "--", source, target], check=True, timeout=300)
    return target


NODE = "id string, name string, kind string, filePath string, startLine int, endLine int, exported boolean, scope string"
EDGE = "source string, target string, kind string, filePath string, line int"
PROJECT = f"root string, files array<string>, nodes array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<{EDGE.replace(' ', ':').replace(',:', ',')}>>"


def export_json(g: CodeGraph, root: str) -> DataFrame:
    """One JSON document: files sorted, nodes and edges in extraction order."""
    n = g.nodes.agg(F.array_sort(F.collect_set("file_path")).alias("files"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "id", "name", "kind", F.col("file_path").alias("filePath"), F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), "exported"))), lambda x: x.dropFields("seq")).alias("nodes"))
    e = g.edges.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "source", "target", "kind", F.col("file_path").alias("filePath"), "line"))), lambda x: x.dropFields("seq")).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct(F.lit(root).alias("root"), "files", "nodes", "edges")).alias("value"))  # one row each


def import_json(spark: SparkSession, path: str) -> CodeGraph:
    doc = spark.read.schema(PROJECT).option("multiLine", True).json(path)
    nodes = doc.select(F.posexplode("nodes").alias("seq", "n")).select("n.id", "n.name", "n.kind", F.col("n.filePath").alias("file_path"), F.col("n.startLine").alias("start_line"), F.col("n.endLine").alias("end_line"), "n.exported", "n.scope", F.col("seq").cast("long").alias("seq"))
    edges = doc.select(F.posexplode("edges").alias("seq", "e")).select("e.source", "e.target", "e.kind", F.col("e.filePath").alias("file_path"), "e.line", F.col("seq").cast("long").alias("seq"))
    return build_graph(nodes, edges)


def save_graph(g: CodeGraph, path: str) -> None:
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> CodeGraph:
    return CodeGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def save_snapshot(snapshot: DataFrame, path: str) -> None:
    snapshot.withColumn("commit", F.substring("hash", 1, 8)).write.mode("append").partitionBy("commit").parquet(path)


def load_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("date")


def loose_ranges(manifest: DataFrame) -> DataFrame:
    """(file_path, content) of package.json files to dependencies with ^ or ~ ranges."""
    m = manifest.select("file_path", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("m"))
    deps = m.select("file_path", F.explode(F.map_concat(F.coalesce("m.dependencies", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.coalesce("m.devDependencies", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))).alias("package", "range"))
    return deps.where(F.col("range").startswith("^") | F.col("range").startswith("~"))


def install_scripts(manifests: DataFrame) -> DataFrame:
    m = manifests.select("file_path", F.from_json("content", "name string, scripts map<string,string>").alias("m"))
    script = F.coalesce(F.col("m.scripts")["postinstall"], F.col("m.scripts")["preinstall"], F.col("m.scripts")["install"])
    return m.select("file_path", F.col("m.name").alias("package"), script.alias("script")).where("script is not null")


def audit_findings(audits: DataFrame) -> DataFrame:
    """Audit reports as JSON ({name: {severity, title}} under vulnerabilities) to one row for each package."""
    a = audits.select(F.from_json("value", "vulnerabilities map<string, struct<severity:string, title:string>>").alias("a"))
    return a.select(F.explode("a.vulnerabilities").alias("package", "v")).select("package", "v.severity", "v.title")


def sarif(findings: DataFrame) -> DataFrame:
    """SARIF 2.1.0 of findings (rule, severity, file_path, line, title): one JSON document."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    rules = findings.groupBy(F.col("rule").alias("id")).agg(F.min("title").alias("t")).agg(F.array_sort(F.collect_list(F.struct("id", F.struct(F.col("t").alias("text")).alias("shortDescription")))).alias("rules"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    results = findings.agg(F.collect_list(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit("depmill").alias("name"), "rules").alias("driver")).alias("tool"), "results")
    return rules.crossJoin(results).select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("value"))  # one row each
