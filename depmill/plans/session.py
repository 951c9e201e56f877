"""One object for a project: the library's functions and the service's tools, over one graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comments, cross_language, dead_code, health, lookup, rollup, security, simulate, temporal, traverse
from ..sources import scan
from .graph import CodeGraph, add_edges


@dataclass
class Session:
    spark: SparkSession
    graph: CodeGraph | None = None
    root: str | None = None
    files: DataFrame | None = None
    errors: DataFrame | None = None
    notes: dict = field(default_factory=dict)

    def connect(self, source: str, workspace: str = ".", exclude: tuple[str, ...] = ()) -> DataFrame:
        """Reads a project, joins cross-language edges in, and tells its counts."""
        self.root = scan.connect(source, workspace)
        self.files = scan.with_content(scan.scan_files(self.spark, self.root, exclude), self.root).persist()
        rows = scan.extracted(self.files, scan.path_aliases(self.root)).persist()
        self.errors = rows.where("rec = 'error'").select("file_path", "error")
        g = scan.graph_of(rows)
        lines = scan.lines_of(self.files)
        extra = cross_language.as_edges(cross_language.rest_edges(lines), cross_language.script_edges(lines, self.files), 1 << 50)
        ends = extra.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(g.nodes.select("id"), "id", "left_anti")
        made = ends.select("id", F.lit("__file__").alias("name"), F.lit("import").alias("kind"), F.expr("left(id, length(id) - 10)").alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(False).alias("exported"), F.lit(1 << 49).alias("seq"))
        made = made.join(g.files.select("file_path"), "file_path", "left_semi")
        self.graph = add_edges(CodeGraph(g.nodes.unionByName(made, allowMissingColumns=True), g.edges), extra).persist()
        return rollup.architecture_counts(self.graph)

    @property
    def g(self) -> CodeGraph:
        if self.graph is None:
            raise RuntimeError("no project is connected")
        return self.graph

    @property
    def lines(self) -> DataFrame:
        if self.files is None:
            raise RuntimeError("no project is connected")
        return scan.lines_of(self.files)

    def status(self) -> dict:
        return {"connected": self.graph is not None, "root": self.root}

    def symbol_info(self, name: str) -> tuple[DataFrame, bool]:
        return lookup.symbol_info(self.g, name)

    def dependencies(self, symbol: str) -> DataFrame:
        return lookup.by_relation(lookup.dependencies(self.g, symbol))

    def dependents(self, symbol: str) -> DataFrame:
        return lookup.by_relation(lookup.dependents(self.g, symbol))

    def impact(self, name: str, file: str | None = None) -> DataFrame:
        found = lookup.by_file(lookup.find_symbols(self.g, name), file).limit(2).collect()
        if len(found) != 1:
            raise LookupError(f"{name} names {len(found) or 'no'} symbol{'s' if found else ''}; give an id or a file")
        return traverse.impact(self.g, found[0]["id"])

    def file_context(self, path: str) -> dict[str, DataFrame]:
        return {"symbols": lookup.file_symbols(self.g, path), "imports": lookup.file_imports(self.g, path), "imported_by": lookup.file_imported_by(self.g, path)}

    def search(self, query: str, limit: int = 20) -> DataFrame:
        return lookup.ranked_search(self.g, query, limit)

    def architecture(self) -> dict[str, DataFrame]:
        return {"counts": rollup.architecture_counts(self.g), "connected": rollup.most_connected(self.g), "directories": rollup.top_directories(self.g), "languages": rollup.language_histogram(self.g)}

    def list_files(self, prefix: str = "") -> DataFrame:
        return rollup.list_files(self.g, prefix)

    def visualisation(self, limit: int | None = None) -> dict[str, DataFrame]:
        return {"files": rollup.viz_files(self.g), "arcs": rollup.viz_limited(self.g, limit) if limit else rollup.viz_arcs(self.g)}

    def health(self) -> tuple[DataFrame, DataFrame]:
        parts = health.dimensions(self.g)
        return parts, health.overall(parts)

    def dead_code(self, confidence: str = "low", include_tests: bool = False) -> DataFrame:
        return dead_code.at_least(dead_code.dead_symbols(self.g, include_tests), confidence)

    def simulate(self, action: simulate.Action, compat: bool = False) -> simulate.Outcome:
        return simulate.simulate(self.g, action, compat)

    def security(self, target: str | None = None, kind: str | None = None) -> DataFrame:
        found = security.findings(self.lines).unionByName(security.architecture_findings(self.g))
        if target:
            found = found.where(lookup.same_file("file_path", target))
        if kind:
            found = found.where(F.col("class") == kind)
        return security.numbered(security.elevated(found, self.g))

    def history(self) -> dict[str, DataFrame]:
        commits, changes = scan.commits_of(self.spark, self.root or "."), scan.changes_of(self.spark, self.root or ".")
        return {"timeline": temporal.timeline(commits), "types": temporal.commit_types(commits), "contributors": temporal.contributors(commits), "churn": temporal.churn(changes, self.g), "ages": temporal.file_ages(changes)}

    def snapshots(self, store: str, count: int = 10, strategy: str = "even") -> DataFrame:
        """Snapshots of sampled commits, those that the store lacks read from the object store."""
        commits = scan.commits_of(self.spark, self.root or ".")
        key = {"weekly": temporal.week_key, "monthly": temporal.month_key}.get(strategy)
        picked = temporal.sample_buckets(commits, count, key(F.col("date"))) if key else temporal.sample_evenly(commits, count)
        try:
            picked = temporal.missing(picked, scan.load_snapshots(self.spark, store))
        except Exception as e:  # an empty store has no path or no schema yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        for c in picked.collect():  # a handful of sampled commits
            g = scan.graph_of(scan.extracted(scan.files_at(self.spark, self.root or ".", c["hash"])))
            scan.save_snapshot(temporal.snapshot(g, {k: c[k] for k in ("hash", "date", "message", "author")}), store)
        return temporal.snapshot_changes(scan.load_snapshots(self.spark, store))

    def documents(self) -> dict[str, str]:
        """The documents as Markdown, each made by itself: one that fails tells its error and leaves the others alone."""
        g, out = self.g, {}
        for name, make in DOCUMENTS.items():
            try:
                out[name] = "\n\n".join([f"# {name.replace('_', ' ').capitalize()}", *(f"## {k}\n\n{markdown(df)}" for k, df in make(self, g).items())])
            except Exception as e:  # noqa: BLE001
                out[name] = f"# {name}\n\nNot made: {e}"
        return out


def markdown(df: DataFrame, most: int = 50) -> str:
    """A small frame as a table."""
    rows = df.limit(most).collect()
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
    return "\n".join([head, *(f"| {' | '.join(str(v).replace('|', chr(92) + '|') for v in r)} |" for r in rows)]) if rows else "Nothing."


DOCUMENTS = {
    "architecture": lambda s, g: {"counts": rollup.architecture_counts(g), "directories": rollup.directory_stats(g), "entry points": rollup.entry_points(g), "hubs": rollup.hub_files(g), "layers": rollup.layers(g), "languages": rollup.language_histogram(g)},
    "conventions": lambda s, g: {"files": rollup.file_lengths(g), "naming": rollup.naming(g), "imports": rollup.import_style(g), "exports": rollup.export_patterns(g), "kinds": rollup.kind_distribution(g), "patterns": rollup.design_patterns(g)},
    "dependencies": lambda s, g: {"modules": rollup.module_matrix(g), "high impact": rollup.high_impact_symbols(g), "isolated": rollup.isolated_files(g), "pairs": rollup.connected_pairs(g), "chains": traverse.chains(g.fp), "cycles": traverse.cycles(g.fp)},
    "onboarding": lambda s, g: {"reading order": rollup.reading_order(g), "modules": rollup.directory_stats(g), "clusters": rollup.feature_clusters(g), "heavily used": rollup.heavily_used_files(g)},
    "files": lambda s, g: {"largest": rollup.largest_files(g), "smallest": rollup.largest_files(g, smallest=True), "mean": rollup.mean_file_size(g), "orphans": rollup.orphan_files(g), "hubs": rollup.hub_files_by_degree(g), "top directories": rollup.top_dir_breakdown(g)},
    "api_surface": lambda s, g: {"by file": rollup.exports_by_file(g), "by kind": rollup.exports_by_kind(g), "most used": rollup.most_used_exports(g), "unused": rollup.unused_exports(g), "barrels": rollup.barrel_files(g)},
    "errors": lambda s, g: {"symbols": rollup.error_symbols_top(g), "classes": rollup.error_classes(g), "risky files": rollup.error_prone_files(g), "patterns": rollup.error_patterns(g), "unguarded": rollup.unguarded_files(g)},
    "tests": lambda s, g: {"tests": rollup.test_files(g), "mapping": rollup.tested_sources(g), "untested": rollup.untested_files(g), "by directory": rollup.test_stats(g)},
    "history": lambda s, g: s.history(),
    "current": lambda s, g: {"files": rollup.file_index(g), "symbols": rollup.symbol_index(g), "matrix": rollup.connection_matrix(g)},
    "status": lambda s, g: {"markers": comments.by_type(comments.markers(s.lines)), "priorities": comments.priorities(comments.markers(s.lines), g), "completeness": comments.completeness(comments.markers(s.lines), g)},
    "health": lambda s, g: {"dimensions": s.health()[0], "overall": s.health()[1], "recommendations": health.recommendations(s.health()[0])},
    "dead_code": lambda s, g: {"report": dead_code.report(g), "symbols": dead_code.dead_symbols(g), "exclusions": dead_code.exclusion_counts(g)},
}
