"""The registered queries over the bound graph, and the SQL that they are compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comments, cross_language, dead_code, health, lookup, rollup, rules, security, simulate, temporal, traverse
from ..sources.binding import CODE_LINES, NODES, ORDER_PRELUDE, PRELUDE, SAMPLES, bound_graph, code_lines, order_graph
from ..streaming import watch
from .graph import CodeGraph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "a2_most_connected"

DIR = "CASE WHEN contains({0}, '/') THEN array_to_string(string_split({0}, '/')[1:-2], '/') ELSE '.' END"
TOP = "CASE WHEN contains({0}, '/') THEN string_split({0}, '/')[1] ELSE '.' END"
LANG = "CASE regexp_extract({0}, '\\.([^./]+)$', 1) WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' ELSE 'other' END"
#: Relations that several queries use.
SUMMARY = """
ic AS (SELECT target_file AS file_path, count(*) AS incoming FROM FP GROUP BY 1), oc AS (SELECT source_file AS file_path, count(*) AS outgoing FROM FP GROUP BY 1),
FS AS (SELECT f.file_path, f.symbols, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing FROM (SELECT file_path, count(*) AS symbols FROM N GROUP BY 1) f LEFT JOIN ic USING (file_path) LEFT JOIN oc USING (file_path)),
dg AS (SELECT file_path, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming, CAST(sum(o + i) AS BIGINT) AS connections FROM (SELECT source_file AS file_path, 1 AS o, 0 AS i FROM XF UNION ALL SELECT target_file, 0, 1 FROM XF) GROUP BY 1),
di AS (SELECT target AS id, count(*) AS dependents FROM E GROUP BY 1)
"""


def query(name: str, run: Callable[[CodeGraph], DataFrame], sql: str | None = None, orders: bool = False) -> None:
    """A query over the bound graph; with ``orders`` over the sparse one, on which closures and paths are not the whole graph."""
    graph, prelude = (order_graph, ORDER_PRELUDE) if orders else (bound_graph, PRELUDE)
    QUERIES[name] = lambda spark, sf_dir: run(graph(spark, sf_dir))
    if sql:
        more = "," if re.match(r"\s*\w+(\([^)]*\))? AS \(", sql) else ""  # further relations before the SELECT
        SQL[name] = f"WITH RECURSIVE {prelude}, {SUMMARY}{more} {sql}"


def table_query(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


# --- lookups -----------------------------------------------------------------------------------------------------------
#: Symbols that exist at every scale of the tables.
PART, NATION = "part_2", "Nation3"
ID = "(SELECT id FROM N WHERE name = '{}')"


def symbol_id(g: CodeGraph, name: str) -> str:
    row = g.nodes.where(F.col("name") == name).select("id").first()
    return row[0] if row else name


plain = ["id", "name", "kind", "file_path", "dependents"]
query("q1_find_symbols", lambda g: lookup.find_symbols(g, PART.upper()).select(*plain), f"SELECT id, name, kind, file_path, coalesce(dependents, 0) AS dependents FROM N LEFT JOIN di USING (id) WHERE lower(name) = '{PART}'")
query("q2_search_symbols", lambda g: lookup.search_symbols(g, "customer1").select(*plain), "SELECT id, name, kind, file_path, coalesce(dependents, 0) AS dependents FROM N LEFT JOIN di USING (id) WHERE contains(lower(name), 'customer1')")
query(
    "q3_ranked_search", lambda g: lookup.ranked_search(g, "Part_2").select("id", "match", "total"),
    "SELECT id, CASE WHEN lower(name) = 'part_2' THEN 0 WHEN starts_with(lower(name), 'part_2') THEN 1 ELSE 2 END AS match, count(*) OVER () AS total FROM N WHERE contains(lower(name), 'part_2') ORDER BY match, lower(name), seq LIMIT 20",
)
query("q4_symbol_info", lambda g: lookup.symbol_info(g, "supplier1")[0].select(*plain), "SELECT id, name, kind, file_path, coalesce(dependents, 0) AS dependents FROM N LEFT JOIN di USING (id) WHERE lower(name) = 'supplier1'")
query("q5_disambiguation", lambda g: lookup.disambiguation(g, PART).select("id", "hint"), f"SELECT id, row_number() OVER (ORDER BY coalesce(dependents, 0) DESC, seq) = 1 AND coalesce(dependents, 0) > 0 AS hint FROM N LEFT JOIN di USING (id) WHERE lower(name) = '{PART}'")
query("q6_dependencies", lambda g: lookup.dependencies(g, symbol_id(g, PART)).select("id", "relation", "line"), f"SELECT target AS id, kind AS relation, line FROM E WHERE source = {ID.format(PART)}")
query("q7_dependents", lambda g: lookup.dependents(g, symbol_id(g, PART)).select("id", "relation", "line"), f"SELECT source AS id, kind AS relation, line FROM E WHERE target = {ID.format(PART)}")
query(
    "q8_by_relation", lambda g: lookup.by_relation(lookup.dependents(g, symbol_id(g, "Customer1"))).select("relation", "total", F.array_join(F.array_sort(F.transform("symbols", lambda s: s["id"])), ",").alias("ids")),
    f"SELECT kind AS relation, count(*) AS total, string_agg(source, ',' ORDER BY source) AS ids FROM E WHERE target = {ID.format('Customer1')} GROUP BY 1", True,
)
FILE = "lib/supp/n{}.go"
query("q9_file_imports", lambda g: lookup.file_imports(g, _a_file(g)).select("file_path", F.array_join("names", ",").alias("names")), "SELECT target_file AS file_path, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM XF JOIN N ON id = target WHERE source_file = (SELECT min(file_path) FROM N) GROUP BY 1")
query("q9_file_imported_by", lambda g: lookup.file_imported_by(g, _a_file(g)).select("file_path", F.array_join("names", ",").alias("names")), "SELECT source_file AS file_path, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM XF JOIN N ON id = target WHERE target_file = (SELECT min(file_path) FROM N) GROUP BY 1")
query("q9_file_symbols", lambda g: lookup.file_symbols(g, _a_file(g)).select("id", "kind", "start_line"), "SELECT id, kind, start_line FROM N WHERE file_path = (SELECT min(file_path) FROM N)")
query("q10_list_files", lambda g: rollup.list_files(g, "src/cust/"), "SELECT * FROM FS WHERE starts_with(file_path, 'src/cust/')")
query("q11_cross_file_edges", lambda g: g.xf.select("source", "target", "kind", "source_file", "target_file"), "SELECT source, target, kind, source_file, target_file FROM XF")
query("q12_by_file", lambda g: lookup.by_file(g.nodes, "/n1.go").select("id"), "SELECT id FROM N WHERE file_path = '/n1.go' OR ends_with(file_path, '/n1.go')")
query(
    "q13_many_impacts", lambda g: _many_impacts(g, "nation1"),
    """q AS (SELECT id FROM N WHERE contains(lower(name), 'nation1')),
    r(root, id) AS (SELECT id, id FROM q UNION SELECT r.root, e.source FROM r JOIN E e ON e.target = r.id) SELECT root, count(*) AS reached FROM r WHERE root <> id GROUP BY 1""", True,
)
query("q14_same_file", lambda g: g.nodes.where(lookup.same_file("file_path", "./supp/n3.go")).select("id"), "SELECT id FROM N WHERE file_path = 'supp/n3.go' OR ends_with(file_path, '/supp/n3.go')")


def _a_file(g: CodeGraph) -> str:
    return g.nodes.agg(F.min("file_path")).first()[0]


def _many_impacts(g: CodeGraph, name: str) -> DataFrame:
    starts = lookup.search_symbols(g, name).select(F.col("id").alias("root"), "id")
    return traverse.closure(g.edges, starts).where("root <> id").groupBy("root").agg(F.count(F.lit(1)).alias("reached"))


# --- graph construction and joins ---------------------------------------------------------------------------------------
query("b1_build_nodes", lambda g: g.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")), "SELECT kind, count(*) AS n, min(seq) AS first FROM N GROUP BY 1")
query("b1_build_edges", lambda g: g.edges.select("source", "target", "kind", "line", "seq"), "SELECT source, target, kind, line, seq FROM E")
query("b3_remove_file", lambda g: _counts(_removed(g)), "k AS (SELECT min(file_path) AS f FROM N) SELECT (SELECT count(*) FROM N, k WHERE file_path <> f) AS nodes, (SELECT count(*) FROM EF, k WHERE source_file <> f AND target_file <> f) AS edges")
query("j1_edges_with_files", lambda g: g.pairs.select("source_file", "target_file", "kind", F.col("edges").alias("n")), "SELECT source_file, target_file, kind, count(*) AS n FROM EF GROUP BY 1, 2, 3")
query("file_graph", lambda g: g.fp.select("source_file", "target_file", "seq", "edges"), "SELECT source_file, target_file, seq, edges FROM FP")


def _removed(g: CodeGraph) -> CodeGraph:
    from .graph import remove_files

    return remove_files(g, [_a_file(g)])


def _counts(g: CodeGraph) -> DataFrame:
    return g.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("edges")))


# --- roll-ups -----------------------------------------------------------------------------------------------------------
query("a1_file_summary", rollup.file_summary, "SELECT * FROM FS")
query("a2_architecture_counts", rollup.architecture_counts, "SELECT (SELECT count(*) FROM FS) AS files, (SELECT count(*) FROM N) AS symbols, (SELECT count(*) FROM FS WHERE incoming = 0 AND outgoing = 0) AS orphans, (SELECT count(*) FROM EF) AS edges, (SELECT count(*) FROM XF) AS cross_file_edges")
query("a2_most_connected", rollup.most_connected, "SELECT *, incoming + outgoing AS connections FROM FS ORDER BY connections DESC, file_path LIMIT 5")
query("a3_top_directories", rollup.top_directories, f"SELECT {DIR.format('file_path')} AS dir, count(*) AS symbols FROM N GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
query("a4_edge_degree", lambda g: g.edge_degree, "SELECT * FROM dg")
query("a5_in_degree", lambda g: g.in_degree, "SELECT * FROM di")
query(
    "a6_file_stats", rollup.file_stats,
    f"SELECT f.file_path, {LANG.format('f.file_path')} AS language, symbols, exports, max_line, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing, coalesce(connections, 0) AS connections FROM (SELECT file_path, count(*) AS symbols, count(*) FILTER (exported) AS exports, max(end_line) AS max_line FROM N GROUP BY 1) f LEFT JOIN dg USING (file_path)",
)
query("a7_top_dir_breakdown", rollup.top_dir_breakdown, f"SELECT {TOP.format('FS.file_path')} AS top_dir, count(*) AS files, CAST(sum(symbols) AS BIGINT) AS symbols, arg_min(FS.file_path, (-coalesce(connections, 0), FS.file_path)) AS most_connected FROM FS LEFT JOIN dg USING (file_path) GROUP BY 1")
query("a8_largest_files", rollup.largest_files, "SELECT file_path, symbols FROM FS ORDER BY symbols DESC, file_path LIMIT 10")
query("a8_smallest_files", lambda g: rollup.largest_files(g, smallest=True), "SELECT file_path, symbols FROM FS ORDER BY symbols, file_path LIMIT 10")
query("a8_mean_size", rollup.mean_file_size, "SELECT count(*) AS files, CAST(floor(avg(symbols) + 0.5) AS BIGINT) AS mean_symbols FROM FS")
query("a9_orphan_files", rollup.orphan_files, "SELECT file_path FROM FS ANTI JOIN dg USING (file_path)", True)
query("a9_hub_files", rollup.hub_files_by_degree, "SELECT * FROM dg ORDER BY connections DESC, file_path LIMIT 10")
query(
    "a10_directory_stats", rollup.directory_stats,
    f"""b AS (SELECT {DIR.format('file_path')} AS dir, count(*) AS symbols, count(DISTINCT file_path) AS files, count(*) FILTER (kind IN ('interface', 'type_alias')) AS types, count(*) FILTER (kind IN ('function', 'method')) AS functions FROM N GROUP BY 1),
    p AS (SELECT {DIR.format('source_file')} AS s, {DIR.format('target_file')} AS t FROM XF), x AS (SELECT dir, CAST(sum(o) AS BIGINT) AS o, CAST(sum(i) AS BIGINT) AS i FROM (SELECT s AS dir, 1 AS o, 0 AS i FROM p WHERE s <> t UNION ALL SELECT t, 0, 1 FROM p WHERE s <> t) GROUP BY 1),
    y AS (SELECT b.*, coalesce(o, 0) AS outgoing, coalesce(i, 0) AS incoming FROM b LEFT JOIN x USING (dir) WHERE dir <> '.')
    SELECT *, CASE WHEN types / symbols > 0.7 THEN 'types' WHEN outgoing / greatest(outgoing + incoming, 1) > 0.7 THEN 'orchestration' WHEN incoming / greatest(outgoing + incoming, 1) > 0.7 THEN 'foundation' ELSE 'core' END AS role FROM y""",
)
query("a11_entry_points", rollup.entry_points, "SELECT *, CASE WHEN incoming = 0 THEN CAST('inf' AS DOUBLE) ELSE outgoing / (incoming + 1) END AS ratio FROM FS WHERE outgoing > 0 ORDER BY ratio DESC, outgoing DESC, file_path LIMIT 5")
query("a12_hubs", rollup.hub_files, "SELECT target_file AS file_path, count(*) AS dependents FROM FP GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
query("a13_layers", rollup.layers, "SELECT file_path, CASE WHEN incoming > 2 * outgoing THEN 'foundation' WHEN outgoing > 2 * incoming THEN 'orchestration' ELSE 'core' END AS layer FROM FS")
query("a14_languages", rollup.language_histogram, f"SELECT {LANG.format('file_path')} AS language, count(*) AS files, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM FS GROUP BY 1")
MODULE = "CASE WHEN len(string_split({0}, '/')) < 2 THEN NULL WHEN starts_with({0}, 'src/') THEN CASE WHEN len(string_split({0}, '/')) >= 3 THEN array_to_string(string_split({0}, '/')[1:2], '/') END ELSE array_to_string(string_split({0}, '/')[1:2], '/') END"
query(
    "a15_module_matrix", rollup.module_matrix,
    f"""m AS (SELECT {MODULE.format('source_file')} AS source_dir, {MODULE.format('target_file')} AS target_dir FROM XF), c AS (SELECT source_dir, target_dir, count(*) AS edges FROM m WHERE source_dir <> target_dir GROUP BY 1, 2),
    t AS (SELECT source_dir, sum(edges) AS total FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15) SELECT c.* FROM c SEMI JOIN t USING (source_dir)""",
)
query("a16_high_impact", rollup.high_impact_symbols, "SELECT id, name, kind, file_path, dependents, CASE WHEN dependents > 20 THEN 'high' WHEN dependents > 10 THEN 'medium' ELSE 'low' END AS impact FROM N JOIN di USING (id) ORDER BY dependents DESC, id LIMIT 15")
query("a17_isolated_files", rollup.isolated_files, "SELECT file_path, symbols FROM FS ANTI JOIN (SELECT target_file AS file_path FROM XF) x USING (file_path) ORDER BY file_path LIMIT 20", True)
query("a18_connected_pairs", rollup.connected_pairs, "SELECT least(source_file, target_file) AS file_a, greatest(source_file, target_file) AS file_b, count(*) AS edges FROM XF GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
EXPORTS = "ex AS (SELECT N.*, coalesce(dependents, 0) AS dependents FROM N LEFT JOIN di USING (id) WHERE exported)"
query("a19_exports_by_file", rollup.exports_by_file, f"{EXPORTS} SELECT file_path, count(*) AS exports, CAST(sum(dependents) AS BIGINT) AS dependents FROM ex GROUP BY 1")
query("a19_exports_by_kind", rollup.exports_by_kind, f"{EXPORTS} SELECT * FROM (SELECT kind, id, dependents, row_number() OVER (PARTITION BY kind ORDER BY dependents DESC, id) AS rank FROM ex) WHERE rank <= 20")
query("a20_most_used_exports", rollup.most_used_exports, f"{EXPORTS} SELECT id, name, kind, file_path, dependents FROM ex WHERE dependents > 0 ORDER BY dependents DESC, id LIMIT 20")
query("a20_unused_exports", rollup.unused_exports, f"{EXPORTS} SELECT file_path, count(*) AS unused, string_agg(name, ',' ORDER BY name) AS names FROM ex WHERE dependents = 0 GROUP BY 1")
query(
    "a21_barrel_files", rollup.barrel_files,
    f"{EXPORTS}, o AS (SELECT source AS id, target_file FROM XF WHERE kind = 'imports'), p AS (SELECT file_path, count(DISTINCT id) AS exports, count(DISTINCT id) FILTER (target_file IS NOT NULL) AS re_exports, count(DISTINCT target_file) AS source_files FROM ex LEFT JOIN o USING (id) GROUP BY 1) SELECT * FROM p WHERE re_exports * 2 >= exports AND re_exports > 0",
)
query("a22_file_lengths", rollup.file_lengths, "p AS (SELECT file_path, max(end_line) AS lines FROM N GROUP BY 1) SELECT count(*) AS files, CAST(floor(avg(lines) + 0.5) AS BIGINT) AS mean_lines, CAST(floor(quantile_cont(lines, 0.5) + 0.5) AS BIGINT) AS median_lines, count(*) FILTER (regexp_matches(file_path, '(^|/)index\\.[^/]*$')) AS barrels, count(*) FILTER (contains(file_path, '/test/')) AS tests FROM p")
_CAMEL, _PASCAL, _SNAKE = "(regexp_matches({0}, '^[a-z][a-zA-Z0-9]*$') AND regexp_matches({0}, '[A-Z]'))", "regexp_matches({0}, '^[A-Z][a-zA-Z0-9]*$')", "regexp_matches({0}, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$')"
query(
    "a23_naming", rollup.naming,
    f"""s AS (SELECT CASE kind WHEN 'function' THEN 'functions' WHEN 'class' THEN 'classes' ELSE 'interfaces' END AS category, CASE
      WHEN kind = 'function' THEN CASE WHEN {_CAMEL.format('name')} THEN 'camelCase' WHEN {_PASCAL.format('name')} THEN 'PascalCase' WHEN {_SNAKE.format('name')} THEN 'snake_case' ELSE 'other' END
      WHEN kind = 'class' THEN CASE WHEN {_PASCAL.format('name')} THEN 'PascalCase' ELSE 'other' END
      ELSE CASE WHEN starts_with(name, 'I') AND {_PASCAL.format('substr(name, 2)')} THEN 'IPrefixed' WHEN {_PASCAL.format('name')} THEN 'PascalCase' ELSE 'other' END END AS style FROM N
     UNION ALL SELECT 'files', CASE WHEN {_CAMEL.format('b')} THEN 'camelCase' WHEN {_PASCAL.format('b')} THEN 'PascalCase' WHEN regexp_matches(b, '^[a-z][a-z0-9]*(-[a-z0-9]+)*$') THEN 'kebab-case' WHEN {_SNAKE.format('b')} THEN 'snake_case' ELSE 'other' END FROM (SELECT regexp_extract(file_path, '([^/]*)\\.[^./]*$', 1) AS b FROM FS))
    SELECT category, style, count(*) AS n FROM s GROUP BY 1, 2""",
)
query("a24_import_style", rollup.import_style, "SELECT count(*) AS imports, count(*) FILTER (regexp_matches(target_file, '(^|/)index\\.[^/]*$')) AS barrel, count(*) FILTER (source_file = target_file) AS local FROM EF WHERE kind = 'imports'")
query("a25_export_patterns", rollup.export_patterns, "SELECT count(*) FILTER (name <> 'default') AS named, count(*) FILTER (name = 'default') AS default_exports, count(*) FILTER (kind = 'export') AS re_exports FROM N WHERE exported")
query("a26_kinds", rollup.kind_distribution, "SELECT kind, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM N GROUP BY 1")
query(
    "a27_design_patterns", rollup.design_patterns,
    """SELECT 'service' AS pattern, count(*) FILTER (kind = 'class' AND ends_with(name, 'Service')) AS n FROM N UNION ALL SELECT 'factory', count(*) FILTER (kind = 'function' AND starts_with(name, 'create')) FROM N
    UNION ALL SELECT 'hook', count(*) FILTER (kind = 'function' AND starts_with(name, 'use') AND length(name) > 3) FROM N UNION ALL SELECT 'middleware', count(*) FILTER (contains(lower(file_path), 'middleware')) FROM N
    UNION ALL SELECT 'controller', count(*) FILTER (kind IN ('class', 'function') AND ends_with(name, 'Controller')) FROM N UNION ALL SELECT 'repository', count(*) FILTER (kind IN ('class', 'function') AND ends_with(name, 'Repository')) FROM N
    UNION ALL SELECT 'handler', count(*) FILTER (kind IN ('class', 'function') AND ends_with(name, 'Handler')) FROM N""",
)
_ANY = " OR ".join(f"contains(lower(name), '{w}')" for w in rollup.ERROR_WORDS)
_HAS = lambda *w: "(" + " OR ".join(f"contains(lower(name), '{x}')" for x in w) + ")"
ERRORS = f"er AS (SELECT *, CASE WHEN {_HAS('retry', 'timeout')} THEN 'retry_timeout' WHEN {_HAS('invalid', 'validate')} THEN 'validation' WHEN {_HAS('unauthorized', 'forbidden')} THEN 'auth_error' WHEN {_HAS('notfound', 'not_found')} THEN 'not_found' ELSE 'error_handling' END AS category FROM N WHERE {_ANY})"
query("a28_error_symbols", lambda g: rollup.error_symbols(g).select("id", "category"), f"{ERRORS} SELECT id, category FROM er")
query("a28_error_symbols_top", rollup.error_symbols_top, f"{ERRORS} SELECT * FROM (SELECT category, id, kind, start_line, row_number() OVER (PARTITION BY category ORDER BY seq) AS rank FROM er) WHERE rank <= 10")
query("a29_error_classes", rollup.error_classes, f"SELECT id, file_path, coalesce(dependents, 0) AS dependents, coalesce(dependents, 0) = 0 AS unused FROM N LEFT JOIN di USING (id) WHERE kind = 'class' AND {_HAS('error', 'exception')}")
query("a30_error_prone_files", rollup.error_prone_files, f"{ERRORS}, c AS (SELECT file_path, count(*) AS errors FROM er GROUP BY 1) SELECT file_path, connections, coalesce(errors, 0) AS errors, CAST(connections * (1 + 0.5 * coalesce(errors, 0)) AS DOUBLE) AS risk FROM dg LEFT JOIN c USING (file_path) WHERE connections > 5 ORDER BY risk DESC, file_path LIMIT 15")
query(
    "a31_error_patterns", rollup.error_patterns,
    f"""SELECT 'custom_errors' AS pattern, count(*) FILTER (kind = 'class' AND {_HAS('error', 'exception')}) AS n FROM N UNION ALL SELECT 'retry', count(*) FILTER ({_HAS('retry', 'attempt')}) FROM N UNION ALL SELECT 'timeout', count(*) FILTER ({_HAS('timeout')}) FROM N
    UNION ALL SELECT 'validation', count(*) FILTER ({_HAS('validate', 'validator', 'check')}) FROM N UNION ALL SELECT 'guard', count(*) FILTER ({_HAS('guard')} OR starts_with(lower(name), 'is') OR starts_with(lower(name), 'has')) FROM N""",
)
query("a31_unguarded_files", rollup.unguarded_files, f"{ERRORS} SELECT file_path, connections FROM dg ANTI JOIN er USING (file_path) WHERE connections > 10")
query("a32_untested_files", rollup.untested_files, "SELECT file_path, coalesce(connections, 0) AS connections, CASE WHEN coalesce(connections, 0) > 10 THEN 'high' WHEN coalesce(connections, 0) > 5 THEN 'medium' ELSE 'low' END AS priority FROM FS LEFT JOIN dg USING (file_path) ORDER BY 2 DESC, 1 LIMIT 20")
query("a32_test_stats", rollup.test_stats, f"SELECT {TOP.format('file_path')} AS top_dir, count(*) FILTER (contains(file_path, '.test.')) AS tests, count(*) FILTER (NOT contains(file_path, '.test.')) AS sources FROM FS GROUP BY 1", True)
query("a41_clusters", lambda g: rollup.feature_clusters(g).select("dir", "files", "internal", "name"), f"""i AS (SELECT {DIR.format('source_file')} AS dir, count(*) AS internal FROM FP WHERE {DIR.format('source_file')} = {DIR.format('target_file')} GROUP BY 1),
    f AS (SELECT {DIR.format('file_path')} AS dir, count(*) AS files FROM FS GROUP BY 1), w AS (SELECT {DIR.format('file_path')} AS dir, lower(unnest(regexp_split_to_array(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z]+'))) AS w FROM N),
    c AS (SELECT dir, w, count(*) AS n FROM w WHERE length(w) > 3 GROUP BY 1, 2), m AS (SELECT dir, arg_min(w, (-n, w)) AS name FROM c GROUP BY 1)
    SELECT dir, files, internal, name FROM f JOIN i USING (dir) LEFT JOIN m USING (dir) WHERE files >= 2 AND internal >= 2""", True)
query("a42_reading_order", rollup.reading_order, """z AS (SELECT *, incoming + outgoing AS total FROM FS), a AS (SELECT file_path FROM z WHERE incoming > outgoing ORDER BY incoming DESC, file_path LIMIT 3),
    b AS (SELECT file_path FROM z ANTI JOIN a USING (file_path) WHERE total > 0 ORDER BY total DESC, file_path LIMIT 5), c AS (SELECT file_path FROM z ANTI JOIN a USING (file_path) ANTI JOIN b USING (file_path) WHERE outgoing > incoming ORDER BY outgoing DESC, file_path LIMIT 3)
    SELECT file_path, 'foundation' AS step FROM a UNION ALL SELECT file_path, 'core' FROM b UNION ALL SELECT file_path, 'orchestration' FROM c""")
query("a44_heavily_used_files", rollup.heavily_used_files, "SELECT file_path, incoming FROM dg WHERE incoming >= 5 ORDER BY 2 DESC, 1 LIMIT 5")
query("a45_file_index", rollup.file_index, """X AS (SELECT DISTINCT source_file, target_file FROM XF), u AS (SELECT source_file AS file_path, string_agg(target_file, ',' ORDER BY target_file) AS uses FROM X GROUP BY 1), v AS (SELECT target_file AS file_path, string_agg(source_file, ',' ORDER BY source_file) AS used_by FROM X GROUP BY 1)
    SELECT file_path, symbols, coalesce(uses, '') AS uses, coalesce(used_by, '') AS used_by FROM FS LEFT JOIN u USING (file_path) LEFT JOIN v USING (file_path)""")
query("a45_symbol_index", rollup.symbol_index, "SELECT * FROM (SELECT kind, name, file_path, start_line, row_number() OVER (PARTITION BY kind ORDER BY name, id) AS rank FROM N) WHERE rank <= 100")
query("a45_connection_matrix", rollup.connection_matrix, f"""d AS (SELECT DISTINCT {TOP.format('source_file')} AS s, {TOP.format('target_file')} AS t FROM FP), e1 AS (SELECT * FROM d WHERE s <> t), b AS (SELECT s, t FROM e1 UNION SELECT t, s FROM e1)
    SELECT b.s AS dir_a, b.t AS dir_b, CASE WHEN x.s IS NOT NULL AND y.s IS NOT NULL THEN 'both' WHEN x.s IS NOT NULL THEN 'out' ELSE 'in' END AS arrow FROM b LEFT JOIN e1 x ON x.s = b.s AND x.t = b.t LEFT JOIN e1 y ON y.s = b.t AND y.t = b.s""")
query("a46_viz_arcs", rollup.viz_arcs, "SELECT source_file, target_file, count(*) AS edges, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM XF GROUP BY 1, 2")
query("a47_pair_weights", rollup.pair_weights, "SELECT least(source_file, target_file) AS file_a, greatest(source_file, target_file) AS file_b, count(*) AS weight FROM XF GROUP BY 1, 2")
query("v1_viz_files", rollup.viz_files, f"f AS (SELECT *, {DIR.format('file_path')} AS dir, greatest(4, symbols) AS width FROM FS) SELECT *, CAST(coalesce(sum(width) OVER (ORDER BY dir, file_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x FROM f")
query(
    "v3_viz_layout", rollup.viz_layout,
    f"""f AS (SELECT file_path, {DIR.format('file_path')} AS dir, greatest(4, symbols) AS width FROM FS), p AS (SELECT file_path, coalesce(sum(width) OVER (ORDER BY dir, file_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + width / 2 AS x FROM f),
    a AS (SELECT source_file, target_file, count(*) AS edges, s.x AS source_x, t.x AS target_x FROM XF JOIN p s ON s.file_path = source_file JOIN p t ON t.file_path = target_file GROUP BY ALL)
    SELECT source_file, target_file, CAST(source_x AS DOUBLE) AS source_x, CAST(target_x AS DOUBLE) AS target_x, round(CAST(abs(target_x - source_x) AS DOUBLE) / (SELECT max(abs(target_x - source_x)) FROM a), 6) AS share, round(least(4.0, 1 + ln(edges)), 6) AS stroke FROM a""", True,
)
query("v4_viz_search", lambda g: rollup.viz_search(g, " N3/"), "SELECT source_file, target_file, count(*) AS edges, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM XF WHERE contains(lower(source_file), 'n3/') OR contains(lower(target_file), 'n3/') GROUP BY 1, 2", True)
query("v2_viz_limited", lambda g: rollup.viz_limited(g, 200), "t AS (SELECT file_path FROM FS ORDER BY incoming + outgoing DESC, file_path LIMIT 200) SELECT source_file, target_file, count(*) AS edges, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM XF WHERE source_file IN (FROM t) AND target_file IN (FROM t) GROUP BY 1, 2", True)

# --- health -------------------------------------------------------------------------------------------------------------
GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade"


def health_sql(name: str, relation: str, score: str, value: str) -> str:
    return f"{relation}, z AS (SELECT CAST({score} AS INTEGER) AS score, round(CAST({value} AS DOUBLE), 6) AS value FROM h) SELECT '{name}' AS dimension, score, CAST({health.WEIGHTS[name]} AS DOUBLE) AS weight, {GRADE}, value FROM z"


query(
    "h1_coupling", health.coupling,
    health_sql("coupling", f"h AS (SELECT (SELECT count(*) FROM XF) AS e, (SELECT count(*) FROM FS) AS f, (SELECT max(connections) FROM dg) AS top, (SELECT count(*) FROM XF WHERE {TOP.format('source_file')} <> {TOP.format('target_file')}) AS a)",
        "greatest(0, CASE WHEN e / f <= 3 THEN 100 WHEN e / f <= 6 THEN 80 WHEN e / f <= 10 THEN 60 WHEN e / f <= 15 THEN 40 ELSE 20 END - CASE WHEN top > 3 * e / f THEN 10 ELSE 0 END - CASE WHEN a / e > 0.7 THEN 10 ELSE 0 END)", "e / f"),
)
query("h2_cohesion", health.cohesion, health_sql("cohesion", f"q AS (SELECT {DIR.format('source_file')} AS d, count(*) AS n, count(*) FILTER ({DIR.format('source_file')} = {DIR.format('target_file')}) AS o FROM XF GROUP BY 1), h AS (SELECT sum(o / n) / count(*) AS m FROM q)", "CASE WHEN m >= 0.7 THEN 100 WHEN m >= 0.5 THEN 80 WHEN m >= 0.3 THEN 60 WHEN m >= 0.1 THEN 40 ELSE 20 END", "m"))
query("h4_god_files", health.god_files, health_sql("god_files", "h AS (SELECT count(*) AS n FROM dg WHERE connections > 3 * (SELECT avg(connections) FROM dg))", "CASE WHEN n = 0 THEN 100 WHEN n <= 1 THEN 80 WHEN n <= 3 THEN 60 WHEN n <= 5 THEN 40 ELSE 20 END", "n"))
query("h5_orphans", health.orphans, health_sql("orphans", "h AS (SELECT (100 * (SELECT count(*) FROM FS ANTI JOIN dg USING (file_path)) / (SELECT count(*) FROM FS) + 100 * (SELECT count(*) FROM N ANTI JOIN di USING (id)) / (SELECT count(*) FROM N)) / 2 AS s)", "CASE WHEN s = 0 THEN 100 WHEN s <= 5 THEN 80 WHEN s <= 10 THEN 60 WHEN s <= 20 THEN 40 ELSE 20 END", "s"))
#: File pairs, all simple paths, and all cycles by their least file.
PATHS = "P AS (SELECT source_file AS a, target_file AS b FROM FP), lp(a, b, path) AS (SELECT a, b, [a, b] FROM P UNION ALL SELECT lp.a, P.b, list_append(path, P.b) FROM lp JOIN P ON P.a = lp.b WHERE NOT list_contains(path, P.b))"
CYCLES = """cy(start, b, path) AS (SELECT a, b, [a, b] FROM P WHERE b > a UNION ALL SELECT start, P.b, list_append(path, P.b) FROM cy JOIN P ON P.a = cy.b WHERE P.b > start AND NOT list_contains(path, P.b)),
cyc AS (SELECT DISTINCT array_to_string(list_sort(path), ',') AS members FROM cy JOIN P ON P.a = cy.b AND P.b = cy.start)"""
BAND = "CASE WHEN {0} <= {1} THEN 100 WHEN {0} <= {2} THEN 80 WHEN {0} <= {3} THEN 60 WHEN {0} <= {4} THEN 40 ELSE 20 END"
query("h3_cycles", health.circular, health_sql("cycles", f"{PATHS}, {CYCLES}, h AS (SELECT count(*) AS n FROM cyc)", BAND.format("n", 0, 2, 5, 10), "n"), True)
query("h6_depth", health.depth, health_sql("depth", f"{PATHS}, h AS (SELECT max(len(path)) - 1 AS n FROM lp)", BAND.format("n", 4, 6, 8, 12), "n"), True)
query(
    "h7_overall", lambda g: health.overall(health.dimensions(g)),
    f"""{PATHS}, {CYCLES}, k AS (SELECT (SELECT count(*) FROM XF) AS e, (SELECT count(*) FROM FS) AS f, (SELECT max(connections) FROM dg) AS top, (SELECT count(*) FROM XF WHERE {TOP.format('source_file')} <> {TOP.format('target_file')}) AS a),
    q AS (SELECT {DIR.format('source_file')} AS d, count(*) AS n, count(*) FILTER ({DIR.format('source_file')} = {DIR.format('target_file')}) AS o FROM XF GROUP BY 1), m AS (SELECT sum(o / n) / count(*) AS m FROM q),
    parts AS (SELECT greatest(0, CASE WHEN e / f <= 3 THEN 100 WHEN e / f <= 6 THEN 80 WHEN e / f <= 10 THEN 60 WHEN e / f <= 15 THEN 40 ELSE 20 END - CASE WHEN top > 3 * e / f THEN 10 ELSE 0 END - CASE WHEN a / e > 0.7 THEN 10 ELSE 0 END) AS score, {health.WEIGHTS['coupling']} AS weight FROM k
      UNION ALL SELECT CASE WHEN m >= 0.7 THEN 100 WHEN m >= 0.5 THEN 80 WHEN m >= 0.3 THEN 60 WHEN m >= 0.1 THEN 40 ELSE 20 END, {health.WEIGHTS['cohesion']} FROM m
      UNION ALL SELECT {BAND.format('n', 0, 2, 5, 10)}, {health.WEIGHTS['cycles']} FROM (SELECT count(*) AS n FROM cyc)
      UNION ALL SELECT {BAND.format('n', 0, 1, 3, 5)}, {health.WEIGHTS['god_files']} FROM (SELECT count(*) AS n FROM dg WHERE connections > 3 * (SELECT avg(connections) FROM dg))
      UNION ALL SELECT {BAND.format('s', 0, 5, 10, 20)}, {health.WEIGHTS['orphans']} FROM (SELECT (100 * (SELECT count(*) FROM FS ANTI JOIN dg USING (file_path)) / (SELECT count(*) FROM FS) + 100 * (SELECT count(*) FROM N ANTI JOIN di USING (id)) / (SELECT count(*) FROM N)) / 2 AS s)
      UNION ALL SELECT {BAND.format('n', 4, 6, 8, 12)}, {health.WEIGHTS['depth']} FROM (SELECT max(len(path)) - 1 AS n FROM lp)),
    z AS (SELECT CAST(floor(sum(score * weight) + 0.5) AS INTEGER) AS score FROM parts)
    SELECT score, {GRADE}, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 80 THEN 'good' WHEN score >= 70 THEN 'fair' WHEN score >= 60 THEN 'poor' ELSE 'critical' END AS summary FROM z""", True,
)

# --- traversal ----------------------------------------------------------------------------------------------------------
REACH = f"r(id) AS (SELECT {ID.format(NATION)} UNION SELECT e.source FROM r JOIN E e ON e.target = r.id)"
query("t1_impact", lambda g: _impact(g).select("id", "file_path", "relation"), f"{REACH} SELECT r.id, file_path, E.kind AS relation FROM r JOIN N USING (id) LEFT JOIN E ON E.source = r.id AND E.target = {ID.format(NATION)} WHERE r.id <> {ID.format(NATION)}", True)
query("t2_affected_files", lambda g: traverse.affected_files(_impact(g)).select("file_path", "symbols"), f"{REACH} SELECT file_path, count(*) AS symbols FROM r JOIN N USING (id) WHERE r.id <> {ID.format(NATION)} GROUP BY 1", True)
query(
    "t3_reachable_entries", lambda g: traverse.reachable_entries(g, g.files.where(F.col("file_path").startswith("src/geo/"))),
    """s AS (SELECT file_path AS root, id FROM N WHERE starts_with(file_path, 'src/geo/')), r(root, id, depth) AS (SELECT root, id, 0 FROM s UNION SELECT r.root, e.source, depth + 1 FROM r JOIN E e ON e.target = r.id WHERE depth < 24),
    x AS (SELECT root, N.file_path AS entry_file, depth, CASE WHEN regexp_matches(N.file_path, '(?i)(?:mcp/|mcp-|\\.mcp\\.)') THEN 'mcp' WHEN regexp_matches(N.file_path, '(?i)(?:routes?/|api/|handler|controller|endpoint|server)') THEN 'http' WHEN regexp_matches(N.file_path, '(?i)(?:commands?/|cli/|bin/)') THEN 'cli' END AS entry_class FROM r JOIN N USING (id))
    SELECT root AS file_path, entry_file, entry_class, min(depth) AS depth FROM x WHERE entry_class IS NOT NULL GROUP BY 1, 2, 3""", True,
)
query(
    "t4_strong_components", lambda g: traverse.strong_components(g.fp),
    f"{PATHS}, r(a, b) AS (SELECT a, b FROM P UNION SELECT r.a, P.b FROM r JOIN P ON P.a = r.b) SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1", True,
)
query("t4_cycles", lambda g: traverse.cycles(g.fp).select(F.array_join(F.array_sort("members"), ",").alias("members")), f"{PATHS}, {CYCLES} SELECT members FROM cyc", True)
query(
    "t6_chains", lambda g: traverse.chains(g.fp),
    """first AS (SELECT source_file AS a FROM FP WHERE source_file NOT IN (SELECT target_file FROM FP) GROUP BY 1 ORDER BY min(seq), 1 LIMIT 10),
    ch(path, b) AS (SELECT [a], a FROM first UNION ALL SELECT list_append(path, target_file), target_file FROM ch JOIN FP ON source_file = b WHERE NOT list_contains(path, target_file))
    SELECT array_to_string(path, ' > ') AS chain, CAST(len(path) - 1 AS INTEGER) AS length FROM ch WHERE b NOT IN (SELECT source_file FROM FP) AND len(path) > 1 ORDER BY 2 DESC, 1 LIMIT 5""", True,
)
query("t7_without_auth", lambda g: traverse.without_auth(g, g.files), "SELECT DISTINCT file_path FROM N WHERE file_path NOT IN (SELECT source_file FROM EF JOIN N t ON t.id = target WHERE regexp_matches(t.name, '(?i)(?:auth|session|token|jwt|oauth|login|passport|middleware)') OR regexp_matches(t.file_path, '(?i)(?:auth|session|token|jwt|oauth|login|passport|middleware)'))")


def _impact(g: CodeGraph) -> DataFrame:
    return traverse.impact(g, symbol_id(g, NATION)).where(F.col("name") != NATION)


# --- what-if ------------------------------------------------------------------------------------------------------------
A_FILE = "(SELECT min(file_path) FROM N)"
MOVED = "CASE WHEN {0}_file = {1} THEN '{2}::' || substr({0}, instr({0}, '::') + 2) ELSE {0} END AS {0}"
_REWRITTEN = f"SELECT {MOVED.format('source', '{0}', '{1}')}, {MOVED.format('target', '{0}', '{1}')}, kind FROM EF WHERE source_file = {{0}} OR target_file = {{0}}"
AN_ORDER = "(SELECT min(file_path) FROM N WHERE starts_with(file_path, 'svc/'))"
query("w2_move_edges", lambda g: _sim(g, "move", "moved/x.go", "svc/").added_edges.select("source", "target", "kind"), _REWRITTEN.format(AN_ORDER, "moved/x.go"), True)
query("w4_rename_edges", lambda g: _sim(g, "rename", "renamed.ts", "svc/").added_edges.select("source", "target", "kind"), _REWRITTEN.format(AN_ORDER, "{2}").replace("'{2}::'", f"{DIR.format(AN_ORDER)} || '/renamed.ts::'"), True)
query("w5_split_edges", lambda g: _sim(g, "split", "split/part.ts", "svc/", True).added_edges.select("source", "target", "kind"), _REWRITTEN.format(AN_ORDER, "split/part.ts"), True)
query("w6_merge_edges", lambda g: _sim(g, "merge", "src/geo/r0.py", "svc/").added_edges.select("source", "target", "kind"), _REWRITTEN.format(AN_ORDER, "src/geo/r0.py"), True)
query(
    "w1_health_after", lambda g: health.orphans(_sim(g, "delete", None, "src/geo/n").after),
    f"""k AS (SELECT min(file_path) AS f FROM N WHERE starts_with(file_path, 'src/geo/n')), n2 AS (SELECT N.* FROM N, k WHERE file_path <> f), e2 AS (SELECT EF.* FROM EF, k WHERE source_file <> f AND target_file <> f),
    x2 AS (SELECT source_file AS file_path FROM e2 WHERE source_file <> target_file UNION SELECT target_file FROM e2 WHERE source_file <> target_file),
    {health_sql("orphans", "h AS (SELECT (100 * (SELECT count(DISTINCT file_path) FROM n2 ANTI JOIN x2 USING (file_path)) / (SELECT count(DISTINCT file_path) FROM n2) + 100 * (SELECT count(*) FROM n2 WHERE id NOT IN (SELECT target FROM e2)) / (SELECT count(*) FROM n2)) / 2 AS s)", BAND.format("s", 0, 5, 10, 20), "s")}""", True,
)
query("w9_cycles_resolved", lambda g: _ring_cut(g).cycle_changes().select("members", "change"), f"{PATHS}, {CYCLES} SELECT members, 'resolved' AS change FROM cyc WHERE list_contains(string_split(members, ','), (SELECT min(list_extract(string_split(members, ','), 1)) FROM cyc))", True)
query("w3_delete_edges", lambda g: _sim(g, "delete").removed_edges.select("source", "target", "kind"), f"SELECT source, target, kind FROM EF WHERE source_file = {A_FILE} OR target_file = {A_FILE}")
query("w7_broken_imports", lambda g: _sim(g, "delete").broken_imports.select("importer", "source", "target"), f"SELECT source_file AS importer, source, target FROM XF WHERE target_file = {A_FILE}")
query("w8_affected_nodes", lambda g: _sim(g, "delete").affected_nodes(), f"SELECT DISTINCT unnest([source, target]) AS id FROM EF WHERE source_file = {A_FILE} OR target_file = {A_FILE}")


def _sim(g: CodeGraph, kind: str, to: str | None = None, start: str = "", all_names: bool = False) -> simulate.Outcome:
    file = g.nodes.where(F.col("file_path").startswith(start)).agg(F.min("file_path")).first()[0]
    names = tuple(r[0] for r in g.nodes.where(F.col("file_path") == file).select("name").collect()) if all_names else ()  # of one file
    return simulate.simulate(g, simulate.Action(kind, file, to, names))


def _ring_cut(g: CodeGraph) -> simulate.Outcome:
    """The first file that lies on a cycle is deleted."""
    first = traverse.cycle_list(g).agg(F.min(F.element_at(F.array_sort("members"), 1))).first()[0]
    return simulate.simulate(g, simulate.Action("delete", first))


# --- dead code ----------------------------------------------------------------------------------------------------------
DEAD = """cand AS (SELECT N.* FROM N ANTI JOIN (SELECT target AS id FROM E) x USING (id)),
dead0 AS (SELECT *, CASE WHEN contains(file_path, '.test.') THEN 'test' WHEN contains(file_path, '/api/') OR starts_with(name, 'operator') THEN 'framework' END AS excluded FROM cand),
dead AS (SELECT *, CASE WHEN exported AND ends_with(file_path, '/index.ts') THEN 'medium' ELSE 'high' END AS confidence FROM dead0 WHERE excluded IS NULL)"""
query("d1_candidates", lambda g: dead_code.candidates(g).select("id", "kind"), f"{DEAD} SELECT id, kind FROM cand", True)
query("d2_exclusions", dead_code.exclusion_counts, f"{DEAD} SELECT excluded, count(*) AS n FROM dead0 WHERE excluded IS NOT NULL GROUP BY 1", True)
query("d4_confidence", lambda g: dead_code.dead_symbols(g).select("id", "confidence", "reason"), f"{DEAD} SELECT id, confidence, CASE WHEN NOT exported THEN 'not exported, no references' WHEN confidence = 'medium' THEN 'exported from a barrel file, no dependents' ELSE 'exported, no dependents' END AS reason FROM dead", True)
query("d5_report", dead_code.report, f"{DEAD} SELECT count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, CAST(0 AS BIGINT) AS low, count(*) AS dead, (SELECT count(*) FROM N) AS symbols, round(100.0 * count(*) / (SELECT count(*) FROM N), 4) AS percent FROM dead", True)

# --- history: commits are the events table --------------------------------------------------------------------------------


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").cast("string").alias("hash"), F.col("ts").cast("timestamp").alias("date"), F.col("event_type").alias("message"), F.col("user_id").cast("string").alias("author"), F.col("event_id").alias("seq"))


C = "WITH c AS (SELECT CAST(event_id AS VARCHAR) AS hash, ts AS date, event_type AS message, CAST(user_id AS VARCHAR) AS author, event_id AS seq FROM events)"
table_query("y1_sample_evenly", lambda s, d: temporal.sample_evenly(commits(s, d), 20).select("hash"), f"{C}, n AS (SELECT count(*) AS n FROM c), k AS (SELECT CAST(floor(i * (n - 1) / 19 + 0.5) AS BIGINT) AS i FROM n, range(20) t(i)) SELECT hash FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i FROM c) SEMI JOIN k USING (i)")
table_query("y2_week_buckets", lambda s, d: commits(s, d).groupBy(temporal.week_key(F.col("date")).alias("week")).agg(F.max("seq").alias("kept"), F.count(F.lit(1)).alias("n")), f"{C} SELECT concat(year(date), '-W', weekofyear(date)) AS week, max(seq) AS kept, count(*) AS n FROM c GROUP BY 1")
table_query("y2_month_buckets", lambda s, d: commits(s, d).groupBy(temporal.month_key(F.col("date")).alias("month")).agg(F.max("seq").alias("kept"), F.count(F.lit(1)).alias("n")), f"{C} SELECT strftime(date, '%Y-%m') AS month, max(seq) AS kept, count(*) AS n FROM c GROUP BY 1")
table_query("y2_sample_monthly", lambda s, d: temporal.sample_buckets(commits(s, d), 4, temporal.month_key(F.col("date"))).select("hash"), f"""{C}, b AS (SELECT strftime(date, '%Y-%m') AS m, arg_max(hash, seq) AS hash, min(seq) AS place FROM c GROUP BY 1), i AS (SELECT hash, row_number() OVER (ORDER BY place) - 1 AS i, count(*) OVER () AS n FROM b),
    step AS (SELECT DISTINCT n, (n - 2) // 2 AS step FROM i), picked AS (SELECT hash FROM i JOIN step USING (n) WHERE n <= 4 OR i IN (least(step, n - 2), least(2 * step, n - 2)))
    SELECT hash FROM picked UNION SELECT hash FROM c WHERE (SELECT max(n) FROM i) > 4 AND seq IN ((SELECT min(seq) FROM c), (SELECT max(seq) FROM c))""")
table_query("a36_timeline", lambda s, d: temporal.timeline(commits(s, d)), f"{C}, t AS (SELECT min(date) AS a, max(date) AS b, count(*) AS n FROM c), u AS (SELECT *, CAST(floor((epoch_us(b) // 1000000 - epoch_us(a) // 1000000) / 86400) AS BIGINT) AS days FROM t) SELECT strftime(a, '%Y-%m-%d') AS first, strftime(b, '%Y-%m-%d') AS last, n AS commits, days, days // 30 AS months, round(CASE WHEN days // 30 > 0 THEN n / (days // 30) ELSE n END, 1) AS per_month FROM u")
table_query("a38_commit_types", lambda s, d: temporal.commit_types(commits(s, d)), f"{C}, t AS (SELECT CASE WHEN regexp_matches(lower(message), 'feat|add|new|implement|create') THEN 'features' WHEN regexp_matches(lower(message), 'fix|bug|patch|resolve') THEN 'fixes' WHEN regexp_matches(lower(message), 'refactor|cleanup|restructure|improve') THEN 'refactors' ELSE 'other' END AS type FROM c) SELECT type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM t GROUP BY 1")
table_query("a40_contributors", lambda s, d: temporal.contributors(commits(s, d)), f"{C} SELECT author, count(*) AS commits, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, file_path, date): each order changes its customer's file."""
    o, c = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer"))
    path = F.concat(F.lit("src/cust/n"), F.col("c_nationkey").cast("string"), F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(".ts"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").cast("string").alias("hash"), path.alias("file_path"), F.col("o_orderdate").alias("date"))


_H = "h AS (SELECT CAST(o_orderkey AS VARCHAR) AS hash, concat('src/cust/n', CAST(c_nationkey AS VARCHAR), '/c', CAST(c_custkey AS VARCHAR), '.ts') AS file_path, o_orderdate AS date FROM orders JOIN customer ON o_custkey = c_custkey)"
CH = f"WITH {_H}"
table_query(
    "a37_churn", lambda s, d: temporal.churn(changes(s, d), order_graph(s, d), 400),
    f"WITH {ORDER_PRELUDE}, {SUMMARY}, {_H} SELECT file_path, changes, coalesce(connections, 0) AS connections, CASE WHEN changes > 20 AND coalesce(connections, 0) > 10 THEN 'high' WHEN changes > 10 OR coalesce(connections, 0) > 10 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT file_path, count(*) AS changes FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 400) LEFT JOIN dg USING (file_path)",
)
table_query("h8_trend", lambda s, d: health.trend(changes(s, d).groupBy(F.date_format("date", "yyyy-MM").alias("timestamp")).agg((F.count(F.lit(1)) % 100).cast("int").alias("score"))).withColumn("delta", F.col("delta").cast("double")), f"{CH}, m AS (SELECT strftime(date, '%Y-%m') AS timestamp, CAST(count(*) % 100 AS INTEGER) AS score FROM h GROUP BY 1) SELECT *, CAST(score - lag(score) OVER (ORDER BY timestamp) AS DOUBLE) AS delta FROM m")
table_query("a39_file_ages", lambda s, d: temporal.file_ages(changes(s, d)).select("file_path", F.date_format("added", "yyyy-MM-dd").alias("added"), "end"), f"{CH}, f AS (SELECT file_path, min(date) AS added FROM h GROUP BY 1) SELECT file_path, strftime(added, '%Y-%m-%d') AS added, 'oldest' AS \"end\" FROM (FROM f ORDER BY added, file_path LIMIT 5) UNION ALL SELECT file_path, strftime(added, '%Y-%m-%d'), 'newest' FROM (FROM f ORDER BY added DESC, file_path LIMIT 5)")


# --- lines of text: the pages' HTML and the documents as files -------------------------------------------------------------


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(F.concat(F.lit("site/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"), F.posexplode(F.split("html", "\n")).alias("p", "line")).select("file_path", (F.col("p") + 1).alias("line_no"), "line")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.concat(F.lit("doc/d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"), F.posexplode(F.split("text", "\n")).alias("p", "line")).select("file_path", (F.col("p") + 1).alias("line_no"), "line")


L = "WITH l AS (SELECT concat('{0}', CAST({1} AS VARCHAR), '{2}') AS file_path, unnest(string_split({3}, chr(10))) AS line, unnest(range(1, len(string_split({3}, chr(10))) + 1)) AS line_no FROM {4})"
PAGE_L, DOC_L = L.format("site/p", "page_id", ".html", "html", "pages"), L.format("doc/d", "doc_id", ".py", "text", "documents")
table_query("l_page_lines", lambda s, d: page_lines(s, d).groupBy("file_path").agg(F.count(F.lit(1)).alias("lines")), f"{PAGE_L} SELECT file_path, count(*) AS lines FROM l GROUP BY 1")
table_query(
    "v12_secrets", lambda s, d: security.findings(document_lines(s, d), tuple(r for r in security.RULES if r.check == "secrets")).select("rule", "severity", "file_path", F.col("line").cast("long").alias("line")),
    DOC_L + """, r AS (SELECT * FROM (VALUES ('secrets/literal-credential', 'high', '(?i)\\b(api_?key|secret|password|passwd|token)\\b\\s*[:=]\\s*[''"][^''"\\s]{8,}[''"]'), ('secrets/private-key', 'critical', '-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----'), ('secrets/access-key', 'critical', '\\bAKIA[0-9A-Z]{16}\\b')) t(rule, severity, p))
    SELECT rule, severity, file_path, CAST(line_no AS BIGINT) AS line FROM l JOIN r ON regexp_matches(line, p) WHERE NOT regexp_matches(ltrim(line), '^(//|#|\\*)')""",
)

# --- lines of code: the line checks, comment markers, and edges between languages ---------------------------------------------
_Q = lambda x: "'" + x.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    """The pattern without look-ahead, which the comparison's engine lacks; alike on the sample lines."""
    return _Q("(?-s)" + pattern.replace('(?!")', "").replace(r"(?!(?:localhost|127\.))", "[^l1]"))


def rule_sql(r: rules.Rule) -> str:
    has = lambda of, p: f"regexp_matches({of}, {_re2(p)})"
    tests = [has("line", r.pattern), *(has("line", p) for p in r.also), *(f"NOT {has('line', p)}" for p in r.never), *([has("file_path", r.files)] if r.files else [])]
    tests += [f"NOT contains(file_path, {_Q(x)})" for x in rules.SKIPPED_DIRS] + [f"NOT starts_with(ltrim(line), {_Q(x)})" for x in rules.COMMENTS.get(r.check, rules.OTHER_COMMENTS)]
    if r.check == "injection":
        tests += [f"NOT contains(lower(file_path), {_Q(x)})" for x in rules.TEST_WORDS] + [f"NOT contains(line, {_Q(rules.REVIEWED)})"]
    if r.check == "path-traversal":
        tests += [f"NOT (contains(line, '__dirname') AND {has('line', rules.SAFE_ARGUMENTS)})", f"NOT (contains(line, 'writeFileSync') AND {has('line', rules.FIXED_OUTPUT)})"]
    for f in r.frames:
        around = f"(SELECT string_agg(m.line, chr(10) ORDER BY m.line_no) FROM code_lines m WHERE m.file_path = l.file_path AND m.line_no BETWEEN l.line_no - {f.before} AND l.line_no + {f.after})"
        found = " AND ".join(has(around, p) for p in f.patterns)
        tests.append(f"({found})" if f.needed else f"NOT ({found})")
    raised = {"input": has("line", rules.INJECTION_INPUT), "route": has("file_path", rules.ROUTE_FILES), "crypto": has("file_path", rules.CRYPTO_FILES)}
    severity = f"CASE WHEN {raised[r.worse]} THEN 'high' ELSE 'medium' END" if r.worse and r.severity == "medium" else _Q(r.severity)
    return f"SELECT {_Q(r.kind)} AS class, {severity} AS severity, {_Q(r.title)} AS title, file_path, line_no AS line FROM code_lines l WHERE {' AND '.join(tests)}"


for _name, _check in (("v1_injection", "injection"), ("v2_path_traversal", "path-traversal"), ("v3_auth", "auth"), ("v4_input_validation", "input"), ("v5_disclosure", "disclosure"), ("v6_cryptography", "crypto"), ("v7_frontend", "frontend")):
    _own = tuple(r for r in rules.RULES if r.check == _check)
    table_query(_name, lambda s, d, own=_own: security.findings(code_lines(s, d), own).select("class", "severity", "title", "file_path", "line"), f"WITH {CODE_LINES} " + " UNION ALL ".join(map(rule_sql, _own)))
_FOUND = f"WITH {CODE_LINES}, f AS ({' UNION ALL '.join(rule_sql(r) for r in rules.RULES if r.check != 'secrets')})"
_lines_found = lambda s, d: security.findings(code_lines(s, d), tuple(r for r in rules.RULES if r.check != "secrets"))
table_query("a48_security_summary", lambda s, d: security.summary(_lines_found(s, d)).select("critical", "high", "medium", "low", "info", "total"), f"{_FOUND} SELECT " + ", ".join(f"count(*) FILTER (severity = '{k}') AS {k}" for k in security.RANK) + ", count(*) AS total FROM f")
table_query("v0_numbered", lambda s, d: security.numbered(_lines_found(s, d)).groupBy("severity").agg(F.min(F.substring("id", 5, 9).cast("int")).alias("first"), F.max(F.substring("id", 5, 9).cast("int")).alias("last")), f"{_FOUND}, n AS (SELECT severity, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS i FROM f) SELECT severity, CAST(min(i) AS INTEGER) AS first, CAST(max(i) AS INTEGER) AS last FROM n GROUP BY 1")
table_query("v11_gate", lambda s, d: s.createDataFrame([(k, security.gate(_lines_found(s, d), k)) for k in ("critical", "high")], "threshold string, fails boolean"), f"{_FOUND} SELECT 'critical' AS threshold, count(*) FILTER (severity = 'critical') > 0 AS fails FROM f UNION ALL SELECT 'high', count(*) FILTER (severity IN ('critical', 'high')) > 0 FROM f")


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, line_no, line): a line for each part, in the part's file of the bound graph."""
    file = NODES["part"][0].replace("as varchar(20)", "as string")
    pick = F.element_at(F.array(*map(F.lit, SAMPLES)), (F.col("p_partkey") * 7 % len(SAMPLES) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.expr(file).alias("file_path"), F.col("p_partkey").alias("line_no"), pick.alias("line"))


_PICK = f"[{', '.join(map(_Q, SAMPLES))}][p_partkey * 7 % {len(SAMPLES)} + 1]"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(line, '(?i)(?://|#|/\\*)\\s*{t}:?\\s*(.+)') THEN '{t}'" for t in comments.TYPES) + " END"
MARKERS = f"pl AS (SELECT {NODES['part'][0]} AS file_path, p_partkey AS line_no, {_PICK} AS line FROM part), mk AS (SELECT file_path, line_no, {_KIND} AS type FROM pl WHERE {_KIND} IS NOT NULL)"
table_query("a33_markers", lambda s, d: comments.markers(part_lines(s, d)).select("file_path", "line_no", "type"), f"WITH {MARKERS} SELECT file_path, line_no, type FROM mk")
table_query("a33_by_type", lambda s, d: comments.by_type(comments.markers(part_lines(s, d))), f"WITH {MARKERS} SELECT type, count(*) AS n, count(DISTINCT file_path) AS files FROM mk GROUP BY 1")
table_query(
    "a34_priorities", lambda s, d: comments.priorities(comments.markers(part_lines(s, d)), bound_graph(s, d)).select("file_path", "line_no", "type", "connections", "priority"),
    f"""WITH {PRELUDE}, {SUMMARY}, {MARKERS}, k AS (SELECT mk.*, coalesce(connections, 0) AS connections FROM mk LEFT JOIN dg USING (file_path) WHERE type IN ('TODO', 'FIXME', 'HACK')),
    z AS (SELECT *, CASE type WHEN 'FIXME' THEN CASE WHEN connections > 10 THEN 4 WHEN connections > 5 THEN 3 ELSE 2 END WHEN 'TODO' THEN CASE WHEN connections > 10 THEN 3 WHEN connections > 5 THEN 2 ELSE 1 END ELSE CASE WHEN connections > 10 THEN 3 ELSE 2 END END AS score FROM k)
    SELECT file_path, line_no, type, connections, ['low', 'medium', 'high', 'critical'][score] AS priority FROM z ORDER BY score DESC, connections DESC, file_path, line_no LIMIT 20""",
)
table_query(
    "a35_completeness", lambda s, d: comments.completeness(comments.markers(part_lines(s, d)), bound_graph(s, d)),
    f"""WITH {PRELUDE}, {MARKERS}, o AS (SELECT file_path, count(*) AS open FROM mk WHERE type IN ('TODO', 'FIXME') GROUP BY 1), f AS (SELECT file_path, count(*) AS symbols FROM N GROUP BY 1),
    b AS (SELECT {DIR.format('file_path')} AS dir, coalesce(open, 0) / symbols > 0.1 AS busy FROM f LEFT JOIN o USING (file_path))
    SELECT dir, count(*) AS files, count(*) FILTER (busy) AS in_progress, round(100.0 * (count(*) - count(*) FILTER (busy)) / count(*), 2) AS percent FROM b GROUP BY 1""",
)

_JS, _PY, _GO = "regexp_matches(file_path, '\\.(ts|tsx|js)$')", "ends_with(file_path, '.py')", "ends_with(file_path, '.go')"
CALLS = f"""calls AS (SELECT file_path, line_no, 'GET' AS method, regexp_replace(regexp_extract(line, 'fetch\\s*\\(\\s*''([^'']+)''', 1), '^https?://[^/]+', '') AS path FROM code_lines WHERE {_JS} AND regexp_matches(line, 'fetch\\s*\\(\\s*''')
  UNION SELECT file_path, line_no, upper(regexp_extract(line, 'axios\\.(\\w+)', 1)), regexp_extract(line, '''([^'']+)''', 1) FROM code_lines WHERE {_JS} AND regexp_matches(line, 'axios\\.(get|post)\\('))"""
_FIRST = "regexp_extract(line, '[''\"]([^''\"]+)[''\"]', 1)"
ROUTES = f"""routes AS (SELECT file_path, line_no, upper(regexp_extract(line, '\\.(get|post)\\(', 1)) AS method, {_FIRST} AS path FROM code_lines WHERE ({_JS} AND regexp_matches(line, '\\b(app|router)\\.(get|post)\\(')) OR ({_PY} AND regexp_matches(line, '@app\\.get\\('))
  UNION ALL SELECT file_path, line_no, unnest(['GET', 'POST']), {_FIRST} FROM code_lines WHERE {_PY} AND contains(line, '@app.route(')
  UNION ALL SELECT file_path, line_no, 'GET', {_FIRST} FROM code_lines WHERE {_GO} AND contains(line, 'r.GET('))"""
table_query("r1_http_calls", lambda s, d: cross_language.http_calls(code_lines(s, d)).select("file_path", "line_no", "method", "path"), f"WITH {CODE_LINES}, {CALLS} SELECT file_path, line_no, method, path FROM calls")
table_query("r3_routes", lambda s, d: cross_language.routes(code_lines(s, d)).select("file_path", "line_no", "method", "path"), f"WITH {CODE_LINES}, {ROUTES} SELECT file_path, line_no, method, path FROM routes")
_MARK = "regexp_replace(regexp_replace({0}, ':[a-zA-Z_]\\w*', '*', 'g'), '\\{{[a-zA-Z_]\\w*\\}}', '*', 'g')"
table_query(
    "r5_rest_edges", lambda s, d: cross_language.rest_edges(code_lines(s, d)).select("source_file", "line", "call_method", "call_path", "target_file", "target_line", "route_method", "route_path", "confidence"),
    f"""WITH {CODE_LINES}, {CALLS}, {ROUTES}, c AS (SELECT *, {_MARK.format('path')} AS p, string_split(substr({_MARK.format('path')}, 2), '/') AS cs FROM calls), r AS (SELECT *, {_MARK.format('path')} AS p, string_split(substr({_MARK.format('path')}, 2), '/') AS rs FROM routes),
    m AS (SELECT DISTINCT c.file_path AS source_file, c.line_no AS line, c.method AS call_method, c.path AS call_path, r.file_path AS target_file, r.line_no AS target_line, r.method AS route_method, r.path AS route_path, c.p = r.p AS same FROM c JOIN r ON c.file_path <> r.file_path AND rs[1] IN (cs[1], '*') AND len(cs) <= len(rs)
      WHERE list_bool_and(list_transform(range(1, len(cs) + 1), lambda i: rs[i] = '*' OR cs[i] = rs[i] OR cs[i] = '*')))
    SELECT source_file, line, call_method, call_path, target_file, target_line, route_method, route_path, CASE WHEN same AND call_method = route_method THEN 'high' WHEN same OR call_method = route_method THEN 'medium' ELSE 'low' END AS confidence FROM m""",
)
table_query(
    "sp_script_edges", lambda s, d: cross_language.script_edges(code_lines(s, d), code_lines(s, d)).select("source_file", "line", "target_file", "script", "confidence"),
    f"""WITH {CODE_LINES}, c AS (SELECT file_path AS source_file, line_no AS line, CASE WHEN {_PY} THEN 'tools/job.py' ELSE 'job.py' END AS script FROM code_lines WHERE ({_PY} AND (contains(line, 'os.system(''python tools/job.py') OR contains(line, 'subprocess.run([''python'', ''tools/job.py'''))) OR ({_JS} AND contains(line, 'spawn(''python'', [''job.py''')))
    SELECT source_file, line, 'tools/job.py' AS target_file, script, 'high' AS confidence FROM c WHERE source_file <> 'tools/job.py'""",
)

# --- windows over the events --------------------------------------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")).drop("end")


table_query("z_tumbling_activity", lambda s, d: shown(watch.activity(events(s, d))), "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
table_query("z_sliding_activity", lambda s, d: shown(watch.activity(events(s, d), "2 hours", "1 hour")), "SELECT strftime(time_bucket(INTERVAL '1 hour', ts) - k * INTERVAL '1 hour', '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events, range(2) t(k) GROUP BY 1, 2")
table_query(
    "z_sessions", lambda s, d: shown(watch.sessions(events(s, d))),
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k",
)
