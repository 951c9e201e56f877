"""Steps that must not grow faster than their input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from depmill.operators import cross_language, security, simulate, traverse
from depmill.sources import binding

TABLES = {
    "customer": "SELECT id AS c_custkey, CAST(id % 2 AS int) AS c_nationkey, concat('S', id % 3) AS c_mktsegment FROM range(1, 2001)",
    "supplier": "SELECT id AS s_suppkey, CAST(id % 2 AS int) AS s_nationkey FROM range(1, 61)",
    "part": "SELECT id AS p_partkey, concat('Brand#', id % 2) AS p_brand, CAST(id % 3 AS int) AS p_size FROM range(1, 31)",
    "orders": "SELECT id AS o_orderkey, id * 7 % 50 + 1 AS o_custkey FROM range(1, 301)",
    "lineitem": "SELECT id DIV 3 + 1 AS l_orderkey, id * 11 % 30 + 1 AS l_partkey, id * 5 % 20 + 1 AS l_suppkey, CAST(id % 3 + 1 AS int) AS l_linenumber FROM range(900)",
}


@pytest.fixture(scope="module")
def bound(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    for name, sql in TABLES.items():
        spark.sql(sql).write.parquet(f"{folder}/{name}.parquet")
    return binding.bound_graph(spark, folder)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_counts_by_keys_are_those_of_the_edges(bound):
    cols = ["source_file", "target_file", "kind", "edges", "seq"]
    n = F.count(F.lit(1))
    assert rows(bound.pairs, *cols) == rows(bound.ef.groupBy("source_file", "target_file", "kind").agg(n.alias("edges"), F.min("seq").alias("seq")), *cols)
    assert rows(bound.in_degree, "id", "dependents") == rows(bound.edges.groupBy(F.col("target").alias("id")).agg(n.alias("dependents")), "id", "dependents")
    assert bound.edges.count() == bound.edges.select("source", "target").distinct().count()


def test_no_query_over_files_makes_or_keeps_the_edges(bound):
    assert not bound.edges.storageLevel.useDisk
    # what suppliers reference is a product of 60 and 40, counted from its factors: no step has as many rows
    plan = bound.neighbours._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "Join" not in plan
    assert bound.pairs.where("kind = 'references'").agg(F.sum("edges")).first()[0] == 2 * 30 * 20


def test_frames_meet_blocks_of_lines_and_not_whole_files(spark):
    n = 3_000
    lines = spark.sql(f"SELECT 'src/routes/users.js' AS file_path, id + 1 AS line_no, CASE WHEN id % 3 = 0 THEN 'db.create(req.body)' WHEN id % 700 = 1 THEN 'if (!isValid(id)) return' ELSE 'a = 1' END AS line FROM range({n})")
    rule = tuple(r for r in security.RULES if r.frames and r.check == "input")
    found = security.findings(lines, rule)
    text = [x["line"] for x in lines.orderBy("line_no").collect()]

    def kept(r, i):
        around = ["\n".join(text[max(0, i - f.before) : i + f.after + 1]) for f in r.frames]
        return all(all(re.search(p, t) for p in f.patterns) == f.needed for f, t in zip(r.frames, around, strict=True))

    hit = lambda r, t: re.search(r.pattern, t) and all(re.search(p, t) for p in r.also) and not any(re.search(p, t) for p in r.never)
    files = lambda r: not r.files or re.search(r.files, "src/routes/users.js")
    expected = sorted((security.rule_name(r), i + 1) for r in rule if files(r) for i, t in enumerate(text) if hit(r, t) and kept(r, i))
    assert expected and rows(found, "rule", "line") == expected
    # a hit meets one row, its block's, and not the lines of its file
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "block" in plan


def test_lines_of_a_small_table_are_dealt_to_all_cores(spark, bound, tmp_path):
    spark.range(1, 40).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert binding.code_lines(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_numbers_go_on_over_blocks_of_a_file(spark, monkeypatch):
    monkeypatch.setattr(security, "BLOCK", 10)
    found = spark.sql("SELECT CASE WHEN id % 3 = 0 THEN 'high' ELSE 'low' END AS severity, concat('f', id % 2) AS file_path, nullif(id, 7) AS line, 'r' AS rule FROM range(100)")
    made = [tuple(r) for r in security.numbered(found).select("severity", "file_path", "line", "id").collect()]
    assert [r[3] for r in made] == [f"SEC-{i:03d}" for i in range(1, 101)]
    assert made == sorted(made, key=lambda r: (r[0] != "high", r[1], r[2] is not None, r[2]))


def test_rest_edges_are_made_without_a_shuffle_of_the_products(spark):
    calls = spark.sql("SELECT concat('web/v', id % 2, '.ts') AS file_path, id AS line_no, \"fetch('/api/users/1')\" AS line FROM range(40)")
    routes = spark.sql("SELECT 'web/v1.ts' AS file_path, 100 + id AS line_no, \"app.get('/api/users/:id', f)\" AS line FROM range(30)")
    found = cross_language.rest_edges(calls.unionByName(routes).unionByName(calls))
    assert found.count() == 20 * 30 and found.distinct().count() == 20 * 30
    assert found.where("source_file = target_file").count() == 0
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_a_deleted_file_is_compared_by_its_own_edges(bound):
    file = "lib/supp/n0.go"
    out = simulate.simulate(bound, simulate.Action("delete", file))
    at = bound.ef.where((F.col("source_file") == file) | (F.col("target_file") == file))
    assert rows(out.removed_edges, "source", "target", "kind") == rows(at, "source", "target", "kind") == rows(bound.edges.join(out.after.edges, ["source", "target", "kind"], "left_anti"), "source", "target", "kind")
    assert rows(out.affected_nodes(), "id") == rows(at.select(F.explode(F.array("source", "target")).alias("id")).distinct(), "id")
    # nothing is compared with all other edges
    assert "LeftAnti" not in out.removed_edges._jdf.queryExecution().optimizedPlan().toString()


def test_small_tangles_share_a_call_of_the_cycle_search(spark, monkeypatch):
    monkeypatch.setattr(traverse, "CALL_EDGES", 10_000)
    n = 300
    ring = spark.sql(f"SELECT concat('f', id) AS source_file, concat('f', id DIV 3 * 3 + (id + 1) % 3) AS target_file, id AS seq FROM range({3 * n})")
    found = traverse.cycles(ring)
    assert sorted(sorted(r[0]) for r in found.collect()) == sorted(sorted(f"f{3 * i + k}" for k in range(3)) for i in range(n))
    assert "call" in found._jdf.queryExecution().optimizedPlan().toString()


def test_longest_path_searches_only_within_tangles(spark):
    # eight layers of eight make 8^8 paths to a ring of five; behind it a clique of four, and a tail. Loops don't count
    edges = [(f"d{i}{a}", f"d{i + 1}{b}") for i in range(7) for a in range(8) for b in range(8)]
    edges += [("d70", "r0"), *((f"r{i}", f"r{(i + 1) % 5}") for i in range(5)), ("r3", "q0"), ("r4", "q0"), *((f"q{i}", f"q{j}") for i in range(4) for j in range(4)), ("q2", "t")]
    fp = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "source_file string, target_file string, seq long")
    assert traverse.longest_path(fp) == 7 + 1 + 4 + 1 + 3 + 1


@pytest.mark.parametrize("seed", range(40))
def test_longest_arrivals_are_those_of_all_paths(seed):
    r = random.Random(seed)
    k = r.randint(2, 6)
    n, ring, after = [r.randint(0, 9) for _ in range(k)], r.sample(range(k), k), [[] for _ in range(k)]
    for i in range(k):
        after[ring[i]].append(ring[(i + 1) % k])
    for _ in range(r.choice([0, 3, 6])):
        a, b = r.sample(range(k), 2)
        after[a] += [] if b in after[a] else [b]
    best = list(n)

    def walk(x, met, length):
        best[x] = max(best[x], length)
        for y in after[x]:
            if y not in met:
                walk(y, met | {y}, length + 1)

    for x in range(k):
        walk(x, {x}, n[x])
    assert traverse.longest_arrivals(n, after) == best


def test_imports_that_a_deletion_breaks_are_found_without_all_edges(bound, monkeypatch):
    file = bound.nodes.agg(F.min("file_path")).first()[0]
    touched = bound.nodes.where(F.col("file_path") == file)
    cols = ["importer", "source", "target", "name"]
    all_edges = rows(simulate._broken(bound, touched, touched, ""), *cols)
    bare = binding.CodeGraph(bound.nodes, None)
    bare.__dict__["ef"] = bound.ef
    monkeypatch.setattr(simulate, "remove_files", lambda g, files: g)
    assert all_edges and rows(simulate.simulate(bare, simulate.Action("delete", file)).broken_imports, *cols) == all_edges
