"""Graph construction, lookups, traversal and what-if on a small graph with known answers."""

import pytest
from pyspark.sql import functions as F

from depmill.operators import dead_code, health, lookup, rollup, simulate, traverse
from depmill.plans.graph import REFERENCE, SYMBOL, build_graph, remove_files

NODES = [
    ("src/a.ts::Foo", "Foo", "class", "src/a.ts", 1, 10, True, None, 0), ("src/a.ts::helper", "helper", "function", "src/a.ts", 12, 20, True, None, 1),
    ("src/b.ts::Bar", "Bar", "class", "src/b.ts", 1, 15, True, None, 2), ("src/c.ts::baz", "baz", "function", "src/c.ts", 1, 8, False, None, 3),
]
EDGES = [("src/b.ts::Bar", "src/a.ts::Foo", "imports", "src/b.ts", 2, 10), ("src/c.ts::baz", "src/a.ts::Foo", "imports", "src/c.ts", 1, 11), ("src/c.ts::baz", "src/b.ts::Bar", "calls", "src/c.ts", 3, 12)]


@pytest.fixture(scope="module")
def g(spark):
    symbols = [*NODES, ("src/a.ts::Foo", "Foo", "function", "src/a.ts", 99, 99, False, None, 50)]
    refs = [*EDGES, ("src/b.ts::Bar", "src/a.ts::Foo", "calls", "src/b.ts", 9, 20), ("src/b.ts::Bar", "src/x.ts::Gone", "calls", "src/b.ts", 9, 21)]
    made = build_graph(spark.createDataFrame(symbols, SYMBOL), spark.createDataFrame(refs, REFERENCE))
    return made.persist()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_build_keeps_first_nodes_last_edges_and_drops_dangling(g):
    assert g.nodes.count() == 4
    assert g.nodes.where("id = 'src/a.ts::Foo'").first()["kind"] == "class"
    assert g.edges.count() == 3
    assert g.edges.where("source = 'src/b.ts::Bar'").first()["kind"] == "calls"


def test_file_pseudo_nodes_come_from_references(spark):
    refs = [("m/a.py::__file__", "m/b.py::f", "imports", "m/a.py", 1, 0)]
    made = build_graph(spark.createDataFrame([("m/b.py::f", "f", "function", "m/b.py", 1, 2, True, None, 0)], SYMBOL), spark.createDataFrame(refs, REFERENCE))
    assert rows(made.nodes.where("name = '__file__'"), "file_path", "kind") == [("m/a.py", "import")]
    assert made.edges.count() == 1


def test_empty_graph(spark):
    made = build_graph(spark.createDataFrame([], SYMBOL), spark.createDataFrame([], REFERENCE))
    assert rollup.file_summary(made).count() == 0
    assert health.coupling(made).first()["score"] == 100
    assert health.cohesion(made).first()["score"] == 100


def test_impact_is_the_transitive_closure(g):
    found = traverse.impact(g, "src/a.ts::Foo")
    assert rows(found, "name") == [("Bar",), ("baz",)]
    assert rows(traverse.affected_files(found), "file_path") == [("src/b.ts",), ("src/c.ts",)]


def test_closure_of_its_result_adds_nothing(g):
    reached = traverse.closure(g.edges, g.nodes.where("name = 'Foo'").select(F.lit("r").alias("root"), "id")).select("root", "id")
    again = traverse.closure(g.edges, reached).select("id").distinct()
    assert set(rows(again, "id")) <= set(rows(reached, "id"))


def test_lookups(g):
    assert rows(lookup.find_symbols(g, "foo"), "id", "dependents") == [("src/a.ts::Foo", 2)]
    assert rows(lookup.dependents(g, "src/b.ts::Bar"), "id") == [("src/c.ts::baz",)]
    assert lookup.symbol_info(g, "ba")[1]
    assert [r["name"] for r in lookup.ranked_search(g, "ba").collect()] == ["Bar", "baz"]


def test_degrees_add_up(g):
    assert g.in_degree.agg(F.sum("dependents")).first()[0] == g.edges.count()
    assert rows(g.edge_degree, "file_path", "connections") == [("src/a.ts", 2), ("src/b.ts", 2), ("src/c.ts", 2)]


def test_no_cycle_and_longest_path(g):
    assert traverse.cycles(g.fp).count() == 0
    assert traverse.longest_path(g.fp) == 2
    assert traverse.strong_components(g.fp).count() == 0


def test_cycles_and_components(spark):
    fp = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("c", "d", 4), ("d", "e", 5), ("e", "d", 6)], "source_file string, target_file string, seq long")
    assert sorted(tuple(sorted(r[0])) for r in traverse.cycles(fp).collect()) == [("a", "b", "c"), ("d", "e")]
    assert rows(traverse.strong_components(fp), "node", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    assert traverse.longest_path(fp) == 4


def test_delete(g):
    out = simulate.simulate(g, simulate.Action("delete", "src/a.ts"))
    assert (out.after.nodes.count(), out.after.edges.count()) == (2, 1)
    assert out.broken_imports.count() == 2
    assert out.removed_edges.count() == 2
    assert g.nodes.count() == 4


@pytest.mark.parametrize(("kind", "to"), [("move", "lib/z.ts"), ("rename", "z.ts")])
def test_move_keeps_nodes_and_flags_importers(g, kind, to):
    out = simulate.simulate(g, simulate.Action(kind, "src/a.ts", to))
    assert out.after.nodes.count() == 4
    assert rows(out.broken_imports, "importer") == [("src/b.ts",), ("src/c.ts",)]
    assert out.after.nodes.where(F.col("file_path") == ("lib/z.ts" if kind == "move" else "src/z.ts")).count() == 2


def test_move_there_and_back_changes_nothing(g):
    there = simulate.simulate(g, simulate.Action("move", "src/a.ts", "q/a.ts")).after
    back = simulate.simulate(there, simulate.Action("move", "q/a.ts", "src/a.ts")).after
    assert rows(back.edges, "source", "target", "kind") == rows(g.edges, "source", "target", "kind")


def test_split_and_merge(g):
    split = simulate.simulate(g, simulate.Action("split", "src/a.ts", names=("helper",)))
    assert split.after.nodes.where("file_path = 'src/a.split.ts'").count() == 1
    merged = simulate.simulate(g, simulate.Action("merge", "src/c.ts", "src/b.ts"))
    assert merged.after.nodes.where("file_path = 'src/b.ts'").count() == 2
    clash = remove_files(g, []).nodes.unionByName(g.nodes.where("name = 'Foo'").withColumns({"id": F.lit("src/c.ts::Foo"), "file_path": F.lit("src/c.ts")}))
    with pytest.raises(simulate.Collision):
        simulate.simulate(type(g)(clash, g.edges), simulate.Action("merge", "src/c.ts", "src/a.ts"))


def test_health_example(spark):
    parts = spark.createDataFrame(list(zip(health.WEIGHTS, (70, 80, 100, 40, 20, 60), health.WEIGHTS.values(), strict=True)), "dimension string, score int, weight double")
    assert tuple(health.overall(parts).first())[:2] == (68, "D")


def test_dead_code(g):
    assert rows(dead_code.dead_symbols(g), "name", "confidence") == [("baz", "high"), ("helper", "high")]
    assert dead_code.package_entries('{"main": "./lib/x.js", "exports": {".": {"import": "./lib/y.ts"}}}') == ["lib/x.js", "lib/x.ts", "lib/y.js", "lib/y.ts"]


def test_moved_symbols_keep_their_scopes(spark):
    symbols = [(f"a.ts::{x}.run", "run", "method", "a.ts", 1, 2, True, x, i) for i, x in enumerate("AB")] + [("b.ts::go", "go", "function", "b.ts", 1, 2, True, None, 5)]
    refs = [("b.ts::go", f"a.ts::{x}.run", "calls", "b.ts", 1, 10 + i) for i, x in enumerate("AB")]
    small = build_graph(spark.createDataFrame(symbols, SYMBOL), spark.createDataFrame(refs, REFERENCE))
    for action in (simulate.Action("move", "a.ts", "x/m.ts"), simulate.Action("split", "a.ts", "x/m.ts", ("run",))):
        after = simulate.simulate(small, action).after
        assert rows(after.nodes, "id") == [("b.ts::go",), ("x/m.ts::A.run",), ("x/m.ts::B.run",)]
        assert rows(after.edges, "target") == [("x/m.ts::A.run",), ("x/m.ts::B.run",)]


def _pairs(spark, edges):
    return spark.createDataFrame([(a, b, i, 1) for i, (a, b) in enumerate(edges)], "source_file string, target_file string, seq long, edges long")


def test_long_chains(spark):
    line = [(f"n{i:02}", f"n{i + 1:02}") for i in range(15)]
    got = [tuple(r) for r in traverse.chains(_pairs(spark, [*line, ("n03", "z"), ("n03", "n05")])).collect()]
    whole = " > ".join(f"n{i:02}" for i in range(16))
    assert got == [(whole, 15), (whole.replace("n04 > ", ""), 14), ("n00 > n01 > n02 > n03 > z", 4)]


def test_chains_past_a_cycle(spark):
    got = traverse.chains(_pairs(spark, [("r", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("q", "c")]))
    assert [tuple(r) for r in got.collect()] == [("r > a > b > c", 3), ("q > c", 1)]


def test_cycles_of_apart_tangles(spark):
    fp = _pairs(spark, [("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("b", "c"), ("x", "a")])
    assert sorted(sorted(r[0]) for r in traverse.cycles(fp).collect()) == [["a", "b"], ["c", "d", "e"]]
