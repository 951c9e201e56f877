"""Iterative traversals: closures, components, cycles, longest paths.

Each round is a join against the edges and its result a written table, so lineage stays short and lost executors cost one
round. Frontiers and results stay distributed; the only grouped step is the exact cycle list of a file graph, which is
bounded by ``MOST_CYCLE_EDGES`` and refused beyond.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.graph import CodeGraph
from ..plans.scratch import written

MOST_CYCLE_EDGES = 2_000_000
#: References that a call of the cycle search takes, where parts are small.
CALL_EDGES = 20_000
#: Steps that the search for the longest path within a tangle may try.
MOST_STEPS = 5_000_000


#: Rounds after which what was reached is written as one table.
MERGE = 8


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(root, id, depth): what is reached from the starts (root, id) against the edges' direction, start left out.

    The reversed edges are written once; a round reads them and the tables of what was reached, which are merged every
    few rounds, so that no round reads more than MERGE small tables beside one large one.
    """
    back = written(edges.select(F.col("target").alias("id"), F.col("source").alias("next")).distinct(), "back")
    now = written(starts.select("root", "id", F.lit(0).alias("depth")).distinct(), "closure")
    seen, depth = now, 0
    while True:
        depth += 1
        step = now.select("root", "id").join(back, "id").select("root", F.col("next").alias("id")).distinct()
        now = written(step.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if not now.take(1):
            return seen.where("depth > 0")
        seen = seen.unionByName(now)
        if depth % MERGE == 0:
            seen = written(seen, "seen")


def impact(g: CodeGraph, symbol: str) -> DataFrame:
    """All symbols that depend on one, with their distance and, for direct ones, the relation."""
    start = g.nodes.where(F.col("id") == symbol).select(F.lit(symbol).alias("root"), "id")
    reached = closure(g.edges, start).select("id", "depth")
    direct = g.edges.where(F.col("target") == symbol).select(F.col("source").alias("id"), F.col("kind").alias("relation"))
    return reached.join(g.nodes, "id").join(direct, "id", "left")


def affected_files(impacted: DataFrame) -> DataFrame:
    return impacted.groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols"), F.min("depth").alias("depth"))


#: Patterns of entry points by class, the first that fits counts; and of what authenticates.
ENTRIES = {"mcp": r"(?i)(?:mcp/|mcp-|\.mcp\.)", "http": r"(?i)(?:routes?/|api/|handler|controller|endpoint|server)", "cli": r"(?i)(?:commands?/|cli/|bin/)"}
AUTH = r"(?i)(?:auth|session|token|jwt|oauth|login|passport|middleware)"


def entry_class(path):
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(ENTRIES.items()):
        out = F.when(path.rlike(pattern), kind).otherwise(out)
    return out


def reachable_entries(g: CodeGraph, files: DataFrame) -> DataFrame:
    """(file_path, entry_file, entry_class, depth): entry points from which each file's symbols can be reached."""
    starts = g.nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select(F.col("file_path").alias("root"), "id")
    reached = closure(g.edges, starts).unionByName(starts.withColumn("depth", F.lit(0)))
    hit = reached.join(g.nodes.select("id", F.col("file_path").alias("entry_file")), "id").withColumn("entry_class", entry_class(F.col("entry_file"))).where("entry_class is not null")
    return hit.groupBy(F.col("root").alias("file_path"), "entry_file", "entry_class").agg(F.min("depth").alias("depth"))


def without_auth(g: CodeGraph, files: DataFrame) -> DataFrame:
    """Files none of whose symbols refers to a symbol or path that speaks of authentication."""
    auth = g.nodes.where(F.col("name").rlike(AUTH) | F.col("file_path").rlike(AUTH)).select(F.col("id").alias("target"))
    guarded = g.ef.join(auth, "target", "left_semi").select(F.col("source_file").alias("file_path"))
    return files.select("file_path").distinct().join(guarded, "file_path", "left_anti")


def strong_components(fp: DataFrame) -> DataFrame:
    """(node, component) of nodes on cycles, by trimming and least labels that pass both ways."""
    edges = written(fp.select(F.col("source_file").alias("a"), F.col("target_file").alias("b")).where("a <> b").distinct(), "scc")
    edges = trimmed(edges)
    out = None
    while edges.take(1):
        nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
        forward = _least_label(nodes, edges.select(F.col("a").alias("x"), F.col("b").alias("y")))
        roots = forward.withColumnRenamed("label", "f")
        inside = edges.join(roots.select(F.col("node").alias("a"), F.col("f").alias("fa")), "a").join(roots.select(F.col("node").alias("b"), F.col("f").alias("fb")), "b").where("fa = fb")
        backward = _least_label(nodes, inside.select(F.col("b").alias("x"), F.col("a").alias("y")))
        found = written(roots.join(backward, "node").where("f = label").select("node", F.col("f").alias("component")), "scc")
        out = found if out is None else out.unionByName(found)
        left = edges.join(found.select(F.col("node").alias("a")), "a", "left_anti").join(found.select(F.col("node").alias("b")), "b", "left_anti")
        edges = trimmed(written(left, "scc"))
    if out is None:
        return fp.sparkSession.createDataFrame([], "node string, component string")
    sizes = out.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return out.join(sizes.select("component"), "component", "left_semi").select("node", "component")


def _least_label(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The least node from which each can be reached along x -> y."""
    now = written(nodes.withColumn("label", F.col("node")), "labels")
    while True:
        passed = edges.join(now.select(F.col("node").alias("x"), "label"), "x").select(F.col("y").alias("node"), "label").unionByName(now)
        new = written(passed.groupBy("node").agg(F.min("label").alias("label")), "labels")
        if not new.join(now, ["node", "label"], "left_anti").take(1):
            return new
        now = new


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that remain when nodes without edges in, or without edges out, are taken away again and again."""
    while True:
        rest = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        rest = written(rest.select("a", "b"), "trim")
        if rest.count() == edges.count():
            return rest
        edges = rest


def cycle_list(g: CodeGraph) -> DataFrame:
    """The cycles of a graph's files, searched once for each graph."""
    if "_cycles" not in g.__dict__:
        g.__dict__["_cycles"] = written(cycles(g.fp), "cycle_list")
    return g.__dict__["_cycles"]


def cycles(fp: DataFrame) -> DataFrame:
    """Cycles (an array of files) that one depth-first search meets, distinct by their members.

    Roots and neighbours are taken in the order of their first reference. Only edges on cycles are searched.
    """
    core = trimmed(written(fp.select(F.col("source_file").alias("a"), F.col("target_file").alias("b")).distinct(), "cycles"))
    # a search never leaves its connected part of the core, so each part is searched in a task of its own
    loops = core.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    parts = written(components(core).unionByName(loops).groupBy("node").agg(F.min("component").alias("label")), "parts")
    ordered = core.join(fp.select(F.col("source_file").alias("a"), F.col("target_file").alias("b"), "seq"), ["a", "b"]).join(parts.select(F.col("node").alias("a"), "label"), "a")
    ordered = written(ordered, "ordered")
    largest, total = ordered.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    if (largest or 0) > MOST_CYCLE_EDGES:
        raise ValueError("a tangle of the file graph is too large for a cycle list; strong_components tells which files are on cycles")

    def search(edges: pd.DataFrame) -> pd.DataFrame:
        edges = edges.sort_values("seq", kind="stable")
        after: dict[str, list[str]] = {}
        for a, b in zip(edges["a"], edges["b"], strict=True):
            after.setdefault(a, []).append(b)
        done: set[str] = set()
        found: dict[tuple[str, ...], list[str]] = {}
        for root in after:
            if root in done:
                continue
            path, place, ways = [root], {root: 0}, [iter(after[root])]
            done.add(root)
            while ways:
                step = next(ways[-1], None)
                if step is None:
                    ways.pop()
                    place.pop(path.pop())
                elif step in place:
                    members = path[place[step] :]
                    found.setdefault(tuple(sorted(members)), members)
                elif step not in done:
                    done.add(step)
                    place[step] = len(path)
                    path.append(step)
                    ways.append(iter(after.get(step, ())))
        return pd.DataFrame({"members": list(found.values())})

    # small parts share a call: a search of several finds what a search of each does, and a call costs more than they do
    calls = max((total or 0) // CALL_EDGES, 4 * fp.sparkSession.sparkContext.defaultParallelism)
    return ordered.withColumn("call", F.pmod(F.xxhash64("label"), F.lit(calls))).groupBy("call").applyInPandas(search, "members array<string>")


def cycle_count(g: CodeGraph) -> DataFrame:
    return cycle_list(g).agg(F.count(F.lit(1)).alias("cycles"))


def longest_path(fp: DataFrame) -> int:
    """Edges of the longest simple path: levels of the acyclic part; what lies within tangles is searched exactly, which is bounded."""
    edges = written(fp.select(F.col("source_file").alias("a"), F.col("target_file").alias("b")).where("a <> b").distinct(), "paths")
    core = trimmed(edges)
    if core.take(1):
        return _through_tangles(edges, core)
    level = 0
    while edges.take(1):
        level += 1
        # nodes without edges in go; a path loses one edge a round
        edges = written(edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b"), "paths")
    return level


def _through_tangles(edges: DataFrame, core: DataFrame) -> int:
    """As longest_path, of edges (a, b) with cycles in their core.

    A path that leaves a strong component, a tangle, never comes back to it. So files and tangles are passed from the roots
    on, each as soon as all references into it are: a file knows the edges of the longest path that arrives, a tangle finds
    from those that arrive at its files the longest one to each of them.
    """
    tangles = written(strong_components(core.select(F.col("a").alias("source_file"), F.col("b").alias("target_file"))), "tangles")
    ends = edges.join(tangles.toDF("a", "u"), "a", "left").join(tangles.toDF("b", "v"), "b", "left")
    inner = written(ends.where("u = v").select(F.col("u").alias("unit"), "a", "b"), "inner")
    largest, total = inner.groupBy("unit").count().agg(F.max("count"), F.sum("count")).first()
    if largest > MOST_CYCLE_EDGES:
        raise ValueError("a tangle of the file graph is too large for an exact longest path")
    calls = max(total // CALL_EDGES, 4 * edges.sparkSession.sparkContext.defaultParallelism)
    open_ = written(ends.where("NOT u <=> v OR u IS NULL").select("a", F.coalesce("u", "a").alias("unit"), "b", F.coalesce("v", "b").alias("into"), F.col("v").isNotNull().alias("tangled")), "open")
    now = written(tangles.select("node", F.col("component").alias("unit"), F.lit(True).alias("tangled"), F.lit(0).cast("long").alias("n")), "arrived")
    best = 0
    while True:
        waits = written(open_.select(F.col("into").alias("unit")).distinct(), "waits")
        ready = written(now.join(waits, "unit", "left_anti").select("node", "unit", "tangled", "n"), "ready")
        arrived = ready.where("NOT tangled").select("node", "n")
        if ready.where("tangled").take(1):
            entries = ready.where("tangled").select("unit", F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), "n")
            inside = inner.join(entries.select("unit").distinct(), "unit", "left_semi").select("unit", "a", "b", F.lit(0).cast("long").alias("n"))
            dealt = entries.unionByName(inside).withColumn("call", F.pmod(F.xxhash64("unit"), F.lit(calls)))
            arrived = arrived.unionByName(dealt.groupBy("call").applyInPandas(_arrivals, "node string, n long"))
        arrived = written(arrived, "arrived")
        best = max(best, arrived.agg(F.max("n")).first()[0] or 0)
        if not waits.take(1):
            return best
        passed = open_.join(waits, "unit", "left_anti").join(arrived.withColumnRenamed("node", "a"), "a", "left")
        told = passed.select(F.col("b").alias("node"), F.col("into").alias("unit"), "tangled", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
        now = now.join(waits, "unit", "left_semi").select("node", "unit", "tangled", "n").unionByName(told)
        now = written(now.groupBy("node", "unit", "tangled").agg(F.max("n").alias("n")), "arrived")
        open_ = written(open_.join(waits, "unit", "left_semi").select("a", "unit", "b", "into", "tangled"), "open")


def _arrivals(frame: pd.DataFrame) -> pd.DataFrame:
    """(node, n): the longest path to each file of some tangles; rows (unit, a, b) are their edges, rows without b what arrives at a."""
    parts: dict[str, tuple[dict[str, int], list[tuple[str, str]]]] = {}
    for unit, a, b, n in zip(frame["unit"], frame["a"], frame["b"], frame["n"], strict=True):
        entries, edges = parts.setdefault(unit, ({}, []))
        if b is None:
            entries[a] = n
        else:
            edges.append((a, b))
    nodes, found = [], []
    for entries, edges in parts.values():
        number = {x: i for i, x in enumerate(entries)}
        after: list[list[int]] = [[] for _ in number]
        for a, b in edges:
            after[number[a]].append(number[b])
        nodes += entries
        found += longest_arrivals(list(entries.values()), after)
    return pd.DataFrame({"node": pd.Series(nodes, dtype=object), "n": pd.Series(found, dtype="int64")})


def longest_arrivals(n: list[int], after: list[list[int]]) -> list[int]:
    """The longest path to each node of one tangle, of those that start with n edges at a node.

    Around a ring by a running maximum. Else paths grow edge by edge, and of those that have passed the same nodes and end
    at the same one only that of the longest start goes on.
    """
    k = len(n)
    if all(len(x) == 1 for x in after):
        ring = [0]
        while len(ring) < k:
            ring.append(after[ring[-1]][0])
        best, window = [0] * k, deque()  # places (around twice) whose path may still be the longest, the longest first
        for at, x in enumerate(ring * 2):
            while window and n[ring[window[-1] % k]] - window[-1] <= n[x] - at:
                window.pop()
            window.append(at)
            if window[0] == at - k:
                window.popleft()
            best[x] = at - window[0] + n[ring[window[0] % k]]
        return best
    best, steps, length = list(n), 0, 0
    now = {(1 << x, x): n[x] for x in range(k)}
    while now:
        length += 1
        longer: dict[tuple[int, int], int] = {}
        for (met, x), first in now.items():
            steps += len(after[x])
            if steps > MOST_STEPS:
                raise ValueError("too many simple paths within a tangle for an exact search")
            for y in after[x]:
                if not met >> y & 1:
                    key = (met | 1 << y, y)
                    if longer.get(key, -1) < first:
                        longer[key] = first
        for (_, y), first in longer.items():
            best[y] = max(best[y], first + length)
        now = longer
    return best


def chains(fp: DataFrame, roots: int = 10, k: int = 5) -> DataFrame:
    """The k longest simple paths from files without references in (the first ``roots``) to files without any out.

    Files from which no cycle can be reached are done from the leaves up: each keeps the k best of its successors' paths,
    which is exact and takes as many rounds as the longest path has edges. Paths of roots that reach a cycle are listed.
    """
    edges = written(fp.select(F.col("source_file").alias("a"), F.col("target_file").alias("b")).where("a <> b").distinct(), "chains")
    first = fp.groupBy(F.col("source_file").alias("a")).agg(F.min("seq").alias("seq")).join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti").orderBy("seq", "a").limit(roots)
    first = written(first, "chains")
    edges = _below(edges, first.select("a"))
    done, open_ = _best_paths(edges, k)
    found = done.join(first, "a", "left_semi").select("path")
    tangled = first.join(open_, "a", "left_semi")
    if tangled.take(1):
        found = found.unionByName(_listed(edges, tangled.select(F.array("a").alias("path"))))
    told = found.where(F.size("path") > 1).select(F.array_join("path", " > ").alias("chain"), (F.size("path") - 1).alias("length"))
    return told.orderBy(F.desc("length"), "chain").limit(k)


def _below(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The edges that the starts can reach."""
    ahead = edges.select(F.col("a").alias("target"), F.col("b").alias("source"))  # closures run against the direction
    reached = closure(ahead, starts.select(F.lit("").alias("root"), F.col("a").alias("id"))).select(F.col("id").alias("a"))
    return written(edges.join(reached.unionByName(starts).distinct(), "a", "left_semi"), "below")


def _best_paths(edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(a, path): the k best paths to leaves of files that reach no cycle; and the files (a) that do reach one."""
    leaves = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_anti")
    fresh = written(leaves.select("a", F.array("a").alias("path")), "best")
    done, open_ = fresh, edges
    best = Window.partitionBy("a").orderBy(F.desc(F.size("path")), F.array_join("path", " > "))
    while fresh.take(1) and open_.take(1):
        met = done.select(F.col("a").alias("b")).distinct()
        ready = open_.select("a").distinct().join(open_.join(met, "b", "left_anti").select("a"), "a", "left_anti")
        longer = open_.join(ready, "a", "left_semi").join(done.select(F.col("a").alias("b"), "path"), "b").select("a", F.concat(F.array("a"), "path").alias("path"))
        fresh = written(longer.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place"), "best")
        done = written(done.unionByName(fresh), "best")
        open_ = written(open_.join(fresh.select("a").distinct(), "a", "left_anti"), "open")
    return done, open_.select("a").distinct()


def _listed(edges: DataFrame, now: DataFrame) -> DataFrame:
    """All simple paths from these to leaves, edge by edge; cycles make their number grow fast."""
    leaves = written(edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_anti"), "leaves")
    done, now = now.limit(0), written(now, "chains")
    while now.take(1):
        step = now.withColumn("a", F.element_at("path", -1)).join(edges, "a").where(~F.array_contains("path", F.col("b")))
        now = written(step.select(F.array_append("path", F.col("b")).alias("path")), "chains")
        done = done.unionByName(now.withColumn("b", F.element_at("path", -1)).join(leaves, "b", "left_semi").select("path"))
    return done
