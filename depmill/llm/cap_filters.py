"""Near-duplicate embeddings by spherical-cap filters of random product codes.

A filter is a direction: the sum of one code from each of several random codebooks, over equal parts of the (rotated)
space. A vector is list-decoded to all filters whose cap it lies in, cosine at least alpha: the codes of each book are
sorted by their score, and partial sums go on only with codes that can still reach alpha, so the work is that of the list,
not of all filters. Books are added as the points grow, so that a cap holds about ``CAP_POINTS`` points at any size; alpha
is set, on random directions, so that ``CAPS`` caps hold a vector on average, and is lowered step by step for a vector in
fewer than ``LEAST_CAPS``. Vectors are joined on filters and verified by their cosine in double precision. To the caps
travel codes of a byte a component and the exact length of what they leave out, so that a pair is passed over only where
no vectors with these codes can be close.

Vectors with equal components are one point with a weight. Hot caps don't make pairs: the least id of each cap is its
pivot, and a point that shares an eighth of its caps with a pivot, and whose angle to it is at most half the link angle,
joins the ball of the least such pivot. All of a ball are linked to each other (angles add up), so sums of weights count
those links. Caps then hold balls; close balls are all linked, or not at all, or, where their angle and radii leave it
open, their members are met in pairs of blocks that yield sums of weights, not pairs. Large caps are dealt to tasks in
pairs of blocks of bounded size as well, none is cut.

Defined results: vectors that are null, empty, of another length than most, zero, or hold null or non-finite components
link with nothing and are kept; rows of one vec_id count as one vector each, with a shared component; rows without a
vec_id link with nothing, have no component and are kept; an empty table gives an empty result; columns besides vec_id and embedding
are left out. Recall on pairs of cosine 0.9 is above 0.95 (tests; figures in the README).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import written

COSINE = 0.9
CAPS, LEAST_CAPS = 80, 16
#: Points that a cap holds on average, which sets the number of codes.
CAP_POINTS = 256
LEAST_CODES, MOST_CODES = 16, 256
#: Balls of a cap that a task meets at once.
BLOCK = 1024


class Codes:
    """Codebooks and the cap height; the same for every process."""

    def __init__(self, dim: int, points: int, caps: int = CAPS, seed: int = 17) -> None:
        r = np.random.default_rng(seed)
        filters = max(1.0, points * caps / CAP_POINTS)
        books = min(dim, 2)
        while books < dim and filters ** (1 / books) > MOST_CODES:
            books += 1
        self.codes = max(LEAST_CODES, math.ceil(filters ** (1 / books)))
        self.turn = np.linalg.qr(r.standard_normal((dim, dim)))[0]
        self.cuts = np.linspace(0, dim, books + 1).astype(int)
        unit = lambda c: c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        self.books = [unit(r.standard_normal((self.codes, b - a))) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        # alpha falls until lists of random directions have CAPS entries on average
        probe = unit(r.standard_normal((256, dim)))
        scores = self.scores(probe)
        order = [np.argsort(-x, axis=1) for x in scores]
        falling = [np.take_along_axis(x, o, 1) for x, o in zip(scores, order, strict=True)]
        above = lambda alpha: len(self._above(np.arange(len(probe)), falling, order, alpha)[0]) / len(probe)
        wanted = min(caps, self.codes ** len(self.books))
        self.alpha = math.sqrt(len(self.books))
        while above(self.alpha) < wanted:
            self.alpha -= 0.01

    def scores(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each book the score of each row with each code."""
        x = x @ self.turn
        return [x[:, a:b] @ book.T for (a, b), book in zip(zip(self.cuts, self.cuts[1:], strict=False), self.books, strict=True)]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all caps that the rows of x lie in."""
        rows, filters = [], []
        for i in range(0, len(x), 512):
            a, b = self._listed(x[i : i + 512])
            rows.append(a + i)
            filters.append(b)
        return np.concatenate(rows), np.concatenate(filters)

    def _listed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = min(LEAST_CAPS, self.codes ** len(self.books))
        scores = self.scores(x)
        order = [np.argsort(-s, axis=1) for s in scores]
        falling = [np.take_along_axis(s, o, 1) for s, o in zip(scores, order, strict=True)]
        alpha, waiting, found = self.alpha, np.arange(len(x)), []
        while len(waiting):
            row, filters, _ = self._above(waiting, falling, order, alpha)
            enough = np.bincount(row, minlength=len(x)) >= least
            found.append((row[enough[row]], filters[enough[row]]))
            waiting = waiting[~enough[waiting]]
            alpha -= 0.05
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _above(self, rows: np.ndarray, falling: list[np.ndarray], order: list[np.ndarray], alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, filter, sum) of all sums of one code from each book that reach alpha, book by book."""
        row, number, total = rows, np.zeros(len(rows), np.int64), np.zeros(len(rows))
        rest = np.cumsum([f[:, 0] for f in falling[::-1]], axis=0)[::-1]  # the best that this and later books can add
        for k, (score, code) in enumerate(zip(falling, order, strict=True)):
            later = rest[k + 1][row] if k + 1 < len(falling) else 0.0
            need = alpha - total - later
            # codes fall in score: those that can still reach alpha are the first ones, found in all rows at once
            wide = 16.0 * np.arange(len(score))
            flat = (wide[:, None] - score).ravel()
            n = np.searchsorted(flat, wide[row] - need, "right") - row * score.shape[1]
            n = np.clip(n, 0, score.shape[1])
            back = np.repeat(np.arange(len(row)), n)
            place = np.arange(len(back)) - np.repeat(np.cumsum(n) - n, n)
            row, number, total = row[back], number[back] * self.codes + code[row[back], place], total[back] + score[row[back], place]
        return row, number, total


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _decoded(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, dim = held.value
        for batch in batches:
            ids = batch.column("u").to_numpy()
            for i in range(0, batch.num_rows, 2048):
                rows, filters = codes.decode(matrix(batch.column("x").slice(i, 2048), dim))
                yield pa.RecordBatch.from_arrays([pa.array(filters.astype(np.int64)), pa.array(ids[i : i + 2048][rows])], names=["f", "u"])

    return run


def _cosines(dim: int):
    """Adds the cosine of x and y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = (matrix(batch.column("x"), dim) * matrix(batch.column("y"), dim)).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(c)], names=["a", "b", "cos"])

    return run


def coded(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Rows of bytes: each component of x in a byte, then as floats what a step is worth, the length of the rest, and r."""
    step = (np.abs(x).max(1, keepdims=True) / 127).astype(np.float32)
    near = np.rint(x / step).clip(-127, 127).astype(np.int8)
    rest = np.linalg.norm(x - near * step.astype(np.float64), axis=1)
    up = lambda v: np.nextafter(v.astype(np.float32), np.float32(np.inf))[:, None]
    return np.concatenate([near.view(np.uint8), np.concatenate([step, up(rest), up(r)], 1).view(np.uint8)], 1)


def may_meet(codes: np.ndarray, left: np.ndarray, right: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Of rows left and right of the codes the pairs whose vectors may lie within theta and the sum of their radii."""
    dim = codes.shape[1] - 12
    step, rest, r = np.ascontiguousarray(codes[:, dim:]).view(np.float32).T
    if theta + 2 * float(r.max()) + 1e-6 >= math.pi:
        one, two = np.nonzero(np.ones((len(left), len(right)), bool))
        return left[one], right[two]
    near, ones = codes[:, :dim].view(np.int8) * step[:, None], np.ones_like(rest)
    # the codes' product, off by at most e + f + e f for rests e and f, less cos(theta + r + s) for radii r and s: one product
    mine = np.stack([rest, ones, rest, -np.cos(theta + 1e-6 + r), np.sin(theta + 1e-6 + r)], 1)
    theirs = np.stack([ones, rest, rest, np.cos(r), np.sin(r)], 1)
    one, two = np.nonzero(np.concatenate([near, mine], 1)[left] @ np.concatenate([near, theirs], 1)[right].T >= np.float32(-1e-5))
    return left[one], right[two]


def _coded(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = coded(matrix(batch.column("x"), dim), batch.column("r").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["p", "code"])

    return run


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that count, scaled to length 1 in double precision."""
    for batch in batches:
        ids, out, names = batch.column("vec_id").to_pylist(), [], []
        for i, v in enumerate(batch.column("embedding")):
            if not v.is_valid or not len(v.values) or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0:
                x = x / top  # no square overflows
                out.append(x / np.sqrt((x * x).sum()))
                names.append(ids[i])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=["vec_id", "x"])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): rows whose vector counts."""
    return vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_unit, "vec_id long, x array<double>")


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal keys."""
    rest, ended = None, False
    while not ended:
        batch = next(batches, None)
        ended = batch is None
        if batch is not None:
            rest = batch if rest is None or not rest.num_rows else pa.concat_batches([rest, batch])
        if rest is None or not rest.num_rows:
            continue
        key = np.stack([rest.column(c).to_numpy().astype(np.int64) for c in keys])
        a = 0
        for b in (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist() + ([rest.num_rows] if ended else []):
            yield rest.slice(a, b - a)
            a = b
        rest = rest.slice(a)


def near_groups(vectors: DataFrame, cosine: float = COSINE, caps: int = CAPS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    theta = math.acos(cosine)
    rows = written(usable(vectors), "vectors")
    common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    dim = common["dim"]
    points = written(rows.where(F.size("x") == dim).groupBy("x").agg(F.min("vec_id").alias("u"), F.count(F.lit(1)).alias("m")), "points")
    held = spark.sparkContext.broadcast((Codes(dim, points.count(), caps), dim))
    caps_of = written(points.select("u", "x").mapInArrow(_decoded(held), "f long, u long"), "caps")

    # balls around the least point of each cap
    pivots = caps_of.groupBy("f").agg(F.min("u").alias("p"))
    # near points share many caps, so few pairs need their cosine
    stars = caps_of.join(written(pivots, "pivots"), "f").where("u <> p").groupBy(F.col("p").alias("a"), F.col("u").alias("b")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= max(1, caps // 8))
    stars = written(stars.select("a", "b"), "stars")
    ends = lambda pairs: pairs.join(points.select(F.col("u").alias("a"), "x"), "a").join(points.select(F.col("u").alias("b"), F.col("x").alias("y")), "b").select("a", "b", "x", "y")
    inner = ends(stars).mapInArrow(_cosines(dim), "a long, b long, cos double").where(F.col("cos") >= math.cos(theta / 2 - 1e-7))
    balls = inner.groupBy(F.col("b").alias("u")).agg(F.min(F.struct("a", "cos")).alias("c")).select("u", F.col("c.a").alias("p"), F.acos(F.least(F.col("c.cos"), F.lit(1.0))).alias("angle"))
    member = points.select("u", "m").join(balls, "u", "left").select("u", "m", F.coalesce("p", "u").alias("p"), F.coalesce("angle", F.lit(0.0)).alias("angle"))
    member = written(member, "members")
    # a ball's centre need not be one of its members, so its own place is looked up among all points
    ball = member.groupBy("p").agg(F.sum("m").alias("weight"), F.max("angle").alias("r"))
    ball = written(ball.join(points.select(F.col("u").alias("p"), "x"), "p"), "balls")

    # caps of balls, dealt in pairs of blocks
    at = caps_of.join(member.select("u", "p"), "u").select("f", "p").distinct()
    sizes = at.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("k", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("p"), F.col("k")).cast("int")
    dealt = at.join(sizes, "f").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("f", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "p")
    cells = dealt.join(ball.select("p", "r", "x").mapInArrow(_coded(dim), "p long, code binary"), "p").select("f", "i", "j", "own", "p", "code")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, ("f", "i", "j")):
            p, side = part.column("p").to_numpy(), part.column("own").to_numpy()
            codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(p), -1)
            i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
            one, two = may_meet(codes, np.flatnonzero(side == i), np.flatnonzero(side == j), theta)
            once = p[one] < p[two] if i == j else p[one] != p[two]
            one, two = one[once], two[once]
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p[one], p[two])), pa.array(np.maximum(p[one], p[two]))], names=["a", "b"])

    close = cells.repartition("f", "i", "j").sortWithinPartitions("f", "i", "j").mapInArrow(meet, "a long, b long").distinct()
    measured = ends(close).mapInArrow(_cosines(dim), "a long, b long, cos double")
    facts = ball.select("p", "r", "weight")
    measured = measured.join(facts.select(F.col("p").alias("a"), F.col("r").alias("ra"), F.col("weight").alias("wa")), "a").join(facts.select(F.col("p").alias("b"), F.col("r").alias("rb"), F.col("weight").alias("wb")), "b")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.col("cos"), F.lit(1.0))))
    single = (F.col("ra") == 0) & (F.col("rb") == 0)
    state = F.when(single, F.when(F.col("cos") >= cosine, "all").otherwise("none")).when(angle <= theta - F.col("ra") - F.col("rb") - 1e-7, "all").when(angle > theta + F.col("ra") + F.col("rb") + 1e-6, "none").otherwise("some")
    measured = written(measured.select("a", "b", "wa", "wb", state.alias("state")).where("state <> 'none'"), "near")

    # members of balls of which it depends, met in pairs of blocks: sums of weights, and one link for the pair of balls
    some = measured.where("state = 'some'").select(F.col("a").alias("pa"), F.col("b").alias("pb"))
    held = member.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
    some = written(some.join(held.select(F.col("p").alias("pa"), F.col("k").alias("ka")), "pa").join(held.select(F.col("p").alias("pb"), F.col("k").alias("kb")), "pb"), "some")
    inside = member.select("u", "p", "m").join(points.select("u", "x"), "u")

    def dealt_to(side: str, other: str, place: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("u"), F.col("k" + side)).cast("int")
        all_ = F.explode(F.sequence(F.lit(0), F.col("k" + other) - 1))
        both = some.join(inside.withColumnRenamed("p", "p" + side), "p" + side).withColumn("mine", mine).withColumn("theirs", all_)
        i, j = ("mine", "theirs") if place == 0 else ("theirs", "mine")
        return both.select("pa", "pb", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(place).alias("side"), "u", "m", "x")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, ("pa", "pb", "i", "j")):
            side, u, m, x = part.column("side").to_numpy(), part.column("u").to_numpy(), part.column("m").to_numpy(), matrix(part.column("x"), dim)
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            ok = x[left] @ x[right].T >= cosine
            one, two = np.nonzero(ok)
            if len(one):
                w = np.concatenate([ok @ m[right], ok.T @ m[left]])
                who = np.concatenate([u[left], u[right]])
                yield pa.RecordBatch.from_arrays([pa.array(np.append(who[w > 0], u[left[one[0]]])), pa.array([*[None] * int((w > 0).sum()), int(u[right[two[0]]])], pa.int64()), pa.array(np.append(w[w > 0], 0).astype(np.int64))], names=["a", "b", "w"])

    met = dealt_to("a", "b", 0).unionByName(dealt_to("b", "a", 1)).repartition("pa", "pb", "i", "j").sortWithinPartitions("pa", "pb", "i", "j")
    met = written(met.mapInArrow(sums, "a long, b long, w long"), "met")
    linked = met.where("b is not null").select("a", "b")

    whole = measured.where("state = 'all'")
    more = whole.select(F.col("a").alias("p"), F.col("wb").alias("w")).unionByName(whole.select(F.col("b").alias("p"), F.col("wa").alias("w"))).groupBy("p").agg(F.sum("w").alias("more"))
    apart = met.where("b is null").groupBy(F.col("a").alias("u")).agg(F.sum("w").alias("apart"))
    first = member.groupBy("p").agg(F.min("u").alias("first"))  # a member that stands for its ball
    counts = member.join(ball.select("p", "weight"), "p").join(more, "p", "left").join(apart, "u", "left").select("u", (F.col("weight") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("apart", F.lit(0))).alias("n_links"))
    balls_linked = whole.select("a", "b").join(first.select(F.col("p").alias("a"), F.col("first").alias("fa")), "a").join(first.select(F.col("p").alias("b"), F.col("first").alias("fb")), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    edges = member.join(first, "p").select(F.col("first").alias("a"), F.col("u").alias("b")).unionByName(balls_linked).unionByName(linked)
    found = components(edges)
    done = points.join(counts, "u").join(found, F.col("u") == F.col("node"), "left").select("x", "n_links", F.coalesce("component", "u").alias("component_id"))
    told = rows.join(done, "x", "left").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    joined = ids.join(told, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
