"""Exact Jaccard join of word-shingle sets, as a metric-space join by pivots.

Jaccard distance d is a metric, and two documents link when d <= t. Documents with equal sets are one point. Beside d there
is the distance of sketches: a sketch counts the shingles of each part of the hash space, and the weighted Jaccard distance s
of two sketches of equal parts is a metric as well and never above d, so a link has s <= t. Coarse sketches have 64 parts,
fine ones a part or more for each shingle of the text, so that they come close to d; of two fine sketches the longer is
folded to the parts of the shorter. Small sketches are fine ones folded to an eighth of the parts; they travel to regions.

1. Every shingle is the pivot {shingle}, at distance 1 - 1/n of the n-sets that hold it and 1 of all others. A point's
   nearest pivots tie, and a global order (shingles that many documents hold come last) breaks the tie. A point lies in
   the regions of the first n - ceil((1 - t) n) + 1 pivots of its own: two linked points share at least (1 - t) n
   shingles, so their boundary windows meet in one region at least. Documents can't be the pivots here: unrelated texts
   all have distances near 1, and no triangle inequality parts them.
2. The least member of a region is held against all others. Links put members into connected groups. What is left of a
   region is split by size classes, a member being replicated to the next class, as linked sizes differ by the factor
   1 - t at most; only classes whose members are of several groups go on.
3. Such a region with more than ``LEAF`` members is cut into the Voronoi cells of ``PIVOTS`` of its documents by s: a
   member lies in the cell of its nearest pivot at distance m, and, as a document of the boundary, in each whose pivot is
   within m + 2t: by the triangle inequality a linked pair meets in the home cell of either. Members within t of a pivot
   are held against it, after which the pivot is done. Cells are regions again, and the join goes on in them. Where the
   cells hold as much as the region did, the inequality parts nothing; cells are counted before any is made, and the
   members of such a region are held against their nearest pivot alone and then met in pairs of blocks.
4. Regions of at most ``LEAF`` members and pairs of blocks of ``BLOCK`` are joined in one task, of regions with the same
   members one and similar regions made one, members of one group left out and the rest held to the bounds on sizes and small sketches. Of a block with more pairs than members that pass, only those of a
   spanning forest of the groups are measured, by fine sketches and then on the sets themselves, the closest first; where
   groups are left apart, the members of the others meet again, by fine sketches, and then on their sets, so that a task
   returns no more pairs than members, however many are close.

All steps are exact. Sets never travel but for pairs that pass the sketches, and members of blocks in which more pairs do than there are members. A region's ids are counted in one task, packed
to a few bytes each; beyond that no region is gathered in one task, but for about 2 * ``BLOCK`` members.

Defined results: words are in lower case (A-Z); a text of 1 to 3 words is one shingle; null, empty and blank texts have
no shingles and link with nothing; rows of one doc_id count as one document, each with its own n_shingles; rows
without a doc_id are returned, link with nothing and have a null component_id; an empty
table gives an empty result; columns besides doc_id and text are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import forget, written
from .tops import most_frequent
from .words import chunks, grams, mixed, signed, split

WORDS = 4
#: Least similarity in hundredths.
PERCENT = 85
#: Shingles put last in the global order, at most; the order only saves work.
HOT = 1 << 18
#: Documents of a chunk that share a shingle before the chunk reports it.
HOT_IN_CHUNK = 4
#: Members of a region that is cut no further; pivots of a larger one.
LEAF, PIVOTS = 64, 8
#: Members of a block of a region that no pivot parts: a member travels once for each block of its region.
BLOCK = 1024
#: Pairs whose coarse sketches are compared at a time.
STRIPE = 1 << 14
#: Window shingles that travel packed to one task at a time, on average; bits of their hashes.
BUCKET_ROWS, BITS = 250_000, 40
#: Part of a region's pairs that its cells may hold for the cut to count as one.
PARTED = 0.8
#: Ids or shingles that are broadcast as a filter, at most (8 bytes each).
BROADCAST_IDS = 500_000
FACTS = "doc_id long, n long, s1 long, s2 long, fine binary"
PACKED = "bucket long, k long, packed binary"
LIVE = "e long, node long, n long, p long, k long"


class Sets:
    """Shingle sets of the texts of a chunk, sorted by hash."""

    def __init__(self, part: pa.RecordBatch, k: int) -> None:
        words = split(part.column("text"), lower=True)
        hashes = words.hashes()[words.codes] if len(words.vocab) else np.zeros(0, np.uint64)
        self.all, self.offsets, self.k = grams(hashes, k), words.offsets, k
        self.hashes = hashes

    def __iter__(self) -> Iterator[np.ndarray]:
        for a, b in zip(self.offsets.tolist(), self.offsets[1:].tolist(), strict=False):
            if b - a >= self.k:
                yield np.unique(self.all[a : b - self.k + 1])
            elif b > a:
                yield grams(self.hashes[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(np.bitwise_xor.reduce(mixed(s ^ np.uint64(0x5851F42D4C957F2D)))), int(np.add.reduce(mixed(s)))


def sketch(s: np.ndarray) -> bytes:
    """The fine sketch: how many of the distinct hashes fall into each part; there are as many parts as hashes, or up to twice."""
    bits = max(6, math.ceil(math.log2(max(1, len(s)))))
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def folded(fine: bytes) -> bytes:
    """The small sketch: an eighth of the parts of the fine one, 64 at least."""
    x = np.frombuffer(fine, np.uint8)
    return np.minimum(x.reshape(max(64, len(x) // 8), -1).sum(1, dtype=np.int64), 255).astype(np.uint8).tobytes()


def coarse(fine: bytes) -> np.ndarray:
    return np.frombuffer(fine, np.uint8).reshape(64, -1).sum(1, dtype=np.int64)


def sketches(column: pa.Array) -> np.ndarray:
    """Coarse sketches of a column of fine or small ones."""
    fine = column.to_pylist()
    return np.stack([coarse(x) for x in fine]) if fine else np.zeros((0, 64), np.int64)


def sketch_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weighted Jaccard distance of rows of counts."""
    apart, total = np.abs(x - y).sum(-1), x.sum(-1) + y.sum(-1)
    return 2 * apart / np.maximum(total + apart, 1)


def fine_distance(x: bytes, y: bytes) -> float:
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    parts = min(len(a), len(b))
    return float(sketch_distance(*(v.reshape(parts, -1).sum(1, dtype=np.int64) for v in (a, b))))


def least_overlap(n: np.ndarray | int, percent: int = PERCENT):
    return (percent * n + 99) // 100


def _facts(k: int):
    """Per document its size, signature and sketch; beside them (fine null) shingles that many texts of a chunk hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sizes, ones, twos, sketches, seen, kept = [], [], [], [], set(), []
                for s in Sets(part, k):
                    sig = signature(s)
                    sizes.append(len(s))
                    ones.append(sig[0])
                    twos.append(sig[1])
                    sketches.append(sketch(s))
                    if sig not in seen:
                        seen.add(sig)
                        kept.append(s)
                keys, counts = np.unique(np.concatenate(kept), return_counts=True) if kept else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                keys, counts = keys[counts >= HOT_IN_CHUNK], counts[counts >= HOT_IN_CHUNK]
                as64 = lambda x: np.array(x, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([part.column("doc_id").cast(pa.int64()), pa.nulls(len(keys), pa.int64())]),
                        pa.array(np.concatenate([np.array(sizes, np.int64), counts])), pa.array(np.concatenate([as64(ones), keys.view(np.int64)])),
                        pa.array(np.concatenate([as64(twos), np.zeros(len(keys), np.int64)])), pa.array([*sketches, *[None] * len(keys)], pa.binary()),
                    ],
                    names=["doc_id", "n", "s1", "s2", "fine"],
                )

    return run


def pack(e: np.ndarray, node: np.ndarray, n: np.ndarray) -> bytes:
    """Three columns of long as planes of bytes: equal high bytes take no room, and nodes are near each other."""
    planes = [np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for x in (e, np.diff(node, prepend=0), n)]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpack(k: int, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(packed, 24 * k, codec="zstd"), np.uint8).reshape(3, 8, k)
    e, node, n = (np.ascontiguousarray(x.T).view(np.int64).ravel() for x in planes)
    return e, np.cumsum(node), n


def _rows(k: int, percent: int, hot, buckets: int):
    """The boundary windows, (shingle, node, size) for the first shingles of each representative's set, packed by ranges of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank = hot.value
        for batch in batches:
            for part in chunks(batch):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                found, nodes, sizes, lengths = [], [], [], []
                for doc, s in zip(ids, Sets(part, k), strict=True):
                    if not len(s):
                        continue
                    want = len(s) - least_overlap(len(s), percent) + 1
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                        order = np.where(keys[at] == s, rank[at], 0)
                        if order.any():
                            s = s[np.argsort(order, kind="stable")]
                    found.append(s[:want])
                    nodes.append(doc)
                    sizes.append(len(s))
                    lengths.append(want)
                if not found:
                    continue
                e = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)
                node, n = np.repeat(np.array(nodes, np.int64), lengths), np.repeat(np.array(sizes, np.int64), lengths)
                bucket = (e * buckets) >> BITS
                order = np.argsort(bucket, kind="stable")
                at, first, count = np.unique(bucket[order], return_index=True, return_counts=True)
                blobs = [pack(e[x], node[x], n[x]) for x in (order[i : i + c] for i, c in zip(first.tolist(), count.tolist(), strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "k", "packed"])

    return run


def _heads(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of (shingles, nodes, least sizes, largest sizes, counts) each shingle once: its least node with that node's sizes, the sum of the counts."""
    e, node, low, high, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((node, e))
    e, node = e[order], node[order]
    new = np.concatenate([[True], e[1:] != e[:-1]])
    runs = np.flatnonzero(new | np.concatenate([[True], node[1:] != node[:-1]]))
    first, own = np.flatnonzero(new), new[runs]
    low, high = np.minimum.reduceat(low[order], runs)[own], np.maximum.reduceat(high[order], runs)[own]
    return e[first], node[first], low, high, np.add.reduceat(count[order], first)


def _live(percent: int):
    """Packed windows, sorted by bucket, to the rows (e, node, n, p, k) of shingles that several have; they stay packed but for one at a time.

    p is null where its size allows no link with the node.
    """

    def rows(blobs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        heads: list[tuple[np.ndarray, ...]] = []
        for k, packed in blobs:
            e, node, n = unpack(k, packed)
            heads.append(_heads([(e, node, n, n, np.ones(k, np.int64))]))
            if len(heads) > 1 and sum(len(x[0]) for x in heads[1:]) > max(len(heads[0][0]), BUCKET_ROWS):
                heads = [_heads(heads)]
        *heads, count = _heads(heads)
        keys, least, low, high, count = (x[count > 1] for x in (*heads, count))
        held, size = [], 0
        for k, packed in blobs if len(keys) else []:
            e, node, n = unpack(k, packed)
            at = np.minimum(np.searchsorted(keys, e), len(keys) - 1)
            ok = keys[at] == e
            e, node, n, at = e[ok], node[ok], n[ok], at[ok]
            fits = (n * 100 >= low[at] * percent) & (high[at] * 100 >= n * percent)
            held.append([e, node, n, least[at], fits, count[at]])
            size += len(e)
            if size > 1 << 16:
                yield batch(held)
                held, size = [], 0
        if size:
            yield batch(held)

    def batch(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        e, node, n, p, fits, k = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(e), pa.array(node), pa.array(n), pa.array(p, mask=~fits), pa.array(k)], names=["e", "node", "n", "p", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for part in batches:
            for bucket, k, packed in zip(*(part.column(c).to_pylist() for c in ("bucket", "k", "packed")), strict=True):
                if bucket != now and blobs:
                    yield from rows(blobs)
                    blobs = []
                now = bucket
                blobs.append((k, packed))
        if blobs:
            yield from rows(blobs)

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = list(Sets(part, k))
                edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                lists = pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), signed(np.concatenate([*sets, np.zeros(0, np.uint64)]))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), lists], names=["node", "shingles"])

    return run


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        small = [folded(x) for x in batch.column("fine").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(small, pa.binary())], names=["node", "n", "sketch"])


def _close(edge: float):
    """Pairs (p, node) whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = [fine_distance(x, y) <= edge for x, y in zip(batch.column("fine").to_pylist(), batch.column("p_fine").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("node")], names=["p", "node"]).filter(pa.array(ok))

    return run


def _distances(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each member and pivot of its region: the member's place, the pivot, their distance, the least distance of the member."""
    pivots, mine = batch.column("pivots"), sketches(batch.column("sketch"))
    edges = pivots.offsets.to_numpy().astype(np.int64)
    flat = pivots.flatten()
    p, theirs = flat.field("p").to_numpy(), sketches(flat.field("sketch"))
    row = np.repeat(np.arange(batch.num_rows), np.diff(edges))
    d = sketch_distance(mine[row], theirs)
    return row, p, d, np.minimum.reduceat(d, edges[:-1] - edges[0])[row]


def _counted(edge: float):
    """Members with their region's pivots, to (e, p, k, size): how many would lie in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, p, d, least = _distances(batch)
                ok = np.flatnonzero(d <= least + 2 * edge)
                held = batch.select(["e", "size"]).take(pa.array(row[ok]))
                found = pa.table([*held.columns, pa.array(p[ok])], names=["e", "size", "p"]).group_by(["e", "p", "size"]).aggregate([([], "count_all")])
                yield from found.select(["e", "p", "count_all", "size"]).rename_columns(["e", "p", "k", "size"]).to_batches()

    return run


def _celled(edge: float):
    """Members with their region's pivots, to (e, node, n, g, size, p, d): the cells that they lie in, at distance d of p.

    Of regions that are not parted the nearest pivot alone, if it is within the edge.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, p, d, least = _distances(batch)
            parted = batch.column("parted").to_numpy(zero_copy_only=False).astype(bool)[row]
            nearest = np.flatnonzero(d == least)
            first = np.zeros(len(d), bool)
            first[nearest[np.unique(row[nearest], return_index=True)[1]]] = True
            ok = np.flatnonzero(np.where(parted, d <= least + 2 * edge, first & (d <= edge)))
            held = batch.select(["e", "node", "n", "g", "size"]).take(pa.array(row[ok]))
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(p[ok]), pa.array(d[ok])], names=["e", "node", "n", "g", "size", "p", "d"])

    return run


def _leaf(percent: int, edge: float):
    """Rows by (e, i, j) to the pairs (p, node, null) that sizes and sketches allow, of different groups, one of block i and one of j.

    Of a block with more pairs than members only as many as connect the groups that all of these pairs connect, the
    closest first, and the members of all of them, as (null, node, e). Where the sketches are the sets themselves, only
    links, as many as connect the groups that all links connect.
    """

    def distances(x, y, sk, total) -> np.ndarray:
        apart = np.abs(sk[x] - sk[y]).sum(1)
        return 2 * apart / np.maximum(total[x] + total[y] + apart, 1)

    def pairs(n, g, sk, fine, one_block, side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right = (np.arange(len(n)),) * 2 if one_block else (np.flatnonzero(side), np.flatnonzero(~side))
        sk, total, found = sk.astype(np.int32), sk.sum(1), [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = max(1, STRIPE // max(1, len(right)))
        for at in range(0, len(left), step):
            x = left[at : at + step]
            beyond = right[at:] if one_block else right
            ok = (g[x, None] != g[beyond]) & (np.minimum(n[x, None], n[beyond]) * 100 >= np.maximum(n[x, None], n[beyond]) * percent)
            if one_block:
                ok &= x[:, None] < beyond
            i, j = np.nonzero(ok)
            i, j = x[i], beyond[j]
            d = distances(i, j, sk, total)
            ok = d <= edge
            found.append((d[ok], i[ok], j[ok]))
        d, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        parts = np.array([len(x) for x in fine])
        parts = np.minimum(parts[i], parts[j])
        for p in np.unique(parts[parts > sk.shape[1]]).tolist():
            mine = np.flatnonzero(parts == p)
            used, place = np.unique(np.concatenate([i[mine], j[mine]]), return_inverse=True)
            finer = np.stack([np.frombuffer(fine[q], np.uint8).reshape(p, -1).sum(1, dtype=np.int32) for q in used.tolist()])
            sums, step = finer.sum(1), max(1, STRIPE * 64 // p)
            for at in range(0, len(mine), step):
                end = min(at + step, len(mine))
                d[mine[at:end]] = distances(place[at:end], place[len(mine) + at : len(mine) + end], finer, sums)
        ok = d <= edge
        return d[ok], i[ok], j[ok]

    def connecting(d, i, j, g, holds) -> list[int]:
        """Places of the pairs of a forest of the groups, the closest pairs that hold first."""
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        order, kept = np.lexsort((j, i, d)), []
        for at, x, y in zip(order.tolist(), g[i[order]].tolist(), g[j[order]].tolist(), strict=True):
            a, b = top(x), top(y)
            if a != b and holds(i[at], j[at]):
                root[a] = b
                kept.append(at)
        return kept

    def links(x: np.ndarray, y: np.ndarray) -> bool:
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                rest = batch if rest is None or not rest.num_rows else pa.concat_batches([rest, batch])
            if rest is None or not rest.num_rows:
                continue
            keys = np.stack([rest.column(c).to_numpy().astype(np.int64) for c in ("e", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            ends = [*cuts.tolist(), *([rest.num_rows] if batch is None else [])]
            node, n, g, own = (rest.column(x).to_numpy() for x in ("node", "n", "g", "own"))
            column = rest.column("sketch")
            exact = pa.types.is_list(column.type)
            if exact:
                edges, hashes = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
                sets = [hashes[p:q] for p, q in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
                column = pa.array([sketch(x) for x in sets], pa.binary())
            fine, sk = column.to_pylist(), sketches(column)
            a, out, more = 0, [np.zeros((0, 2), np.int64)], [np.zeros((2, 0), np.int64)]
            for b in ends:
                if b - a > 1:
                    d, x, y = pairs(n[a:b], g[a:b], sk[a:b], fine[a:b], keys[1, a] == keys[2, a], own[a:b] == keys[1, a])
                    if exact or len(d) > b - a:
                        kept = connecting(d, x, y, g[a:b], (lambda i, j, at=a: links(sets[at + i], sets[at + j])) if exact else lambda i, j: True)
                        if not exact:
                            again = np.unique(node[a + np.concatenate([x, y])])
                            more.append(np.stack([again, np.full(len(again), keys[0, a])]))
                        x, y = x[kept], y[kept]
                    out.append(np.sort(np.stack([node[a + x], node[a + y]], 1), 1))
                a = b
            rest = rest.slice(a)
            met = np.unique(np.concatenate(out), axis=0)  # a pair may meet in many regions
            again, region = np.unique(np.concatenate(more, 1), axis=1)
            if len(met) or len(again):
                first, second = (np.ascontiguousarray(x) for x in met.T)
                found = [pa.concat_arrays([pa.array(first), pa.nulls(len(again), pa.int64())]), pa.array(np.concatenate([second, again])), pa.concat_arrays([pa.nulls(len(met), pa.int64()), pa.array(region)])]
                yield pa.RecordBatch.from_arrays(found, names=["p", "node", "e"])

    return run


def connected(edges: DataFrame) -> DataFrame:
    """As components, written; of at most BROADCAST_IDS edges the driver finds them, without rounds of jobs."""
    spark = edges.sparkSession
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if edges.count() > BROADCAST_IDS:
        return written(components(edges), "groups")
    table = edges.toArrow()
    nodes, place = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("a", "b")]).astype(np.int64), return_inverse=True)
    a, b = place[: table.num_rows], place[table.num_rows :]
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    return written(spark.createDataFrame(pa.table({"node": nodes, "component": nodes[label]})), "groups")


class Join:
    """One join: its tables and the rounds over them."""

    def __init__(self, docs: DataFrame, k: int, percent: int) -> None:
        self.docs, self.k, self.percent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, percent
        self.edge, self.salt = 1 - percent / 100 + 1e-9, 0
        facts = written(self.docs.mapInArrow(_facts(k), FACTS), "facts")
        self.facts = facts.where("fine is not null")
        counts = facts.where("fine is null").groupBy("s1").agg(F.sum("n").alias("n"))
        self.hot = most_frequent(counts, HOT).toPandas()  # at most HOT rows
        reps = self.facts.where("n > 0 AND doc_id is not null").groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "fine")).alias("first"))
        self.points = written(reps.select("s1", "s2", "n", F.col("first.doc_id").alias("node"), F.col("first.fine").alias("fine")), "points")
        self.small = written(self.points.select("node", "n", "fine").mapInArrow(_folded, "node long, n long, sketch binary"), "small")

    def regions(self) -> DataFrame:
        """(e, node, n, p, k): the k members of each region that has more than one, and its least one, p, or null where sizes forbid a link with it.

        Windows travel once, packed; the members of a region are held packed in one task, a few bytes each.
        """
        keys = self.hot["s1"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        held = self.docs.sparkSession.sparkContext.broadcast((keys[order], self.hot["n"].to_numpy().astype(np.int64)[order]))
        first = self._only(self.points.select(F.col("node").alias("doc_id")))
        total = self.points.agg(F.sum(F.expr(f"n - ({self.percent} * n + 99) div 100 + 1"))).first()[0] or 0
        rows = first.mapInArrow(_rows(self.k, self.percent, held, 1 + total // BUCKET_ROWS), PACKED)
        return written(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_live(self.percent), LIVE), "live")

    def _only(self, ids: DataFrame) -> DataFrame:
        """Documents with these ids; the ids are broadcast if they are few enough."""
        ids = written(ids.distinct(), "ids")
        return self.docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")

    def sketched(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.sketches, "node")

    def _near(self, pairs: DataFrame, points: DataFrame) -> DataFrame:
        """Of (p, node) pairs those whose sizes and sketches, of points (node, n, fine), allow a link."""
        both = pairs.join(points, "node").join(points.select(F.col("node").alias("p"), F.col("n").alias("p_n"), F.col("fine").alias("p_fine")), "p")
        fits = F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * self.percent
        return both.where(fits).select("p", "node", "fine", "p_fine").mapInArrow(_close(self.edge), "p long, node long")

    def close(self, pairs: DataFrame) -> DataFrame:
        """The distinct (p, node) pairs whose sizes and sketches allow a link: small sketches first, then fine ones."""
        pairs = written(pairs.where("p <> node").distinct(), "pairs")
        near = written(self._near(pairs, self.small.withColumnRenamed("sketch", "fine")), "near")
        ids = written(near.select("node").unionByName(near.select(F.col("p").alias("node"))).distinct(), "ids")
        points = self.points.select("node", "n", "fine").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "node", "left_semi")
        return self._near(near, points)

    def linked(self, close: DataFrame) -> DataFrame:
        """Of (p, node) pairs those that link, measured on their sets; rows of one doc_id may have several, any counts."""
        close = written(close.distinct(), "close")
        needed = close.select(F.col("p").alias("doc_id")).unionByName(close.select(F.col("node").alias("doc_id")))
        sets = written(self._only(needed).mapInArrow(_sets(self.k), "node long, shingles array<long>"), "sets")
        joined = close.join(sets, "node").join(sets.select(F.col("node").alias("p"), F.col("shingles").alias("p_shingles")), "p")
        shared = F.size(F.array_intersect("shingles", "p_shingles"))
        found = joined.select("p", "node", shared.alias("x"), (F.size("shingles") + F.size("p_shingles") - shared).alias("y"))
        found = written(found.where(f"x > 0 AND 100 * x >= {self.percent} * y").select(F.col("p").alias("a"), F.col("node").alias("b")).distinct(), "links")
        forget(close, sets)
        return found

    def classed(self, rows: DataFrame) -> DataFrame:
        """(e, node, n): the size classes of regions, but for those that the class below holds as a whole."""
        c = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / self.percent)) + 1e-9)
        rows = rows.withColumn("c", c).withColumn("key", F.explode(F.array(F.col("c"), F.col("c") + 1)))
        rows = written(rows.select(F.xxhash64("e", "key").alias("e"), "node", "n", (F.col("c") == F.col("key")).alias("own")), "classes")
        several = written(rows.groupBy("e").agg(F.count(F.lit(1)).alias("k"), F.max("own").alias("any")).where("k > 1 AND any").select("e"), "several")
        found = written(rows.join(several, "e").select("e", "node", "n"), "classed")
        forget(rows, several)
        return found

    def mixed(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        """(e, node, n, g, size): rows of regions whose members are of several groups; of regions with the same members, by sums of hashes, one."""
        rows = written(rows.join(groups, "node", "left").select("e", "node", "n", F.coalesce("component", "node").alias("g")), "grouped")
        halves = [f(F.xxhash64("node", "n", F.lit(seed))) for seed in (1, 2) for f in (lambda h: F.shiftright(h, 32), lambda h: h.bitwiseAND(0xFFFFFFFF))]
        several = rows.groupBy("e").agg(F.count(F.lit(1)).alias("size"), F.min("g").alias("g0"), F.max("g").alias("g1"), *(F.sum(h).alias(f"h{i}") for i, h in enumerate(halves)))
        several = written(several.where("g0 <> g1").groupBy("size", "h0", "h1", "h2", "h3").agg(F.min("e").alias("e")).select("e", "size"), "several")
        found = written(rows.join(several, "e"), "mixed")
        forget(rows, several)
        return found

    def gathered(self, rows: DataFrame) -> DataFrame:
        """(e, node, n, g, size): regions with the same least hash of a member made one, where that has no more pairs than they have; twice.

        Near copies share most of their regions, and these most of their members.
        """
        for _ in range(2):
            self.salt += 1
            least = rows.groupBy("e").agg(F.min(F.xxhash64("node", F.lit(self.salt))).alias("key"))
            keyed = written(rows.join(least, "e"), "keyed")
            ones = written(keyed.groupBy("key", "node", "n").agg(F.min("g").alias("g"), F.sum("size").alias("pairs")), "ones")
            fewer = written(ones.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("pairs").alias("pairs")).where("size * size <= pairs").select("key", "size"), "fewer")
            made = ones.join(fewer, "key").select(F.col("key").alias("e"), "node", "n", "g", "size")
            rows = made.unionByName(keyed.join(fewer, "key", "left_anti").select("e", "node", "n", "g", "size"))
        return written(rows, "gathered")

    def leaf(self, rows: DataFrame, meeting: int) -> DataFrame:
        """Pairs of members, of different groups, that sizes and sketches allow, by blocks of at most BLOCK on average; and members that are to meet again."""
        self.sketches = self.told(rows, meeting)
        rows = rows.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
        dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = self.sketched(dealt.select("e", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "g"))
        return dealt.repartition("e", "i", "j").sortWithinPartitions("e", "i", "j").mapInArrow(_leaf(self.percent, self.edge), "p long, node long, e long")

    def told(self, rows: DataFrame, meeting: int) -> DataFrame:
        """(node, sketch): by what members meet; small sketches, then fine ones, then their sets."""
        if meeting == 0:
            return self.small.select("node", "sketch")
        ids = written(rows.select("node").distinct(), "ids")
        if meeting == 1:
            return self.points.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "node", "left_semi").select("node", F.col("fine").alias("sketch"))
        sets = self._only(ids.select(F.col("node").alias("doc_id"))).mapInArrow(_sets(self.k), "node long, shingles array<long>")
        return written(sets.where("size(shingles) > 0").select("node", F.col("shingles").alias("sketch")), "sets")

    def cells(self, rows: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """(e, node, n, g, size, p, d): the Voronoi cells of PIVOTS members of each region, with the boundary's documents; and (e, parted)."""
        rows = written(self.sketched(rows), "large")
        bucket = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(PIVOTS))
        pivots = rows.groupBy("e", bucket.alias("bucket")).agg(F.min(F.struct(F.col("node").alias("p"), "sketch")).alias("pivot"))
        pivots = written(pivots.groupBy("e").agg(F.collect_list("pivot").alias("pivots")), "pivots")  # PIVOTS each
        counted = rows.join(pivots, "e").mapInArrow(_counted(self.edge), "e long, p long, k long, size long").groupBy("e", "p").agg(F.sum("k").cast("double").alias("k"), F.max("size").alias("size"))
        parted = counted.groupBy("e").agg((F.sum(F.col("k") * F.col("k")) <= PARTED * F.max(F.col("size") * F.col("size"))).alias("parted"))
        parted = written(parted, "parted")
        found = rows.join(pivots.join(parted, "e"), "e").mapInArrow(_celled(self.edge), "e long, node long, n long, g long, size long, p long, d double")
        found = written(found, "cells")
        forget(rows, pivots)
        return found, parted

    def merged(self, groups: DataFrame, pairs: DataFrame) -> DataFrame:
        """The groups with the links among these pairs."""
        known = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return connected(known.unionByName(self.linked(self.close(pairs))))

    def groups(self) -> DataFrame:
        """(node, component) of all that links connect; points without links are left out."""
        live, turn = self.regions(), 0
        groups = connected(self.linked(self.close(live.select("p", "node"))))
        classed = self.classed(live.where("NOT (node <=> p) AND k > 2").select("e", "node", "n"))
        now = self.mixed(classed, groups)
        forget(live, classed)
        while now.take(1):
            turn += 1
            cells, parted, self.sketches = None, None, self.small.select("node", "sketch")
            rest = now.where(F.col("size") <= LEAF)
            large = now.where(F.col("size") > LEAF)
            if large.take(1):
                cells, parted = self.cells(large, turn)
                groups = self.merged(groups, cells.where(F.col("d") <= self.edge).select("p", "node"))
                rest = rest.unionByName(large.join(parted.where("NOT parted"), "e", "left_semi").select(*rest.columns))
                rest = self.mixed(rest.select("e", "node", "n"), groups)
            # all pairs of most regions, the closest of others, then, where groups are left apart, by what tells more
            for meeting in range(3):
                if not rest.take(1):
                    break
                if meeting == 0:
                    rest = self.gathered(rest)
                found = written(self.leaf(rest, meeting), "met")
                groups = self.merged(groups, found.where("p is not null").select("p", "node"))
                again = found.where("e is not null").select("e", "node").distinct()
                rest = self.mixed(rest.join(again, ["e", "node"], "left_semi").select("e", "node", "n"), groups)
            if cells is None:
                return groups
            inner = cells.where("node <> p").join(parted.where("parted"), "e", "left_semi").select(F.xxhash64("e", "p").alias("e"), "node", "n")
            now = self.mixed(inner, groups)
            forget(cells, parted)
        return groups


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def jaccard_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the least doc_id that links of at least ``percent`` reach."""
    join = Join(docs, words, percent)
    found = join.groups()
    keys = ["s1", "s2", "n"]
    reps = join.points.join(found, "node", "left").select(*keys, F.coalesce("component", "node").alias("component_id"))
    rows = join.facts.select("doc_id", *keys).join(reps, keys, "left")
    known = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), known.alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of which no link leads to one of a smaller doc_id, all columns as they were.

    Every row is a document of its own, whatever its id: of rows with one id and of rows without an id too, those stay that
    are no near copies. Of a group the row with the least id stays, of equal ones the first written.
    """
    row = "row__"
    while row in docs.columns:
        row += "_"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = jaccard_groups(numbered.select(F.col(row).alias("doc_id"), "text"), words, percent).where("n_shingles > 0").select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    first = found.join(numbered.select(row, "doc_id"), row).groupBy("component_id").agg(F.min_by(row, order).alias("first"))
    gone = written(found.join(written(first, "first"), "component_id").where(F.col(row) != F.col("first")).select(row), "gone")
    return numbered.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, row, "left_anti").drop(row)
