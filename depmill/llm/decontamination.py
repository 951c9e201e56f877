"""Benchmark decontamination by greedy string tiling.

Runs of ``least`` tokens that a document shares with a benchmark item are seeds. Documents keep the tokens under seeds of
the benchmark and are joined to items on the seeds. Of each pair that shares enough seeds, the longest match of unmarked
tokens is marked again and again, matches being found by running Karp-Rabin hashes of falling length and extended token by
token, until none has ``least`` tokens. The item counts as contained when its tiles cover ``threshold`` of its tokens, in
whatever order its passages stand. Items of fewer than ``least`` tokens are contained in texts that have just their tokens.

Tokens are runs of letters and digits in lower case. The seeds of the benchmark are broadcast if they are at most
``BROADCAST_SEEDS``, so that documents send matching seeds only; else all seeds of the documents are joined.

Defined results: null or empty texts and items match nothing; repeated documents and items each count; an empty table on
either side finds nothing; columns of other names pass through ``clean`` untouched, rows without an id are judged alike.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .words import chunks, grams, split, whole, within

#: Tokens of a seed, which is also the least match.
LEAST = 5
THRESHOLD = 0.8
#: Seeds of the benchmark that are broadcast, and keys of texts, at most (8 and 64 bytes each).
BROADCAST_SEEDS, BROADCAST_KEYS = 4_000_000, 500_000
ITEMS = "item_id long, n int, tokens binary, seeds array<long>"
HELD = "doc_id long, key string, n int, tokens binary, seeds array<long>"
FOUND = "doc_id long, key string, item_id long, coverage double, tiles int, covered int, item_tokens int"


def plain(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(whole(texts)), r"[^\pL\pN]+", " ")


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens and the offsets of the texts."""
    words = split(plain(texts))
    return words.hashes()[words.codes], words.offsets


def greedy_tiles(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of the tiles of two token sequences: the longest match first, then the earliest."""
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles, size = [], max(least, min(len(item), len(doc)))
    while True:
        found = [(-n, i, j) for n, i, j in _matches(item, doc, free_item, free_doc, size)]
        heapq.heapify(found)
        while found:
            n, i, j = heapq.heappop(found)
            n = -n
            free = free_item[i : i + n] & free_doc[j : j + n]
            if free.all():
                tiles.append((i, j, n))
                free_item[i : i + n] = free_doc[j : j + n] = False
                continue
            # what earlier tiles left of the match is a match of its own
            edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
            for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if y - x >= size:
                    heapq.heappush(found, (x - y, i + x, j + x))
        if size == least:
            return tiles
        size = max(least, size // 2)


def _matches(item: np.ndarray, doc: np.ndarray, free_item: np.ndarray, free_doc: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, place, place) of at least ``size`` unmarked tokens, by hashes of that length."""
    if size > min(len(item), len(doc)):
        return []
    open_item = np.flatnonzero(np.convolve(free_item, np.ones(size, int), "valid") == size)
    open_doc = np.flatnonzero(np.convolve(free_doc, np.ones(size, int), "valid") == size)
    if not len(open_item) or not len(open_doc):
        return []
    own, other = grams(item, size)[open_item], grams(doc, size)[open_doc]
    hits = np.flatnonzero(np.isin(other, own))
    places: dict[int, list[int]] = {}
    for i, h in zip(open_item.tolist(), own.tolist(), strict=True):
        places.setdefault(h, []).append(i)
    out, last = [], {}
    for j, h in zip(open_doc[hits].tolist(), other[hits].tolist(), strict=True):
        for i in places[h]:
            if last.get(j - i, -1) > j:  # within the match found on this diagonal
                continue
            n = 0
            while i + n < len(item) and j + n < len(doc) and free_item[i + n] and free_doc[j + n] and item[i + n] == doc[j + n]:
                n += 1
            if n >= size:
                out.append((n, i, j))
                last[j - i] = j + n
    return out


def _items(least: int):
    """Items with their tokens and distinct seeds; a short item's seed is the hash of all its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                hashes, offsets = tokens(part.column("text"))
                own = [hashes[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
                seeds = [np.unique(grams(x, least)) if len(x) >= least else whole_hash(x) for x in own]
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").cast(pa.int64()), pa.array([len(x) for x in own], pa.int32()), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([x.view(np.int64) for x in seeds], pa.list_(pa.int64()))],
                    names=["item_id", "n", "tokens", "seeds"],
                )

    return run


def whole_hash(tokens_: np.ndarray) -> np.ndarray:
    """One hash of all tokens, none of no tokens."""
    return grams(tokens_, len(tokens_)) if len(tokens_) else np.zeros(0, np.uint64)


def _held(least: int, known):
    """Of each text the tokens under seeds that the benchmark has (all seeds if ``known`` is None), and these seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = None if known is None else known.value
        for batch in batches:
            for part in chunks(batch):
                hashes, offsets = tokens(part.column("text"))
                at, text = within(offsets, least)
                seeds = grams(hashes, least)[at] if len(at) else np.zeros(0, np.uint64)
                if keys is not None:
                    hit = _among(seeds, keys)
                    at, text, seeds = at[hit], text[hit], seeds[hit]
                rows, texts, ids = [], part.column("text"), part.column("doc_id").to_pylist()
                for i in np.unique(text).tolist():
                    a, b = np.searchsorted(text, [i, i + 1])
                    covered = np.unique((at[a:b][:, None] + np.arange(least)).ravel())
                    # runs of tokens under seeds, kept apart by tokens that no item has
                    cut = np.flatnonzero(np.diff(covered) > 1) + 1
                    rows.append((i, np.insert(hashes[covered], cut, np.uint64(0)), np.unique(seeds[a:b])))
                for i in np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < least)).tolist():
                    own = hashes[offsets[i] : offsets[i + 1]]
                    if keys is None or _among(whole_hash(own), keys).any():
                        rows.append((i, own, whole_hash(own)))
                if rows:
                    key = [hashlib.sha256(texts[i].as_py().encode()).hexdigest() for i, _, _ in rows]
                    n = np.diff(offsets)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[i] for i, _, _ in rows], pa.int64()), pa.array(key), pa.array([int(n[i]) for i, _, _ in rows], pa.int32()), pa.array([x.tobytes() for _, x, _ in rows], pa.binary()), pa.array([x.view(np.int64) for _, _, x in rows], pa.list_(pa.int64()))],
                        names=["doc_id", "key", "n", "tokens", "seeds"],
                    )

    return run


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values the sorted keys hold."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _tiled(least: int, threshold: float):
    """Pairs of a document's and an item's tokens to the coverage that tiles reach, if it is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "item_id", "coverage", "tiles", "covered", "item_tokens"]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
        for batch in batches:
            rows = []
            for doc, key, n, text, item, tokens_ in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "n", "tokens", "item_id", "item_tokens")), strict=True):
                own, other = np.frombuffer(tokens_, np.uint64), np.frombuffer(text, np.uint64)
                if len(own) < least:
                    tiles = [(0, 0, len(own))] if n == len(own) and (own == other).all() else []
                else:
                    tiles = greedy_tiles(own, other, least)
                covered = sum(t[2] for t in tiles)
                if tiles and covered >= threshold * len(own):
                    rows.append((doc, key, item, covered / len(own), len(tiles), covered, len(own)))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def _found(docs: DataFrame, benchmark: DataFrame, least: int, threshold: float) -> DataFrame:
    items = written(benchmark.select("item_id", "text").mapInArrow(_items(least), ITEMS).where("n > 0").withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = written(items.select("item", "n", F.explode("seeds").alias("h")), "seeds")
    distinct = seeds.select("h").distinct()
    known = None
    if distinct.count() <= BROADCAST_SEEDS:
        found = distinct.toArrow().column("h").to_numpy().view(np.uint64)  # at most BROADCAST_SEEDS
        known = docs.sparkSession.sparkContext.broadcast(np.sort(found))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_held(least, known), HELD)
    held = written(held.withColumn("doc", F.monotonically_increasing_id()), "held")
    shared = held.select("doc", F.explode("seeds").alias("h")).join(seeds, "h").groupBy("doc", "item", F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("k"))
    # tiles that cover the threshold of n tokens hold one seed for each ``least`` of them at least
    pairs = written(shared.where(F.col("k") >= F.when(F.col("size") < least, 1).otherwise(F.ceil(F.col("size") * threshold / least))).select("doc", "item"), "pairs")
    joined = pairs.join(held.select("doc", "doc_id", "key", "n", "tokens"), "doc").join(items.select("item", "item_id", F.col("tokens").alias("item_tokens")), "item")
    return joined.select("doc_id", "key", "n", "tokens", "item_id", "item_tokens").mapInArrow(_tiled(least, threshold), FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item whose tiles cover at least ``threshold`` of the item."""
    return _found(docs, benchmark, least, threshold).drop("key")


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item, all columns as they were: texts tell them, so ids need not."""
    keys = written(_found(docs, benchmark, least, threshold).select("key").distinct(), "keys")
    gone = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return docs.join(gone, F.sha2(docs["text"], 256) == gone["key"], "left_anti")
