"""Best-fit packing of token sequences by bin completion with branch and bound.

Documents become token ids and an end id; a text longer than the capacity is cut into pieces of exactly the capacity and
a shorter last one. Full pieces are sequences of their own. The others are dealt at random into groups of a bounded
number of pieces; each group is packed by itself. Best fit, largest pieces first, is the group's incumbent packing; where it needs
more than the lower bound, bins are completed: around the largest piece left, fillings of the rest are enumerated, the
best-fit filling first, those dominated by another are passed over (a piece, or two, could give way to one piece that is
left and no smaller), and those that waste more than the best so far are cut off. A sequence's search ends at no waste,
after ``NODES`` fillings, or, after half of them, at a waste of which an optimum may hold as much. The better of the two
packings is taken. That the search is bounded may cost sequences: ``gap`` tells how many more a packing has than the lower
bound (README: measured on whole tables).

Defined results: a null or empty text is the end id alone; repeated rows are separate documents; an empty table gives an
empty result; columns besides doc_id and text are left out.
"""

from __future__ import annotations

import bisect
import itertools
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .words import chunks, split

CAPACITY = 4096
#: Pieces that one group holds on average: what bounds a packing task.
GROUP = 16_384
#: Fillings looked at for one sequence before the incumbent is taken.
NODES = 400
#: Words (of those that differ in more than case and marks at the end) whose ids a worker remembers, from task to task.
MEMORY = 300_000
#: Bytes of text whose distinct words are encoded together.
ENCODE_BYTES = 32_000_000
PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters that no normal form changes but in case, with marks after them that end a word.
_ENDED = re.compile("([!-\xff]*[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff])([!-/:-@[-`{-~]*)")


def parts(word: str) -> list[str]:
    """The word in lower case, and marks at its end apart: the tokenizer ignores case and parts marks from letters too."""
    found = _ENDED.fullmatch(word)
    if not found or "<|" in word:  # there may be a name of a special token
        return [word]
    stem, marks = found.groups()
    return [stem.lower(), marks] if marks else [stem.lower()]


class Encoder:
    """Ids of many words. The tokenizer drops white space and never looks across it, so words are encoded apart."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; its threads would only hold memory
        from tokenizers import Tokenizer

        self.model, self.known = Tokenizer.from_file(path), {}

    def __call__(self, vocab: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words, one after another, and the number of each."""
        known, flat, first = self.known, [], []
        for w in vocab:
            first.append(len(flat))
            flat += parts(w)
        new = [w for w in dict.fromkeys(flat) if w not in known]
        fresh: dict[str, list[int]] = {}
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            fresh.update(zip(part, (e.ids for e in self.model.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        out = [known[w] if w in known else fresh[w] for w in flat]
        if len(known) + len(new) > MEMORY:
            known.clear()
            known.update(itertools.islice(zip(flat, out, strict=True), MEMORY))
        else:
            known.update(fresh)
        counts = np.fromiter(map(len, out), np.int64, len(out))
        ids = np.fromiter(itertools.chain.from_iterable(out), np.uint32, counts.sum())
        return ids, np.add.reduceat(counts, first) if first else counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder: workers are used for many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part in chunks(batch, limit=ENCODE_BYTES):
                words = split(part.column("text"))
                ids, counts = encode(words.vocab.to_pylist())
                first = np.concatenate([[0], np.cumsum(counts)])
                docs, copies = part.column("doc_id").to_pylist(), part.column("copy").to_pylist()
                rows = []
                for i, (doc, copy) in enumerate(zip(docs, copies, strict=True)):
                    codes = words.codes[words.offsets[i] : words.offsets[i + 1]]
                    n = counts[codes]
                    total = int(n.sum())
                    tokens = np.empty(total + 1, "<u4")
                    at = np.repeat(first[codes] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n)
                    tokens[:total] = ids[at + np.arange(total)]
                    tokens[total] = end_id
                    for k, start in enumerate(range(0, total + 1, capacity)):
                        own = tokens[start : start + capacity]
                        rows.append((doc, copy, k, start, len(own), zlib.crc32(own.tobytes())))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "copy", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece. copy tells repeated document ids apart."""
    rows = docs.select("doc_id", "text").withColumn("copy", F.monotonically_increasing_id())
    return rows.mapInArrow(_pieces(path or tokenizer_path(), end_id, capacity), PIECES)


class Filling:
    """Bins of a capacity for whole lengths, as branch and bound completes them."""

    def __init__(self, lengths: np.ndarray, capacity: int, nodes: int = NODES) -> None:
        self.capacity, self.nodes = capacity, nodes
        self.left = np.bincount(lengths, minlength=capacity + 1)
        self.left = self.left.tolist()
        self.sizes = [size for size, n in enumerate(self.left) if n and size]

    def _largest(self, room: int) -> int:
        """Largest length in stock that fits, else 0."""
        i = bisect.bisect_right(self.sizes, room) - 1
        while i >= 0 and not self.left[self.sizes[i]]:
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def _dominated(self, taken: list[int], room: int) -> bool:
        """Whether one piece left in stock could stand in for one piece, or two, of the filling and be no smaller."""
        if self._largest(room):
            return True
        for i, x in enumerate(taken):
            if room and self._largest(x + room) > x:
                return True
            for y in taken[i + 1 :]:
                if self._largest(x + y + room) >= x + y:
                    return True
        return False

    def complete(self, allowed: int) -> list[int]:
        """Takes the largest length in stock and the best filling found around it."""
        top = self._largest(self.capacity)
        self.left[top] -= 1
        best: list[int] = []
        best_waste, budget = self.capacity - top + 1, self.nodes
        taken: list[int] = []
        # a first look for no waste at all; the bound on an optimum's waste ends the search once half the nodes are used
        tolerated = 0

        def descend(room: int, cap: int) -> None:
            # lengths fall along a path
            nonlocal best, best_waste, budget, tolerated
            budget -= 1
            if budget == self.nodes // 2:
                tolerated = min(allowed, self.capacity // 64)
            size = self._largest(min(room, cap))
            if size == 0:
                if room < best_waste and not self._dominated(taken, room):
                    best, best_waste = list(taken), room
                return
            while size:
                if best_waste <= tolerated or budget <= 0:
                    return
                taken.append(size)
                self.left[size] -= 1
                if room == size:
                    best, best_waste = list(taken), 0
                else:
                    descend(room - size, size)
                self.left[size] += 1
                taken.pop()
                if best_waste <= tolerated:
                    return
                size = self._largest(size - 1)

        descend(self.capacity - top, self.capacity)
        for size in best:
            self.left[size] -= 1
        for size in {top, *best}:
            if not self.left[size]:
                self.sizes.pop(bisect.bisect_left(self.sizes, size))
        return [top, *best]

    def bins(self) -> list[list[int]]:
        total = sum(size * self.left[size] for size in self.sizes)
        slack = math.ceil(total / self.capacity) * self.capacity - total  # waste that an optimum may hold
        out = []
        while self.sizes:
            out.append(made := self.complete(slack))
            slack = max(0, slack - self.capacity + sum(made))
        return out


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit, largest first: each length goes where least room is left."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room that they have
    open_, bins = 0, []  # bit r of open_: some bin has room r
    for size in sorted(lengths.tolist(), reverse=True):
        wide = open_ >> size
        if wide:
            room = size + (wide & -wide).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_ &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(size)
        by_room[room - size].append(b)
        open_ |= 1 << (room - size)
    return bins


def packed(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The better of best fit and bin completion; the latter is tried only where the former is above the lower bound."""
    incumbent = best_fit(lengths, capacity)
    if len(incumbent) * capacity - int(lengths.sum()) < capacity:
        return incumbent
    completed = Filling(lengths, capacity).bins()
    return completed if len(completed) < len(incumbent) else incumbent


def gap(packing: DataFrame, capacity: int = CAPACITY) -> int:
    """Sequences above the lower bound, the tokens over the capacity."""
    sums = packing.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    return sums["sequences"] - -(-sums["tokens"] // capacity)


def fill(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length."""
    order = np.argsort(lengths, kind="stable")
    stacks = {int(size): list(order[a:b]) for size, a, b in zip(*_runs(lengths[order]), strict=True)}
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, made in enumerate(packed(lengths, capacity)):
        at = 0
        for size in made:
            i = stacks[size].pop()
            bins[i], offsets[i] = b, at
            at += size
    return bins, offsets


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[starts], starts, np.concatenate([starts[1:], [len(values)]]) if len(values) else starts


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces of all documents with sequence_id and offset."""
    made = written(pieces(docs, path, end_id, capacity), "pieces")
    counted = made.agg(F.sum((F.col("length") < capacity).cast("long"))).first()[0] or 0
    groups = max(1, math.ceil(counted / group))
    dealt = F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(groups)).cast("long")

    def place(key, frame):
        bins, offsets = fill(frame["length"].to_numpy(), capacity)
        # ids of a group start at a multiple of 2^32, those of whole pieces are negative
        return frame.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)[["doc_id", "copy", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    short = made.where(F.col("length") < capacity).withColumn("dealt", dealt)
    packed = short.groupBy("dealt").applyInPandas(place, PIECES + ", sequence_id long, offset long")
    whole = made.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(whole).drop("copy")
