"""Removal of repeated passages with Aho-Corasick automata over words.

A window is ``size`` consecutive words of a document. Every word under a window that also starts in a document with a
smaller id goes. Three steps:

1. Confirm. Texts with equal words are one text. Of every window, the least hash of its runs of ``anchor`` words is its
   anchor, so equal windows have equal anchors at equal places; neighbouring windows mostly share theirs. The words under
   the windows of an anchor are a stretch. Anchors of two documents at least recur, and their stretches are cut out once.
   A passage is a run of windows of the first holder's stretch that another stretch of the anchor holds too: all of it
   where another document has an equal stretch, else the common part, found by the windows' first holders.
2. Compile. Passages are dealt to shards by their anchors, so that a shard has about ``AUTOMATON_WORDS`` words, and become
   automata over word numbers, each passage with the id of its first holder. Passages of an anchor that has more go to
   several automata.
3. Stream. All documents' recurring stretches run through the automata of their anchor's shard; stretches of a hot anchor
   are dealt to several copies of its automaton. What is removed are the occurrences that the automata find, where the
   first holder has a smaller id; the documents are then written without them.

Keys pair two 64-bit hashes. No step gathers the holders of a passage: counts and first holders are sums and minima.

Defined results: words are runs of anything but space and U+0009..U+000D, unchanged; null, empty and short texts keep all
words; rows of one doc_id are judged each by itself and never make each other repeats; rows without a doc_id keep all
words and repeat nothing; an empty table gives an empty result; columns besides doc_id and text are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import forget, written
from .words import MIX, chunks, grams, mixed, split, windows

SIZE = 50
ANCHOR = 12
#: Words of the passages that one automaton holds, and stretches that a copy of it is to meet, on average.
AUTOMATON_WORDS, STRETCHES = 100_000, 20_000
#: Document ids that are broadcast as a filter, at most (8 bytes each).
BROADCAST_IDS = 500_000
FACTS = "doc_id long, s1 long, s2 long, n_words long, sha string"
ROWS = "a long, span long, doc_id long, s1 long, lo int, hi int"
STRETCH = "a long, span long, doc_id long, s1 long, lo int, own boolean, repeated boolean, several boolean, words binary"
WINDOWS = "a long, h long, doc_id long, s1 long, lo int, start int"
PASSAGE = "a long, owner long, n long, words binary"
HITS = "doc_id long, s1 long, lo int, hi int"
KEPT = "doc_id long, s1 long, n_removed long, sha string"


def _each(part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per row: its number, its words' hashes and codes."""
    words = split(part.column("text"))
    table = words.hashes()
    for i, (a, b) in enumerate(zip(words.offsets.tolist(), words.offsets[1:].tolist(), strict=False)):
        codes = words.codes[a:b]
        yield i, table[codes] if len(table) else np.zeros(0, np.uint64), codes


def _whole(hashes: np.ndarray) -> tuple[int, int]:
    """Two hashes of a sequence."""
    if not len(hashes):
        return 0, 0
    other = mixed(hashes ^ np.uint64(0xD6E8FEB86659FD93))
    return int(windows(hashes, len(hashes))[0]), int(windows(other, len(other))[0])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            words = split(part.column("text"))
            table, vocab = words.hashes(), np.array(words.vocab.to_pylist(), object)
            one, two, n, sha = [], [], [], []
            for a, b in zip(words.offsets.tolist(), words.offsets[1:].tolist(), strict=False):
                codes = words.codes[a:b]
                x, y = _whole(table[codes]) if b > a else (0, 0)
                one.append(x)
                two.append(y)
                n.append(b - a)
                sha.append(hashlib.sha256(" ".join(vocab[codes]).encode()).hexdigest() if b > a else hashlib.sha256(b"").hexdigest())
            as64 = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), as64(one), as64(two), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "s1", "s2", "n_words", "sha"])


def _anchored(size: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = size - anchor + 1
        inverse = np.uint64(pow(int(MIX), -1, 1 << 64))
        for batch in batches:
            for part in chunks(batch):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                out: list[list] = [[] for _ in range(6)]
                for i, hashes, _ in _each(part):
                    if len(hashes) < size:
                        continue
                    runs = grams(hashes, anchor)
                    least = np.lib.stride_tricks.sliding_window_view(runs, wide).argmin(1) + np.arange(len(runs) - wide + 1)
                    lo = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                    hi = np.concatenate([lo[1:] - 1, [len(least) - 1]])
                    with np.errstate(over="ignore"):
                        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes) - 1, MIX)]), dtype=np.uint64)
                        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes) * power, dtype=np.uint64)])
                        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes) - 1, inverse)]), dtype=np.uint64)
                        spans = mixed((total[hi + size] - total[lo]) * back[lo] + (hi - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
                    key = _whole(hashes)[0]
                    out[0].append(runs[least[lo]])
                    out[1].append(spans)
                    out[2].append(np.full(len(lo), ids[i], np.int64))
                    out[3].append(np.full(len(lo), key, np.uint64))
                    out[4].append(lo.astype(np.int32))
                    out[5].append(hi.astype(np.int32))
                if out[0]:
                    cols = [np.concatenate(x) for x in out]
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cols], names=["a", "span", "doc_id", "s1", "lo", "hi"])

    return run


def _cut(size: int):
    """The stretches that are asked of each text, with the hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                ids, asked = part.column("doc_id").to_pylist(), part.column("asked").to_pylist()
                rows = []
                for i, hashes, _ in _each(part):
                    key = int(np.uint64(_whole(hashes)[0]).view(np.int64))
                    rows += [(x["a"], x["span"], ids[i], key, x["lo"], x["own"], x["repeated"], x["several"], hashes[x["lo"] : x["hi"] + size].tobytes()) for x in asked[i] if x["s1"] == key]
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.bool_()] * 3 + [pa.binary()]
                    names = ["a", "span", "doc_id", "s1", "lo", "own", "repeated", "several", "words"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _taken_apart(size: int):
    """The windows of stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [windows(np.frombuffer(x, np.uint64), size) for x in batch.column("words").to_pylist()]
            counts = np.array([len(x) for x in found])
            row, starts = np.repeat(np.arange(len(found)), counts), np.concatenate([np.arange(n) for n in counts])
            held = batch.select(["a", "doc_id", "s1", "lo"]).take(pa.array(row))
            a, doc, s1, lo = held.columns
            yield pa.RecordBatch.from_arrays([a, pa.array(np.concatenate(found).view(np.int64)), doc, s1, lo, pa.array((lo.to_numpy() + starts).astype(np.int32))], names=["a", "h", "doc_id", "s1", "lo", "start"])

    return run


def runs(starts: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    first = last = None
    for x in sorted(starts):
        if last is not None and x != last + 1:
            yield first, last
            first = x
        first, last = x if first is None else first, x
    if last is not None:
        yield first, last


def _passages(size: int):
    """Passages of the first holders' stretches: whole ones, and the runs of windows that others hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for a, doc, lo, repeated, common, words in zip(*(batch.column(c).to_pylist() for c in ("a", "doc_id", "lo", "repeated", "common", "words")), strict=True):
                if repeated:
                    rows.add((a, doc, words))
                for starts in common or ():
                    rows |= {(a, doc, words[8 * (x - lo) : 8 * (y - lo + size)]) for x, y in runs(starts)}
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([len(x) // 8 for x in cols[2]], pa.int64()), pa.array(cols[2], pa.binary())], names=["a", "owner", "n", "words"])

    return run


class Shard:
    """An automaton of passages (word hashes), each with its first holder."""

    def __init__(self, passages: dict[bytes, int]) -> None:
        import ahocorasick

        every = [np.frombuffer(x, np.uint64) for x in passages]
        self.words = np.unique(np.concatenate(every))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for hashes, owner in zip(every, passages.values(), strict=True):
            self.automaton.add_word(tuple(np.searchsorted(self.words, hashes).tolist()), (len(hashes), owner))
        self.automaton.make_automaton()

    def find(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, start, end, first holder) of all occurrences."""
        lengths = np.array([len(x) // 8 for x in texts])
        hashes = np.frombuffer(b"".join(texts), np.uint64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        codes = np.where(self.words[at] == hashes, at, len(self.words))  # a word of no passage ends every match
        edges = np.concatenate([[0], np.cumsum(lengths)])
        parted = np.insert(codes, edges[1:-1], len(self.words))  # as does the end of a text
        edges = edges + np.arange(len(edges))
        text = -1
        for end, (n, owner) in self.automaton.iter(tuple(parted.tolist())):
            if text < 0 or end >= edges[text + 1]:
                text = int(np.searchsorted(edges, end, "right")) - 1
            yield text, int(end + 1 - n - edges[text]), int(end + 1 - edges[text]), owner


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by copy of a shard, passages (doc_id null) first, to the parts of texts that passages of smaller ids cover."""
    now, passages, shard = None, {}, None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("shard", "part", "copy")])
        owner, doc, s1, lo, words = (batch.column(c).to_pylist() for c in ("owner", "doc_id", "s1", "lo", "words"))
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if now != (key := tuple(keys[:, a].tolist())):
                now, passages, shard = key, {}, None
            first = next((i for i in range(a, b) if doc[i] is not None), b)
            for i in range(a, first):
                passages[words[i]] = min(owner[i], passages.get(words[i], owner[i]))
            if first == b or not passages:
                continue
            shard = shard or Shard(passages)
            covered: dict[int, list[tuple[int, int]]] = {}
            for text, x, y, holder in shard.find(words[first:b]):
                if holder < doc[first + text]:
                    covered.setdefault(first + text, []).append((lo[first + text] + x, lo[first + text] + y))
            rows = [(doc[i], s1[i], x, y) for i, found in covered.items() for x, y in joined(found)]
            if rows:
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "s1", "lo", "hi"])


def joined(parts: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The union of half-open intervals."""
    now = None
    for x, y in sorted(parts):
        if now and x <= now[1]:
            now = (now[0], max(now[1], y))
        else:
            if now:
                yield now
            now = (x, y)
    if now:
        yield now


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the parts that are cut from them."""
    for batch in batches:
        for part in chunks(batch):
            words = split(part.column("text"))
            table, vocab = words.hashes(), np.array(words.vocab.to_pylist(), object)
            ids, cuts, keys, gone, sha = part.column("doc_id").to_pylist(), part.column("cuts").to_pylist(), [], [], []
            for a, b, mine in zip(words.offsets.tolist(), words.offsets[1:].tolist(), cuts, strict=False):
                codes = words.codes[a:b]
                key = int(np.uint64(_whole(table[codes])[0]).view(np.int64)) if b > a else 0
                kept = np.ones(b - a, bool)
                for c in mine:
                    if c["s1"] == key:
                        kept[c["lo"] : c["hi"]] = False
                keys.append(key)
                gone.append(b - a - int(kept.sum()))
                sha.append(hashlib.sha256(" ".join(vocab[codes[kept]]).encode() if kept.any() else b"").hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "s1", "n_removed", "sha"])


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = written(ids.distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def stretches(docs: DataFrame, facts: DataFrame, size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """The stretches of recurring anchors, cut out of their texts; own: of the first holder; repeated: others have it whole."""
    first = facts.where(F.col("n_words") >= size).groupBy("s1", "s2", "n_words").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    rows = written(_only(docs, first).mapInArrow(_anchored(size, anchor), ROWS), "anchors")
    # sums are written before they are joined: a join of plain tables splits the rows of one hot anchor among tasks
    recur = written(rows.groupBy("a").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("a"), "recur")
    shared = written(rows.join(recur, "a"), "recurring")
    forget(rows, recur)
    holders = written(shared.groupBy("a", "span").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")), "holders")
    several = written(holders.groupBy("a").agg(F.count(F.lit(1)).alias("spans")), "spans")
    told = shared.join(holders, ["a", "span"]).join(several, "a")
    told = told.select("doc_id", F.struct("a", "span", "s1", "lo", "hi", (F.col("owner") == F.col("doc_id")).alias("own"), (F.col("owner") < F.col("last")).alias("repeated"), (F.col("spans") > 1).alias("several")).alias("x"))
    asked = written(told.groupBy("doc_id").agg(F.collect_list("x").alias("asked")), "asked")  # bounded by the text
    cut = written(docs.join(asked, "doc_id").mapInArrow(_cut(size), STRETCH), "stretches")
    forget(shared, holders, several, asked)
    return cut


def passages(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """(a, owner, n, words): the recurring passages, from their first holders' stretches."""
    apart = written(cut.where("own and several").mapInArrow(_taken_apart(size), WINDOWS), "windows")
    place = F.struct("doc_id", "s1", "lo", "start")
    holders = written(apart.groupBy("a", "h").agg(F.min(place).alias("o"), F.max("doc_id").alias("last")).where("o.doc_id < last").drop("last"), "firsts")
    hits = apart.join(holders, ["a", "h"]).where("o.doc_id < doc_id")
    # the windows of one anchor that a stretch shares with a first holder's; at most as many as an anchor has
    common = hits.groupBy("a", "doc_id", "s1", "lo", F.col("o.doc_id").alias("od"), F.col("o.s1").alias("os"), F.col("o.lo").alias("ol")).agg(F.sort_array(F.collect_set("o.start")).alias("starts"))
    common = common.select("a", F.col("od").alias("doc_id"), F.col("os").alias("s1"), F.col("ol").alias("lo"), "starts").distinct()
    common = written(common.groupBy("a", "doc_id", "s1", "lo").agg(F.collect_set("starts").alias("common")), "common")  # subsets of one stretch's windows
    forget(apart, holders)
    own = cut.where("own and (repeated or several)").join(common, ["a", "doc_id", "s1", "lo"], "left").where("repeated or common is not null")
    found = written(own.mapInArrow(_passages(size), PASSAGE).groupBy("a", "n", "words").agg(F.min("owner").alias("owner")), "passages")
    forget(common)
    return found


def occurrences(cut: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, s1, lo, hi): what passages of smaller ids cover, by streaming the stretches through the shards' automata."""
    sums = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    anchors = written(found.groupBy("a").agg(F.ceil(F.sum("n") / AUTOMATON_WORDS).cast("int").alias("parts")), "anchors")
    texts = written(cut.join(anchors, "a").select("a", "parts", "doc_id", "s1", "lo", "words"), "texts")
    shards = max(1, -(-int(sums["words"]) // AUTOMATON_WORDS), -(-texts.count() // STRETCHES))
    shard = F.pmod(F.xxhash64("a"), F.lit(shards)).alias("shard")
    # a shard that many stretches go to has several copies
    copies = written(texts.groupBy(shard).agg(F.ceil(F.count(F.lit(1)) / (2 * STRETCHES)).cast("int").alias("copies")), "copies")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = lambda kind: F.lit(None).cast(kind)
    held = found.join(anchors, "a").withColumn("shard", shard).withColumn("part", F.pmod(F.xxhash64("words"), F.col("parts")).cast("int")).join(copies, "shard").withColumn("copy", each("copies"))
    held = held.select("shard", "part", "copy", "owner", none("long").alias("doc_id"), none("long").alias("s1"), none("int").alias("lo"), "words")
    sent = texts.withColumn("shard", shard).withColumn("part", each("parts")).join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("doc_id", "lo"), F.col("copies")).cast("int"))
    sent = sent.select("shard", "part", "copy", none("long").alias("owner"), "doc_id", "s1", "lo", "words")
    rows = held.unionByName(sent).repartition("shard", "part", "copy").sortWithinPartitions("shard", "part", "copy", F.col("doc_id").asc_nulls_first())
    hits = written(rows.mapInArrow(_streamed, HITS), "hits")
    forget(texts, anchors, copies)
    return hits


def without_repeats(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = every.where("doc_id is not null")
    facts = written(every.mapInArrow(_facts, FACTS), "facts")
    cut = stretches(docs, facts.where("doc_id is not null"), size, anchor)
    found = passages(cut, size)
    cuts = written(occurrences(cut, found).groupBy("doc_id").agg(F.collect_list(F.struct("s1", "lo", "hi")).alias("cuts")), "cuts")  # bounded by the text
    forget(cut, found)
    kept = docs.join(cuts, "doc_id").mapInArrow(_without, KEPT)
    kept = written(kept.groupBy("doc_id", "s1").agg(F.max("n_removed").alias("n_removed"), F.max_by("sha", "n_removed").alias("kept")), "kept")
    whole = written(facts.where(F.col("n_words") >= size).groupBy("s1", "s2", "n_words").agg(F.min("doc_id").alias("first")), "whole")
    joined = facts.join(whole, ["s1", "s2", "n_words"], "left").join(kept, ["doc_id", "s1"], "left")
    copy = F.col("first") < F.col("doc_id")
    return joined.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
