"""Document log-likelihood by a gated recurrent language model with a class-factored softmax.

Word counts over all training texts give the vocabulary: the most frequent words are the shortlist, in classes of equal
size by rank; all other words fall into tail classes by their first and last letters. The network predicts the class, and
a shortlist class its word; within a tail class words have their smoothed share (c + 0.1) / (n + 0.1 (v + 1)) of all
training counts, unseen words c = 0. The probabilities of a next token sum to one. The state runs through a whole
document, window after window, from its first word to the end token.

Counts, shortlist and classes cover all training texts. The weights are trained in numpy by truncated backpropagation on
all of their tokens, end tokens included, the state carried through a text. Each partition makes a pass from the same
weights, and the average by tokens is where the next pass starts; the driver gets the summed weights only, so its share
does not grow with the input. A document's score needs only the weights, the counts of its own rare words (a join) and
those of the ``HEAD`` most frequent.

Defined results: a null, empty or blank text is the end token alone; repeated rows are scored each; without training
texts every token has count 0 and the weights are those of the start; an empty table gives an empty result; columns
besides doc_id and text are left out.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .optim import Adam, by_gate, gru_next, gru_run, gru_run_back
from .scratch import written
from .tops import most_frequent
from .words import chunks, split

SHORT, CLASSES, TAILS = 2048, 32, 32
HEAD = 65_536
#: State size; streams and tokens of one update; updates of a chunk at least; passes over the training texts.
UNITS, STREAMS, SPAN, LEAST_UPDATES, EPOCHS = 24, 256, 24, 16, 1
SCORE_BYTES = 8_000_000
#: Tokens whose softmax is taken at a time.
FLUSH = 40_000
#: Rows into which the weights of a partition are cut for their sum.
BLOCKS = 64
END = np.uint64(0xE4D0FF5EED000001)
SMOOTH = 0.1
COUNTS = "h long, k int, n long"
WEIGHTS = "block int, tokens long, weights binary"
SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, rare array<long>, times array<int>"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 10 == 0


def tails(vocab: pa.Array) -> np.ndarray:
    """Tail class of each word: by its first and last two letters."""
    if not len(vocab):
        return np.zeros(0, np.int64)
    vocab = vocab.cast(pa.large_string())
    ends = pc.binary_join_element_wise(pc.utf8_slice_codeunits(vocab, 0, 1), pc.utf8_slice_codeunits(vocab, -2, None), pa.scalar("", pa.large_string())).dictionary_encode()
    of_end = [sum(ord(c) * p for c, p in zip(x, (7, 31, 101), strict=False)) % TAILS for x in ends.dictionary.to_pylist()]
    return np.array(of_end, np.int64)[ends.indices.to_numpy(zero_copy_only=False)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, limit=SCORE_BYTES):
            words = split(part.column("text"), lower=True)
            n = np.bincount(words.codes, minlength=len(words.vocab))
            h, k = np.append(words.hashes(), END), np.append(tails(words.vocab), 0)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k.astype(np.int32)), pa.array(np.append(n, part.num_rows).astype(np.int64))], names=["h", "k", "n"])


class Vocabulary:
    """Bounded facts about the counts: shortlist, head, and sums by tail class."""

    def __init__(self, counts: DataFrame) -> None:
        top = most_frequent(counts, HEAD).toPandas().sort_values(["n", "h"], ascending=[False, True])
        h = top["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        self.head, self.head_n = h[order], top["n"].to_numpy(np.int64)[order]
        rank = np.full(len(h), -1, np.int64)
        rank[: SHORT] = np.arange(min(SHORT, len(h)))
        self.head_short = rank[order]  # place in the shortlist, -1 outside
        self.short_n = top["n"].to_numpy(np.int64)[:SHORT]
        sums = {r["k"]: (r["n"], r["v"]) for r in counts.groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}  # one row per tail class
        self.total, self.distinct = sum(x[0] for x in sums.values()), sum(x[1] for x in sums.values())
        self.tail_n, self.tail_v = np.zeros(TAILS), np.zeros(TAILS)
        for k, (n, v) in sums.items():
            self.tail_n[k] += n
            self.tail_v[k] += v
        for n, k in zip(top["n"][:SHORT], top["k"][:SHORT], strict=True):
            self.tail_n[k] -= n
            self.tail_v[k] -= 1
        self.tail_z = np.log10(self.tail_n + SMOOTH * (self.tail_v + 1))
        self.base_z = math.log10(self.total + SMOOTH * (self.distinct + 1))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (-1: not in the head) and place in the shortlist (-1: none) of each hash."""
        if not len(self.head):
            return np.full(len(h), -1), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        hit = self.head[at] == h
        return np.where(hit, self.head_n[at], -1), np.where(hit, self.head_short[at], -1)


def _tamed(logits: np.ndarray) -> None:
    """Logits are taken between -60 and 60, where no sum overflows."""
    if max(logits.max(), -logits.min()) > 60:
        np.clip(logits, -60, 60, out=logits)


def _log_share(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax of one entry of each row."""
    _tamed(logits)
    own = logits[np.arange(len(at)), at]
    return own - np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype))


class Network:
    """Inputs and outputs are numbers below SHORT for shortlist words and SHORT + k for words of tail class k."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s, scale=0.1: (r.standard_normal(s) * scale).astype(np.float32)
        n = np.zeros(SHORT)
        n[: len(vocabulary.short_n)] = vocabulary.short_n
        per = SHORT // CLASSES
        share = np.concatenate([n.reshape(CLASSES, per).sum(1), vocabulary.tail_n]) + 1
        self.p = {
            "e": f(SHORT + TAILS + 1, UNITS), "wx": f(UNITS, 3 * UNITS, scale=UNITS**-0.5), "bx": np.zeros(3 * UNITS, np.float32), "wh": f(UNITS, 3 * UNITS, scale=UNITS**-0.5), "bn": np.zeros(UNITS, np.float32),
            "wc": f(UNITS, CLASSES + TAILS), "bc": np.log(share / share.sum()).astype(np.float32), "ww": f(CLASSES, UNITS, per), "bw": np.log(n.reshape(CLASSES, per) + 0.5).astype(np.float32),
        }
        self.per = per

    def logs(self, h: np.ndarray, out: np.ndarray) -> np.ndarray:
        """log10 of the probability of each output, but for a tail word's share of its class."""
        p = self.p
        kind = np.where(out < SHORT, out // self.per, out - SHORT + CLASSES)
        found = _log_share(h @ p["wc"] + p["bc"], kind)
        order = np.argsort(kind.astype(np.uint8), kind="stable")
        edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        order = order[: edges[-1]]
        own, place, more = h[order], out[order] % self.per, np.empty(len(order), h.dtype)
        for c in range(CLASSES):
            a, b = edges[c], edges[c + 1]
            if a < b:
                more[a:b] = _log_share(own[a:b] @ p["ww"][c] + p["bw"][c], place[a:b])
        found[order] += more
        return found * np.float32(1 / math.log(10))

    def _loss(self, h: np.ndarray, out: np.ndarray, grads: dict) -> np.ndarray:
        """Gradient of the mean negative log-likelihood by h; adds those of the output weights."""
        p, m, ones = self.p, len(out), np.ones(len(out), np.float32)
        kind = np.where(out < SHORT, out // self.per, out - SHORT + CLASSES)

        def softmax(x):
            """In place."""
            _tamed(x)
            np.exp(x, out=x)
            x *= (1 / (x @ np.ones(x.shape[1], x.dtype)))[:, None]
            return x

        d = softmax(h @ p["wc"] + p["bc"])
        d[np.arange(m), kind] -= 1
        d *= np.float32(1 / m)
        grads["wc"], grads["bc"] = h.T @ d, ones @ d
        dh = d @ p["wc"].T
        grads["ww"], grads["bw"] = np.zeros_like(p["ww"]), np.zeros_like(p["bw"])
        order = np.argsort(kind.astype(np.uint8), kind="stable")
        edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        order = order[: edges[-1]]
        own, place, back = h[order], out[order] % self.per, np.empty((len(order), UNITS), h.dtype)
        for c in range(CLASSES):
            a, b = edges[c], edges[c + 1]
            if a < b:
                d = softmax(own[a:b] @ p["ww"][c] + p["bw"][c])
                d[np.arange(b - a), place[a:b]] -= 1
                d *= np.float32(1 / m)
                grads["ww"][c], grads["bw"][c] = own[a:b].T @ d, ones[a:b] @ d
                np.matmul(d, p["ww"][c].T, out=back[a:b])
        dh[order] += back
        return dh

    def train(self, adam: Adam, texts: list[np.ndarray], r: np.random.Generator) -> int:
        """Truncated backpropagation: streams of all tokens of the texts, SPAN at a time, the state carried through a text."""
        order = r.permutation(len(texts))
        out = np.concatenate([texts[i] for i in order])
        starts = np.cumsum([0, *(len(texts[i]) for i in order[:-1])])
        into, fresh = np.roll(out, 1), np.ones(len(out), np.float32)
        into[starts], fresh[starts] = SHORT + TAILS, 0
        streams = max(1, min(STREAMS, len(out) // (SPAN * LEAST_UPDATES)))
        n = len(out) // streams
        for a, b, k in ((0, n * streams, streams), (n * streams, len(out), 1)):  # the few tokens left over are a stream of their own
            x, y, f = (v[a:b].reshape(k, -1).T for v in (into, out, fresh))
            h = np.zeros((k, UNITS), np.float32)
            for at in range(0, len(x), SPAN):
                h = self._update(adam, x[at : at + SPAN], y[at : at + SPAN], f[at : at + SPAN, :, None], h)
        return len(out)

    def copy(self) -> Network:
        made = copy.copy(self)
        made.p = {k: v.copy() for k, v in self.p.items()}
        return made

    def _update(self, adam: Adam, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> np.ndarray:
        p = self.p
        table = by_gate(p["e"] @ p["wx"] + p["bx"])
        states, kept = gru_run(np.take(table, x, axis=1), h, fresh, p["wh"], p["bn"])
        grads: dict = {}
        dh = self._loss(states.reshape(-1, UNITS), y.ravel(), grads).reshape(states.shape)
        flat, grads["wh"], grads["bn"] = gru_run_back(dh, fresh, kept, p["wh"])
        x, wx, ones = x.ravel(), by_gate(p["wx"]), np.ones(x.size, np.float32)
        before = p["e"][x].T
        grads["wx"], grads["bx"] = np.concatenate([before @ f for f in flat], 1), np.concatenate([ones @ f for f in flat])
        order = np.argsort(x.astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.diff(x[order], prepend=-1))
        grads["e"] = (x[order[first]], np.add.reduceat(sum(f @ w.T for f, w in zip(flat, wx, strict=True))[order], first))
        adam.step(grads)
        return states[-1]

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Sum of logs over each text; the state runs through it."""
        p = self.p
        half = np.array([0.5, 0.5, 1], np.float32)[:, None, None]  # as in gru_run
        table, wide = by_gate(p["e"] @ p["wx"] + p["bx"]) * half, by_gate(p["wh"]) * half
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        flat, first = np.concatenate([texts[i] for i in order]), np.concatenate([[0], np.cumsum(lengths[order])[:-1]])
        alive = np.searchsorted(-lengths[order], -np.arange(lengths.max()), "left")  # texts longer than each place
        total = np.zeros(len(texts))
        h = np.zeros((len(texts), UNITS), np.float32)
        into = np.full(len(texts), SHORT + TAILS)
        states, outs, who, held = [], [], [], 0
        for t, n in enumerate(alive.tolist()):
            h = gru_next(np.take(table, into[:n], axis=1), h[:n], wide, p["bn"])
            into = flat[first[:n] + t]
            states.append(h)
            outs.append(into)
            who.append(n)
            held += n
            if held >= FLUSH or t == len(alive) - 1:
                logs = self.logs(np.concatenate(states), np.concatenate(outs)).astype(np.float64)
                at = 0
                for m in who:
                    total[:m] += logs[at : at + m]
                    at += m
                states, outs, who, held = [], [], [], 0
        back = np.empty_like(total)
        back[order] = total
        return back


def numbered(vocabulary: Vocabulary, part: pa.RecordBatch):
    """Per text its output numbers, end token included; and what the vocabulary knows of the chunk's words."""
    words = split(part.column("text"), lower=True)
    h = np.append(words.hashes(), END)
    k = np.append(tails(words.vocab), 0)
    count, short = vocabulary.find(h)
    number = np.where(short >= 0, short, SHORT + k)
    end = len(h) - 1
    codes = [np.append(words.codes[a:b], end) for a, b in zip(words.offsets, words.offsets[1:], strict=False)]
    return codes, number, count, h


def _scored(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, network = held.value
        for batch in batches:
            for part in chunks(batch, limit=SCORE_BYTES):
                codes, number, count, h = numbered(vocabulary, part)
                model = network.score([number[c] for c in codes])
                known_log = np.log10(np.maximum(count, 0) + SMOOTH)
                share = np.where(number >= SHORT, -vocabulary.tail_z[np.maximum(number - SHORT, 0)] + np.where(count >= 0, known_log, 0), 0)
                plain = np.where(count >= 0, known_log, 0) - vocabulary.base_z
                rare, times, known, base = [], [], [], []
                for i, c in enumerate(codes):
                    model[i] += share[c].sum()
                    base.append(plain[c].sum())
                    known.append(int((count[c] > 0).sum()))
                    own, n = np.unique(c[count[c] < 0], return_counts=True)
                    rare.append(h[own].view(np.int64))
                    times.append(n.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid"), part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array([len(c) for c in codes], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(model, pa.float64()), pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))],
                    names=["uid", "doc_id", "held_out", "n_tokens", "known", "base", "model", "rare", "times"],
                )

    return run


def _shard(held, rate: float, seed: int):
    """One pass over the texts of a partition; its weights times its tokens, in BLOCKS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, network = held.value
        network, tokens, r = network.copy(), 0, np.random.default_rng(seed)
        adam = Adam(network.p, rate)
        for batch in batches:
            for part in chunks(batch, limit=SCORE_BYTES):
                codes, number, _, _ = numbered(vocabulary, part)
                if codes:
                    tokens += network.train(adam, [number[c] for c in codes], r)
        if tokens:
            blocks = np.array_split(np.concatenate([network.p[k].ravel() for k in sorted(network.p)]).astype(np.float64) * tokens, BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([tokens] * BLOCKS, pa.int64()), pa.array([x.tobytes() for x in blocks], pa.binary())], names=["block", "tokens", "weights"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in table.column("weights").to_pylist())
    return pa.table({"block": table.column("block")[:1], "tokens": pa.array([sum(table.column("tokens").to_pylist())], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary())})


def fit(train: DataFrame, counts: DataFrame, epochs: int = EPOCHS) -> tuple[Vocabulary, Network]:
    """Vocabulary and weights of all training texts: partitions train side by side, their weights are averaged by tokens after each pass."""
    vocabulary, spark = Vocabulary(counts), train.sparkSession
    network = Network(vocabulary)
    for epoch in range(epochs):
        held = spark.sparkContext.broadcast((vocabulary, network))
        shards = train.select("text").mapInArrow(_shard(held, 4e-3 / (3 if epoch == epochs - 1 else 1), 11 + epoch), WEIGHTS)
        rows = sorted(shards.groupBy("block").applyInArrow(_summed, WEIGHTS).collect())  # BLOCKS rows, the size of the network
        if not rows:
            break
        flat, at, network = np.concatenate([np.frombuffer(r["weights"], np.float64) / r["tokens"] for r in rows]), 0, network.copy()
        for k in sorted(network.p):
            v = network.p[k]
            network.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
    return vocabulary, network


def scored(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every row; learns from the others."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(held_out(F.col("doc_id")) if held is None else held, F.lit(False)))
    train = rows.where(~F.col("held_out"))
    counts = train.select("text").mapInArrow(_counts, COUNTS).groupBy("h").agg(F.first("k").alias("k"), F.sum("n").alias("n"))
    counts = written(counts, "counts")
    vocabulary, network = fit(train, counts)
    held_model = spark.sparkContext.broadcast((vocabulary, network))
    found = written(rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_scored(held_model), SCORED), "scored")
    rare = found.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("h"), F.col("x.times").alias("t"))
    looked = rare.join(counts.select("h", "n"), "h", "left")
    n = F.coalesce("n", F.lit(0))
    sums = looked.groupBy("uid").agg(F.sum(F.col("t") * F.log10(n + SMOOTH)).alias("more"), F.sum(F.when(n > 0, F.col("t")).otherwise(0)).alias("also"))
    more = F.coalesce("more", F.lit(0.0))
    return found.join(sums, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"), F.lit(int(vocabulary.total)).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )
