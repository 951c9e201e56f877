"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input joins the embedding of the word (those of the training sample's vocabulary; others share one) and the mean
embedding of its character n-grams, hashed to buckets, so inflected and unseen forms are known by their parts. The first
coordinate of each starts as the smoothed log-odds of toxic over clean training texts. All windows of ``WINDOW`` words at
steps of ``STRIDE``, overlapping and the last at the text's end, are scored: both directions' states are pooled by
attention and a logistic unit scores the pool. A text's score is that of its most toxic window. Training is multiple-
instance learning in numpy: of a text, the windows that now score highest (and one at random of clean texts) carry its
label, on a sample of at most ``SAMPLE_EACH`` labelled texts of each class and ``SAMPLE_BYTES`` bytes, chosen by a hash of
the id. One executor task learns from the written sample; the driver sees the weights only.

Only text is input to a score. Words are runs of letters and digits in lower case.

Defined results: null, empty and wordless texts have one window without words, scored by the bias; repeated rows are
scored each; labels that are null or of ids without a text are left out, and with both labels for an id it is toxic;
without training texts the network stays as it starts; labelled texts longer than the room that is left in the sample
are scored but not learnt from; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decontamination import plain
from .optim import Adam, gru_back, gru_step, sigmoid
from .scratch import written
from .words import MIX, chunks, mixed, split

WINDOW, STRIDE = 32, 16
#: Labelled texts of each class that are learnt from, at most.
SAMPLE_EACH = 1_500
#: Bytes of text that are learnt from, at most: what bounds the learning task's memory.
SAMPLE_BYTES = 12_000_000
VOCABULARY, LEAST_TEXTS = 20_000, 3
GRAMS, BUCKETS = (3, 4, 5), 1 << 14
WORD_DIM, CHAR_DIM, UNITS, LOOK = 6, 6, 8, 8
UPDATES, BATCH = 420, 96
THRESHOLD = 0.3
SCORED = "doc_id long, held_out boolean, score double"
#: Windows scored at a time.
AT_ONCE = 8192


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def grams_of(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of each word with marks at its ends, and where each word's begin."""
    chars = [np.fromiter(map(ord, f"^{w}$"), np.uint64, len(w) + 2) for w in vocab.to_pylist()]
    sizes = np.array([len(c) for c in chars], np.int64)
    if not len(sizes):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    flat, word = mixed(np.concatenate(chars)), np.repeat(np.arange(len(sizes)), sizes)
    found, owner = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(flat) < n:
                continue
            h = np.zeros(len(flat) - n + 1, np.uint64)
            for j in range(n):
                h = h * MIX + flat[j : j + len(h)]
            ok = word[: len(h)] == word[n - 1 :]
            found.append((mixed(h[ok] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32))
            owner.append(word[: len(h)][ok].astype(np.int32))
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])


def window_starts(n: int) -> np.ndarray:
    """Starts of the overlapping windows of n words."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


class Network:
    def __init__(self, words: dict[str, int], word_odds: np.ndarray, gram_odds: np.ndarray, prior: float, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        self.words = words
        e, c = f(len(words) + 1, WORD_DIM, scale=0.05), f(BUCKETS, CHAR_DIM, scale=0.05)
        e[1:, 0], c[:, 0] = word_odds, gram_odds
        e[0] = 0
        self.p = {"e": e, "c": c, "att": f(2 * UNITS, LOOK, scale=0.3), "look": f(LOOK, scale=0.3), "out": f(2 * UNITS, scale=0.3), "bias": np.array([prior], np.float32)}
        for way in "fb":
            self.p |= {"wx" + way: f(d, 3 * UNITS, scale=d**-0.5), "bx" + way: np.zeros(3 * UNITS, np.float32), "wh" + way: f(UNITS, 3 * UNITS, scale=UNITS**-0.5), "bn" + way: np.zeros(UNITS, np.float32)}

    def inputs(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input of each word; and word number, gram buckets and their edges."""
        number = np.fromiter((self.words.get(w, 0) for w in vocab.to_pylist()), np.int64, len(vocab))
        buckets, edges = grams_of(vocab)
        return self._join(number, buckets, edges), number, buckets, edges

    def _join(self, number, buckets, edges) -> np.ndarray:
        out = np.empty((len(number), WORD_DIM + CHAR_DIM), np.float32)
        out[:, :WORD_DIM] = self.p["e"][number]
        for i in range(0, len(number), 50_000):  # every word has a gram, as its ends are marked
            part = edges[i : i + 50_001]
            sums = np.add.reduceat(self.p["c"][buckets[part[0] : part[-1]]], part[:-1] - part[0])
            out[i : i + 50_000, WORD_DIM:] = sums / np.diff(part)[:, None]
        return out

    def forward(self, x: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows; at: (windows, WINDOW) rows of x, -1 behind a text's end."""
        p, width = self.p, at.shape[1]
        mask = (at >= 0).astype(np.float32)
        full = bool(mask.all())
        states, kept = [], {}
        for way in "fb":
            table = np.concatenate([x @ p["wx" + way] + p["bx" + way], np.zeros((1, 3 * UNITS), np.float32)])
            h = np.zeros((len(at), UNITS), np.float32)
            out = [h] * width
            kept[way] = [None] * width
            for t in range(width) if way == "f" else range(width - 1, -1, -1):
                new, k = gru_step(table[at[:, t]], h, p["wh" + way], p["bn" + way])
                h = new if full else h + mask[:, t, None] * (new - h)
                out[t] = h
                if keep:
                    kept[way][t] = k
            states.append(np.stack(out, 1))
        s = np.concatenate(states, 2)
        look = np.tanh(s @ p["att"])
        weight = np.exp(look @ p["look"]) * mask
        weight /= np.maximum(weight.sum(1, keepdims=True), 1e-9)
        pool = (weight[:, :, None] * s).sum(1)
        logits = pool @ p["out"] + p["bias"][0]
        return (logits, s, look, weight, pool, kept, mask) if keep else logits

    def update(self, adam: Adam, vocab: tuple, codes: np.ndarray, label: np.ndarray) -> None:
        """One step of Adam on windows of word codes (-1: none)."""
        p = self.p
        number, buckets, edges = vocab
        own, back = np.unique(codes[codes >= 0], return_inverse=True)
        if not len(own):
            return
        at = np.full(codes.shape, -1)
        at[codes >= 0] = back
        sizes = edges[own + 1] - edges[own]
        place = np.repeat(edges[own], sizes) + _places(sizes)
        own_buckets, own_edges = buckets[place], np.concatenate([[0], np.cumsum(sizes)])
        x = self._join(number[own], own_buckets, own_edges)
        logits, s, look, weight, pool, kept, mask = self.forward(x, at, keep=True)
        dl = ((sigmoid(logits) - label) / len(label)).astype(np.float32)
        g: dict = {"out": pool.T @ dl, "bias": dl.sum(keepdims=True)}
        dpool = dl[:, None] * p["out"]
        dw = (s @ dpool[:, :, None])[:, :, 0]
        de = weight * (dw - (weight * dw).sum(1, keepdims=True))
        dlook = de[:, :, None] * p["look"] * (1 - look * look)
        g["look"] = np.einsum("bt,btk->k", de, look)
        g["att"] = np.einsum("btu,btk->uk", s, dlook)
        ds = weight[:, :, None] * dpool[:, None, :] + dlook @ p["att"].T
        dx, width = np.zeros_like(x), at.shape[1]
        flat = at.ravel()
        order = np.argsort(flat, kind="stable")[int((flat < 0).sum()) :]
        first = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
        for i, way in enumerate("fb"):
            g["wh" + way], g["bn" + way] = np.zeros_like(p["wh" + way]), np.zeros_like(p["bn" + way])
            dh, da = np.zeros((len(at), UNITS), np.float32), np.zeros((*at.shape, 3 * UNITS), np.float32)
            for t in range(width - 1, -1, -1) if way == "f" else range(width):
                dh = dh + ds[:, t, i * UNITS : (i + 1) * UNITS]
                m = mask[:, t, None]
                prev, da[:, t], dwh, dbn = gru_back(dh * m, kept[way][t], p["wh" + way])
                dh = prev + dh * (1 - m)
                g["wh" + way] += dwh
                g["bn" + way] += dbn
            by_word = np.add.reduceat(da.reshape(-1, 3 * UNITS)[order], first)  # rows of x in order: each is in use
            g["wx" + way], g["bx" + way] = x.T @ by_word, by_word.sum(0)
            dx += by_word @ p["wx" + way].T
        words, wb = np.unique(number[own], return_inverse=True)
        ge = np.zeros((len(words), WORD_DIM), np.float32)
        np.add.at(ge, wb, dx[:, :WORD_DIM])
        ge[words == 0] = 0
        grams, gb = np.unique(own_buckets, return_inverse=True)
        gc = np.zeros((len(grams), CHAR_DIM), np.float32)
        np.add.at(gc, gb, np.repeat(dx[:, WORD_DIM:] / np.maximum(sizes, 1)[:, None], sizes, axis=0))
        adam.step(g | {"e": (words, ge), "c": (grams, gc)})

    def windows(self, x: np.ndarray, codes: np.ndarray, offsets: np.ndarray, judge=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Value (the logit, or judge's of the codes in it), text and place of the first word of all windows."""
        starts = [window_starts(n) for n in np.diff(offsets).tolist()]
        text = np.repeat(np.arange(len(starts), dtype=np.int32), [len(s) for s in starts])
        start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        start = start + offsets[:-1][text]
        value = np.zeros(len(start), np.float32)
        for i in range(0, len(start), AT_ONCE):  # the table of windows is made slice by slice
            at = codes_of(codes, offsets, start[i : i + AT_ONCE], text[i : i + AT_ONCE])
            value[i : i + AT_ONCE] = judge(at) if judge else self.forward(x, at)
        return value, text, start

    def score(self, texts: pa.Array) -> np.ndarray:
        words = split(plain(texts))
        x = self.inputs(words.vocab)[0]
        logits, text, _ = self.windows(x, words.codes, words.offsets)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, logits)
        return sigmoid(best.astype(np.float64))


def codes_of(codes: np.ndarray, offsets: np.ndarray, start: np.ndarray, text: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) word codes from these places on, -1 behind the text's end."""
    at = start[:, None] + np.arange(WINDOW)
    room = at < offsets[1:][text][:, None]
    return np.where(room, np.append(codes, -1)[np.minimum(at, len(codes))], -1)


def _places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def fit(texts: pa.Array, toxic: np.ndarray, updates: int = UPDATES, seed: int = 3) -> Network:
    """A network that has learnt from these texts."""
    words = split(plain(texts))
    text = np.repeat(np.arange(len(toxic)), words.lengths)
    pairs = np.unique(np.stack([words.codes, text]), axis=1) if len(words.codes) else np.zeros((2, 0), np.int64)
    bad = toxic[pairs[1]] == 1
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    v = len(words.vocab)
    one, nil = np.bincount(pairs[0][bad], minlength=v), np.bincount(pairs[0][~bad], minlength=v)

    def odds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Log-odds, held back by the likelihood-ratio statistic: what chance explains among so many words counts for nothing."""
        part = lambda n, e: np.where(n > 0, n * np.log(np.maximum(n, 1) / np.maximum(e, 1e-9)), 0)
        sure = 2 * (part(a, (a + b) * n1 / (n1 + n0)) + part(b, (a + b) * n0 / (n1 + n0)))
        ratio = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
        return np.clip(ratio, -4, 4) * np.clip((sure - 10) / 20, 0, 1)

    vocab = words.vocab.to_pylist()
    often = np.argsort(-(one + nil), kind="stable")[:VOCABULARY]
    often = often[(one + nil)[often] >= LEAST_TEXTS]
    buckets, edges = grams_of(words.vocab)
    sizes = np.diff(edges)
    by_gram = [np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)]
    for i, (a, b) in enumerate(zip(words.offsets, words.offsets[1:], strict=False)):
        own = np.unique(words.codes[a:b])  # a text counts once for each bucket, however many of its words have it
        held = buckets[np.repeat(edges[own], sizes[own]) + _places(sizes[own])]
        by_gram[1 - toxic[i]] += np.bincount(held, minlength=BUCKETS) > 0
    network = Network({vocab[i]: k + 1 for k, i in enumerate(often)}, odds(one, nil)[often], odds(*by_gram), float(np.log(n1 / n0)))
    if not toxic.any() or toxic.all():
        return network
    r, adam = np.random.default_rng(seed), Adam(network.p, 8e-3, {"e": 0.15, "c": 0.15})
    rounds = 6
    for turn in range(rounds):
        if turn == rounds - 1:
            adam.rate /= 4
        x, number, _, _ = network.inputs(words.vocab)
        # at first the network knows nothing yet: windows are chosen by their words' log-odds
        odd = np.append(x[:, 0] + x[:, WORD_DIM], np.float32(-np.inf))
        logits, owner, start = network.windows(x, words.codes, words.offsets, (lambda at: odd[at].max(1)) if not turn else None)
        order = np.lexsort((-logits, owner))
        first = np.concatenate([[True], owner[order][1:] != owner[order][:-1]])
        top = order[first]
        # of clean texts the two highest and a random window, of toxic ones the highest
        second = order[1:][first[:-1] & ~first[1:]]
        any_one = r.permutation(len(owner))[: len(toxic)]
        clean = np.concatenate([top[toxic[owner[top]] == 0], second[toxic[owner[second]] == 0], any_one[toxic[owner[any_one]] == 0]])
        bad = top[toxic[owner[top]] == 1]
        for _ in range(updates // rounds):
            pick = np.concatenate([r.choice(bad, BATCH // 3), r.choice(clean, BATCH - BATCH // 3)])
            at = codes_of(words.codes, words.offsets, start[pick], owner[pick])
            network.update(adam, (number, buckets, edges), at, toxic[owner[pick]].astype(np.float32))
    return network


def sample(docs: DataFrame, labels: DataFrame, held: Column, each: int = SAMPLE_EACH, size: int = SAMPLE_BYTES) -> DataFrame:
    """(place, text, toxic) to learn from: at most ``each`` of a class and ``size`` bytes, by a hash of the id; never of held-out rows."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = docs.select("doc_id", F.octet_length("text").alias("bytes")).where(~held & (F.coalesce("bytes", F.lit(0)) <= size))
    known = known.join(own.groupBy("doc_id").agg(F.max("bytes").alias("bytes")), "doc_id").withColumn("place", F.xxhash64("doc_id"))
    ids = [known.where(F.col("toxic") == k).orderBy("place", "doc_id").limit(each) for k in (0, 1)]
    so_far = F.sum(F.coalesce("bytes", F.lit(0))).over(Window.orderBy("place", "doc_id"))  # of 2 * each rows
    ids = ids[0].unionByName(ids[1]).withColumn("so_far", so_far).where(F.col("so_far") <= size)
    short = F.coalesce(F.octet_length("text"), F.lit(0)) <= size
    texts = docs.select("doc_id", "text").where(short).join(F.broadcast(ids.select("doc_id", "place", "toxic")), "doc_id")
    return texts.groupBy("doc_id", "place", "toxic").agg(F.max("text").alias("text")).select("place", "doc_id", "text", "toxic")


def _learnt(updates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        texts = pa.concat_arrays([b.column("text") for b in held]) if held else pa.array([], pa.string())
        toxic = np.concatenate([b.column("toxic").to_numpy() for b in held]).astype(np.int64) if held else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, toxic, updates))], pa.binary())], names=["network"])

    return run


def trained(docs: DataFrame, labels: DataFrame, held: Column | None = None) -> Network:
    """The network that one task learns from the sample: its weights are the one row that comes to the driver."""
    rows = written(sample(docs, labels, held_out(F.col("doc_id")) if held is None else held), "sample")
    rows = rows.repartition(1).sortWithinPartitions("place", "doc_id")
    found = rows.mapInArrow(_learnt(UPDATES), "network binary").first()
    return pickle.loads(found["network"]) if found else fit(pa.array([], pa.string()), np.zeros(0, np.int64))


def scored(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(held.value.score(part.column("text")))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, SCORED).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, all columns as they were."""
    held = docs.sparkSession.sparkContext.broadcast(network)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield part.filter(pa.array(held.value.score(part.column("text")) < threshold))

    return docs.mapInArrow(keep, docs.schema)
