"""Vectorised word splitting and hashing over Arrow string arrays.

Words are maximal runs of anything but space and U+0009..U+000D, the rule that all word-based operators here share.
Nulls count as empty texts. Hashes are 64 bits, the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are split at a time: what bounds a worker's memory, besides a single text.
CHUNK_BYTES = 6_000_000


@dataclass
class Words:
    """The words of some texts: ``codes`` index ``vocab``, text i has codes[offsets[i]:offsets[i + 1]]."""

    vocab: pa.Array
    codes: np.ndarray
    offsets: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each vocab entry."""
        return string_hashes(self.vocab)


def whole(texts: pa.Array) -> pa.Array:
    """The texts, nulls as '', in buffers of their own: some string kernels misread the offsets of a slice."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return texts.take(pa.array(np.arange(len(texts))))


def split(texts: pa.Array, lower: bool = False) -> Words:
    texts = whole(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets -= offsets[0]
    full = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
    if not full.all():  # white space at a text's ends gives empty strings
        before = np.concatenate([[0], np.cumsum(full)])
        values, offsets = values.filter(pa.array(full)), before[offsets]
    coded = values.dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets)


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with at most ``limit`` bytes of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


#: What a byte counts in each of two sums, and their odd bases.
_BYTES = [mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)]
_BASES = [MIX, np.uint64(0xD6E8FEB86659FD93)]


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hash of each string, by prefix sums of two polynomials over all their bytes."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    strings = strings.cast(pa.large_string())
    edges = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    out = mixed(np.diff(edges).astype(np.uint64))
    with np.errstate(over="ignore"):
        for values, base in zip(_BYTES, _BASES, strict=True):
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), base)]), dtype=np.uint64)
            total = np.concatenate([[np.uint64(0)], np.cumsum(values[data] * power[:-1], dtype=np.uint64)])
            back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), inverse)]), dtype=np.uint64)
            out = mixed(out * MIX + mixed((total[edges[1:]] - total[edges[:-1]]) * back[edges[:-1]]))
    return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * MIX + hashes[j : j + n]
            out ^= out >> np.uint64(29)
    return mixed(out)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """As grams, by prefix sums of a Karp-Rabin polynomial modulo 2^64: time does not grow with k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes) - 1, MIX)]), dtype=np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes) * power, dtype=np.uint64)])
        # every difference is a multiple of power[i]; the inverse of the odd base makes them comparable
        inverse = np.uint64(pow(int(MIX), -1, 1 << 64))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse)]), dtype=np.uint64)
        return mixed((total[k:] - total[:n]) * back)


def within(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which k words of one text start, and the text of each."""
    lengths = np.maximum(np.diff(offsets) - k + 1, 0)
    text = np.repeat(np.arange(len(lengths)), lengths)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    return (np.arange(lengths.sum()) - first[text] + offsets[:-1][text]).astype(np.int64), text


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
