"""Words of Arrow string columns as numpy arrays: bounds, exact codes and hashes, for whole batches at a time.

A word is a run of bytes other than space and 0x09 to 0x0D. UTF-8 never has those bytes inside a character, so bytes
give the same words as characters do. Hashes find what may be equal; what is equal is judged on the bytes themselves,
within a batch by ``codes``, across batches by ``digests``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text is worked on alone.
CHUNK_BYTES = 2_000_000
#: Bytes of the longest word that is hashed without BLAKE2b.
SHORT = 32

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit bijection that spreads every input bit (the splitmix64 finaliser)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as they have been asked for."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 2**64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 2**64))])
        return self.up[:n], self.down[:n]


_WORDS = _Powers(0xAF251AF3B0F025B5)


def prefix(values: np.ndarray) -> np.ndarray:
    """Running sums from which ``between`` takes the hash of any run of ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _WORDS.to(len(values))[0], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the runs [start, end), wherever they stand; equal runs have equal hashes.

    Others may share one, so these find candidates; equality is judged on ``digests`` or on ``codes``.
    """
    down = _WORDS.to(len(sums))[1]
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _ODD, seed)


class Words(NamedTuple):
    """Words of consecutive texts: byte bounds in ``data``, the text's index, a hash, and each text's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one more than there are texts


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes: up to ``SHORT`` bytes in mixed lanes of eight, of longer ones BLAKE2b."""
    size = end - start
    padded = np.concatenate([data, np.zeros(SHORT, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    out, at = mixed(size.astype(np.uint64), 3), np.arange(len(start))
    for j in range(SHORT // 8):
        at = at[size[at] > 8 * j]
        over = np.maximum(8 * (j + 1) - size[at], 0).astype(np.uint64) * np.uint64(8)
        lane = lanes[start[at] + 8 * j] << over  # drops the bytes after the span
        out[at] = mixed(out[at] ^ lane, j)
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def packed(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words without gaps, and their bounds."""
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.start] = 1
    inside[w.end] -= 1
    return w.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)], np.concatenate([[0], np.cumsum(w.end - w.start)])


def codes(w: Words) -> tuple[np.ndarray, pa.Array]:
    """A code for each word and the bytes of each code: two words have one code if and only if their bytes are equal."""
    if not len(w.start):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    data, bounds = packed(w)
    found = pa.Array.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def digests(w: Words, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """BLAKE2b digests of 16 bytes of the runs of words [start, end), joined by one space: equality of the words."""
    at = np.concatenate([[0], np.cumsum(w.end - w.start + 1)])
    joined, word = np.full(at[-1], 32, np.uint8), np.ones(at[-1], bool)
    word[at[1:] - 1] = False
    joined[word] = packed(w)[0]
    view, new = memoryview(joined.tobytes()), hashlib.blake2b
    low, high = at[start].tolist(), (at[end] - 1).tolist()
    return pa.array([new(view[a:b], digest_size=16).digest() for a, b in zip(low, high, strict=True)], pa.binary())


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the bounds of its texts; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def keyed(w: Words, key: bytes) -> Words:
    """The words with hashes that only those who know ``key`` can foresee, so that no words can be made to share one."""
    code, kinds = codes(w)
    new = hashlib.blake2b
    digest = b"".join(new(x, digest_size=8, key=key).digest() for x in kinds.to_pylist())
    return w._replace(hash=np.frombuffer(digest, "<u8")[code])


def words(texts: pa.Array, lower: bool = False, key: bytes | None = None) -> Words:
    """Words of all texts of an array; ``lower`` folds A to Z first. With ``key`` their hashes are ``keyed``."""
    data, bounds = buffers(texts)
    if lower:
        data = _LOWER[data]
    inside = ~_GAP[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    if key is not None:
        return keyed(Words(data, start, end, doc, np.zeros(0, np.uint64), first), key)
    return Words(data, start, end, doc, span_hashes(data, start, end), first)


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, so that arrays for it stay small."""
    sizes = np.diff(buffers(batch.column(text))[1])
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def signed(x: np.ndarray) -> pa.Array:
    """uint64 as the bigint with the same bits."""
    return pa.array(x.view(np.int64))
