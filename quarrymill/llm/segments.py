"""Texts cut where tokenizers cut them anyway, so that every distinct segment is encoded once."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from quarrymill.llm.words import buffers

#: Segments that a worker keeps the encoding of, the bytes of the longest one, and bytes that are encoded at once.
KEPT, KEPT_BYTES, JOINED = 400_000, 64, 1 << 16

_SPACE = 0x20
#: Last bytes but one, or first bytes, of white space outside ASCII and of what shares them: no cut beside those.
_WIDE = np.zeros(1 << 16, bool)
_WIDE[[0xC285, 0xC2A0, 0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380]] = True
#: For bytes.translate: 1 for the first byte of each of those.
_LEADS = _WIDE.reshape(256, 256).any(1).tobytes()


class Segments(NamedTuple):
    """The code of every segment of consecutive texts, the bytes of each code, and each text's first segment."""

    code: np.ndarray
    kinds: list[bytes]
    first: np.ndarray  # one more than there are texts


def cuts(data: np.ndarray) -> np.ndarray:
    """Places of single spaces between two characters that are no white space.

    Byte-level BPE splits at those before it merges, and pieces that begin with a space can't reach over one, so texts
    cut there have the same tokens. Beside characters that may be white space nothing is cut, which is always safe.
    """
    if len(data) < 3:
        return np.zeros(0, np.int64)
    plain = (data > _SPACE) & (data != 0x7F)
    at = np.flatnonzero((data[1:-1] == _SPACE) & plain[:-2] & plain[2:]) + 1
    lead = np.flatnonzero(np.frombuffer(data.tobytes().translate(_LEADS), bool)[:-1])
    odd = np.zeros(len(data) - 1, bool)  # of bytes i and i + 1
    odd[lead] = _WIDE[data[lead].astype(np.uint16) << 8 | data[lead + 1]]
    before = odd[at - 2] & (at >= 2)  # C2 85, C2 A0
    before |= odd[np.maximum(at - 3, 0)] & (at >= 3)  # E2 80 xx and so on
    after = odd[np.minimum(at + 1, len(odd) - 1)] & (at + 1 < len(odd))
    return at[~before & ~after]


def file_bytes(path: str) -> bytes:
    """The content of a tokenizer's file, as the driver reads it once and sends it to the tasks."""
    with open(path, "rb") as f:
        return f.read()


def byte_level(model: bytes, specials: bool = True) -> tuple[Callable[[list[str]], list], list[bytes]]:
    """(a function from texts to their ids, the bytes of every id) of a byte-level tokenizer's file.

    Without ``specials`` the strings of special tokens in a text are ordinary text.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tokenizer, kind = Tokenizer.from_str(model.decode()), json.loads(model)
    split = kind.get("pre_tokenizer") or {}
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or kind.get("normalizer"):
        raise ValueError("texts are cut as byte-level tokenizers without a prefix space cut them")
    tokenizer.encode_special_tokens = not specials
    spelt = [b""] * tokenizer.get_vocab_size(True)
    # The alphabet of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    for piece, i in tokenizer.get_vocab(False).items():
        spelt[i] = bytes(byte_of[c] for c in piece)
    for i, token in tokenizer.get_added_tokens_decoder().items():
        spelt[i] = token.content.encode()
    return lambda texts: [np.fromiter(e.ids, np.uint32, len(e)) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], spelt


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_MARK[0x7C] = False  # in the strings of special tokens
_BREAK, _QUOTE = 0x0A, 0x27
#: For bytes.translate: 1 for letters, 2 for marks, 3 for the quote, which is a mark.
_SORTS = (_LETTER + 2 * _MARK + (np.arange(256) == _QUOTE)).astype(np.uint8).tobytes()
#: The sign that piece vocabularies write for a space; a text that has it is spelled otherwise by them.
_SIGN = "▁".encode()


def fine_cuts(data: np.ndarray) -> np.ndarray:
    """More places where byte-level BPE splits: between ASCII letters and marks, and around a lone line break.

    A quote may begin a contraction, so nothing is cut after it.
    """
    sort = np.frombuffer(data.tobytes().translate(_SORTS), np.uint8)
    letter, mark = sort == 1, sort >= 2
    ends = letter[:-1] & mark[1:] | (sort[:-1] == 2) & letter[1:]
    lone = np.flatnonzero(data[1:-1] == _BREAK) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    before, after = data[lone - 1], data[lone + 1]
    lone = lone[(before > _SPACE) & (before < 0x7F) & (after > _SPACE) & (after < 0x7F)]
    return np.concatenate([np.flatnonzero(ends) + 1, lone, lone + 1])


def _listed(values: pa.Array) -> list[bytes]:
    """The values of a large binary array; as ``to_pylist``, at a quarter of its time."""
    if not len(values):
        return []
    bounds = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    data = values.buffers()[2].slice(int(bounds[0]), int(bounds[-1] - bounds[0])).to_pybytes()
    at = (bounds - bounds[0]).tolist()
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def segments(texts: pa.Array, fine: bool = False) -> Segments:
    """Segments of all texts of an array, with ``fine`` also cut by ``fine_cuts``; null and empty texts have none."""
    data, bounds = buffers(texts)
    if not len(data):
        return Segments(np.zeros(0, np.int64), [], np.zeros(len(bounds), np.int64))
    new = np.zeros(len(data), bool)
    new[cuts(data)] = True
    if fine:
        new[fine_cuts(data)] = True
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    start = np.flatnonzero(new)
    ends = np.append(start, len(data))
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    return Segments(found.indices.to_numpy(zero_copy_only=False).astype(np.int64), _listed(found.dictionary), np.searchsorted(start, bounds))


def _beside(new: list[bytes]) -> np.ndarray:
    """Which segments can stand after another one or a line break, and before either, and be cut from them again."""
    size = np.fromiter(map(len, new), np.int64, len(new))
    data = np.frombuffer(b"".join(new) + b"aaa", np.uint8).astype(np.uint16)
    end = np.cumsum(size)
    start = end - size
    first = start + (data[start] == _SPACE)
    a, z = data[first], data[end - 1]
    ok = (first < end) & (size < JOINED) & (a > _SPACE) & (z > _SPACE) & (a != 0x7F) & (z != 0x7F)
    pair = _WIDE[data[:-1] << 8 | data[1:]]
    wide = (a >= 0x80) & (end - first > 1) & pair[first]
    wide |= (z >= 0x80) & ((size > 1) & pair[np.maximum(end - 2, 0)] | (size > 2) & pair[np.maximum(end - 3, 0)])
    signs = np.flatnonzero((data[:-2] == _SIGN[0]) & (data[1:-1] == _SIGN[1]) & (data[2:] == _SIGN[2]))
    ok &= ~wide
    ok[np.searchsorted(end, signs, side="right")] = False
    return ok


def together(new: list[bytes], encode: Callable[[list[str]], list], sizes: np.ndarray) -> list[np.ndarray]:
    """The ids of segments: those that can stand side by side are encoded in runs and told apart by their bytes.

    ``sizes`` has the bytes of every id. A call for each segment would take longer than its tokens do. Segments that
    don't begin with a space stand after a line break, which is a token of its own there.
    """
    out: list = [None] * len(new)
    ok, size = _beside(new), np.fromiter(map(len, new), np.int64, len(new))
    alone = np.flatnonzero(~ok).tolist()
    for i, ids in zip(alone, encode([new[i].decode() for i in alone]), strict=True):
        out[i] = ids
    beside = np.flatnonzero(ok)
    held = np.cumsum(size[beside]) // JOINED
    for run in np.split(beside, np.flatnonzero(np.diff(held)) + 1) if len(beside) else []:
        own = run.tolist()
        spelt = [k if k[0] == _SPACE else b"\n" + k for k in map(new.__getitem__, own)]
        ids = encode([b"".join(spelt).decode()])[0]
        ends, wanted = np.concatenate([[0], np.cumsum(sizes[ids])]), np.cumsum(np.fromiter(map(len, spelt), np.int64, len(spelt)))
        from_, to = np.searchsorted(ends, begun := wanted - size[run]), np.searchsorted(ends, wanted)
        if ends[-1] != wanted[-1] or not np.array_equal(ends[to], wanted) or not np.array_equal(ends[from_], begun):
            raise ValueError("the tokenizer joins segments")
        for j, a, b in zip(own, from_.tolist(), to.tolist(), strict=True):
            out[j] = ids[a:b]
    return out


class Known:
    """What ``encode`` makes of segments, kept for short ones; ``encode`` takes those that are new, all at once."""

    def __init__(self, encode: Callable[[list[bytes]], list]):
        self.encode, self.held = encode, {}

    def __call__(self, kinds: list[bytes]) -> list:
        held = self.held
        out = list(map(held.get, kinds))
        if at := [i for i, x in enumerate(out) if x is None]:
            new = [kinds[i] for i in at]
            made = self.encode(new)
            for i, x in zip(at, made, strict=True):
                out[i] = x
            if len(held) + len(new) > KEPT:
                held.clear()
            held.update((k, x) for k, x in zip(new, made, strict=True) if len(k) <= KEPT_BYTES)
        return out


def gathered(parts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The parts of all codes in a row: of code c, ``parts[starts[c] : starts[c] + sizes[c]]``."""
    n = sizes[code]
    ends = np.cumsum(n)
    if not len(ends):
        return parts[:0]
    return parts[np.repeat(starts[code] - (ends - n), n) + np.arange(ends[-1])]
