"""Alignment of two tokenizers: groups of tokens between common ends, and how often two ids end together in the corpus."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm.scratch import dropped, own_dir, written
from quarrymill.llm.segments import Known, Segments, byte_level, file_bytes, fine_cuts, gathered, segments, together
from quarrymill.llm.words import pieces

#: Bytes of text that are aligned at a time, and pairs that a task counts before it passes them on.
AT_ONCE, HELD_PAIRS = 4_000_000, 2_000_000


class Aligned(NamedTuple):
    """A segment in both vocabularies: numbers of ids, packed pairs of the ids that end together, and its groups spelled."""

    n_a: int
    n_b: int
    pairs: np.ndarray
    groups: str
    same: bool  # whether both give the segment's bytes


def piece_level(model: bytes):
    """(a function from texts to their ids, the bytes of every id, whether ``fine_cuts`` hold) of a piece tokenizer's file.

    Texts begin with a space or stand in the middle of a text: the space that the tokenizer adds is theirs, or it is cut
    off with a line break before them, which is a token of its own.
    """
    from sentencepiece import SentencePieceProcessor

    tokenizer = SentencePieceProcessor(model_proto=model)
    spelt, fine = [], True
    for i in range(tokenizer.vocab_size()):
        piece = tokenizer.id_to_piece(i)
        spelt.append(bytes([int(piece[3:5], 16)]) if tokenizer.is_byte(i) else piece.replace("▁", " ").encode())
        if tokenizer.is_byte(i) or tokenizer.is_control(i) or tokenizer.is_unknown(i):
            continue
        if "▁" in piece.lstrip("▁"):
            raise ValueError("texts are cut at spaces that no piece reaches over")
        fine = fine and "\n" not in piece and not len(fine_cuts(np.frombuffer(spelt[-1], np.uint8)))

    def encode(texts: list[str]) -> list[np.ndarray]:
        found = tokenizer.encode([t[1:] if t[0] == " " else "\n" + t for t in texts], num_threads=1)
        return [np.array(ids if t[0] == " " else ids[2:], np.uint32) for t, ids in zip(texts, found, strict=True)]

    return encode, spelt, fine


def _joined(strings: pa.Array, bounds: np.ndarray, by: str) -> pa.Array:
    """The strings of each run, joined."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), strings), pa.scalar(by, strings.type))


@lru_cache(maxsize=1)
def _aligner(model_a: bytes, model_b: bytes):
    """(a function from segments to their alignments, whether texts may be cut finely)."""
    (encode_a, spelt_a), (encode_b, spelt_b, fine) = byte_level(model_a, specials=False), piece_level(model_b)
    sides = [(encode, spelt, np.array([len(x) for x in spelt]), pa.array([str(i) for i in range(len(spelt))], pa.large_string())) for encode, spelt in ((encode_a, spelt_a), (encode_b, spelt_b))]

    def align(new: list[bytes]) -> list[Aligned]:
        same, found = np.ones(len(new), bool), []
        for encode, spelt, sizes, _ in sides:
            ids = together(new, encode, sizes)
            if b"".join([spelt[i] for i in np.concatenate(ids).tolist()]) != b"".join(new):
                same &= np.array([b"".join([spelt[i] for i in x.tolist()]) == k for x, k in zip(ids, new, strict=True)])
            found.append(ids)
        counts = [np.array([len(x) for x in ids]) for ids in found]
        good = np.flatnonzero(same).tolist()
        if not good:
            return [Aligned(int(a), int(b), np.zeros(0, np.int64), "", False) for a, b in zip(*counts, strict=True)]
        ids = [np.concatenate([x[i] for i in good]) for x in found]
        ends = [np.cumsum(sizes[own]) for own, (_, _, sizes, _) in zip(ids, sides, strict=True)]  # in the good segments, one after the other
        common = ends[0][ends[1][np.minimum(np.searchsorted(ends[1], ends[0]), len(ends[1]) - 1)] == ends[0]]
        last = [np.searchsorted(e, common) for e in ends]
        spelled = [_joined(names.take(pa.array(own)), np.concatenate([[0], at + 1]), ",") for own, at, (_, _, _, names) in zip(ids, last, sides, strict=True)]
        upto = np.concatenate([[0], np.searchsorted(common, np.cumsum([len(new[i]) for i in good])) + 1])
        groups = _joined(pc.binary_join_element_wise(*spelled, pa.scalar("|", pa.large_string())), upto, ";").to_pylist()
        pairs, n_a, n_b = ids[1][last[1]].astype(np.int64) << 32 | ids[0][last[0]].astype(np.int64), *[x.tolist() for x in counts]
        out = [Aligned(a, b, pairs[:0], "", False) for a, b in zip(n_a, n_b, strict=True)]
        for k, (i, low, high) in enumerate(zip(good, upto[:-1].tolist(), upto[1:].tolist(), strict=True)):
            out[i] = Aligned(n_a[i], n_b[i], pairs[low:high], groups[k], True)
        return out

    return align, fine


@lru_cache(maxsize=1)
def _known(model_a: bytes, model_b: bytes) -> tuple[Known, bool]:
    align, fine = _aligner(model_a, model_b)
    return Known(align), fine


def spaced(texts: pa.Array, fine: bool) -> Segments:
    """Segments of the texts, each after a space; null and empty texts have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    return segments(pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))), fine)


def _sums(values: np.ndarray, s: Segments) -> np.ndarray:
    """Of a number for each code, the sum over every text's segments."""
    upto = np.concatenate([[0], np.cumsum(values[s.code])])
    return upto[s.first[1:]] - upto[s.first[:-1]]


def _whole(own: list, s: Segments) -> np.ndarray:
    """Which texts have tokens: none of their segments is spelled otherwise by a vocabulary."""
    odd = np.array([not x.same for x in own], np.int64)
    return (np.diff(s.first) > 0) & (_sums(odd, s) == 0 if len(own) else True)


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[head], np.add.reduceat(n, head) if len(head) else n


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, pairs array<long>, times array<long>"


def aligner(model_a: bytes, model_b: bytes, with_groups: bool):
    """A function for mapInArrow: (doc_id, text) to the figures of its alignment and its pairs with how often it links each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fine = _known(model_a, model_b)
        for whole in batches:
            for batch in pieces(whole, most=AT_ONCE):
                s = spaced(batch.column("text"), fine)
                own = known(s.kinds)
                full = _whole(own, s)
                n_a, n_b, links = (np.where(full, _sums(np.array(x, np.int64), s), 0) for x in ([x.n_a for x in own], [x.n_b for x in own], [len(x.pairs) for x in own]))
                spelt, code = [x.groups for x in own], s.code.tolist()
                groups = [";".join([spelt[k] for k in code[a:b]]) if ok else "" for ok, a, b in zip(full.tolist(), s.first[:-1].tolist(), s.first[1:].tolist(), strict=True)]
                digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups]
                # A document's pairs, each once: numbers of the batch's pairs, sorted within the document.
                sizes = np.array([len(x.pairs) for x in own], np.int64)
                kinds, of = np.unique(np.concatenate([x.pairs for x in own]) if own else np.zeros(0, np.int64), return_inverse=True)
                doc = np.repeat(np.arange(len(batch)), np.diff(s.first))
                taken = s.code[full[doc]]
                pair = gathered(of, np.cumsum(sizes) - sizes, sizes, taken) + np.repeat(doc[full[doc]], sizes[taken]) * max(len(kinds), 1)
                pair.sort()
                head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
                times, pair = np.diff(np.append(head, len(pair))), pair[head]
                bounds = pa.array(np.searchsorted(pair, np.arange(len(batch) + 1) * max(len(kinds), 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int64))) for x in (kinds[pair % max(len(kinds), 1)] if len(kinds) else pair, times)]
                arrays = [batch.column("doc_id"), pa.array(n_a), pa.array(n_b), pa.array(links), pa.array(digests, pa.string()), pa.array(groups if with_groups else [None] * len(groups), pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in ALIGNED.split(", ")])

    return run


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    kinds, of = np.unique(np.concatenate(keys), return_inverse=True)
    return kinds, np.bincount(of, np.concatenate(counts), len(kinds)).astype(np.int64)  # exact below 2**53


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (pairs, times) to (pair, n), the partial counts of a task."""
    keys, counts, held = [], [], 0
    for batch in batches:
        key, n = added([batch.column("pairs").flatten().to_numpy()], [batch.column("times").flatten().to_numpy()])
        keys.append(key)
        counts.append(n)
        held += len(key)
        if held > HELD_PAIRS:
            key, n = added(keys, counts)
            keys, counts, held = [key], [n], len(key)
            if held > HELD_PAIRS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])
                keys, counts, held = [], [], 0
    if keys:
        key, n = added(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])


def _store(path: str):
    """(file system, path) of a folder's address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


SHARD = "low long, high long, path string, rows long, ids array<long>, most array<long>"


def sharder(folder: str):
    """A function for mapInArrow: one range of sorted partial counts to a file of sorted pairs and their sums.

    Every attempt of a task writes a file of its own name; the row that a task returns names the one that counts. The row
    also has the highest count of each id of the second vocabulary within the file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:  # sorted, so sums of runs that reach over batches meet when all are added
            key, n = added([batch.column("pair").to_numpy()], [batch.column("n").to_numpy()])
            if keys and len(key) and keys[-1][-1] == key[0]:
                counts[-1][-1] += n[0]
                key, n = key[1:], n[1:]
            if len(key):
                keys.append(key)
                counts.append(n.copy())
        if not keys:
            return
        key, n = np.concatenate(keys), np.concatenate(counts)
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        name = f"counts-{uuid.uuid4().hex}.i8"
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(np.concatenate([key, n]).astype("<i8").tobytes())
        of = key >> 32
        head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        row = [[int(key[0])], [int(key[-1])], [f"{folder}/{name}"], [len(key)], [of[head]], [np.maximum.reduceat(n, head)]]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], [f.split()[0] for f in SHARD.split(", ")])

    return write


class Counts(NamedTuple):
    """Files of sorted pair counts by their lowest pair, and the highest count of every id of the second vocabulary."""

    low: np.ndarray
    paths: list[str]
    most: np.ndarray

    def of(self, pairs: np.ndarray) -> np.ndarray:
        """The counts of sorted pairs, searched in the files, which are mapped into memory; 0 for pairs that no text counts."""
        out = np.zeros(len(pairs), np.int64)
        shard = np.searchsorted(self.low, pairs, side="right") - 1
        for k in np.unique(shard[shard >= 0]).tolist():
            here = np.flatnonzero(shard == k)
            key, n = _mapped(self.paths[k])
            at = np.searchsorted(key, pairs[here])
            there = at < len(key)
            there[there] = key[at[there]] == pairs[here[there]]
            out[here[there]] = n[at[there]]
        return out


@lru_cache(maxsize=4096)
def _mapped(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The pairs and counts of a file: mapped where the folder is mounted, so that workers share what they read of it."""
    from pyarrow import fs

    store, name = _store(path)
    data = np.memmap(name, "<i8", "r") if isinstance(store, fs.LocalFileSystem) else np.frombuffer(store.open_input_file(name).read_buffer(), "<i8")
    return data[: len(data) // 2], data[len(data) // 2 :]


def pair_counts(alignments: DataFrame) -> Counts:
    """How often two ids end together in all ``alignments`` (pairs, times), as sorted files in the shared folder.

    Tasks count pairs as packed whole numbers; partial counts are written, dealt by sampled ranges, sorted and summed by
    runs. The driver gets one row a file, which hold a number for each id of the second vocabulary in all.
    """
    folder = f"{own_dir(alignments.sparkSession)}/pair-counts-{uuid.uuid4().hex}"
    partial = written(alignments.select("pairs", "times").mapInArrow(counted, "pair long, n long"), "pair-partial")  # the ranges are sampled from it
    ranges = partial.repartitionByRange("pair").sortWithinPartitions("pair")
    rows = sorted(ranges.mapInArrow(sharder(folder), SHARD).collect(), key=lambda r: r["low"])
    dropped(partial)
    most = np.zeros(1 + max([0, *(max(r["ids"]) for r in rows)]), np.int64)
    for r in rows:
        np.maximum.at(most, np.array(r["ids"]), np.array(r["most"]))
    return Counts(np.array([r["low"] for r in rows], np.int64), [r["path"] for r in rows], most)


FIGURES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def linker(counts: Counts):
    """A function for mapInArrow: rows of ``ALIGNED`` to those of ``FIGURES``, by the counts of their pairs."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            kinds, of = np.unique(pairs.flatten().to_numpy(), return_inverse=True)
            n = counts.of(kinds)
            best = (n == counts.most[kinds >> 32])[of]
            ends = np.cumsum(pc.list_value_length(pairs).to_numpy().astype(np.int64))
            starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (np.where(best, times, 0), n[of] * times)]
            figures = [pa.array(x[ends] - x[starts]) for x in sums]
            a, b, groups = (batch.column(c) for c in ("n_a", "n_b", "n_groups"))
            arrays = [batch.column("doc_id"), a, b, groups, groups, *figures, batch.column("groups_sha256"), batch.column("groups")]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in FIGURES.split(", ")])

    return link


def aligned(docs: DataFrame, model_a: bytes, model_b: bytes, with_groups: bool = False) -> DataFrame:
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and groups of every row of ``docs`` (doc_id, text).

    ``model_a`` is a byte-level tokenizer's file and takes a space and the text, ``model_b`` a piece tokenizer's and takes
    the text, to which it adds the space. Where tokens of both end at one byte a group ends, and the two tokens are a link.
    A link's count is how many links in all texts have its two ids; it is best if no other id has a higher one with its
    second id. ``groups`` spells them as ``a1,a2|b1;a3|b2`` (null without ``with_groups``).

    Both tokenizers split where texts are cut (``segments``), so each distinct segment is aligned once, with the same
    result. Texts that are null, empty or spelled otherwise by one of the vocabularies have no tokens: figures of 0 and ''.
    Rows that repeat are aligned and counted each. Texts of any length are aligned whole, at some 100 bytes of memory a
    byte. A null doc_id stays null; other columns, whatever their names, aren't looked at. An empty table gives an empty
    result. Texts are read once; what is written of a text are its figures and its distinct pairs.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    rows = written(own.mapInArrow(aligner(model_a, model_b, with_groups), ALIGNED), "alignments")
    return rows.mapInArrow(linker(pair_counts(rows)), FIGURES)


def op12_pair_count_alignment(spark: SparkSession, sf_dir: str, path_a: str = "", path_b: str = "") -> DataFrame:
    """All documents aligned between a byte-level and a piece vocabulary."""
    if not (path_a and path_b):
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return aligned(docs, file_bytes(path_a), file_bytes(path_b)).drop("groups")
