"""Token counts of fields and sections: documents encoded once, token spans joined to sections by their offsets."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The vocabulary that the registered query takes: a public byte-level one, as ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this kind of vocabulary splits texts before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Which section gets a token that reaches over a boundary: that of its first or last byte, or that with most of its
#: bytes (the first of several).
RULES = ("first", "last", "most")
#: Sections of a batch that is passed on, about.
SECTIONS = 16_384


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
    length = np.zeros(max(table.values()) + 1, np.int64)
    for piece, rank in table.items():
        length[rank] = len(piece)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), length


def attributed(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Interval join of tokens [start, end) with sections [bounds[i], bounds[i+1]): the section that gets each token."""
    first = np.searchsorted(bounds, start, side="right") - 1
    if rule == "first":
        return first
    last = np.searchsorted(bounds, end - 1, side="right") - 1
    if rule == "last":
        return last
    out = first.copy()
    for i in np.flatnonzero(last > first):  # few tokens reach over a boundary
        own = np.arange(first[i], last[i] + 1)
        out[i] = own[np.argmax(np.minimum(bounds[own + 1], end[i]) - np.maximum(bounds[own], start[i]))]
    return out


COUNTS = "doc_id long, field string, section int, start_char long, end_char long, n_tokens long"


def counter(ranks: bytes, fields: list[str], rule: str):
    """A function for mapInArrow: (doc_id, *fields) to one row for each line of each field."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, length = _encoding(ranks)
        for batch in batches:
            held: list[tuple[list, ...]] = []
            waiting = 0
            for i in range(len(batch)):
                doc_id = batch.column("doc_id")[i].cast(pa.int64()).as_py()
                texts = [batch.column(f)[i].as_py() or "" for f in fields]
                whole = "\n".join(texts)
                data = np.frombuffer(whole.encode(), np.uint8)
                breaks = np.flatnonzero(data == 10) + 1
                bounds = np.concatenate([[0], breaks, [len(data)]])
                ends = np.cumsum(length[encoding.encode_to_numpy(whole, disallowed_special=())])
                of = attributed(np.concatenate([[0], ends[:-1]])[: len(ends)], ends, bounds, rule)
                n = np.bincount(of, minlength=len(bounds) - 1)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
                lines = [text.count("\n") + 1 for text in texts]
                field = np.repeat(np.arange(len(fields)), lines)
                heads = np.cumsum(lines) - lines
                section = np.arange(len(field)) - heads[field]
                base = chars[heads][field]
                held.append(([doc_id] * len(field), field, section, chars[:-1] - base, chars[1:] - base, n))
                waiting += len(field)
                if waiting >= SECTIONS:
                    yield _batch(held, fields)
                    held, waiting = [], 0
            if held:
                yield _batch(held, fields)

    return count


def _batch(held: list[tuple], fields: list[str]) -> pa.RecordBatch:
    ids, field, section, start, end, n = zip(*held, strict=True)
    arrays = [
        pa.array([x for own in ids for x in own], pa.int64()),
        pa.array(fields).take(pa.array(np.concatenate(field))),
        pa.array(np.concatenate(section).astype(np.int32)),
        *(pa.array(np.concatenate(x).astype(np.int64)) for x in (start, end, n)),
    ]
    return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in COUNTS.split(", ")])


def section_tokens(docs: DataFrame, fields: list[str], vocabulary: str, rule: str = "first") -> DataFrame:
    """Tokens of every line of every field of ``docs`` (doc_id and ``fields``).

    A document is its fields joined by line breaks and encoded once, as a model would see it. Its lines, each with its
    line break, are sections; together they hold every byte. Token offsets come from the lengths of the tokens' bytes,
    so no text is encoded in parts. A token goes to one section by ``rule``, and a document's counts add up to its
    number of tokens. Offsets are characters within the field; the line break that joins two fields belongs to the
    first.

    ``vocabulary`` is a file of ranks that the driver reads once and sends to the tasks. A null or empty field is one
    section without text. Texts of any length are encoded whole, one document at a time. Rows that repeat are counted
    each; columns that aren't in ``fields``, whatever their names, aren't looked at. An empty table gives an empty
    result. Nothing is shuffled.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if not Path(vocabulary).is_file():
        raise FileNotFoundError(f"no vocabulary at {vocabulary}: give the path of a file of ranks")
    return docs.select("doc_id", *fields).mapInArrow(counter(Path(vocabulary).read_bytes(), fields, rule), COUNTS)


def op3_section_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of all documents, with their source and language as fields before the text."""
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["source", "lang", "text"], VOCABULARY)
