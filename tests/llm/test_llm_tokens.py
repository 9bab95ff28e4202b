"""Packing, alignment and resampling against plain versions, and on odd tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.llm import alignment, packing, resampling, segments

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

A, B = (segments.file_bytes(public_tokenizers.path(p)) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
PLAIN = tokenizers.Tokenizer.from_str(A.decode())
PIECES = sentencepiece.SentencePieceProcessor(model_proto=B)
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "Don't we've x'y .'s '", "one two\nthree\n\nfour\r\nfive \n six", "a b c  d  e", "x▁y ▁ z", "<|endoftext|> a<|endoftext|>b <|endoftext|>",
    "é ́x 日本 語 \U0001f600 \U0001f600‍ x", "12,345.67 (a)b[c]{d}|e|f", "tab\tx \t y\x00z \x7f q", "\u0085  x 　y᠎ z", "a" * 3000 + " " + "b" * 5, "<s> </s> <unk> <0x41> a",
    "\n", "\n\na", "a\n", ".\nfoo bar.\n", "é.\nÉ à,b", "wörter. Wörter,und\nmehr",
]


SPELT_A, SPELT_B = segments.byte_level(A, specials=False)[1], alignment.piece_level(B)[1]
WHOLE = tokenizers.Tokenizer.from_str(A.decode())
WHOLE.encode_special_tokens = True


def same_ids(texts):
    ids, bounds = packing.token_ids(pa.array(texts), A)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == PLAIN.encode(t or "", add_special_tokens=False).ids, t


def plain_alignment(text):
    """Ids, groups and links of a text, token by token."""
    if not text:
        return None
    a, b, data = WHOLE.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text), (" " + text).encode()
    if b"".join(SPELT_A[i] for i in a) != data or b"".join(SPELT_B[i] for i in b) != data:
        return None
    ends = [list(np.cumsum([len(s[i]) for i in x])) for x, s in ((a, SPELT_A), (b, SPELT_B))]
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        to_a, to_b = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append(",".join(map(str, a[i:to_a])) + "|" + ",".join(map(str, b[j:to_b])))
        links.append((a[to_a - 1], b[to_b - 1]))
        i, j = to_a, to_b
    return len(a), len(b), ";".join(groups), links


def plain_figures(texts):
    own = [plain_alignment(t) for t in texts]
    count = Counter(link for x in own if x for link in x[3])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [
        (x[0], x[1], len(x[3]), len(x[3]), sum(count[k] == most[k[1]] for k in x[3]), sum(count[k] for k in x[3]), hashlib.sha256(x[2].encode()).hexdigest(), x[2]) if x else (0, 0, 0, 0, 0, 0, "", "")
        for x in own
    ]


def aligned_in_one(texts):
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    return pa.Table.from_batches(list(alignment.aligner(A, B, True)(iter([batch])))).to_pylist()


def test_ids_are_those_of_whole_texts():
    same_ids([*ODD, None])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab eé.,'\n\t|<>-1   ▁日sS"), max_size=40), min_size=1, max_size=6))
def test_ids_and_groups_of_any_text(texts):
    same_ids(texts)
    for got, text in zip(aligned_in_one(texts), texts, strict=True):
        want = plain_alignment(text)
        assert (got["n_a"], got["n_b"], got["groups"]) == (want[:3] if want else (0, 0, ""))


def test_alignment(spark):
    texts = [*ODD, None, "the cat sat", "the cat sat", "the dog"]
    df = spark.createDataFrame([(None if i == 3 else i, t, "x", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, n_a string, pairs double").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.aligned(df, A, B, with_groups=True).collect()}
    want = plain_figures(texts)
    assert len(got) == len(texts)
    assert all(got[None if i == 3 else i] == w for i, w in enumerate(want))
    assert alignment.aligned(df.where("false"), A, B).count() == 0
    assert [tuple(r)[1:] for r in alignment.aligned(df.where("text is null"), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "", None)]


def packed_rows(spark, texts, **options):
    df = spark.createDataFrame([(i, t, 7, "y") for i, t in texts], "doc_id long, text string, piece int, offset string").repartition(4)
    rows = packing.packed(df, A, with_ids=True, **options).collect()
    capacity, at = options.get("capacity", packing.CAPACITY), {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0) and r["length"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"])
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= capacity for n in at.values())
    return rows, len(at)


def test_packing_gives_documents_back(spark):
    texts = [(i % 7 if i % 5 else None, f"{t} " * (1 + i % 9)) for i, t in enumerate(ODD)] + [(50, None), (51, ""), (52, "word " * 500), (52, "word " * 500), (53, "x" * 200_000)]
    rows, _ = packed_rows(spark, texts, capacity=64, block=8)
    found = Counter()
    docs = {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
    for key, own in docs.items():
        want = Counter(tuple([*PLAIN.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in texts if k == key)
        if sum(want.values()) == 1:
            ids = b"".join(r["ids"] for r in sorted(own, key=lambda r: r["piece"]))
            assert Counter([struct.unpack(f"<{len(ids) // 4}I", ids)]) == want
            assert all(r["length"] == 64 for r in own if r["piece"])
        assert sum(r["length"] for r in own) == sum(len(x) * n for x, n in want.items())
        found[key] = len(own)
    assert set(found) == {k for k, _ in texts}
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), A).count() == 0


def test_packing_of_blocks_is_close_to_the_least(spark):
    rng = np.random.default_rng(3)
    texts = [(i, " a" * int(n)) for i, n in enumerate(rng.integers(5, 90, 600))]
    _, n = packed_rows(spark, texts, capacity=100, block=100)
    sizes = np.array([len(PLAIN.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts])
    least = packing.bound(sizes, 100)
    plain = len(packing.best_fit([], sorted(sizes.tolist(), reverse=True), list(range(600)), 100))
    assert least <= n <= plain * 1.04
    _, again = packed_rows(spark, [(1, " b b b")] * 700, capacity=16, block=100)  # equal rows only
    assert again == math.ceil(700 / (16 // 4))


def test_islands_mend_what_best_fit_leaves():
    sizes = [51, 27, 23, 23, 23, 27, 51, 26, 26, 23, 27, 51] * 6  # best fit by size needs more than these need
    capacity = 101
    sizes = sorted(sizes, reverse=True)
    start = packing.best_fit([], sizes, list(range(len(sizes))), capacity)
    least = packing.bound(np.array(sizes), capacity)
    best = packing.evolved(sizes, [], capacity, least, 1)
    assert sorted(i for b in best for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= capacity for b in best)
    assert least <= len(best) <= len(start)
    child = packing.crossed(best, start, sizes, capacity, np.random.default_rng(0))
    assert sorted(i for b in child for i in b) == list(range(len(sizes)))


def test_bound_is_never_above_the_least():
    rng = np.random.default_rng(0)
    for _ in range(200):
        bins = [rng.multinomial(20 - rng.integers(0, 4), np.ones(k) / k) for k in rng.integers(1, 5, 6)]
        sizes = np.array([x for b in bins for x in b if x])
        assert packing.bound(sizes, 20) <= 6


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(low)
    return [" ".join(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1)], len(ws)


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_buckets_by_suffix_array(longest):
    rng = np.random.default_rng(longest)
    texts = [" ".join(rng.choice(["a", "b", "Ab", "ü", "x9", "-", "日本"], n)) for n in rng.integers(0, 40, 30)] + [None, "", "b", "a"]
    bucket, text, words = resampling.bucketed(pa.array(texts), longest, 997)
    for i, t in enumerate(texts):
        want, n = features(t, longest)
        assert Counter(bucket[text == i].tolist()) == Counter(zlib.crc32(x.encode()) % 997 for x in want) and words[i] == n


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(spark, longest):
    rng = np.random.default_rng(5)
    texts = [(int(i % 40) if i % 11 else None, " ".join(rng.choice(["Alpha", "beta", "gamma,", "delta-", "ü"], n))) for i, n in enumerate(rng.integers(0, 30, 120))]
    texts += [(200, None), (201, ""), (7, "beta " * 25), (7, "beta " * 25), (300, "gamma beta " * 60_000)]
    target, buckets = ["alpha alpha beta", None, "zeta"], 50
    got = resampling.resampled(
        spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, score long").repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), longest, buckets, percent=30, least_words=10
    )
    s, t = (Counter(zlib.crc32(x.encode()) % buckets for text in own for x in features(text, longest)[0]) for own in ([x for _, x in texts], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in texts:
        own, n = features(text, longest)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[2] >= 10), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {}
    for place, r in enumerate(able[: len(able) * 30 // 100], 1):
        drawn.setdefault(r, []).append(place)
    found = {}
    for r in got.collect():
        found.setdefault(tuple(r)[:5], []).append(r["rank"])
    assert Counter(rows) == Counter({k: len(v) for k, v in found.items()})
    assert {k: sorted(x for x in v if x) for k, v in found.items() if any(v)} == drawn


def test_resampling_of_nothing(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampling.resampled(none, some).count() == 0
    assert [(r["weight"] is not None, r["rank"]) for r in resampling.resampled(some, none).collect()] == [(True, None)]


def test_labels_of_other_documents_take_no_place(spark):
    from quarrymill.llm import labelled

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    own = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5]
    rows = labelled.training_rows(docs, labels, "toxic", 5, 0, {0: 100, 1: 100}, 1000).collect()
    assert sorted(r["doc_id"] for r in rows) == own


def test_islands_are_dealt_to_fewer_tasks_than_there_are():
    assert [packing.tasks_of(n) for n in (1, 4, 5, 125, 6250, 10**6)] == [1, 1, 2, 32, 1563, packing.TASKS]


def test_best_fit_takes_the_least_room_and_of_equal_rooms_the_first():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes, capacity = rng.integers(1, 30, 60).tolist(), 30
        start = [[0, 1]] if sizes[0] + sizes[1] <= capacity else [[0], [1]]
        items = rng.permutation(np.arange(2, 60)).tolist()
        want = [list(b) for b in start]
        for i in items:
            rooms = [(capacity - sum(sizes[x] for x in b), k) for k, b in enumerate(want)]
            fits = [x for x in rooms if x[0] >= sizes[i]]
            if fits:
                want[min(fits)[1]].append(i)
            else:
                want.append([i])
        assert packing.best_fit([list(b) for b in start], sizes, items, capacity) == want


def test_segments_are_looked_up_once_and_listed_whole():
    looked = []

    class Counted(dict):
        def __contains__(self, k):
            looked.append(k)
            return super().__contains__(k)

        def __getitem__(self, k):
            looked.append(k)
            return super().__getitem__(k)

        def get(self, k, other=None):
            looked.append(k)
            return super().get(k, other)

    known, asked = segments.Known(lambda new: asked.append(list(new)) or [len(k) for k in new]), []
    known.held = Counted()
    long = b"x" * (segments.KEPT_BYTES + 1)
    for kinds, new in (([b"a", b"bb", long], [b"a", b"bb", long]), ([b"bb", b"c", long], [b"c", long]), ([], [])):
        before = len(looked)
        assert known(kinds) == [len(k) for k in kinds] and len(looked) - before <= len(kinds)
        assert sum(asked[-1:], []) == new or not kinds
    values = pa.array([b"", b"ab", b"\x00", b"", "é".encode(), b"xyz"], pa.large_binary())
    for some in (values, values[:0], values[1:], values[2:5]):
        assert segments._listed(some) == some.to_pylist()


def test_cuts_of_bytes_against_plain_loops():
    rng, letters = random.Random(8), "aZ09   '|.-\n\t\x7f\u00e9\x85\xa0\u1680\u2003\u2028\u205f\u3000\u0142\u2603\U0001d11e"
    for n in [1, 2, 3, *range(4, 90)]:
        data = "".join(rng.choice(letters) for _ in range(n)).encode()
        plain = lambda i, d=data: 0x20 < d[i] != 0x7F
        odd = lambda i, d=data: 0 <= i < len(d) - 1 and bool(segments._WIDE[d[i] << 8 | d[i + 1]])
        want = [i for i in range(1, len(data) - 1) if data[i] == 0x20 and plain(i - 1) and plain(i + 1) and not (odd(i - 2) or odd(i - 3) or odd(i + 1))]
        array = np.frombuffer(data, np.uint8)
        assert segments.cuts(array).tolist() == want
        letter = lambda i, d=data: chr(d[i]).isalpha() and d[i] < 0x80
        mark = lambda i, d=data: chr(d[i]) in "'.-"
        fine = {i for i in range(1, len(data)) if letter(i - 1) and mark(i) or mark(i - 1) and data[i - 1] != 0x27 and letter(i)}
        lone = {i for i in range(1, len(data) - 1) if data[i] == 0x0A and plain(i - 1) and plain(i + 1) and max(data[i - 1], data[i + 1]) < 0x7F}
        assert set(segments.fine_cuts(array).tolist()) == fine | lone | {i + 1 for i in lone}
