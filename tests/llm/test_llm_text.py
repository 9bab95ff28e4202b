"""Substring dedup, near dedup, decontamination and token counts against brute force and on edge cases."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarrymill.llm import components, decontamination, near_dedup, substring_dedup, token_counts, words

SCHEMA = "doc_id long, text string, lang string"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "one"), (None, "a b c d"), (905, "é " * 50 + "x"), (906, "w" * 5000), (907, " nbsp stays\x0bsplit")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA)


def corpus(seed=0, n=60, words_a_doc=80):
    """Texts with copies, near copies, shared passages and repeats inside one text."""
    rng = random.Random(seed)
    new = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    passage, rows = new(50), []
    for i in range(n):
        kind, w = i % 6, new(words_a_doc)
        if kind == 1 and rows:
            w = SPLIT.findall(rngtext(rows, rng))
        elif kind == 2 and rows:
            w = SPLIT.findall(rngtext(rows, rng))
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = "changed"
        elif kind == 3:
            at = rng.randrange(len(w))
            w[at:at] = passage[rng.randrange(0, 12) :]
        elif kind == 4:
            w = w + w[3:60]
        rows.append((i, " ".join(w)))
    return rows


def rngtext(rows, rng):
    return rng.choice(rows)[1]


def without_windows(rows, size=35):
    counts, split = collections.Counter(), [(i, SPLIT.findall(t or "")) for i, t in rows]
    for _, w in split:
        counts.update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if counts[tuple(w[k : k + size])] > 1:
                gone.update(range(k, k + size))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_words_match_the_pattern():
    texts = [t for _, t in EDGE]
    w = words.words(pa.array(texts))
    found = [[bytes(w.data[a:b]).decode() for a, b in zip(w.start[x:y], w.end[x:y], strict=True)] for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
    assert found == [SPLIT.findall(t or "") for t in texts]
    same = words.words(pa.array(["The cat", "the CAT"]), lower=True).hash
    assert same[0] == same[2] and same[1] == same[3] and same[0] != same[1]
    assert [len(p) for p in words.pieces(pa.record_batch({"text": pa.array(["a" * 10] * 5)}), most=25)] == [2, 2, 1]


@pytest.mark.parametrize("seed", [0, 1])
def test_substring_dedup(spark, seed):
    rows = corpus(seed) + EDGE
    got = substring_dedup.without_repeats(table(spark, rows)).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got], key=str) == without_windows(rows)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    assert all(sum(f["end"] - f["start"] for f in r["factors"]) == r["n_removed"] for r in got)


def test_substring_dedup_repeated_rows_and_empty(spark):
    rows = [(1, " ".join(f"x{i}" for i in range(40)))] * 2 + [(2, None)]
    assert sorted(r["n_removed"] for r in substring_dedup.without_repeats(table(spark, rows)).collect()) == [0, 40, 40]
    assert substring_dedup.without_repeats(table(spark, []).limit(0)).count() == 0


def shingles(text, n):
    w = SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(rows, n, similarity):
    sets = {i: shingles(t, n) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("n,similarity", [(3, 85), (5, 80)])
def test_near_duplicates(spark, n, similarity):
    rows = corpus(3, 120) + [(i, t) for i, t in EDGE if i is not None]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(table(spark, rows), n, similarity).collect()}
    assert got == groups(rows, n, similarity)


def test_near_duplicates_of_a_large_altered_group(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == groups(rows, 3, 85)


def test_near_duplicates_nulls_and_empty(spark):
    got = near_dedup.near_duplicates(table(spark, [(None, "a b c"), (5, "a b c"), (5, "a b c"), (3, "A b  c")])).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str) == sorted([(None, 3, False), (5, 3, False), (5, 3, False), (3, 3, True)], key=str)
    assert near_dedup.near_duplicates(table(spark, []).limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(30, 31), (31, 32), (32, 30), (40, 40)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 21)}, 30: 30, 31: 30, 32: 30}


ITEM = "A train leaves the station with 120 passengers and travels 60 km in 2 hours before Anna counts all the people who stay on board"


def test_decontamination(spark):
    rng = random.Random(1)
    noise = lambda k: " ".join(f"z{rng.randrange(10**6)}" for _ in range(k))
    other = ITEM.replace("120", "75").replace("60", "90").replace("Anna", "Boris")
    mixed = ITEM.replace("60 km in 2", "120 km in 2")  # the item's two values become one value: no consistent reading
    docs = [(1, f"{noise(30)} {ITEM} {noise(30)}"), (2, f"{noise(9)} {other}. {noise(9)}"), (3, noise(80)), (4, None), (5, ""), (6, "A train leaves the station with 120 passengers"), (7, f"{noise(5)} {mixed}"), (1, f"{noise(30)} {ITEM}")]
    bench = spark.createDataFrame([(10, ITEM), (11, noise(30)), (12, None), (13, "short one here")], "item_id long, text string")
    for sent in (decontamination.SENT, 0):  # hashes sent to the tasks, and the way beyond that bound
        got = decontamination.leaks(table(spark, docs), bench, sent=sent).collect()
        assert sorted((r["doc_id"], r["item_id"], r["reparameterised"]) for r in got) == [(1, 10, False), (1, 10, False), (2, 10, True)]
    assert decontamination.leaks(table(spark, []).limit(0), bench).count() == 0
    assert decontamination.leaks(table(spark, docs), bench.limit(0)).count() == 0


def test_one_inconsistent_slot_keeps_the_alignment(spark):
    item = "The shop sold 120 apples in the morning before noon and then Anna packed 60 more boxes for the road while the clerk still wrote that 120 apples were sold"
    one, clash = item.replace("that 120", "that 75"), item.replace("that 120", "that 60")
    other = item.replace("120", "33").replace("60", "44").replace("that 33", "that 55")
    shared = item.replace("120", "5").replace("60", "5")
    docs = [(1, f"zz {one} zz"), (2, f"zz {clash} zz"), (3, f"zz {other} zz"), (4, f"zz {shared} zz"), (5, item)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["reparameterised"], r["share"] < 1) for r in decontamination.leaks(table(spark, docs), bench).collect()}
    assert got == {1: (True, True), 2: (True, True), 3: (True, True), 5: (False, False)}


def test_templates():
    t = decontamination.template(pa.array(["Bob saw Anna buy 3.5 kg, or 12% of it. The end", "km 5"]))
    kinds = [{decontamination.NUMBER: "N", decontamination.UNIT: "U", decontamination.NAME: "A"}.get(x, ".") for x in t.token]
    assert "".join(kinds[: t.first[1]]) == "..A.NU.N....".replace("....", "....")[: t.first[1]]
    assert kinds[t.first[1] :] == [".", "N"]


def ranks(tmp_path):
    pairs = [bytes([i]) for i in range(256)] + [b"th", b"the", b" t", b" th", b"\n\n", b"ab", b"\nb"]
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" " + str(i).encode() for i, p in enumerate(pairs)))
    return str(path)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, tmp_path, rule):
    import tiktoken

    vocabulary = ranks(tmp_path)
    rows = [(1, "the the\nab\n\nx"), (2, None), (3, ""), (4, "é\n" * 3), (4, "é\n" * 3), (None, "ab")]
    df = table(spark, rows)
    got = token_counts.section_tokens(df, ["lang", "text"], vocabulary, rule).collect()
    table_ = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(vocabulary, "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=table_, special_tokens={})
    total = sum(len(encoding.encode_ordinary("en\n" + (t or ""))) for _, t in rows)
    assert sum(r["n_tokens"] for r in got) == total
    assert len(got) == sum(2 + (t or "").count("\n") for _, t in rows)
    one = sorted((r["section"], r["start_char"], r["end_char"]) for r in got if r["doc_id"] == 1 and r["field"] == "text")
    assert one == [(0, 0, 8), (1, 8, 11), (2, 11, 12), (3, 12, 13)]
    assert token_counts.section_tokens(df.limit(0), ["text"], vocabulary).count() == 0


def test_boundary_rules():
    start, end, bounds = np.array([0, 3, 8]), np.array([3, 8, 9]), np.array([0, 4, 9])
    assert token_counts.attributed(start, end, bounds, "first").tolist() == [0, 0, 1]
    assert token_counts.attributed(start, end, bounds, "last").tolist() == [0, 1, 1]
    assert token_counts.attributed(start, end, bounds, "most").tolist() == [0, 1, 1]
    with pytest.raises(ValueError):
        token_counts.section_tokens(None, [], "", rule="other")
