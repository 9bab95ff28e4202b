"""Corpus operators against plain versions, texts made to collide, any batch composition, odd columns and very long texts."""

import base64
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quarrymill.llm import decontamination, labelled, mixing, near_dedup, quality, rows, scoring, scratch, sharding, substring_dedup, token_counts, topk, toxicity, words

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def spark_hash(*values):
    """What the engine's xxhash64 gives for ints (int), longs (("long", x)) and strings; nulls are passed over."""
    h = 42
    for v in values:
        if v is None:
            continue
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v[1]) if isinstance(v, tuple) else struct.pack("<i", v)
        h = xxhash.xxh64(data, seed=h % 2**64).intdigest()
    return h - 2**64 if h >= 2**63 else h


def long(x):
    return None if x is None else ("long", x)


def thue_morse(n):
    a = ["a"]
    while len(a) < n:
        a += ["b" if c == "a" else "a" for c in a]
    return "".join(a)


def test_words_that_hashes_of_the_simple_kind_confuse(spark):
    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    frame = [f"w{i}" for i in range(34)]
    df = spark.createDataFrame([(1, " ".join([*frame, one])), (2, " ".join([*frame, other]))], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.without_repeats(df).collect()] == [0, 0]
    df = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}
    w = words.words(pa.array([one, other, "ab", "ba"]))
    assert len(set(w.hash.tolist())) == 4 and len(words.codes(w)[1]) == 4


def test_words_made_to_share_a_hash_are_not_near_duplicates(spark):
    a, b = "abcdefghijklmnop", "eaiytgfe(bd^.`yu"
    w = words.words(pa.array([a, b]))
    assert w.hash[0] == w.hash[1]  # in the hash without a key
    assert len(set(words.words(pa.array([a, b, a]), key=b"k").hash.tolist())) == 2
    rows = [(1, a), (2, b), (3, f"a b {a} a b {b}")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == {1: (1, 1), 2: (2, 1), 3: (3, 4)}


def test_sketches_never_rule_out_a_link(spark):
    rng = np.random.default_rng(3)
    sets = []
    for i in range(60):
        common = rng.integers(0, 2**63, 40 + i * 5).astype(np.uint64)
        sets.append(np.unique(np.concatenate([common[rng.random(len(common)) < 0.93], sets[-1][::7] if i % 3 else common[:9]])))
        sets.append(np.unique(common))
    rows = [(i, len(x), near_dedup.sketched(x).tolist()) for i, x in enumerate(sets)]
    a = spark.createDataFrame(rows, "i_a long, n_shingles_a long, sketch_a array<long>")
    b = spark.createDataFrame(rows, "i_b long, n_shingles_b long, sketch_b array<long>")
    kept = {(r["i_a"], r["i_b"]) for r in a.join(b, F.col("i_a") < F.col("i_b")).where(near_dedup.alike("a", "b", 80)).collect()}
    links = set()
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(x, sets[j]))
            if 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                links.add((i, j))
    assert links and links <= kept and len(kept) < len(sets) ** 2 / 4


def test_codes_and_digests_are_of_the_words():
    w = words.words(pa.array(["a  b\tc", "b c", None, "c", "a b c d"]))
    spelt = [bytes(w.data[a:b]) for a, b in zip(w.start, w.end, strict=True)]
    code, kinds = words.codes(w)
    assert [kinds[c].as_py() for c in code] == spelt
    d = words.digests(w, np.array([0, 6, 1, 3]), np.array([3, 9, 3, 5])).to_pylist()
    assert d[0] == d[1] and d[2] == d[3] != d[0]
    sets = near_dedup.shingle_codes(pa.array(["a b c d", "b c d e", "x", "x y", "x", None]), 3)
    assert len(np.intersect1d(sets[0], sets[1])) == 1 and (sets[2] == sets[4]).all() and not len(sets[5]) and sets[2][0] not in sets[3]


OTHERS = ["fool fool fool bread bread now here", "", "é" * 300, "x y z " * 500, None, "a\nb\nb\na\nlong line of words. Ends!", "some other text"]


def test_scores_do_not_depend_on_other_texts():
    rng = random.Random(3)
    texts = OTHERS + [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    labels = np.array([i % 2 for i in range(len(texts))])
    toxic = toxicity.train(pa.array(texts), labels, steps=(2, 2))
    good = quality.train(quality.features(pa.array(texts)), labels)
    t = scoring.tokens(pa.array(texts))
    symbol = (t.hash % np.uint64(scoring.SYMBOLS)).astype(np.int64)
    model = scoring.train(symbol, scoring.contexts(symbol, t))

    def scored(own):
        t = scoring.tokens(pa.array(own, pa.string()))
        symbol = (t.hash % np.uint64(scoring.SYMBOLS)).astype(np.int64)
        found = scoring.log_probabilities(symbol, scoring.contexts(symbol, t), model)
        return np.bincount(t.text, found, len(own))

    for score in (lambda x: toxicity.scores(pa.array(x, pa.string()), toxic), lambda x: quality.scores(pa.array(x, pa.string()), good), scored):
        whole = score(texts)
        order = rng.sample(range(len(texts)), len(texts))
        assert (score([texts[i] for i in order]) == whole[order]).all()
        assert (np.array([score([x])[0] for x in texts]) == whole).all()


def test_toxicity_against_plain_loops():
    rng = np.random.default_rng(0)
    model = toxicity.Model(rng.normal(0, 2, 1 << toxicity.BUCKETS_LOG).astype(np.float32), -0.5)
    texts = [*OTHERS, " ".join(f"t{i}" for i in range(77))]

    def bucket(piece):
        x = int.from_bytes(piece, "big") + (len(piece) << 48)
        x = x * 0x9E3779B97F4A7C15 % 2**64
        return ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % 2**64) >> (64 - toxicity.BUCKETS_LOG)

    def word_value(w):
        data = b" " + w.lower().encode() + b" "
        own = [model.table[bucket(data[i : i + n])] for n in toxicity.GRAMS for i in range(len(data) - n + 1)]
        return sum(map(float, own)) / max(len(own), 1)

    for text, got in zip(texts, toxicity.scores(pa.array(texts), model), strict=True):
        v = [word_value(w) for w in SPLIT.findall(text or "")]
        starts = [0] if len(v) <= toxicity.SEGMENT else range(0, -(-(len(v) - toxicity.SEGMENT) // toxicity.STRIDE) * toxicity.STRIDE + 1, toxicity.STRIDE)
        best = max((sum(v[a : a + toxicity.SEGMENT]) / len(v[a : a + toxicity.SEGMENT]) for a in starts), default=0) if v else 0
        assert math.isclose(got, 1 / (1 + math.exp(-(best + model.bias))), rel_tol=1e-5)


def test_quality_scores_are_sums_of_table_entries():
    texts = OTHERS + ["Good words here. Fine!", "%%% ### 12", "A b\nA b\nc"]
    x = quality.features(pa.array(texts))
    rng = np.random.default_rng(1)
    edges = [np.unique(np.quantile(x[:, k], [0.2, 0.5, 0.8])) for k in range(x.shape[1])]
    model = quality.Model(0.3, edges, rng.normal(size=(x.shape[1], quality.BINS)), [(0, 3), (2, 5)], rng.normal(size=(2, quality.BINS, quality.BINS)))
    for row, got in zip(x, quality.scores(pa.array(texts), model), strict=True):
        bins = [sum(v >= e for e in own) for v, own in zip(row, edges, strict=True)]
        logit = 0.3 + sum(model.tables[k][b] for k, b in enumerate(bins)) + sum(t[bins[i], bins[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert math.isclose(got, 1 / (1 + math.exp(-logit)), rel_tol=1e-9)
    lines = dict(zip(quality.FEATURES, quality.features(pa.array(["a b\nb a\na b"]))[0], strict=True))
    assert lines["distinct_lines"] == 2 / 3  # lines of the same words in another order are others


def test_language_model_scores_against_plain_loops(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["red", "blue", "green"]) + (str(rng.randrange(300)) if rng.random() < 0.5 else "") for _ in range(rng.randrange(0, 40)))) for i in range(120)]
    df = spark.createDataFrame([*docs, (500, None)], "doc_id long, text string")
    held = {}
    real = scoring.trained
    monkeypatch.setattr(scoring, "FREQUENT", 20)
    monkeypatch.setattr(scoring, "trained", lambda texts, counts: held.setdefault("model", real(texts, held.setdefault("counts", counts))))
    got = {r["doc_id"]: r["score"] for r in scoring.scored(df).collect()}
    model, counts = held["model"], held["counts"]
    training = [t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    n = Counter(w for t in training for w in SPLIT.findall(t))
    for i, text in [*docs, (500, None)]:
        t = scoring.tokens(pa.array([text], pa.string()))
        symbol, past, total = scoring.symbols(t, counts).tolist(), [], 0.0
        for w, s in zip([*SPLIT.findall(text or ""), None], symbol, strict=True):
            context = (past[::-1] + [scoring.SYMBOLS] * scoring.CONTEXT)[: scoring.CONTEXT]
            logits = sum(model.tables[j][c].astype(float) for j, c in enumerate(context)) @ model.targets.T.astype(float) + model.bias
            total += (logits[s] - np.log(np.exp(logits).sum())) / np.log(10)
            if s > scoring.OWN:
                total += math.log10((n[w] + 1) / counts.class_total[s - scoring.OWN - 1])
            past.append(s)
        assert math.isclose(got[i], total, rel_tol=1e-4), i


def test_token_counts_by_section_against_offsets(spark, tmp_path):
    import tiktoken

    pairs = [bytes([i]) for i in range(256)] + [b"th", b"the", b" t", b" th", b"\n\n", b"ab", b"\nb", b"\n\n\n"]
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" " + str(i).encode() for i, p in enumerate(pairs)))
    encoding = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks={p: i for i, p in enumerate(pairs)}, special_tokens={})
    docs = [(1, "the the\nab\n\n\nx", "é\nb"), (2, None, ""), (3, "th\n" * 40, "the \n\n ab")]
    df = spark.createDataFrame(docs, "doc_id long, title string, text string")
    for rule in token_counts.RULES:
        got = {(r["doc_id"], r["field"], r["section"]): r["n_tokens"] for r in token_counts.section_tokens(df, ["title", "text"], str(path), rule).collect()}
        want: Counter = Counter()
        for i, title, text in docs:
            whole = f"{title or ''}\n{text or ''}"
            sections = [(f, k, line) for f, x in (("title", title), ("text", text)) for k, line in enumerate((x or "").split("\n"))]
            owner = [(f, k) for f, k, line in sections for _ in (line + "\n").encode()][: len(whole.encode())]
            want.update({(i, f, k): 0 for f, k, _ in sections})
            at = 0
            for token in encoding.encode_ordinary(whole):
                own = owner[at : at + len(pairs[token])]
                most = max(sorted(set(own), key=own.index), key=lambda o: own.count(o))
                want[(i, *{"first": own[0], "last": own[-1], "most": most}[rule])] += 1
                at += len(pairs[token])
        assert got == dict(want)


def test_places_of_shards_are_recomputed(spark):
    ids = [*range(200), None]
    df = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
    leaves = [x._replace(weight=1.0 + x.shard % 3) for x in sharding.topology(24)]
    got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.sharded(df, leaves).collect()}

    def winner(i, nodes):
        draws = []
        for number, (name, weight) in nodes.items():
            unit = ((spark_hash(long(i), name) % 2**64 >> 11) + 0.5) / 2**53
            draws.append((-math.log(unit) / weight, number))
        return min(draws)[1]

    def place(i, own):
        tree = defaultdict(lambda: defaultdict(dict))
        for x in own:
            tree[x.region][x.rack][x.shard] = x.weight
        r = winner(i, {r: (f"region {r}", sum(sum(k.values()) for k in racks.values())) for r, racks in tree.items()})
        k = winner(i, {k: (f"rack {r}/{k}", sum(s.values())) for k, s in tree[r].items()})
        return winner(i, {s: (f"shard {r}/{k}/{s}", w) for s, w in tree[r][k].items()})

    assert got == {i: (place(i, leaves), place(i, sharding.grown(leaves))) for i in ids}


def test_words_taken_are_recomputed(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["w"] * rng.randrange(0, 90)) + f" d{i}", rng.choice(["a", "b", None])) for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    block, shards, seed = 16, 8, 17
    got = {r["doc_id"]: (r["taken"], r["target"], r["source_size"]) for r in mixing.mixed(df, block=block, shards=shards).collect()}
    size = {i: len(SPLIT.findall(t)) for i, t, _ in docs}
    source = {i: s for i, _, s in docs}
    for sid, s in enumerate(sorted(set(source.values()), key=lambda x: (x is None, x or "")), 1):
        own = [i for i in source if source[i] == s]
        key = {i: (spark_hash(long(i), dict((d, t) for d, t, _ in docs)[i]), i) for i in own}
        own.sort(key=lambda i: (spark_hash(long(key[i][0]), long(i)) % 1024, key[i]))
        total = sum(size[i] for i in own)
        target = got[own[0]][1]
        blocks = -(-total // block)
        draws = int(target * blocks / total + 0.5)
        by_shard = Counter(spark_hash(sid, long(t), seed) % shards for t in range(min(draws, 3 * blocks)))
        times, t = Counter(), 0
        for shard in sorted(by_shard):
            for _ in range(by_shard[shard]):
                x, drawn = t % blocks, spark_hash(sid, long(t // blocks), seed)
                for i in range(mixing.ROUNDS):
                    mirror = (spark_hash(long(drawn), i) % blocks - x) % blocks
                    x = mirror if spark_hash(long(drawn), i, long(max(x, mirror))) & 1 else x
                times[x] += 1
                t += 1
        at = 0
        for i in own:
            assert got[i][0] == sum(times[p // block] for p in range(at, at + size[i])) and got[i][2] == total
            at += size[i]


def plain_template(text):
    """(token, value, is a slot) of a text, word by word."""
    out, opens, number_before = [], True, False
    for word in SPLIT.findall(text or ""):
        bare = word
        for _ in range(4):
            bare = bare[1:] if bare and bare[0] in ".,;:!?'\"()[]{}<>*_|#&~`" else bare
            bare = bare[:-1] if bare and bare[-1] in ".,;:!?'\"()[]{}<>*_|#&~`" else bare
        if bare:
            low = "".join(c.lower() if c.isascii() else c for c in bare)
            number = bool(re.fullmatch(r"[0-9.,:/\-+%$]+", bare)) and any(c.isdigit() for c in bare)
            unit = number_before and low in decontamination.UNITS
            name = bool(re.match(r"[A-Z][a-z]", bare)) and not opens and not number and not unit
            out.append(("<number>" if number else "<unit>" if unit else "<name>" if name else low, low, number or unit or name))
            number_before = number
        opens = word[-1] in ".!?"
    return out


def plain_leaks(docs, items, size=8, literals=5, share=0.5):
    found = set()
    for d, doc in docs:
        t = plain_template(doc)
        for i, item in items:
            own = plain_template(item)
            if not own:
                continue
            n = min(size, len(own))
            low = range(len(own) - n + 1)
            good = [a for a in low if n == size and sum(not x[2] for x in own[a : a + n]) >= literals]
            if len(own) < size and sum(not x[2] for x in own) >= literals:
                good = list(low) if not any(x[2] for x in own) else good
            weak, used = not good, good or list(low)
            met = defaultdict(list)
            for a in used:
                for b in range(len(t) - n + 1):
                    if [x[0] for x in own[a : a + n]] == [x[0] for x in t[b : b + n]]:
                        met[b - a].append({"item_place": a, "item_slots": [x[1] for x in own[a : a + n] if x[2]], "slots": [x[1] for x in t[b : b + n] if x[2]]})
            whole = (len(used) if sum(not x[2] for x in own) >= decontamination.FEW else len(used) + 1) if weak else 0
            places = {p for m in met.values() for p in decontamination.evidence(m, whole)[0]}
            if len(places) / len(used) >= share:
                found.add((d, i))
    return found


def test_leaks_against_all_pairs(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["apple", "river", "stone", "cloud", "paper", "glass", "train", "house"]) + str("abcdefgh"[rng.randrange(8)])
    item = lambda k: " ".join(rng.choice([word, word, word, lambda: str(rng.randrange(99)), lambda: rng.choice(["Anna", "Boris"])])() for _ in range(k))
    items = [(i, item(rng.randrange(9, 30))) for i in range(12)] + [(20, "Compute 12 x 14 - 3 x 9 + 2"), (21, "what is 7 of 9 here"), (22, "3 + 4"), (23, "one small step for man"), (24, None)]
    docs = []
    for d in range(60):
        body = [word() for _ in range(rng.randrange(0, 12))]
        chosen = rng.choice(items)[1] or ""
        kind = d % 5
        if kind == 1:
            body += chosen.split()
        elif kind == 2:
            body += re.sub(r"\d+", lambda m: str(int(m.group()) + 100), chosen).split()
        elif kind == 3:
            body += re.sub(r"\d+", lambda _: str(rng.randrange(9)), chosen).split()
        elif kind == 4:
            body += chosen.split()[: rng.randrange(1, 20)]
        docs.append((d, " ".join(body + [word() for _ in range(5)])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(df, bench).collect()}
    want = plain_leaks(docs, items)
    assert got == want and len(want) > 15
    assert {i for _, i in want} >= {20, 21}


def test_openings_that_many_items_share_bring_nothing_together(spark):
    opening = "which of the following statements about the old harbour towns is true in every"
    items = [(i, f"{opening} " + " ".join(f"own{i}x{j}" for j in range(16))) for i in range(100)]
    docs = [(i, f"{opening} " + " ".join(f"doc{i}x{j}" for j in range(30))) for i in range(200)] + [(1000, f"so then {items[7][1]} indeed"), (None, items[8][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    own = bench.mapInArrow(decontamination.itemiser(8, 5), decontamination.ITEMS)
    texts = df.selectExpr("doc_id AS id", "coalesce(doc_id, -1) AS key_a", "0L AS key_b", "text")
    found = texts.mapInArrow(decontamination.windower(None, [8]), decontamination.WINDOWS)
    assert found.join(own, "window").count() >= 200 * 100 * 6
    assert sorted(r["key_a"] for r in decontamination.candidates(found, own).collect()) == [-1, 1000]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(df, bench).collect()}
    assert got == {(1000, 7), (None, 8)}
    for share in (0.3, 0.31):  # the opening has 7 of an item's 23 windows
        few = spark.createDataFrame(items[6:9], "item_id long, text string")
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(df, few, share=share).collect()}
        every = {i for i, _ in docs} if share <= 0.3 else set()
        assert got == {(1000, 7), (None, 8)} | {(i, j) for i in every for j in (6, 7, 8)}


def test_items_of_one_template_are_one_class(spark):
    text = "The shop sold {} apples in the morning before noon and then packed {} more boxes for the road"
    items = [(i, text.format(10 + i, 50 + i)) for i in range(1, 20)] + [(40, text.format(7, 7)), (50, "an item of its own with many words that nothing else has at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(1, text.format(3, 4)), (2, text.format(5, 5))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["items"]) for r in decontamination.leaks(df, bench).collect()}
    assert {(1, 1, 19), (2, 40, 1)} <= got and (2, 1, 19) not in got and len(got) <= 3  # two values aren't read as one
    assert {r["item_id"]: r["representative"] for r in decontamination.members(bench).collect()} == {**{i: 1 for i in range(1, 20)}, 40: 40, 50: 50}


EXTRA = ["_id", "_copies", "copies", "copy", "of", "key", "key_a", "key_b", "_key", "_label", "anchor", "row", "place", "shard", "slot", "id", "word", "found", "taken", "sid", "node", "cell"]


def crowded(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


def test_other_columns_do_not_matter(spark, tmp_path):
    said = "one two three four five six seven eight nine ten"
    docs = [(i, f"{said} {i} more words for document number {i}", "en", "ab"[i % 2], 1) for i in range(12)] + [(3, "another text under the same id", "en", "a", 1), (None, said, "en", None, 1), (None, "no id and other words", "en", "b", 1), (20, None, "en", "a", 0), (21, " ", None, "a", 0)]
    df = crowded(spark, docs)
    labels = spark.createDataFrame([(i, i % 2, i % 2, 5) for i in range(12)], "doc_id long, quality int, toxic int, _label int")
    bench = spark.createDataFrame([(1, said, 1, 2)], "item_id long, text string, window int, class int")
    n = len(docs)
    assert substring_dedup.without_repeats(df).count() == n and near_dedup.near_duplicates(df).count() == n
    assert sharding.sharded(df, sharding.topology(3)).count() == n and mixing.mixed(df).count() == n
    assert decontamination.leaks(df, bench).count() == 13
    assert scoring.scored(df).count() == n
    assert quality.scored(df, quality.fitted(df, labels)).count() == n and toxicity.scored(df, toxicity.fitted(df, labels)).count() == n
    vectors = spark.createDataFrame([(i, [float(i), 1.0], 0, 0, 0) for i in range(9)], "vec_id long, embedding array<double>, id int, cell int, whole int")
    assert topk.nearest(vectors, vectors).count() == 45
    path = f"file://{tmp_path}"
    labels.write.parquet(f"{path}/labels.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, path)
        assert out.columns == df.columns and out.count() >= (4 if name == "decontamination" else 5), name
    kept = corpus_pipeline.drop_near_duplicates(spark, df, path).collect()
    assert [r["text"] for r in kept if r["doc_id"] == 3 and r["text"].startswith("another")] and sum(r["doc_id"] is None for r in kept) == 2
    assert corpus_pipeline.shard(spark, df, path).count() == n


def test_several_texts_under_one_id(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (1, "a b c d e"), (2, "v w x y z"), (None, "q r s t"), (None, "q r s t")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"], r["n_shingles"]) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True, 3)] * 3 + [(2, 1, False, 3)] + [(None, None, True, 2)] * 2, key=str)
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    rows_ = labelled.training_rows(df, labels, "toxic", 5, 0, {1: 5}, 100).collect()
    assert [(r["doc_id"], r["text"]) for r in rows_] == [(1, "a b c d e")]


def test_one_very_long_text(spark, tmp_path):
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    whole = " ".join(f"w{rng.randrange(10**6)}" for _ in range(350_000))  # more than a piece of a batch
    df = spark.createDataFrame([(1, f"{whole} {passage}"), (2, passage), (3, "x" * 3_000_000), (4, "\n" * 100_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.without_repeats(df).collect()}
    assert got == {1: (350_060, 60), 2: (60, 60), 3: (1, 0), 4: (0, 0)}
    sizes = {r["doc_id"]: r["n_shingles"] for r in near_dedup.near_duplicates(df).collect()}
    assert sizes[1] > 349_000 and sizes[3] == 1 and sizes[4] == 0
    assert decontamination.leaks(df, spark.createDataFrame([(9, passage)], "item_id long, text string")).count() == 2
    x = quality.features(pa.array([r["text"] for r in df.orderBy("doc_id").collect()]))
    assert math.isclose(x[0][0], math.log1p(350_060)) and x[2][quality.FEATURES.index("longest_word")] == 3_000_000
    sums = {r["doc_id"]: r["n"] for r in scoring.scored(df).select("doc_id", F.col("n_tokens").alias("n")).collect()}
    assert sums == {1: 350_061, 2: 61, 3: 2, 4: 1}


def test_rows_and_scratch(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (None, None)], "doc_id long, text string")
    a, b = rows.row_keys(df)
    keys = [tuple(r) for r in df.select(a, b).collect()]
    assert len(set(keys)) == 4 and keys[0][0] == keys[1][0] == 1
    assert rows.fresh(df, "doc_id", "x", "X") == ["_doc_id", "x", "_X"]
    table = scratch.written(df, "test")
    folder = table.inputFiles()[0].rsplit("/", 1)[0]
    assert spark.sparkContext.applicationId in folder and table.count() == 4
    scratch.dropped(table)
    with pytest.raises(Exception, match="(?i)not.exist|FILE_NOT_EXIST|PATH_NOT_FOUND"):
        spark.read.parquet(folder).count()
