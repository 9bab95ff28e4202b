"""Classifiers, language model, search, sharding, mixing and the pipeline: held-out accuracy, brute force, invariants."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrymill.llm import mixing, numbering, quality, scoring, sharding, topk, toxicity

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def texts(n=400, seed=0):
    """Half clean, a quarter with insults (also misspelt), a quarter junk."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "lo", "mi", "re", "san", "ko"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(20, 120))]
        toxic, good = int(i % 4 == 1), int(i % 4 != 2)
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "idi0t", "idiots", "morons", "moron", "mor0n"])
        if not good:
            w = [x + rng.choice(["###", "%%%"]) for x in w]
        rows.append((i, " ".join(w), toxic, good))
    return rows


def test_toxicity_held_out():
    rows = texts()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    train = [r for r in rows if not held(r[0])]
    model = toxicity.train(pa.array([r[1] for r in train]), np.array([r[2] for r in train]))
    test = [r for r in rows if held(r[0])]
    right = (toxicity.scores(pa.array([r[1] for r in test]), model) >= 0.5) == np.array([r[2] for r in test])
    assert right.mean() > 0.95
    assert toxicity.scores(pa.array(["mi lo re moronz ta ta lo ko"]), model)[0] > toxicity.scores(pa.array(["mi lo re taloko ta ta lo ko"]), model)[0]


def test_toxicity_edges(spark):
    model = toxicity.train(pa.array(["a", "b"]), np.array([0, 0]))
    df = documents(spark, [(1, None, "s"), (2, "", "s"), (None, "x " * 20000, "s"), (2, "", "s")])
    got = toxicity.scored(df, model).collect()
    assert len(got) == 4 and all(0 <= r["score"] < 0.01 and r["predicted"] == 0 for r in got)
    assert toxicity.scored(df.limit(0), model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fitted(df, labels).bias == -20.0


def test_quality_held_out(spark):
    rows = texts(seed=2)
    df = documents(spark, [(i, t, "s") for i, t, _, _ in rows] + [(None, None, "s"), (1000, "", "s")])
    labels = spark.createDataFrame([(i, g, x) for i, _, x, g in rows], "doc_id long, quality int, toxic int")
    model = quality.fitted(df, labels)
    got = {r["doc_id"]: r for r in quality.scored(df, model).collect()}
    assert len(got) == len(rows) + 2 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i]["predicted"] == g for i, _, _, g in held]) > 0.97
    assert quality.train(np.zeros((0, len(quality.FEATURES))), np.zeros(0)).intercept == 20.0


def test_features_against_plain_counts():
    x = quality.features(pa.array(["Aa bb!! bb\nAa bb!! bb\n1 #", None, ""]))
    f = dict(zip(quality.FEATURES, x[0], strict=True))
    assert math.isclose(f["log_words"], math.log1p(8)) and math.isclose(f["distinct_words"], 5 / 8) and math.isclose(f["distinct_lines"], 2 / 3)
    assert math.isclose(f["upper_letters"], 2 / 12) and math.isclose(f["symbol_words"], 1 / 8) and f["longest_word"] == 4
    assert not x[1:].any()


def test_language_model(spark):
    rng = random.Random(0)
    a, b = ([f"{p}{rng.randrange(60)}" for _ in range(400)] for p in ("xa", "qu"))
    rows = [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(rng.randrange(10, 60))), "s") for i in range(300)]
    rows += [(300, None, "s"), (301, "", "s"), (302, "unseen words only", "s"), (None, "xa1 qu2", "s"), (5, rows[5][1], "s")]
    got = scoring.scored(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts: dict = {}
    for i, t, _ in rows:
        if not held(i):
            for w in [*SPLIT.findall((t or "").lower()), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    by_id = {i: t for i, t, _ in rows}
    for r in got:
        w = [*SPLIT.findall((by_id[r["doc_id"]] or "").lower()), None]
        base = sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(x in counts for x in w), n, held(r["doc_id"]))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isfinite(r["score"]) and r["score"] < 0
    full = [r for r in got if r["held_out"] and r["n_tokens"] > 9]
    assert sum(r["score"] for r in full) > sum(r["base_score"] for r in full)
    assert scoring.scored(documents(spark, []).limit(0)).count() == 0


def test_language_model_learns_from_all_documents(spark):
    rows = [(i, "red blue " * 4 if i % 2 else "green house " * 4, "s") for i in range(600)]
    training = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(600))
    learned, real = spark.sparkContext.accumulator(0), scoring.learner

    def counting(state, counts, passes, number):
        def run(batches):
            def count():
                for x in batches:
                    learned.add(len(x))
                    yield x

            return real(state, counts, passes, number)(count())

        return run

    scoring.learner = counting
    try:
        got = [r for r in scoring.scored(documents(spark, rows * 4)).collect() if r["held_out"]]
    finally:
        scoring.learner = real
    assert learned.value == 4 * training * scoring.ROUNDS > 1500 * scoring.ROUNDS
    assert all(r["score"] > r["base_score"] for r in got)
    counts = scoring.summed(spark.createDataFrame([(int(scoring.END_HASH.view(np.int64)), 0, 5), (7, 24930, 9), (8, 24931, 4)], "word long, head int, n long"))
    assert counts.symbol_total.sum() == 18 and counts.symbol_total[scoring.OWN] == 5 and counts.symbol_total[:2].tolist() == [9, 4]


def test_rarer_words_are_joined():
    counts = scoring.Counts(10, 5, 3, np.array([], np.uint64), np.array([], np.int64), np.array([], np.uint64), np.zeros(65536, np.int64), np.ones(scoring.CLASSES))
    t = scoring.tokens(pa.array(["a b a", None]))
    assert t.first.tolist() == [0, 4, 5] and scoring.symbols(t, counts).tolist()[3:] == [scoring.OWN, scoring.OWN]
    symbol = scoring.symbols(t, counts)
    assert scoring.contexts(symbol, t)[0].tolist() == [scoring.SYMBOLS, *symbol[:3], scoring.SYMBOLS]
    model = scoring.train(symbol, scoring.contexts(symbol, t))
    every = [np.exp(scoring.log_probabilities(np.array([s]), np.full((scoring.CONTEXT, 1), 3), model))[0] for s in range(scoring.SYMBOLS)]
    assert math.isclose(sum(every), 1, rel_tol=1e-4)


def best_by_brute_force(x, ids, k=5):
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    s = q @ q.T
    return {i: [(int(ids[j]), int(s[i, j])) for j in np.lexsort((ids, -s[i])) if j != i][:k] for i in range(len(x))}


@pytest.mark.parametrize("copies,cell,clusters", [(1, 1024, 0), (40, 16, 0), (1, 24, 6)])
def test_topk(spark, monkeypatch, copies, cell, clusters):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 1)  # blocks of 64 vectors
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.3, (300, 8)).astype(np.float32)
    if clusters:
        x = (x / 10 + rng.normal(0, 1, (clusters, 8))[np.arange(300) % clusters]).astype(np.float32)
    x[:copies] = x[0]
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(500, None), (550, [1.0, None] + [0.0] * 6), (600, [float("nan")] + [0.0] * 7), (50, [float(v) for v in x[50]])]
    rows += [(700, []), (701, []), (750, [1.0, 2.0]), (751, [2.0, 1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, id int")
    got, report = {}, {}
    for r in topk.nearest(df, df.where("vec_id % 50 = 0"), cell=cell, query_cell=1, sample=300, report=report).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = {i: [p for p in best for _ in range(2 if 50 in (i, p[0]) else 1)][:5] for i, best in best_by_brute_force(x, np.arange(300)).items()}  # 50 is there twice
    assert got == {i: want[i] for i in range(0, 300, 50)} | {700: [(701, 0)], 750: [(751, 4 * 65536)]}
    assert not clusters or report["left"] < report["cell_pairs"]
    few = df.where("vec_id in (0, 299)")
    assert topk.nearest(few, few).count() == 2 and topk.nearest(df.limit(0), df.limit(0)).count() == 0


def test_topk_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.9, 0.0]), (2, [0.1, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 58880), (1, 32768), (2, 6400)]
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(v) for v in rng.integers(-2, 3, 3)]) for i in rng.integers(0, 12, 150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = []
    for q in {i for i, _ in rows if i % 5 == 0}:
        met = [(-65536 * int(np.dot(a, b)), j) for i, a in rows if i == q for j, b in rows if j != q]
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(met)[:5])]
    assert sorted(tuple(r) for r in topk.nearest(df, df.where("vec_id % 5 = 0")).collect()) == sorted(want)


def test_cover_tree_invariants():
    x = np.random.default_rng(0).normal(size=(600, 5))
    x[5] = x[6]
    tree = topk.cover_tree(x, 8)
    assert sorted(tree.order.tolist()) == list(range(600)) and tree.parent[0] == -1
    own = x[tree.order]
    for i in range(len(tree.low)):
        reach = np.sqrt(((own[tree.low[i] : tree.high[i]] - own[tree.centre[i]]) ** 2).sum(1))
        assert reach.max() <= tree.radius[i] + 1e-9 and tree.low[i] <= tree.centre[i] < tree.high[i]
        children = np.flatnonzero(tree.parent == i)
        assert not len(children) or sum(tree.high[c] - tree.low[c] for c in children) == tree.high[i] - tree.low[i]
        assert not len(children) or tree.centre[i] in tree.centre[children]  # a centre stays one in all levels below
    for level in sorted(set(tree.level[1:].tolist())):
        net = sorted(set(tree.centre[tree.level >= level].tolist()))
        gaps = np.sqrt(((own[net][:, None] - own[net][None]) ** 2).sum(2))
        assert (gaps[~np.eye(len(net), dtype=bool)] >= 2.0**level - 1e-9).all()  # separation
        if level > tree.level[1:].min():
            assert np.sqrt(((own[:, None] - own[net][None]) ** 2).sum(2)).min(1).max() <= 2.0**level  # covering
    block = pa.table({"id": np.arange(600), "size": pa.array([5] * 600, pa.int32()), "whole": (x * 100).astype(int).tolist(), "cell": pa.array([0] * 600, pa.int32()), "sub": pa.array([0] * 600, pa.int32()), "floor": np.zeros(600, np.int64)})
    row = next(topk.planted_rows(topk.plant(block, 8)))
    points, root = topk.grown(row)
    assert (points == (x * 100).astype(int)[row["ids"]]).all()
    a, b = root.children[0], root.children[-1]
    assert (points[a.low : a.high] @ points[b.low : b.high].T).max() <= topk.bound(a, b)


def test_sharding(spark):
    rows = [(i, "é" * (i % 5) if i % 7 else None, "s") for i in range(3000)] + [(1, "é", "s"), (None, "x", "s"), (None, None, "s")]
    df = documents(spark, rows)
    leaves = sharding.topology(24)
    got = sharding.sharded(df, leaves).collect()
    assert len(got) == len(rows)
    for shard in range(24):
        own = [r["slot"] for r in got if r["shard"] == shard]
        assert sorted(own) == list(range(len(own))) and len(own) > 60
    assert {r["grown_shard"] for r in got if r["grown_shard"] != r["shard"]} == {24}
    assert all(r["size"] == 8 + len(("é" * (r["doc_id"] % 5) if r["doc_id"] % 7 else "").encode()) for r in got if r["doc_id"] is not None and r["doc_id"] != 1)
    assert {r["text_crc32"] for r in got if r["doc_id"] == 3} == {zlib.crc32(("é" * 3).encode())}
    again = {(r["doc_id"], r["text_crc32"], r["shard"]) for r in sharding.sharded(df.repartition(3), leaves).collect()}
    assert again == {(r["doc_id"], r["text_crc32"], r["shard"]) for r in got}
    assert sharding.sharded(df.limit(0), leaves).count() == 0


def test_weights_confine_movement(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"))
    before = sharding.topology(16)
    after = [x._replace(weight=3.0) if x.shard == 5 else x for x in before]
    names = ("region", "rack", "shard")
    a = {r["doc_id"]: r for r in sharding.placed(df, F.col("doc_id"), before, names).collect()}
    b = {r["doc_id"]: r for r in sharding.placed(df, F.col("doc_id"), after, names).collect()}
    moved = [i for i in a if a[i]["shard"] != b[i]["shard"]]
    assert moved and all(b[i]["region"] == 0 for i in moved)
    assert all(b[i]["shard"] == 5 for i in moved if a[i]["region"] == 0 and a[i]["rack"] == 1)
    with pytest.raises(ValueError):
        sharding.placed(df, F.col("doc_id"), [x._replace(weight=0.0) for x in before], names)


def filled(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.discard(s)
    return target


def test_mixing(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 400)), rng.choice(["a", "b", "b", "b", "b", "c", "d", None])) for i in range(400)]
    rows += [(500, None, "a"), (501, "", "empty"), (7, rows[7][1], rows[7][2]), (None, "x y z", "a")]
    df = documents(spark, rows)
    got = mixing.mixed(df, block=16).collect()
    assert len(got) == len(rows)
    size: dict = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(SPLIT.findall(t or ""))
    want = filled(size)
    for s in size:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {size[s]} and all(math.isclose(r["target"], want[s], abs_tol=1e-6) for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(0.01 * want[s], 32)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    again = mixing.mixed(df.repartition(5), block=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mixed(df.limit(0)).count() == 0
    assert set(mixing.repeated(df).columns) == set(df.columns)


def test_mixed_documents_meet_the_targets(spark):
    rng = random.Random(1)
    rows = [(i, f"n{i} " + " ".join(["w"] * rng.randrange(600, 1000)), "abcdef"[i % 6]) for i in range(1800)]
    rows += [(i, f"other{i} " + " ".join(["w"] * 700), "f") for i in range(300)] + [(None, f"null{i} x", None) for i in range(9)]
    rows += [(2000, None, "a"), (2001, " ", "b")]
    df = documents(spark, rows)
    copies = mixing.repeated(df, block=16).collect()
    got, size = [(r["source"], len(SPLIT.findall(r["text"] or "")), r["doc_id"]) for r in copies], {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(SPLIT.findall(t or ""))
    want = filled(size)
    for s in "abcdef":
        assert abs(sum(n for x, n, _ in got if x == s) / want[s] - 1) < 0.12, s
    assert [sum(i == j for _, _, i in got) for j in (2000, 2001)] == [1, 1]
    assert max(Counter(r["text"] for r in copies if r["doc_id"] is not None).values()) <= 3


def test_permutations_and_numbers(spark):
    df = spark.range(97).select("id", F.lit(97).cast("long").alias("n"))
    for seed in (3, -8):
        rows = mixing.permuted(df, F.col("id"), "n", F.lit(seed).cast("long"), "p").orderBy("id").collect()
        assert sorted(r["p"] for r in rows) == list(range(97))
        assert len({(b["p"] - a["p"]) % 97 for a, b in zip(rows[:-1], rows[1:], strict=True)}) > 20  # no fixed stride
    big = spark.createDataFrame([(i, 2**60) for i in range(50)], "id long, n long")
    assert len({r["p"] for r in mixing.permuted(big, F.col("id"), "n", F.lit(1).cast("long"), "p").collect()}) == 50
    rows = spark.createDataFrame([(i, "a" if i % 3 else None, i % 4) for i in range(100)] + [(7, "a", 3)] * 50, "k long, g string, s long")
    got = numbering.numbered(rows, ["g"], ["k"], "s", parts=4, chunk=8).collect()
    assert len(got) == 150
    for g in ("a", None):
        own = sorted((r["_start"], r["s"]) for r in got if r["g"] == g)
        at = 0
        for start, s in own:
            assert start == at
            at += s


def test_pipeline(spark, tmp_path):
    rows = texts(120, 4)
    item = " ".join(f"bench{i}" for i in range(30))
    docs = [(i, t, f"s{i % 3}") for i, t, _, _ in rows]
    docs += [(200, docs[0][1], "s0"), (201, f"lo mi {item} re", "s1"), (202, None, "s2"), (203, "", None), (None, "ta ta lo mi", "s0"), (0, docs[0][1], "s0")]
    path = f"file://{tmp_path}"
    documents(spark, docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, g, x) for i, _, x, g in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    held, names = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, after = held, stage(spark, held, path)
        after.write.parquet(f"{path}/{name}")
        held = spark.read.parquet(f"{path}/{name}")
        names.append(name)
        ids = {r["doc_id"] for r in held.collect()}
        if name != "sharding":
            assert set(held.columns) == set(before.columns)
        if name == "toxicity":
            toxic = {i for i, _, x, _ in rows if x}
            assert len(ids & toxic) <= 2 and len({i for i, _, x, _ in rows if not x} - ids) <= 2 and None in ids
        if name == "near_duplicates":
            assert 200 not in ids and 0 in ids and None in ids and held.where("doc_id = 0").count() == 1
        if name == "decontamination":
            assert 201 not in ids and before.count() == held.count() + 1
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.run(spark, path).count() == held.count()


def test_a_context_is_normalised_once(monkeypatch):
    """20,000 tokens of 60 contexts: powers of e are taken of the model's tables, not of all symbols for each token."""
    rng = np.random.default_rng(4)
    d, n = scoring.DIMENSIONS, scoring.SYMBOLS
    kinds = rng.integers(0, n + 1, (scoring.CONTEXT, 60))
    context, symbol = kinds[:, rng.integers(0, 60, 20_000)], rng.integers(0, n, 20_000)
    for scale in (0.1, 12.0):  # large ones: words of a context that rule out each other's symbols
        model = scoring.Model(*[(rng.normal(0, scale, x)).astype(np.float32) for x in ((scoring.CONTEXT, n + 1, d), (n, d), (n,))])
        taken, real = [], np.exp
        with monkeypatch.context() as m:
            m.setattr(np, "exp", lambda x, *a, **k: (taken.append(np.size(x)), real(x, *a, **k))[1])
            found = scoring.log_probabilities(symbol, context, model)
        assert sum(taken) <= scoring.CONTEXT * (n + 1) * n + 60 * n
        logits = sum(model.tables[j].astype(float)[context[j]] for j in range(scoring.CONTEXT)) @ model.targets.T.astype(float) + model.bias
        top = logits.max(1)
        want = logits[np.arange(20_000), symbol] - top - np.log(np.exp(logits - top[:, None]).sum(1))
        assert np.abs(found - want).max() < 1e-3 * max(1.0, scale**2)


def test_a_step_follows_the_gradient_of_noise_contrastive_estimation():
    rng, n, k = np.random.default_rng(9), scoring.SYMBOLS, scoring.NOISE
    context, symbol = rng.integers(0, n + 1, (scoring.CONTEXT, 1500)), rng.integers(0, n, 1500)
    unigram = scoring.smoothed(np.bincount(symbol, minlength=n))
    state = scoring.started(unigram)
    vectors, mats, targets, bias, *held = [x.astype(float) for x in state]
    scoring.learned(state, symbol, context, unigram, 1, np.random.default_rng(2))
    draws = np.random.default_rng(2)
    draws.permutation(1500)
    noise = np.minimum(np.searchsorted(np.cumsum(unigram), draws.random(k), side="right"), n - 1)
    q = sum(vectors[context[j]] @ mats[j] for j in range(scoring.CONTEXT))
    odds = q @ targets.T + bias - np.log(unigram) - np.log(k)
    chance = 1 / (1 + np.exp(-odds))
    pull = np.zeros((1500, n))  # the gradient of each logit: up for the token's own, down for every draw
    pull[np.arange(1500), symbol] += 1 - chance[np.arange(1500), symbol]
    np.add.at(pull.T, noise, -chance.T[noise])
    pull /= 1500
    by_q = pull @ targets
    by_vectors, by_mats = np.zeros_like(vectors), np.zeros_like(mats)
    for j in range(scoring.CONTEXT):
        np.add.at(by_vectors, context[j], by_q @ mats[j].T)
        by_mats[j] = vectors[context[j]].T @ by_q
    for new, old, h, g in zip(state[:4], (vectors, mats, targets, bias), held, (by_vectors, by_mats, pull.T @ q, pull.sum(0)), strict=True):
        assert np.allclose(new, old + scoring.RATE * g / np.sqrt(h + g * g), atol=2e-6)


def test_training_takes_powers_of_tables_once_a_batch(monkeypatch):
    """Two batches of 3,000 to 4,096 tokens: powers of e aren't taken for each token and draw; logits of any size are learned from."""
    rng, n = np.random.default_rng(11), scoring.SYMBOLS
    context, symbol = rng.integers(0, n + 1, (scoring.CONTEXT, 7096)), rng.zipf(1.3, 7096) % n
    unigram = scoring.smoothed(np.bincount(symbol, minlength=n))
    for scale in (1, 15):
        found = []
        for safe in (25.0, -1.0):  # powers of parts, of sums
            state, taken, real = scoring.started(unigram), [], np.exp
            for x in (state[0], state[2]):
                x *= scale
            with monkeypatch.context() as m:
                m.setattr(scoring, "SAFE", safe, raising=False)
                m.setattr(np, "exp", lambda x, *a, **k: (taken.append(np.size(x)), real(x, *a, **k))[1])
                scoring.learned(state, symbol, context, unigram, 1, np.random.default_rng(2))
            found.append((state, sum(taken)))
        if scale == 1:
            assert found[0][1] <= 7096 + 2 * scoring.CONTEXT * (n + 1) * scoring.NOISE < 7096 * scoring.NOISE / 2
        for x, y in zip(found[0][0], found[1][0], strict=True):
            assert np.isfinite(x).all() and np.allclose(x, y, rtol=1e-4, atol=1e-5)
    # Parts of opposite signs whose powers no float holds: the first word of a context says 400, the second -400.
    state = scoring.started(unigram)
    state[0][:], state[1][:] = 0, np.eye(scoring.DIMENSIONS)
    state[0][0], state[0][1], state[2][:] = 20, -20, 20 / scoring.DIMENSIONS
    context = np.tile(np.array([[0], [1], [2]]), 3000)
    scoring.learned(state, symbol[:3000], context, unigram, 1, np.random.default_rng(2))
    assert all(np.isfinite(x).all() for x in state)


def test_distinct_hashes_are_counted_once():
    hashes = np.array([7, 2**64 - 1, 7, 0, 7], np.uint64)
    word, code = scoring.coded(hashes)
    assert len(word) == 3 and (word[code] == hashes).all()
    word, code = scoring.coded(hashes[:0])
    assert not len(word) and not len(code)


class InOrder:
    """Numbers that aren't drawn: nothing is permuted, and the draws lie evenly."""

    def permutation(self, n):
        return np.arange(n)

    def random(self, n):
        return (np.arange(n) + 0.5) / n


def test_tokens_after_one_context_are_learned_from_together(monkeypatch):
    """4,000 tokens after 50 contexts: one step follows the gradient over all of them, and odds are found by context."""
    rng, n, k = np.random.default_rng(12), scoring.SYMBOLS, scoring.NOISE
    of = np.minimum(rng.zipf(1.4, 4000) - 1, 49)  # the first context stands before half of the tokens
    context, symbol = rng.integers(0, n + 1, (scoring.CONTEXT, 50))[:, of], rng.integers(0, n, 4000)
    unigram = scoring.smoothed(np.bincount(symbol, minlength=n))
    state, taken, real = scoring.started(unigram), [], np.exp
    vectors, mats, targets, bias, *held = [x.astype(float) for x in state]
    noise = np.minimum(np.searchsorted(np.cumsum(unigram), InOrder().random(k), side="right"), n - 1)
    with monkeypatch.context() as m:
        m.setattr(scoring, "SAFE", -1.0)  # powers of sums, one for each row and draw
        m.setattr(np, "exp", lambda x, *a, **kw: (taken.append(np.size(x)), real(x, *a, **kw))[1])
        scoring.learned(state, symbol, context, unigram, 1, InOrder())
    assert sum(taken) < 4000 + 4000 * len(np.unique(noise)) / 8
    q = sum(vectors[context[j]] @ mats[j] for j in range(scoring.CONTEXT))
    chance = 1 / (1 + np.exp(-(q @ targets.T + bias - np.log(unigram) - np.log(k))))
    pull = np.zeros((4000, n))
    pull[np.arange(4000), symbol] += 1 - chance[np.arange(4000), symbol]
    np.add.at(pull.T, noise, -chance.T[noise])
    pull /= 4000
    by_q, by_vectors, by_mats = pull @ targets, np.zeros_like(vectors), np.zeros_like(mats)
    for j in range(scoring.CONTEXT):
        np.add.at(by_vectors, context[j], by_q @ mats[j].T)
        by_mats[j] = vectors[context[j]].T @ by_q
    for new, old, h, g in zip(state[:4], (vectors, mats, targets, bias), held, (by_vectors, by_mats, pull.T @ q, pull.sum(0)), strict=True):
        assert np.allclose(new, old + scoring.RATE * g / np.sqrt(h + g * g), atol=2e-6)
    before = [x.copy() for x in state]
    scoring.learned(state, symbol[:0], context[:, :0], unigram, 3, InOrder())
    assert all((x == y).all() for x, y in zip(state, before, strict=True))


def test_a_task_normalises_a_context_once(monkeypatch):
    """Four batches of one task: the model's tables are made once, and a text has one score wherever it stands."""
    lines = [" ".join(f"w{(i * i + j) % 23}" for j in range(1 + i % 40)) for i in range(300)] + ["", None]
    t = scoring.tokens(pa.array(lines))
    word, number = np.unique(t.hash, return_counts=True)
    own = word[word != scoring.END_HASH][:5]
    counts = scoring.Counts(len(t.hash), len(word), 1, word, number, own, np.zeros(65536, np.int64), np.full(scoring.CLASSES, 99.0))
    symbol = scoring.symbols(t, counts)
    model = scoring.train(symbol, scoring.contexts(symbol, t))
    made, real = [], np.round

    def batch(texts):
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array([False] * n), pa.array(texts, pa.string())], ["row", "doc_id", "held_out", "text"])

    with monkeypatch.context() as m:
        m.setattr(np, "round", lambda x, *a: (made.append(np.shape(x)), real(x, *a))[1])
        found = list(scoring.scorer(model, counts)(iter([batch(lines), batch(lines[::-1]), batch(lines[:7]), batch([])])))
    assert len(made) == 2
    scores = [x.column("score").to_numpy(zero_copy_only=False) for x in found]
    assert (scores[0][: len(lines)] == scores[1][: len(lines)][::-1]).all() and (scores[0][:7] == scores[2][:7]).all()
