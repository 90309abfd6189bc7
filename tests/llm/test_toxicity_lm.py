"""Toxicity and language-model scores: exactness of the parts, held-out accuracy, awkward rows."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from support import awkward, clashing, empty, frame

from coffer.llm import lmscore, toxicity

NEUTRAL = [f"w{i}" for i in range(300)]
INSULTS = ["idiot", "moron", "loser", "scum"]


def corpus(n: int = 1200, seed: int = 1) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(NEUTRAL) for _ in range(rng.randint(20, 60))]
        toxic = i % 8 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice([*INSULTS, "badstem" + rng.choice("abcdef") * 2]))
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_index_is_exact(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(toxicity, "FREQUENT", 4)
    monkeypatch.setattr(toxicity, "BLOCK", 32)
    vectors = [{t: rng.choice([0.25, rng.random()]) for t in rng.sample(range(12), rng.randint(0, 5))} for _ in range(500)]
    vectors += [dict(vectors[7]) for _ in range(60)]  # more ties than the search holds
    entries = [(i, t, w) for i, v in enumerate(vectors) for t, w in v.items()]
    rows, terms, weights = (np.array(x) for x in zip(*entries, strict=True))
    index = toxicity.BlockMaxIndex(len(vectors), 12, rows, terms, weights)
    queries = [{t: rng.random() for t in rng.sample(range(12), rng.randint(0, 4))} for _ in range(100)] + [dict(vectors[7])]
    for without in (None, [rng.randrange(len(vectors)) for _ in queries]):
        found = index.nearest([(np.array(list(q), np.int64), np.array(list(q.values()))) for q in queries], 15, without)
        for n, (q, got) in enumerate(zip(queries, found, strict=True)):
            dots = sorted(((round(sum(w * v.get(t, 0) for t, w in q.items()), 12), i) for i, v in enumerate(vectors) if without is None or i != without[n]), key=lambda x: (-x[0], x[1]))
            want = [(s, i) for s, i in dots if s > 0][:15]
            assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [s for s, _ in want])


def by_hand(docs: list[tuple], labels: list[tuple]) -> dict[int, list[tuple[int, float, int]]]:
    """The nearest examples of each document by the definition, word by word."""
    text = {d[0]: (d[1] or "").lower().split() for d in docs}
    toxic = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 != 1 and i in text}
    n1, n0 = sum(toxic.values()), len(toxic) - sum(toxic.values())
    known = {w for i in toxic for w in text[i]}
    idf = {w: math.log((1 + len(text)) / (1 + sum(w in t for t in text.values()))) + 1 for w in known}
    z = {}
    for w in known:
        a, c = sum(w in text[i] for i, t in toxic.items() if t) + 0.5, sum(w in text[i] for i, t in toxic.items() if not t) + 0.5
        b, d = n1 - a + 1, n0 - c + 1
        z[w] = math.log(a * d / (b * c)) / math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    top = max(map(abs, z.values()))
    weight = {w: idf[w] * (toxicity.FLOOR + (z[w] / top) ** 2) for w in known}
    unseen = (math.log(1 + len(text)) + 1) * toxicity.FLOOR

    def vector(words: list[str]) -> dict[str, float]:
        v = {w: (1 + math.log(words.count(w))) * weight.get(w, unseen) for w in set(words)}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    vectors = {i: vector(t) for i, t in text.items()}
    out = {}
    for i, v in vectors.items():
        near = sorted((-round(sum(x * vectors[j].get(w, 0) for w, x in v.items()), 9), t, j) for j, t in toxic.items())
        out[i] = [(j, -s, t) for s, t, j in near if s < 0][:3]
    return out


def test_evidence_equals_brute_force_cosine(spark):
    docs, labels = corpus(240, seed=5)
    docs.append((1000, "nothing that any example says", "en", "s", 0))
    want = by_hand(docs, labels)
    for r in toxicity.score_documents(frame(spark, docs), spark.createDataFrame(labels, LABELS)).collect():
        near = want[r["doc_id"]]
        assert [(e["doc_id"], e["toxic"]) for e in r["evidence"]] == [(j, t) for j, _, t in near]
        assert np.allclose([e["similarity"] for e in r["evidence"]], [s for _, s, _ in near], atol=1e-8)
        assert near or r["doc_id"] == 1000  # every other text has evidence


def test_ids_of_other_types_and_long_words(spark):
    docs, labels = corpus(200)
    named = frame(spark, docs).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    out = toxicity.score_documents(named, spark.createDataFrame(labels, LABELS).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))).collect()
    assert len(out) == 200 and all(e["doc_id"].startswith("d") for r in out for e in r["evidence"])
    assert toxicity.words_of(("x" * 500).encode()) == [b"x" * 500]
    assert [w.decode() for w in toxicity.words_of("Ab 漢字文 ÉTÉ-x".encode())] == ["ab", "漢字", "字文", "été", "x"]


def test_held_out_accuracy_and_evidence(spark):
    docs, labels = corpus()
    got = toxicity.score_documents(frame(spark, docs), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    right = 0
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["held_out"]:
            right += r["predicted"] == labels[r["doc_id"]][2]
        if r["predicted"]:
            assert r["evidence"] and all(zlib.crc32(str(e["doc_id"]).encode()) % 3 != 1 for e in r["evidence"])
    assert right >= 0.98 * sum(r["held_out"] for r in got)


def test_held_out_labels_are_not_used(spark):
    docs, labels = corpus(300)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (sorted((r["doc_id"], r["score"]) for r in toxicity.score_documents(frame(spark, docs), spark.createDataFrame(x, LABELS)).collect()) for x in (labels, turned))
    assert a == b


def test_toxicity_awkward_rows(spark):
    docs, labels = corpus(200)
    model = toxicity.learn(frame(spark, docs), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (6, 0, 7)], LABELS))
    rows = toxicity.score(clashing(awkward(spark)), "text", [F.col("doc_id")], ["doc_id"], model).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    for few in ([], [(1, 1, 1)], [(3, 1, 0), (4, 1, 0)]):
        out = toxicity.score_documents(awkward(spark), spark.createDataFrame(few, LABELS)).collect()
        assert len(out) == 10 and len({r["score"] for r in out}) == 1
    assert toxicity.score_documents(empty(spark), spark.createDataFrame(labels, LABELS)).count() == 0
    kept = toxicity.keep_clean(clashing(frame(spark, docs)), spark.createDataFrame(labels, LABELS))
    assert kept.columns == clashing(frame(spark, docs)).columns
    assert {r["doc_id"] for r in kept.collect()} >= {i for i, _, t in labels if not t}


def small_text(rng: random.Random, n: int) -> str:
    out = [rng.choice("abcdef")]
    for _ in range(n - 1):
        out.append(chr(97 + (ord(out[-1]) - 97 + rng.choice([1, 1, 1, 2])) % 6))
    return " ".join(out)


def test_gradients():
    rng = np.random.default_rng(1)
    weights = {k: rng.standard_normal(s) * 0.3 for k, s in lmscore.SHAPES.items()}
    ids, places = lmscore.stream([rng.integers(0, lmscore.VOCABULARY, 30).astype(np.int32)])
    net = lmscore.Network(weights)
    gradient = net.gradient(ids, places)
    loss = lambda: -net.log_probability(ids, places).mean()
    for k, w in weights.items():
        at = np.unravel_index(np.abs(gradient[k]).argmax(), w.shape)
        old, step = w[at], 1e-5
        w[at] = old + step
        up = loss()
        w[at] = old - step
        down = loss()
        w[at] = old
        assert abs((up - down) / (2 * step) - gradient[k][at]) < 1e-5


def test_probabilities_sum_to_one():
    model = lmscore.Network(lmscore.initial())
    ids, places = lmscore.stream([np.array([3, 5, 7, 9, 11], np.int32)])
    total = 0.0
    for word in range(lmscore.VOCABULARY):
        changed = ids.copy()
        changed[places[2]] = word
        total += float(np.exp(model.log_probability(changed, places[2:3])[0]))
    assert abs(total - 1) < 1e-4


def test_scores_equal_each_place_alone():
    rng = np.random.default_rng(2)
    model = lmscore.Model([b"a", b"b"], lmscore.BUCKETS, np.log(rng.random(1024)), lmscore.initial())
    texts = [rng.integers(0, lmscore.KNOWN + 1024, n).astype(np.int32) for n in (0, 1, 2, 40, 0)]
    net, want = lmscore.Network(model.weights), []
    for t in texts:
        ids, places = lmscore.stream([model.ids(t)])
        one = [net.log_probability(ids, places[i : i + 1])[0] + (model.shares[t[i] - lmscore.KNOWN] if t[i] >= lmscore.KNOWN else 0) for i in range(len(t))]
        want.append(sum(one))
    assert np.allclose(model.scores(texts), want, atol=1e-4)


def test_training_learns_order():
    rng = random.Random(3)
    texts = [small_text(rng, 120).encode() for _ in range(900)]
    ids = lmscore.Codes({w.encode(): i for i, w in enumerate("abcdef")})
    trainer = lmscore.Trainer(lmscore.initial())
    for shift in range(lmscore.STRIDE):
        trainer.texts([ids.of(t) for t in texts[100:]], shift)
    model = lmscore.Model([], lmscore.BUCKETS, np.zeros(1024), trainer.net.w)
    held = [ids.of(t) for t in texts[:100]]
    real = model.scores(held).sum() / sum(map(len, held))
    mixed = model.scores([rng.permutation(t) for t, rng in zip(held, map(np.random.default_rng, range(100)), strict=True)]).sum() / sum(map(len, held))
    assert real > mixed + 0.2 and real > np.log(1 / 6)


def test_distributed_training_helps_and_reruns_agree(spark):
    rng = random.Random(4)
    df = frame(spark, [(i, small_text(rng, 120), "en", "s", 0) for i in range(1200)]).repartition(4).cache()
    model = lmscore.train(df)
    assert sorted(model.known) == [c.encode() for c in "abcdef"]
    start = lmscore.Model(model.known, model.buckets, model.shares, lmscore.initial())
    mean = lambda m: np.mean([r["mean_log_likelihood"] for r in lmscore.score(df.limit(50), m).collect()])
    assert mean(model) > mean(start) + 2
    again = lmscore.train(df)
    assert all((model.weights[k] == again.weights[k]).all() for k in lmscore.SHAPES)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """With several lanes, and rows in another order and other partitions."""
    monkeypatch.setattr(lmscore, "LANE_WORDS", 3000)
    monkeypatch.setattr(lmscore, "LANE_SHARE", 0)
    rng = random.Random(6)
    rows = [(i, small_text(rng, rng.randint(0, 150)), "en", "s", 0) for i in range(400)]
    one, other = ({r["doc_id"]: r["log_likelihood"] for r in lmscore.score_documents(frame(spark, x).repartition(n)).collect()} for x, n in ((rows, 2), (rows[::-1], 7)))
    assert one.keys() == other.keys() and all(abs(one[i] - other[i]) < 1e-3 for i in one)


def test_shares_sum_to_one_and_follow_the_counts(spark):
    """A word that occurs twice gets twice the share of one that occurs once, and so do documents with such words."""
    rows = [(i, " ".join(f"r{i}x{j}" for j in range(30)), "en", "s", 0) for i in range(200)]
    rows += [(1000 + i, rows[i][1], "en", "s", 0) for i in range(20)]
    known = [(2000 + i, "the of and " * 40, "en", "s", 0) for i in range(100)]
    df = frame(spark, rows + known).cache()
    model, total = lmscore.vocabulary(df)
    assert total == 220 * 30 + 100 * 120
    bucket = np.arange(len(model.shares)) % model.buckets
    codes = {r[1].split()[0]: model.codes().of(r[1].encode())[0] - model.first for r in rows if r[1].encode().split()[0] not in model.known}
    cells = np.bincount(list(codes.values()), minlength=len(model.shares))
    assert (np.bincount(bucket, np.exp(model.shares), model.buckets) <= 1 + 1e-4).all() and (cells <= 4).all()
    found = {r["doc_id"]: r["mean_log_likelihood"] for r in lmscore.score_documents(df).collect()}
    twice, once = [found[i] for i in range(20)], [found[i] for i in range(20, 200)]
    assert np.mean(twice) > np.mean(once) + 0.3


def test_training_uses_every_place(spark):
    """Texts of period 4 and of two words show a model each word only if all places are trained on."""
    rows = [(i, "a b c d " * 30 if i % 2 else "y z", "en", "s", 0) for i in range(1200)]
    df = frame(spark, rows).repartition(2).cache()
    scores = {r["doc_id"]: r["mean_log_likelihood"] for r in lmscore.score(df, lmscore.train(df)).collect()}
    assert scores[1] > -1 and scores[0] > -2


def test_vocabulary_grows_with_the_corpus(spark):
    """More words than the smallest network knows, all common: each gets an id of its own, and the buckets stay empty."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    df = frame(spark, [(i, " ".join(rng.sample(words, 500)), "en", "s", 0) for i in range(320)]).repartition(4).cache()
    model = lmscore.train(df)
    codes = model.codes()
    assert sorted(model.known) == sorted(w.encode() for w in words) and len({codes[w.encode()] for w in words}) == 2000
    assert max(codes[w.encode()] for w in words) < model.first <= codes[b"unseen"] < model.first + len(model.shares)
    assert model.first <= model.ids(codes.of(b"unseen"))[0] < model.first + model.buckets
    assert all(np.isfinite(r["log_likelihood"]) for r in lmscore.score(df, model).collect())


def test_lm_awkward_rows(spark):
    rows = {r["doc_id"]: r for r in lmscore.score_documents(clashing(awkward(spark))).collect()}
    assert rows[2]["n_words"] == rows[3]["n_words"] == 0 and rows[2]["log_likelihood"] == 0 and rows[2]["mean_log_likelihood"] is None
    assert rows[5]["n_words"] == 30_000 and np.isfinite(rows[5]["log_likelihood"])
    assert lmscore.score_documents(empty(spark)).count() == 0
