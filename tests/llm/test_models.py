from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from urlloom.llm import toxicity as tox
from urlloom.llm.cotraining import quality_scores
from urlloom.llm.toxicity import Boosted, Isotonic, scored, trained

from . import fixtures as fx


def auc(scores, labels) -> float:
    scores, labels = np.array(scores), np.array(labels)
    rank = scores.argsort().argsort()
    pos = labels == 1
    return (rank[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


def out(i) -> bool:
    return zlib.crc32(str(i).encode()) % 4 == 2


def corpus(n=900):
    rng, words = random.Random(8), fx.vocabulary(8)
    bad = ["idiot", "moron", "grumlbak", "zorfen", "stupid"]
    rows, labels = [], []
    for i in range(n):
        t = fx.prose(rng, words, rng.randint(20, 200)).split(" ")
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(max(2, len(t) // 25)):
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = corpus()
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = scored(docs, trained(docs, lab, "toxic")).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == out(r.doc_id) for r in got) and all(0 <= r.score <= 1 for r in got)
    assert auc([r.score for r in held], [truth[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    # the same rows in another order, and labels of held-out rows turned round, give the same scores
    turned = spark.createDataFrame([(i, 1 - y if out(i) else y) for i, y in reversed(labels)], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in scored(docs, trained(docs, turned, "toxic")).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in got)


def test_toxicity_of_a_rare_label(spark):
    rows, labels = corpus()
    hot = [(i, y) for i, y in labels if y and not out(i)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for many, sample in ((16, 200), (5, 6000)):
        some = [(i, y) for i, y in labels if not y] + hot[:many]
        model = trained(docs, spark.createDataFrame(some, "doc_id long, toxic int"), "toxic", sample=sample)
        assert model.trees is not None and abs(model.share - many / (many + sum(not y and not out(i) for i, y in labels))) < 1e-9
        known = {i for i, _ in hot[:many]}
        got = [r for r in scored(docs, model).collect() if r.doc_id not in known]
        truth = dict(labels)
        assert auc([r.score for r in got], [truth[r.doc_id] for r in got]) > 0.9
        assert np.mean([r.predicted for r in got if truth[r.doc_id]]) > 0.5


def test_toxicity_of_odd_tables(spark):
    df = fx.docs(spark)
    labels = spark.createDataFrame([(i, [0, 1, None, 7][i % 4]) for i in range(60)] + [(None, 1), (999, 1), (0, 1), (0, 0)], "doc_id long, toxic int")
    rows = scored(df, trained(df, labels, "toxic"), keep=["lang", "score"]).collect()
    assert len(rows) == df.count() and all(r.score is not None for r in rows)
    none = scored(df, trained(df, labels.where("false"), "toxic")).collect()
    assert {r.score for r in none} == {0.0} and {r.predicted for r in none} == {0}
    assert scored(df.where("false"), trained(df.where("false"), labels, "toxic")).count() == 0


def brute_features(text: str, weight: dict[str, float]) -> list[float]:
    """The dense features in plain Python; the lexicon is given by whole words."""
    import re

    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[0-9a-z\x80-\xff]+", raw.lower())]
    cased = [raw[a:b] for a, b in at]
    words = [w.lower() for w in cased]
    insults, persons = {w.encode() for w in tox.INSULTS}, {w.encode() for w in tox.SECOND_PERSON}
    per, size, letters = max(1, len(words)) / 100, max(1, len(raw)), max(1, len(re.findall(rb"[A-Za-z]", raw)))
    w = [weight.get(x.decode("utf-8", "replace"), 0.0) for x in words]
    n_insults = sum(x in insults for x in words)
    out = [math.log1p(len(words)), n_insults, n_insults / per]
    for tier in tox.TIERS:
        n = sum(x > tier for x in w)
        out += [n, n / per]
    out += [sum(w), sum(w) / per]
    out += (sorted((x for x in w if x > 0), reverse=True) + [0.0] * 4)[:4]
    flagged = [x in insults or y > 2 for x, y in zip(words, w, strict=True)]
    near = [any(words[j] in persons for j in range(max(0, i - tox.NEAR), min(len(words), i + tox.NEAR + 1)) if j != i) for i in range(len(words))]
    out += [sum(a and b for a, b in zip(flagged, near, strict=True)), sum(x in persons for x in words) / per]
    out += [len(re.findall(rb"[A-Z]", raw)) / letters, len(re.findall(rb"[!?]", raw)) / per, len(re.findall(rb"[!-/:-@\[-`{-~]", raw)) / size]
    plain = text
    for sign, letter in tox.LEET.items():
        plain = plain.replace(sign, letter)
    leet = re.findall(rb"[0-9a-z\x80-\xff]+", plain.encode().lower())
    out.append(max(0, sum(x in insults for x in leet) - n_insults))
    out.append(sum(bool(re.search(rb"[0-9]", x) and re.search(rb"[a-z]", x)) for x in words) / per)
    out.append(sum(len(x) == 1 for x in words) / per)
    out.append(sum(len(x) >= 3 and re.fullmatch(rb"[A-Z]+", x) is not None for x in cased) / per)
    return out


def test_features_equal_plain_ones():
    rng, words = random.Random(12), fx.vocabulary(12)
    weight = {w: rng.choice([0.5, 1.5, 2.5, 3.5]) for w in rng.sample(sorted({w for w in words if len(w) > 1 and w.isascii()}), 200)}
    keys = np.array([tox.hashed([w])[0] for w in weight], np.uint64)
    order = np.argsort(keys)
    lexicon = tox.Lexicon(keys[order], np.array([*weight.values()])[order])
    texts = [None, "", "  ", "You IDIOT!!", "1d10t y0u $tup1d f u c k"]
    for _ in range(60):
        t = fx.prose(rng, words, rng.randint(1, 60)).split(" ")
        for _ in range(rng.randint(0, 8)):
            t.insert(rng.randrange(len(t) + 1), rng.choice(["you", "idiot", "STUPID", "1diot", "x1", "NO", "a", "?!", "dich", "Dumm"]))
        texts.append(" ".join(t))
    raw = [(t or "").encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    got = tox.features(np.frombuffer(b"".join(raw), np.uint8), at, lexicon, tox.hashed(tox.INSULTS), tox.hashed(tox.SECOND_PERSON))
    assert np.allclose(got, [brute_features(t or "", weight) for t in texts])


def test_one_tree_equals_a_plain_one():
    """The root's split by trying every cut, and the leaves' values."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, (200, 3)).astype(float), rng.integers(0, 2, 200).astype(float)
    model = Boosted(trees=1, depth=1, rate=1.0, leaf=5, l2=2.0).fit(x, y)
    p = y.mean()
    g, h = y - p, np.full(200, p * (1 - p))
    best = None
    for f in range(3):
        for c in range(5):
            right = x[:, f] > c
            if min(right.sum(), (~right).sum()) >= 5:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 2) for s in (right, ~right))
                if best is None or gain > best[0] + 1e-9:
                    best = gain, right
    want = np.log(p / (1 - p)) + np.where(best[1], *(g[s].sum() / (h[s].sum() + 2) for s in (best[1], ~best[1])))
    assert np.allclose(model.raw(x), want)


def test_labels_without_any_telling_word(spark):
    docs = spark.createDataFrame([(i, "the same words in every text") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in scored(docs, trained(docs, labels, "toxic")).collect())


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    raw = Boosted(trees=60).fit(x, y).raw(x)
    assert auc(raw, y) > 0.97
    curve = Isotonic().fit(raw, y)
    p = curve(np.sort(raw))
    assert (np.diff(p) >= 0).all() and abs(curve(raw).mean() - y.mean()) < 0.05


def test_cotraining_on_held_out_rows(spark):
    rng, words = random.Random(3), fx.vocabulary(3)
    rows, labels = [], []
    for i in range(1200):
        good = rng.random() < 0.6
        text = fx.prose(rng, words, rng.randint(40, 150)) if good else "\n".join([fx.prose(rng, words, 6) + " ###$$"] * rng.randint(3, 9))
        source = rng.choice(["s1", "s2", "s3"] if rng.random() < (0.9 if good else 0.1) else ["s8", "s9"])
        rows.append((i, text, rng.choice(["en", "de"]), source, len(text)))
        if i % 6 == 0 or out(i):
            labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    y = [truth[r.doc_id] for r in held]
    assert len(got) == len(rows)
    assert auc([r.content_score for r in held], y) > 0.97 and auc([r.metadata_score for r in held], y) > 0.8 and auc([r.score for r in held], y) > 0.97
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93


def test_cotraining_of_odd_tables(spark):
    df = fx.docs(spark)
    labels = spark.createDataFrame([(i, [0, 1, None, 7][i % 4]) for i in range(60)] + [(None, 1), (999, 1), (0, 1), (0, 0)], "doc_id long, quality int")
    rows = quality_scores(df.withColumn("__loom_c", F.col("lang")).withColumn("k0", F.col("source")), labels, keep=["lang", "score", "kept", "__loom_c", "k0"])
    assert rows.columns == ["doc_id", "lang", "kept", "__loom_c", "k0", "held_out", "content_score", "metadata_score", "score", "predicted"]
    rows = rows.collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows) and all(r.lang == r["__loom_c"] for r in rows)
    assert {r.score for r in quality_scores(df, labels.where("false")).collect()} == {0.0}
    assert quality_scores(df.where("false"), labels).count() == 0
