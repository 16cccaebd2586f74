from __future__ import annotations

import random
import sys

import numpy as np
import pytest

from urlloom.llm import near_duplicates as nd
from urlloom.llm import suffix_dedup
from urlloom.llm.common import components
from urlloom.llm.near_duplicates import Banding, near_duplicates, signatures
from urlloom.llm.passage_dedup import Rules, chains, gap_matches, nearest, passages, qualifying, repeated_passages
from urlloom.llm.suffix_dedup import substrings_removed, suffix_order, window_classes

from . import fixtures as fx


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.mark.parametrize("block_bytes", [1500, 1 << 21])
def test_substrings_equal_brute_force(spark, block_bytes):
    df = fx.docs(spark)
    got = substrings_removed(df, block_bytes=block_bytes).collect()
    assert fx.ordered(got) == fx.ordered(fx.brute_removed(pairs(df)))


def test_substrings_of_small_alphabets(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 300))) + "abab" * rng.randint(0, 40) for _ in range(60)]
    df = fx.docs(spark, rows)
    got = substrings_removed(df, block_bytes=2000).collect()
    assert fx.ordered(got) == fx.ordered(fx.brute_removed(pairs(df)))
    kept = {r.doc_id: r.kept for r in substrings_removed(df, with_kept=True).collect()}
    assert fx.sha(bytes(kept[5])) == {r[0]: r[4] for r in fx.brute_removed(pairs(df))}[5]
    assert substrings_removed(df.where("false")).count() == 0


@pytest.mark.parametrize("together", [7, 100, 1 << 18])
def test_refinement_orders_suffixes(together):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(50, 90))).encode() for _ in range(50)] * 2 + [b"a" * 120, b"ab" * 70, b"a" * 50, bytes(130), bytes(60)]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    order, left = suffix_order(data, at, together=together)
    # an end of text is below every byte
    suffixes = [[x + 1 for x in joined[p : p + min(n, 50)]] for p, n in zip(order.tolist(), left[order].tolist(), strict=True)]
    assert sorted(order.tolist()) == list(range(len(joined))) and suffixes == sorted(suffixes)
    place, first = window_classes(data, at, together=together)
    windows = [joined[p : p + 50] for p in place.tolist()]
    assert [a != b for a, b in zip(windows, windows[1:], strict=False)] == first[1:].tolist()
    assert len(set(windows)) == first.sum() and len(windows) == sum(max(0, len(t) - 49) for t in texts)


@pytest.mark.parametrize("how", [{"hot_blocks": 1}, {"hot_blocks": 2, "most_groups": 3, "place_bytes": 500}, {"most_groups": 1, "place_bytes": 3000}, {"hot_blocks": 3, "place_bytes": 700, "group_bytes": 2000}])
def test_hot_anchors_and_several_places_for_a_group(spark, how, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_TEXTS", 4)
    rng, words = random.Random(5), fx.vocabulary(5)
    common = fx.prose(rng, words, 60)
    rows = [fx.prose(rng, words, rng.randint(5, 60)) + (" " + common + " " if i % 3 == 0 else " ") + fx.prose(rng, words, rng.randint(5, 60)) for i in range(90)]
    df = fx.docs(spark, rows + rows[:7])
    got = substrings_removed(df, block_bytes=1500, **how).collect()
    assert fx.ordered(got) == fx.ordered(fx.brute_removed(pairs(df)))


def test_work_on_a_group_does_not_grow_with_messages_times_places():
    rng, inner = random.Random(8), 11
    words = [bytes(rng.randrange(97, 123) for _ in range(60)) for _ in range(40)]
    sent, notes = [], []
    for _ in range(600):
        mine = sorted((rng.randrange(2 * inner), rng.choice(words), rng.randrange(1000)) for _ in range(3))
        mine = [(p, t[:50] if p >= inner else t, i) for p, t, i in mine]
        sent.append(mine)
        at = np.bincount([p for p, _, _ in mine], minlength=2 * inner).astype("<i4")
        notes.append(suffix_dedup.pack(at, np.array([len(t) for _, t, _ in mine], "<i4"), np.array([i for *_, i in mine], "<i8"), b"".join(t for _, t, _ in mine)))
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = suffix_dedup.group_answers(notes, inner)
    finally:
        sys.setprofile(None)
    least: dict = {}
    for p, t, i in (x for mine in sent for x in mine):
        for j in range(len(t) - 49):
            least[p, t[j : j + 50]] = min(i, least.get((p, t[j : j + 50]), i))
    for mine, note in zip(sent, got, strict=True):
        found = set()
        if note is not None:
            for j, a, n, v in zip(*(np.frombuffer(x, t).tolist() for x, t in zip(suffix_dedup.unpack(note), ("<i4", "<i4", "<i4", "<i8"), strict=True)), strict=True):
                found |= {(j, a + k, v) for k in range(n)}
        assert found == {(j, a, least[p, t[a : a + 50]]) for j, (p, t, i) in enumerate(mine) for a in range(len(t) - 49) if least[p, t[a : a + 50]] < i}
    # some 45 for a message, whatever the number of places; loops over messages in each place would make 20 for each of 22 places
    assert calls < 100 * len(notes), calls


def test_texts_beyond_a_segment(spark):
    rng, words = random.Random(8), fx.vocabulary(8, 6000)
    long = fx.prose(rng, words, 320_000)
    texts = {1: long[700_000:700_400], 2: long, 3: long[-900:], 4: long[:1_500_000]}
    size = {i: len(t.encode()) for i, t in texts.items()}
    got = {r.doc_id: r for r in substrings_removed(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert size[2] > 2 << 20 and {i: r.n_bytes for i, r in got.items()} == size
    assert {i: r.n_removed for i, r in got.items()} == {1: 0, 2: size[1], 3: size[3], 4: size[4]}


def test_near_duplicates_equal_brute_force(spark):
    df = fx.docs(spark)
    rows = near_duplicates(df, keep=["lang", "kept", "bucket"]).collect()
    assert len(rows) == df.count()
    root = fx.brute_components(pairs(df))
    sets = {r.doc_id: len(fx.brute_shingles(r.text)) for r in df.collect()}
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (sets[r.doc_id], root[r.doc_id], root[r.doc_id] == r.doc_id)
    assert near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("cell", [1 << 13, 1 << 16, 8 << 20])
def test_a_large_group_of_near_copies(spark, monkeypatch, cell):
    """Clusters that fit into a cell, buckets that do, and buckets in blocks; pivots of many partners in several copies."""
    monkeypatch.setattr(nd, "CELL", cell)
    monkeypatch.setattr(nd, "PARTNERS", 7)
    rng, words = random.Random(11), fx.vocabulary(11)
    base = fx.prose(rng, words, 120)
    rows = [fx.changed(rng, words, base, 0.015 * (i % 5)) for i in range(120)] + [base] * 20 + [fx.prose(rng, words, 100) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert got == fx.brute_components(pairs(df))


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000 + 2 * i + j) for i in range(1, 60) for j in (0, 1)] + [(5, 5), (None, 3), (7, None)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(40)).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1001 for i in range(1, 120)}}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for share in (0.3, 0.6, 0.8):
        for _ in range(10):
            n = 400
            common = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
            sides = [np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)]) for _ in range(2)]
            sig = signatures(np.repeat([0, 1], n), np.concatenate(sides), 2, 128)
            true = len(common) / (2 * n - len(common))
            errors.append((sig[0] == sig[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045
    # small sets: every element has its own places, so that equal sets agree and disjoint ones do not
    tiny = signatures(np.array([0, 0, 1, 1, 2]), np.array([5, 9, 9, 5, 7], np.uint64), 4, 128)
    assert (tiny[0] == tiny[1]).all() and not (tiny[0] == tiny[2]).any() and (tiny[3] == np.iinfo(np.uint64).max).all()


def test_signatures_of_large_sets_in_several_rounds(monkeypatch):
    rng = np.random.default_rng(6)
    owner = np.repeat(np.arange(6), [1, 3000, 0, 700, 20, 5000])
    elements = rng.integers(0, 2**63, len(owner), dtype=np.uint64)
    want = signatures(owner, elements, 6, 128)
    monkeypatch.setattr(nd, "ELEMENTS", 500)
    assert (signatures(owner, elements, 6, 128) == want).all()


def test_very_long_near_copies(spark):
    rng, words = random.Random(14), fx.vocabulary(14, 6000)
    long = [rng.choice(words) for _ in range(250_000)]
    near, far = list(long), list(long)
    for i in range(0, len(long), 60):
        near[i] = "changed"
    for i in range(0, len(long), 12):
        far[i] = "changed"
    rows = [(5, " ".join(long)), (9, " ".join(near)), (7, " ".join(far)), (8, " ".join(long[:100]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(rows[0][1]) > 1 << 20 and got == {i: (len(fx.brute_shingles(t)), {9: 5}.get(i, i)) for i, t in rows}


def test_banding_parameters(spark):
    df = fx.docs(spark)
    strict = near_duplicates(df, banding=Banding(similarity=100)).where("NOT kept").count()
    assert 0 < strict <= near_duplicates(df).where("NOT kept").count()


def test_chains_are_collinear():
    x, y = np.array([0, 5, 10, 15, 40, 45, 50, 55, 7]), np.array([100, 105, 110, 115, 10, 15, 20, 25, 300])
    found = chains(x, y, Rules())
    assert sorted(tuple(x[c]) for c in found) == [(0, 5, 10, 15), (40, 45, 50, 55)]
    assert all((np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all() for c in found)


def test_chains_have_the_best_score():
    """The Fenwick tree against all pairs."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 30, 80):
        for _ in range(12):
            x, y = rng.integers(0, 3 * n, n), rng.integers(0, 3 * n, n)
            x, y = np.unique(np.stack([x, y]), axis=1)
            rules = Rules(least_seeds=1, least_words=0, gap_cost=0.1)
            best: dict[int, float] = {}
            for i in np.lexsort((y, x)).tolist():
                before = [best[j] - 0.1 * (x[i] - x[j] + y[i] - y[j]) for j in best if x[j] < x[i] and y[j] < y[i]]
                best[i] = 5 + max([0.0, *before])
            first = chains(x, y, rules)[0]
            score = 5 * len(first) - 0.1 * (x[first[-1]] - x[first[0]] + y[first[-1]] - y[first[0]])
            assert abs(score - max(best.values())) < 1e-9


def test_gaps_are_aligned_at_any_size():
    rng = np.random.default_rng(4)
    for n, m, k in ((3, 5, 4), (20, 30, 6), (190, 191, 400), (250, 201, 5), (400, 390, 50)):
        a, b = rng.integers(0, k, n), rng.integers(0, k, m)
        table = np.zeros((n + 1, m + 1), int)
        for i in range(n):
            for j in range(m):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        taken = gap_matches(a, b)
        assert taken.sum() == table[n, m]
        rest = iter(b.tolist())
        assert all(w in rest for w in a[taken].tolist())
    shared = rng.integers(0, 10**9, 200)
    assert gap_matches(np.concatenate([shared[:100], rng.integers(0, 10**9, 50), shared[100:]]), np.concatenate([[1], shared])).sum() == 200


def planted(seed: int = 6):
    """(rows, where the passage begins in words, its length): clean texts, exact and fuzzy repeats, a passage in two halves."""
    rng, words = random.Random(seed), fx.vocabulary(seed, 8000)
    passage, other = [rng.choice(words) for _ in range(80)], [rng.choice(words) for _ in range(64)]
    plain = lambda n: [rng.choice(words) for _ in range(n)]
    rows, at = [], {}
    for i in range(90):
        kind = i % 9
        if kind == 2:
            at[i] = ("exact", 60, 80)
            rows.append(plain(60) + passage + plain(30))
        elif kind == 4:
            at[i] = ("fuzzy", 50, 64)
            rows.append(plain(50) + (other if i < 9 else [rng.choice(words) if rng.random() < 0.08 else w for w in other]) + plain(50))
        elif kind == 6:
            rows.append(plain(80) + passage[:35] + plain(80))
        else:
            rows.append(plain(150))
    return [" ".join(r) for r in rows], at


@pytest.mark.parametrize("block_bytes", [4000, 1 << 21])
def test_passages(spark, block_bytes):
    rows, at = planted()
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4), with_kept=True, block_bytes=block_bytes).collect()}
    first = {kind: min(i for i, v in at.items() if v[0] == kind) for kind in ("exact", "fuzzy")}
    for i, text in enumerate(rows):
        kind, begin, size = at.get(i, ("", 0, 0))
        if not kind or i == first[kind]:
            assert (got[i].n_passages, got[i].kept) == (0, text), i
        elif kind == "exact":
            words = text.split(" ")
            assert got[i].n_removed_words == size and got[i].source_ids == [first[kind]]
            assert got[i].kept.split() == words[:begin] + words[begin + size :]
        else:
            assert got[i].n_passages == 1 and abs(got[i].n_removed_words - size) <= 8, (i, got[i].n_removed_words)
        assert got[i].kept_sha256 == fx.sha(got[i].kept)


def test_copies_of_a_revised_passage(spark):
    rng, words = random.Random(12), fx.vocabulary(12, 8000)
    plain = lambda n: [rng.choice(words) for _ in range(n)]
    passage = plain(60)
    revised = passage[:21] + plain(18) + passage[39:]
    rows = [" ".join(plain(40) + (revised if i == 0 else passage) + plain(40)) for i in range(6)]
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [got[i].n_removed_words for i in range(6)] == [0, 0, 60, 60, 60, 60]
    assert all(1 in got[i].source_ids for i in range(2, 6))


@pytest.mark.parametrize("shape", ["slot", "slots"])
def test_exact_passages_beside_weak_ones(spark, shape):
    rng, words = random.Random(13), fx.vocabulary(13, 8000)
    plain = lambda n: [rng.choice(words) for _ in range(n)]
    fixed, near = [f"fix{i}" for i in range(60)], [plain(30), plain(30)]
    page = {
        "slot": lambda: plain(40) + fixed + plain(40) + near[0][:9] + plain(40),
        "slots": lambda: plain(40) + fixed + plain(rng.randint(20, 26)) + near[0] + plain(rng.randint(20, 26)) + near[1] + plain(40),
    }[shape]
    rows = [" ".join(page()) for _ in range(12)]
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), with_kept=True).collect()}
    assert got[0].n_removed_words == 0
    for i in range(1, 12):
        assert "fix" not in got[i].kept and got[i].source_ids[0] == 0, i


@pytest.mark.parametrize("core", [0, 15])
def test_passages_whose_phrases_have_other_holders(spark, core):
    rng, words = random.Random(14), fx.vocabulary(14, 8000)
    plain = lambda n: [rng.choice(words) for _ in range(n)]
    passage = [f"p{i}" for i in range(200)]
    low = 100 if core else 200
    # every five words of the passage but for its core are an older document by themselves
    phrases = [passage[i : i + 5] for i in range(196) if i + 5 <= low or i >= low + core]
    older = [" ".join(p) for p in phrases]
    rows = older + [" ".join(plain(40) + part + plain(40)) for part in (passage, passage, passage[20:75])]
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4), block_bytes=20000).collect()}
    n = len(older)
    assert [got[n + i].n_removed_words for i in range(3)] == [0, 200, 55]
    assert all(got[i].n_removed_words == 0 for i in range(n))
    assert got[n + 1].source_ids == [n] and got[n + 2].source_ids == [n]


@pytest.mark.parametrize("own", ["long seeds", "seeds"])
def test_passages_whose_seeds_have_other_holders(spark, own):
    rng, words = random.Random(16), fx.vocabulary(16, 9000)
    plain = lambda n: [rng.choice(words) for _ in range(n)]
    size, rows, copies = (25, [], []) if own == "long seeds" else (9, [], [])
    for k in range(12):
        passage = [f"{k}p{i}" for i in range(52 if size > 9 else 90)]
        fuzzy = [f"new{k}x{i}" if size == 9 and i % 18 == 17 else w for i, w in enumerate(passage)]
        # older documents have every piece of the passage by itself, between words of their own
        pieces = [plain(20) + passage[i : i + size] + plain(20) for i in range(len(passage) - size + 1)]
        rows += rng.sample(pieces, len(pieces))
        copies.append((len(rows), passage, fuzzy))
        rows.append(plain(30) + passage + plain(30))
        rows.append(plain(30) + fuzzy + plain(30))
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string").repartition(4), block_bytes=30000).collect()}
    for at, passage, _ in copies:
        # nearly all of the copy goes where it is changed, and all of it where it is not
        assert got[at + 1].n_removed_words >= (len(passage) if size > 9 else 0.9 * len(passage)), (at, got[at + 1].n_removed_words)
        assert size > 9 or got[at + 1].source_ids == [at]


def test_partners_that_agree_longest():
    rng = np.random.default_rng(5)
    z, around, ids = rng.integers(0, 6, 300).astype(np.uint64), rng.integers(1, 3, (300, 6)).astype(np.uint32), rng.integers(0, 60, 300)
    rank = np.empty(300, np.int64)
    rank[np.lexsort((np.arange(300), ids))] = np.arange(300)
    best = nearest(z, around, ids, rank)
    for i in range(300):
        agree = [(-int(np.argmin(np.append(around[i] == around[j], False))), rank[j], j) for j in range(300) if z[j] == z[i] and ids[j] < ids[i]]
        first = min((rank[j], j) for j in range(300) if z[j] == z[i])[1]
        want = min(agree)[2] if agree and min(agree)[0] < 0 else -1
        assert best[i] == (-1 if want == first else want)


def test_parts_of_a_passage():
    rules = Rules()
    equal = np.array([1] * 50 + [0] * 40 + [1] * 6, bool)
    assert passages([(7, 103, equal, 3)], rules) == [(7, 57, [3])]
    equal = np.array([1] * 50 + [0] * 20 + [1] * 30 + [0] * 20 + [1] * 30, bool)
    found = passages([(0, 150, equal, 3)], rules)
    assert all(e - a >= 50 and equal[a:e].mean() >= 0.75 for a, e, _ in found) and found[0][0] == 0
    rng = np.random.default_rng(4)
    for _ in range(200):
        equal = np.repeat(rng.random(12) < 0.6, rng.integers(1, 70, 12)) & (rng.random() < 0.5) | (rng.random(1) < 0.2)
        equal = np.concatenate([equal, np.ones(50, bool), rng.random(40) < 0.5])
        found = qualifying(equal, rules)
        gone = np.zeros(len(equal), bool)
        for a, e in found:
            assert e - a >= 50 and equal[a:e].mean() >= 0.75 and equal[a] and equal[e - 1] and not gone[a:e].any()
            gone[a:e] = True
        runs = np.flatnonzero(np.diff(np.concatenate([[0], equal, [0]])))
        assert all(gone[a:e].all() for a, e in runs.reshape(-1, 2) if e - a >= 50)


def test_passages_of_odd_rows(spark):
    df = fx.docs(spark)
    rows = repeated_passages(df, keep=["lang", "block", "kept"], with_kept=True, block_bytes=3000).collect()
    assert len(rows) == df.count()
    text = {r.doc_id: r.text or "" for r in df.collect() if r.doc_id is not None}
    lang = {r.doc_id: r.lang for r in df.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            assert r.lang == lang[r.doc_id] and r.block == "x"
            assert r.n_removed_words or r.kept == text[r.doc_id]
    # the passage of 70 words that some texts share stays in the first of them alone
    shared = [i for i in range(60) if i % 10 == 5]
    removed = {r.doc_id: r.n_removed_words for r in rows}
    assert removed[shared[0]] == 0 and all(removed[i] >= 68 for i in shared[1:])
    # a copy of a long text goes as a whole
    assert repeated_passages(df.where("false")).count() == 0


def test_passages_of_very_long_texts(spark):
    rng, words = random.Random(15), fx.vocabulary(15, 9000)
    long = [rng.choice(words) for _ in range(250_000)]
    first = [rng.choice(words) for _ in range(80)]
    long[200_000:200_000] = first
    fuzzy = list(long[50_000:50_300])
    for i in range(5, 300, 20):
        fuzzy[i] = "changed"
    rows = [(1, " ".join(first)), (2, " ".join(long)), (3, " ".join(long[100_000:100_200])), (4, " ".join(["own"] + fuzzy + ["own"])), (5, " ".join(rng.choice(words) for _ in range(300)))]
    got = {r.doc_id: (r.n_words, r.n_passages, r.n_removed_words) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(rows[1][1]) > 1 << 20 and got[1][1:] == got[5][1:] == (0, 0)
    assert got[2] == (250_080, 1, 80) and got[3] == (200, 1, 200) and got[4][0] == 302 and 280 <= got[4][2] <= 300
