from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from urlloom.llm import chat
from urlloom.llm.bpe import BPE, encoded
from urlloom.llm.common import components
from urlloom.llm.decontamination import contamination
from urlloom.llm.quality_rules import score_documents
from urlloom.llm.token_counts import Counter, CountTree, counted, edited_trees, kept_trees, ordered as in_order, scrubbing

from . import fixtures as fx

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  ", "Hello World's it's don't I'LL we're x123 45.6", "<|endoftext|>foo<|startoftext|> bar<|end", "ΣΑΣ Σ İstanbul ß ﬁ \x85x\xa0y z\x1cq\x0b k", "日本語テキスト混在abc", "a" * 300 + " " + "ab!" * 500, "é 👍🏽👩‍👩‍👧 ‍", "١٢٣ ½ ² Ⅳ", "...!!!$$$###", "\n\n\t x  "]


def noise(n: int, signs: str, size: int = 60, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_bpe_equals_the_library(path):
    mine, library = BPE(path), Tokenizer.from_file(path)
    texts = ODD + noise(400, "aAbzé'st .,!<|endoftext|>\n\t 1۲ßΣİ日́​\xa0\x1f")
    for t, raw in zip(texts, mine.encode_many(texts), strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids, t
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_over_a_table(spark):
    df, library = fx.docs(spark), Tokenizer.from_file(WORD)
    rows = encoded(df, WORD, keep=["lang"], outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    want = []
    for r in df.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, r.lang, len(ids), ids, decoded, fx.sha(np.array(ids, "<u4").tobytes()), fx.sha(decoded)))
    assert fx.ordered(rows) == fx.ordered(want)
    assert encoded(df.where("false"), WORD).count() == 0


def test_count_trees_follow_edits():
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    counter, rng, signs = Counter(BPE(BYTE), public_tokenizers.PATTERN), random.Random(3), "ab c'  \n\t's're12é日!. ,<|endoftext|>"
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for text in noise(300, signs, 80, 4):
        tree = CountTree.of(counter, text)
        assert tree.count == count(text)
        for _ in range(4):
            b = rng.randint(0, len(text))
            e, new = min(len(text), b + rng.choice([0, 1, 3, 10])), "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 8])))
            tree.edit(b, e, new)
            text = text[:b] + new + text[e:]
            assert tree.text() == text and tree.count == count(text)
            if rng.random() < 0.5:  # a tree that comes back from a table goes on as it was
                kept, tree = tree, CountTree.kept(counter, *tree.stored())
                assert (tree.text(), tree.count) == (text, kept.count) and tree.stored() == kept.stored()
    long = CountTree.of(counter, "word and " * 5000)
    long.edit(20_000, 20_004, "XY")
    assert long.reencoded < 30


def test_trees_are_kept_between_batches_of_edits(spark):
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rng = random.Random(9)
    texts = {i: t for i, t in enumerate([*noise(40, "ab c'  \n's're12é日!. ,", 80, 6), "word and " * 130_000])}
    df = spark.createDataFrame([*texts.items(), (None, "no id"), (100, None)], "doc_id long, text string").repartition(3)
    trees = kept_trees(df, BYTE, public_tokenizers.PATTERN)
    assert {r.doc_id: r.n_tokens for r in trees.collect()} == {**{i: count(t) for i, t in texts.items()}, None: 2, 100: 0}
    for _ in range(2):
        some = rng.sample(sorted(texts), 9) + [40]
        edits = [(i, b := rng.randint(0, 60), b + rng.randint(0, 4), rng.choice(["", "x", " 12 é"])) for i in dict.fromkeys(some)]
        table = spark.createDataFrame([*edits, (999, 0, 1, "x"), (None, 0, 1, "y")], "doc_id long, begin int, end int, replacement string")
        changed = edited_trees(trees, table, BYTE, public_tokenizers.PATTERN)
        for i, b, e, put in edits:
            b, e = min(b, len(texts[i])), min(e, len(texts[i]))
            texts[i] = texts[i][:b] + put + texts[i][e:]
        got = {r.doc_id: r for r in changed.collect()}
        assert set(got) == {i for i, *_ in edits} and all(got[i].text == texts[i] and got[i].n_tokens == count(texts[i]) for i in got)
        assert got[40].n_reencoded < 30
        trees = spark.createDataFrame(trees.join(changed, "doc_id", "left_anti").unionByName(changed.drop("n_reencoded")).collect(), trees.schema)
    assert {r.doc_id: r.n_tokens for r in trees.collect()} == {**{i: count(t) for i, t in texts.items()}, None: 2, 100: 0}


def test_scrubbing_finds_what_one_pattern_finds():
    import regex

    both = regex.compile(r"([\w.+-]+@[\w-]+\.[\w.-]*\w)|(\+?\d[\d ()-]{7,}\d)")
    rule = scrubbing()
    for text in noise(3000, "a1@.+- ()7_é", 60, 12):
        assert rule(text) == [(m.start(), m.end(), ("[EMAIL]", "[PHONE]")[m.lastindex - 1]) for m in both.finditer(text)], text


def test_counts_over_tables(spark):
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    df = fx.docs(spark, ["mail a.b@c.de now, call +1 (389) 555-5010.", *fx.texts()])
    for r in counted(df, BYTE, public_tokenizers.PATTERN, rule=scrubbing()).collect():
        assert r.n_edits == (2 if r.doc_id == 0 else 0)
    edits = spark.createDataFrame([(0, 5, 9, "x"), (0, 7, 12, "overlap"), (0, 13, 999, "end"), (1, 0, 0, "start "), (None, 0, 5, ""), (2, None, None, None), (999, 0, 1, "")], "doc_id long, begin long, end long, replacement string")
    got = {r.doc_id: r for r in counted(df, BYTE, public_tokenizers.PATTERN, edits=edits).collect()}
    for r in df.where("doc_id < 3").collect():
        text = r.text
        for b, e, new in in_order([(x.begin or 0, min(x.end or 0, len(text)), x.replacement or "") for x in edits.where(f"doc_id = {r.doc_id}").collect()]):
            text = text[:b] + new + text[e:]
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_tokens_after) == (count(r.text), count(text))
    assert counted(df.where("false"), BYTE, public_tokenizers.PATTERN, edits=edits).count() == 0


CONTROL = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "<|endoftext|>", "plain", "", None, " lead\n\n", "é<|", "日本 👍🏽 <"]


def test_escapes_are_reversible():
    for t in [x for x in CONTROL if x] + noise(500, "<\\|im_endé"):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


def test_chat_digests_and_masks(spark):
    rng = random.Random(2)
    rows = [(c, t if t % 4 else None, rng.choice(["user", "assistant", None, "sys\ntem<|"]), rng.choice(CONTROL), 1) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [rows[0], (None, 0, "user", "x", 1), (None, 1, "assistant", "y", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted long").repartition(4)
    got = {r.conv_id: r for r in chat.formatted(df, BYTE, segment_chars=40).collect()}
    by_conv: dict = {}
    for c, t, role, text, _ in rows:
        by_conv.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), fx.sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), fx.sha(loss))
    whole = chat.formatted(df, BYTE, full=True).collect()
    assert sum(len(r.formatted) for r in whole) == sum(r.formatted_chars for r in got.values())
    assert sum(sum(r.loss_mask) for r in whole) == sum(r.n_loss_tokens for r in got.values())
    assert sum(len(r.ids) for r in whole) == sum(r.n_tokens for r in got.values())

    def joined(rows):
        """Conversations from their segments."""
        out = {}
        for r in sorted(rows, key=lambda r: r.segment):
            text, ids, masked, spans = out.setdefault(r.conv_id, ("", [], [], []))
            assert r.begin == len(text)
            out[r.conv_id] = (text + r.formatted, ids + r.ids, masked + r.loss_mask, spans + [tuple(s) for s in r.spans])
        return out

    assert joined(whole) == joined(chat.formatted(df, BYTE, full=True, segment_chars=20).collect())
    for text, *_, spans in joined(whole).values():
        assert all(text[:b].endswith(chat.SEP) and text[e:].startswith(chat.END) for b, e in spans)
    assert chat.formatted(df.where("false"), BYTE).count() == 0


def test_quality_counts_and_verdicts(spark):
    df = fx.docs(spark)
    rows = score_documents(df, keep=["lang", "kept"]).collect()
    want = {(r.doc_id, r.text): fx.brute_counts(r.text) for r in df.collect()}
    text_of = {r.doc_id: r.text for r in df.where("doc_id IS NOT NULL").collect()}
    assert len(rows) == df.count()
    for r in rows:
        if r.doc_id is None:
            continue
        counts = want[r.doc_id, text_of[r.doc_id]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert r.verdict == fx.brute_verdict(text_of[r.doc_id])
        assert r.kept == (not r.base_failed and r.verdict == "ok")
    assert score_documents(df.where("false")).count() == 0


def test_compression_bands_tell_prose_from_junk(spark):
    rng, words = random.Random(7), fx.vocabulary(7, 6000)
    import base64

    prose = [fx.prose(rng, words, n) for n in (12, 40, 300, 3000)]
    noise_ = [base64.b64encode(rng.randbytes(4000)).decode()[i::2][:1500] for i in (0, 1)]
    noise_ = [" ".join(x[i : i + 8] for i in range(0, len(x), 8)) for x in noise_]
    varied = ["\n".join(f"row {i % 7} of the same table, cell {i % 5}{i % 3}" for i in range(400))]
    got = {r.doc_id: r.verdict for r in score_documents(spark.createDataFrame(list(enumerate(prose + noise_ + varied)), "doc_id long, text string")).collect()}
    assert all(got[i] == "ok" for i in range(4))
    assert all(got[i] == "incompressible" for i in (4, 5)) and got[6] == "repetitive"


def test_bands_at_every_length(spark):
    """Texts of every length are judged, and so is the last chunk, however short."""
    rng, words = random.Random(4), fx.vocabulary(4, 6000)
    prose = fx.prose(rng, words, 900_000)
    junk = "".join(chr(rng.randint(33, 126)) for _ in range(5000))
    texts = [prose[:n] for n in [*range(1, 300, 7), 2047, 2048, 2049, 4096, 5001]] + [junk[:n] for n in (100, 180, 220, 1000, 5000)] + ["ab " * n for n in (10, 30, 60, 1000)]
    texts += [prose[:n] + junk[:m] for n, m in ((2048, 900), (1000, 700), (4096, 1000), (4096, 2048))] + [prose[:n] + "ab " * m for n, m in ((2048, 660), (2048, 300), (200, 60))] + [prose, prose[: 1 << 21] + junk * 300]
    got = {r.doc_id: r.verdict for r in score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(prose) > 5_000_000 and got == {i: fx.brute_verdict(t) for i, t in enumerate(texts)}
    verdict = {t: got[i] for i, t in enumerate(texts)}
    assert all(verdict[prose[:n]] == "ok" for n in range(1, 300, 7)) and verdict[junk[:220]] == "incompressible" and verdict["ab " * 30] == "repetitive"
    assert verdict[prose] == "ok" and verdict[prose[: 1 << 21] + junk * 300] != "ok"


ITEMS = [("1", "The quick brown fox jumps over the lazy dog again and again, every day."), ("10", "one two three"), ("2", None), (None, "a null id has these ten words in its only item"), ("3", "!!!"), ("1", "same id, another text of the item, with more than ten words in all"), ("4", "x"), ("5", "the quick brown fox jumps over the lazy dog again and other words here")]


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_contamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(4)
    bits = " ".join(t or "" for _, t in ITEMS).split(" ")
    rows = [t.replace("The", "THE") if t else t for _, t in ITEMS] + ["x" if i % 9 == 0 else " ".join(rng.choice(bits) if rng.random() < 0.2 else bits[(i + j) % len(bits)] for j in range(rng.randint(1, 60))) for i in range(60)] + [None, "", "One, TWO: three", "ONE two threé"]
    df, items = fx.docs(spark, rows), spark.createDataFrame(ITEMS, "item_id string, text string")
    got = contamination(df, items, block_bytes=block_bytes).collect()
    given = [(i or "", t) for i, t in ITEMS]
    assert fx.ordered(got) == fx.ordered([(r.doc_id, *fx.brute_hits(r.text, given)) for r in df.collect()])


def test_contamination_of_empty_tables(spark):
    df, items = fx.docs(spark), spark.createDataFrame(ITEMS, "item_id string, text string")
    assert contamination(df.where("false"), items).count() == 0
    assert contamination(df, items.where("false"), keep=df.columns).where("contaminated").count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(a, a + 1) for a in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(70)] + [(5, 5), (None, 3), (100, 101)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in root} and len(got) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
