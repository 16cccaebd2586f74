from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline

from . import fixtures as fx


def tables(spark, folder):
    """Documents with clean texts, junk, near copies, a shared passage and benchmark passages."""
    rng, words = random.Random(21), fx.vocabulary(21, 6000)
    passage = [rng.choice(words) for _ in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(14))) for i in range(5)]
    rows = []
    for i in range(80):
        text = [rng.choice(words) for _ in range(120)]
        if i % 8 == 1:
            text = text[:50] + passage + text[50:]
        if i % 8 == 3:
            text = text[:30] + items[i % 5][1].upper().split(" ") + text[30:]
        if i % 8 == 5 and i > 8:
            text = rows[i - 5][1].split(" ")
            text[i % len(text)] = "changed"
        rows.append((i, " ".join(text) if i % 8 != 7 else "spam spam\n" * 40))
    rows += [(80, None), (81, "")]
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or ""), i) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items, passage


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, items, passage = tables(spark, tmp_path)
    kept = []
    for i, t in rows:
        n, _, _, _, repeated = fx.brute_counts(t)
        if n >= 10 and 100 * repeated <= 20 * n and fx.brute_verdict(t) == "ok":
            kept.append((i, t))
    root = fx.brute_components(kept)
    kept = [(i, t) for i, t in kept if root[i] == i]
    seen, cut = False, []
    for i, t in kept:
        words, at = t.split(" "), t.find(" ".join(passage))
        if at >= 0:
            if seen:
                a = len(t[:at].split())
                t = " ".join(words[:a]) + "  " + " ".join(words[a + len(passage) :])
            seen = True
        cut.append((i, t))
    clean = [(i, t) for i, t in cut if not fx.brute_hits(t, [(str(k), v) for k, v in items])[4]]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in clean}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for i, ids in want.items():
        assert got[i].ids == ids and got[i].ids_sha256 == fx.sha(np.array(ids, "<u4").tobytes())


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for df in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert (out.columns, [t for _, t in out.dtypes]) == (df.columns, [t for _, t in df.dtypes]), name
            if not df.take(1):
                assert out.count() == 0


def test_registration():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert "pipeline" in queries and set(sql) <= set(queries)
    for n in range(1, 11):
        assert len([q for q in queries if q.startswith(f"op{n}_")]) == 1
