"""Stages of the pipeline on null and repeated ids, against brute force over rows."""

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np

import corpus_pipeline
from tradeweave.llm import quality, toxicity
from tradeweave.llm.common import scores

D = "doc_id bigint, text string, lang string, source string"
WORDS = [f"w{i}" for i in range(500)]


def rows():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(WORDS, k=40)) for _ in range(30)]
    ids = [None] * 10 + [7] * 10 + list(range(100, 110))
    out = [(i, t, "en", "s") for i, t in zip(ids, texts, strict=True)]
    out += [(None, texts[12], "en", "s"), (5, texts[3], "en", "s"), out[25], out[0], (None, None, "en", "s"), (7, None, "en", "s"), (7, "", "en", "s")]
    return out


def brute_dedup(given):
    """One row of each class; here classes are texts that are equal, or have no words."""
    best = {}
    for r in given:
        text, rank = r[1] or "", (r[0] is None, r[0] or 0)
        best[text] = min(best.get(text, rank), rank)
    return Counter((None if rank[0] else rank[1], text) for text, rank in best.items())


def test_stages_leave_clashing_columns_alone(spark, tmp_path):
    """Columns that operators use inside are kept as they are, through all stages."""
    names = ("score", "doc_id_", "mix", "n_tokens", "p", "selected", "topic_key", "id", "bag", "class_id", "_id", "_key")
    extra = ", ".join(f"{n} int" for n in names)
    given = [(*r, *range(len(names))) for r in rows()]
    spark.createDataFrame(given, f"{D}, {extra}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", *names]
    assert {tuple(r) for r in out.collect()} <= set(given)
    assert out.count() > 0


def test_dedup_goes_by_rows(spark):
    given = rows()
    kept = corpus_pipeline.dedup_stage(spark, spark.createDataFrame(given, D), "")
    assert kept.columns == ["doc_id", "text", "lang", "source"]
    assert Counter((r["doc_id"], r["text"] or "") for r in kept.collect()) == brute_dedup(given)


def test_verdicts_go_by_rows(spark, monkeypatch):
    given = rows()
    d = spark.createDataFrame(given, D)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    bad = {given[i][1] for i in (0, 1, 4, 10, 11, 12, 22, 25)}
    items = spark.createDataFrame(list(enumerate(sorted(bad))), "item_id bigint, text string")
    monkeypatch.setattr(corpus_pipeline, "read", lambda s, d, table: items if table == "benchmark" else labels)
    for module, good in ((quality, lambda t: 0.9), (toxicity, lambda t: 0.0)):
        score = {t: (1 - good(t)) if t in bad else good(t) for _, t, *_ in given}

        known = {(t or "").encode(): x for t, x in score.items()}

        def look(texts, known=known):
            return np.array([known[t] for t in texts])

        monkeypatch.setattr(module, "fit", lambda *a, f=look: SimpleNamespace(column=lambda text: scores(f, text)))
    want = Counter(r for r in given if r[1] not in bad)
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.toxicity_stage, corpus_pipeline.benchmark_stage):
        assert Counter(map(tuple, stage(spark, d, "").collect())) == want, stage


def test_whole_pipeline_on_odd_ids(spark, tmp_path):
    d = spark.createDataFrame(rows(), D)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows()[20][1])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r["doc_id"], r["text"] or "") for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert set(got) <= set(brute_dedup(rows()))
    assert len(got) == len(set(got))
    assert rows()[20][1] not in {t for _, t in got}
