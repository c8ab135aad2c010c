"""The pipeline's near-duplicates against brute force over all pairs."""

import random

import pytest

from tradeweave.llm import simhash

D = "doc_id bigint, text string"


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    near = [[1 if not (a | b) else 5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets]
    while True:
        new = [min(label[j] for j in range(len(rows)) if near[i][j]) for i in range(len(rows))]
        if new == label:
            return [rows[x][0] for x in label]
        label = new


def corpus(copies=12):
    """Copies with random edits, so that similarities lie on both sides of 0.8; one common line; short texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    line = " ".join(f"common{i}" for i in range(30))
    texts = [None, "", "  ", "one", "One", "a b c d e", "a b c d e f", "a b c d f"]
    for base in range(12):
        w = rng.choices(words, k=rng.choice([30, 80, 300]))
        texts.append(" ".join(w))
        for _ in range(copies):
            v = list(w)
            for _ in range(max(1, round(len(w) * rng.uniform(0.005, 0.04)))):
                v[rng.randrange(len(v))] = rng.choice(words)
            texts.append(" ".join(v) + (" " + line if base % 3 == 0 else ""))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("common,chunk", [(8, 2048), (10**6, 8)])
def test_classes_match_brute_force(spark, monkeypatch, common, chunk):
    monkeypatch.setattr(simhash, "COMMON", common)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "PIVOTS", 2)
    rows = corpus()
    want = brute(rows)
    got = first_ids(simhash.similar(spark.createDataFrame(rows, D)).collect())
    assert [got[i] for i, _ in rows] == want
    assert 30 < len(set(want)) < len(rows) - 30


def first_ids(found):
    low = {}
    for i, c in sorted(found):
        low.setdefault(c, i)
    return {i: low[c] for i, c in found}


def test_large_groups_lose_no_link(spark, monkeypatch):
    """A chain whose links are neighbours only: every chunk holds strangers, and the largest class grows slowly."""
    monkeypatch.setattr(simhash, "CHUNK", 4)
    monkeypatch.setattr(simhash, "PIVOTS", 1)
    w = [f"w{i}" for i in range(200)]
    texts = [" ".join(w[i * 3 : i * 3 + 60]) for i in range(40)]
    rows = list(enumerate(texts)) + [(100 + i, " ".join(w[:60] + [f"other{i}"] * 30)) for i in range(5)]
    want = brute(rows)
    got = first_ids(simhash.similar(spark.createDataFrame(rows, D)).collect())
    assert [got[i] for i, _ in rows] == want
    assert len(set(want[:40])) == 1


def test_pieces_give_all_shingles(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice(["a", "bc", "d", " ", "\n", "\t", "  "]) for _ in range(4000)).encode() + b"x" * 300 + b" end"
    whole = {k: simhash.shingle_hashes(text, k).tolist() for k in (1, 4, 5)}
    for size in (16, 100):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert b"".join(simhash.pieces(text)) == text
        assert {k: simhash.shingle_hashes(text, k).tolist() for k in whole} == whole


def test_no_rows(spark):
    assert simhash.similar(spark.createDataFrame([], D)).count() == 0


def test_pipeline_stage_keeps_dissimilar_and_drops_similar(spark):
    import corpus_pipeline

    rows = corpus(4)
    kept = corpus_pipeline.dedup_stage(spark, spark.createDataFrame(rows, D), "").collect()
    assert {r["doc_id"] for r in kept} == set(brute(rows))
