"""Small cases against brute force: nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash

from tradeweave.llm import decontaminate, language, licenses, lm, mixing, neighbours, quality, simhash, toxicity, warc

D = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, key int"


def docs(spark, texts, ids=None):
    rows = [(i, t, "en" if i is None or i % 2 else None, "s", 1, "x", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, D)


TEXTS = [
    None, "", "   \n", "A b c d e f g h i j k l", "a B c d e f g h i j k l", "é É Straße über den Fluss " * 3, "word", "word",
    "x" * 300_000, "lorem ipsum dolor sit amet " * 3000, "Released under the MIT License.", "released undr the mitt license", "one two three four five six seven eight nine ten eleven twelve",
]


def words(t):
    return (t or "").encode().lower().split()


def brute_fp(t):
    w = words(t)
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < 4 else [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, TEXTS), 4, 4).collect()}
    fps = [brute_fp(t) for t in TEXTS]
    label = list(range(len(TEXTS)))
    for _ in TEXTS:
        label = [min(label[j] for j in range(len(TEXTS)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(TEXTS))]
    assert [int(got[i]["fingerprint"], 16) for i in range(len(TEXTS))] == fps
    assert [got[i]["component_id"] for i in range(len(TEXTS))] == label
    assert simhash.near_duplicates(docs(spark, []), 4, 4).count() == 0


def test_bit_sliced_comparison_matches_popcount():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, (40, 64), np.uint8)
    bits = np.repeat(base, 5, axis=0) ^ (rng.random((200, 64)) < 0.03).astype(np.uint8)
    starts = np.array([0, 70, 71, 150])
    root = simhash.near_roots(bits, starts, 4)
    ends = [*starts[1:], 200]
    for a, b in zip(starts, ends, strict=True):
        label = np.arange(a, b)
        near = (bits[a:b, None] != bits[None, a:b]).sum(2) <= 4
        for _ in range(b - a):
            label = np.where(near, label[None], 10**6).min(1)
        assert (root[a:b] == label).all()


def test_simhash_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 4)
    texts = ["the quick brown fox jumps over the lazy dog again and again " * 4 + x for x in "abcdefghij"]
    a = {(r[0], r[2]) for r in simhash.near_duplicates(docs(spark, texts), 4, 4).collect()}
    monkeypatch.setattr(simhash, "CHUNK", 2048)
    assert a == {(r[0], r[2]) for r in simhash.near_duplicates(docs(spark, texts), 4, 4).collect()}


def test_language_model_base_scores(spark):
    rows = {r["doc_id"]: r for r in lm.score_texts(docs(spark, TEXTS)).collect()}
    train = collections.Counter()
    for i, t in enumerate(TEXTS):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*words(t), b"\n"])
    n, v = sum(train.values()), len(train)
    for i, t in enumerate(TEXTS):
        w = [*words(t), b"\n"]
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(train[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w))
        assert math.isfinite(r["score"])
        assert r["score"] <= 0
    assert lm.score_texts(docs(spark, [])).count() == 0


def test_license_scan(spark):
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, TEXTS)).collect()}
    assert (got[10]["n_base"], got[10]["first_word"], got[10]["base_labels"]) == (1, 3, "mit")
    assert got[11]["n_base"] == 0
    assert got[11]["first_word"] is None
    assert got[11]["labels"] == "mit-notice"
    assert got[11]["hits"][0]["edits"] == 2
    assert got[0]["n_words"] == 0
    assert got[0]["labels"] == ""


def test_decontamination(spark):
    items = spark.createDataFrame(
        [(1, "One two three four five six seven eight nine ten eleven"), (2, "word"), (3, None), (None, "a b c"), (4, "A b c d e f g h i j"), (4, "a b c d e f g h i j")], "item_id bigint, text string"
    )
    for limit in (decontaminate.IN_PLACE, 0):  # in place, and by shuffled joins
        decontaminate.IN_PLACE, kept = limit, decontaminate.IN_PLACE
        got = {r["doc_id"]: r for r in decontaminate.contamination(docs(spark, TEXTS), items).collect()}
        decontaminate.IN_PLACE = kept
        assert [got[i]["n_hit"] for i in (0, 3, 4, 6, 12)] == [0, 10, 10, 1, 11]
        assert got[12]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
        assert got[0]["items_sha256"] == hashlib.sha256(b"").hexdigest()
        assert got[3]["n_items"] == 1
    assert decontaminate.contamination(docs(spark, []), items).count() == 0
    assert decontaminate.contamination(docs(spark, TEXTS), items.limit(0)).where("contaminated").count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "u", "same\r\n\r\nWARC/1.1"), (2, None, "same\r\n\r\nWARC/1.1"), (3, "u v\r\nX: y", None), (4, "w", ""), (5, "é", "größe" * 10)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert [got[i]["record_type"] for i in range(1, 6)] == ["revisit", "response", "revisit", "response", "response"]
    assert (got[1]["refers_to"], got[3]["refers_to"], got[2]["refers_to"]) == (2, 4, None)
    import base64

    for i, _, html in rows:
        payload = (html or "").encode()
        assert got[i]["payload_bytes"] == len(payload)
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert all(r["record_type"] == "response" for r in warc.round_trip(pages, 10**6).collect())


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] + [1.0] * 7), (1004, [float(y) for y in x[0]])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = neighbours.search(v, v.where("vec_id % 50 = 0")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 400, 50):
        s = u @ u[q]
        s[q] = -9
        ids = {r["vec_id"] for r in got if r["query_id"] == q}
        hit += len(ids & set(np.argsort(-s)[:5].tolist()) | ids & {1004})
    assert hit >= 0.9 * 40
    assert next(r["vec_id"] for r in got if r["query_id"] == 0 and r["rank"] == 1) == 1004


def labelled(spark):
    good = [f"clean plain words number {i} of an ordinary text about rivers and hills {i % 7}" for i in range(60)]
    bad = [f"you stupid moron {i} BUY!! NOW!! %%% $$$ ### stupid moron idiot!! {i % 5}" for i in range(60)]
    d = docs(spark, good + bad)
    return d, spark.createDataFrame([(i, int(i < 60), int(i >= 60)) for i in range(120)], "doc_id bigint, quality int, toxic int")


def test_classifiers_learn_and_stand_odd_rows(spark):
    d, labels = labelled(spark)
    m = toxicity.fit(d, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_texts(d, m).collect()}
    assert np.mean([got[i] == int(i >= 60) for i in range(120)]) > 0.95
    q = quality.fit(d, labels)
    got = {r["doc_id"]: r["predicted"] for r in quality.score_texts(d, q).collect()}
    assert np.mean([got[i] == int(i < 60) for i in range(120)]) > 0.9
    for model, score in ((m, toxicity.score_texts), (q, quality.score_texts)):
        assert all(0 <= r["score"] <= 1 for r in score(docs(spark, TEXTS), model).collect())
        assert score(docs(spark, []), model).count() == 0
    none = labels.limit(0)
    assert score(docs(spark, TEXTS), quality.fit(d, none)).count() == len(TEXTS)
    assert toxicity.score_texts(docs(spark, TEXTS), toxicity.fit(d, none)).where("predicted = 1").count() == 0


def test_language(spark):
    rows = [(i, ("the rivers and the hills " if i % 2 else "der Fluss und die Hügel ") * 9, "en" if i % 2 else "de") for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(d, language.fit(d)).collect()}
    assert all(got[i] == ("en" if i % 2 else "de") for i in range(80))
    odd = {r["doc_id"]: r for r in language.predict(docs(spark, [None, "", "123 %%", "ж", "the hills"]), language.fit(d)).collect()}
    assert [odd[i]["lang_pred"] for i in range(3)] == ["und"] * 3
    assert odd[3]["lang_pred"] != "und"
    assert language.predict(docs(spark, ["a"]), language.fit(d.limit(0))).first()["lang_pred"] == "und"


def test_mixing(spark):
    d = docs(spark, TEXTS)
    got = mixing.mixed(d).collect()
    assert mixing.mixed(d).columns == [*d.columns, "mix"]
    assert len(got) == len(TEXTS)
    for r in got:
        t = (r["text"] or "").encode()
        assert r["mix"]["n_tokens"] == len(t.split())
        assert r["mix"]["topic"] == mixing.topic_of(t)
        assert 0 <= r["mix"]["p"] <= 1
        assert t.split() or not r["mix"]["selected"]
    assert mixing.mixed(docs(spark, [])).count() == 0


def test_mixing_leaves_clashing_columns_alone(spark):
    d = spark.createDataFrame([(1, "a b", "en", "s", 5, "m", 7, 8), (2, None, None, None, 5, "m", 7, 8)], "doc_id bigint, text string, lang string, source string, p int, Mix string, n_tokens int, cell int")
    out = mixing.mixed(d)
    assert out.columns == [*d.columns, "mix_"]
    assert {tuple(r)[:8] for r in out.collect()} == {tuple(r) for r in d.collect()}
    assert out.where("mix_.selected and doc_id = 2").count() == 0


def test_mixing_meets_given_targets(spark):
    """Feasible targets of all three dimensions are met; infeasible ones are reported as missed."""
    rows = [(i, "w " * 20, "en" if i % 3 else "de", f"s{i % 4}", f"t{i % 5}") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, subject string")
    targets = {"lang": {"en": 0.6, "de": 0.4}, "source": {"s0": 0.4, "*": 0.6}, "topic": {f"t{k}": 0.2 for k in range(5)}}
    got = {(r["dimension"], r["value"]): r for r in mixing.marginals(d, targets, rate=0.3, topic="subject").collect()}
    assert all(abs(r["misfit"]) < 1e-6 for r in got.values())
    assert got["lang", "de"]["reached"] == pytest.approx(0.4)
    assert got["source", "s0"]["target"] == pytest.approx(0.4)
    assert got["source", "s1"]["target"] == pytest.approx(0.2)
    p = {(r["lang"], r["source"], r["subject"]): r["mix"]["p"] for r in mixing.mixed(d, targets, rate=0.3, topic="subject").collect()}
    assert sum(p[r[2:]] for r in rows) == pytest.approx(0.3 * 600, rel=1e-6)
    far = {(r["dimension"], r["value"]): r for r in mixing.marginals(d, {"lang": {"de": 1.0}}, rate=0.9, topic="subject").collect()}
    assert far["lang", "en"]["target"] == 0 and far["lang", "en"]["tokens"] > 0
    with pytest.raises(ValueError, match="below 0"):
        mixing.mixed(d, {"lang": {"de": -1.0}})
