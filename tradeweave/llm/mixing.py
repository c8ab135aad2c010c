"""Mixing sources to target weights: raking of token weights, then calibrated sampling.

Iterative proportional fitting: cells of source, language and topic are scaled
to the target marginals of one dimension after the other, and documents are
sampled by the probabilities that the fitted weights give.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, binaries_of, dropped, fresh, read, space_words, stored

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 10
#: Share of all tokens to sample; exponent that flattens marginals without given targets.
RATE, TEMPER = 0.5, 0.7
#: Value of null sources, languages and topics; key of a target for all values that aren't named.
NONE, OTHERS = "(none)", "*"
TOPICS = 8
#: Cells, at most, that are broadcast to the documents; more are joined by shuffling.
BROADCAST = 100_000
#: Targets of the registered query: English gets 45 % of the tokens.
TARGETS = {"lang": {"en": 0.45, OTHERS: 0.55}}

_LONG = re.compile(rb"[a-z]{7,}")


def topic_of(text: bytes) -> str:
    """The text's leading word, its most frequent one of 7 or more letters a-z, dealt to one of TOPICS topics.

    Ties go to the first word by alphabet; without such a word: NONE.
    """
    words = Counter(_LONG.findall(text.lower()))
    if not words:
        return NONE
    most = max(words.values())
    leading = min(w for w, n in words.items() if n == most)
    return f"topic{int(hashlib.md5(leading).hexdigest()[:4], 16) % TOPICS}"


def described(docs: DataFrame, mix: str, topic: str | None) -> DataFrame:
    """docs with the struct ``mix`` of n_tokens, source, lang and topic (null: NONE)."""

    @F.arrow_udf("struct<n_tokens:long,topic:string>")
    def own(texts: pa.Array) -> pa.Array:
        n, topics = [], []
        for at in range(0, len(texts), SLICE):
            for t in binaries_of(texts.slice(at, SLICE)):
                n.append(len(space_words(t or b"")))
                topics.append(topic_of(t or b""))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(topics, pa.string())], names=["n_tokens", "topic"])

    docs = docs.withColumn(mix, own(F.col("text").cast("string")))
    value = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    of = F.col(f"`{mix}`.topic") if topic is None else value(F.col(f"`{topic}`"))
    return docs.withColumn(mix, F.struct(F.col(f"`{mix}`.n_tokens").alias("n_tokens"), value(F.col("source")).alias("source"), value(F.col("lang")).alias("lang"), of.alias("topic")))


def _targets(cells: DataFrame, dimension: str, given: dict[str, float] | None, temper: float) -> DataFrame:
    """The dimension's values with t, their target share; shares sum to 1.

    Named values that occur have the given shares. The share of OTHERS, and the
    whole where nothing is given, goes to the other values by their tokens to
    the power temper. Values that are neither named nor in OTHERS have none.
    """
    sums = cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), temper).alias("flat"), F.sum("tokens").alias("n")).where("n > 0")
    given = {OTHERS: 1.0} if given is None else given
    named = {k: float(v) for k, v in given.items() if k != OTHERS}
    if any(v < 0 for v in given.values()):
        raise ValueError(f"a target of {dimension} is below 0")
    keys = F.create_map(*[F.lit(x) for kv in named.items() for x in kv]) if named else None
    own = F.element_at(keys, F.col(dimension)) if named else F.lit(None).cast("double")
    sums = sums.select(dimension, own.alias("own"), F.when(own.isNull(), F.col("flat")).otherwise(0.0).alias("flat"))
    total = sums.agg(F.sum("flat")).first()[0] or 1.0
    sums = sums.select(dimension, F.coalesce("own", F.col("flat") / total * float(given.get(OTHERS, 0.0))).alias("t"))
    whole = sums.agg(F.sum("t")).first()[0] or 1.0
    return sums.select(dimension, (F.col("t") / whole).alias(f"t_{dimension}"))


def raked(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE, temper: float = TEMPER, rounds: int = ROUNDS) -> DataFrame:
    """The cells (source, lang, topic, tokens) with p, the probability of sampling a document of the cell.

    Each round scales the cells to the targets of one dimension after the other,
    then no cell above what sampling all of it gives: where targets can't be met
    so, those of the topic come closest, and ``marginals`` tells by how much all
    are missed. The cells are one row for each combination that occurs; they stay
    distributed, and a value with many cells is summed before it is shuffled.
    """
    whole = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    w = cells.withColumn("w", F.col("tokens").cast("double"))
    for c in DIMENSIONS:
        w = w.join(_targets(cells, c, (targets or {}).get(c), temper), c, "left").fillna(0.0, [f"t_{c}"])
    w = stored(w)
    for _ in range(rounds):
        before = w
        for c in DIMENSIONS:
            now = w.groupBy(c).agg(F.sum("w").alias("now"))
            w = w.join(now, c).withColumn("w", F.when(F.col("now") > 0, F.col("w") * F.col(f"t_{c}") * whole / F.col("now")).otherwise(0.0)).drop("now")
        w = stored(w.withColumn("w", F.least("w", F.col("tokens") / F.lit(rate))))
        dropped(before)
    return w.withColumn("p", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), rate * F.col("w") / F.col("tokens"))).otherwise(0.0))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the md5 of the id; a null id counts as the empty text."""
    h = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _cells(described: DataFrame, mix: str) -> DataFrame:
    return stored(described.select(f"`{mix}`.*").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))


def marginals(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE, temper: float = TEMPER, rounds: int = ROUNDS, topic: str | None = None) -> DataFrame:
    """dimension, value, tokens, target, reached, misfit: the share that each value should have and that sampling
    is expected to give it, and their difference."""
    mix = fresh("mix", docs.columns)
    cells = stored(raked(_cells(described(docs, mix, topic), mix), targets, rate, temper, rounds))
    whole = cells.agg(F.sum(F.col("p") * F.col("tokens"))).first()[0] or 1.0
    out = None
    for c in DIMENSIONS:
        part = cells.groupBy(F.lit(c).alias("dimension"), F.col(c).alias("value")).agg(F.sum("tokens").alias("tokens"), F.max(f"t_{c}").alias("target"), (F.sum(F.col("p") * F.col("tokens")) / whole).alias("reached"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("misfit", F.col("reached") - F.col("target"))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE, temper: float = TEMPER, rounds: int = ROUNDS, topic: str | None = None) -> DataFrame:
    """docs with a struct ``mix`` of n_tokens, source, lang, topic, p and selected: whether the calibrated sample has the row.

    targets: for a dimension (source, lang, topic) the share of each value, with
    OTHERS for all that aren't named; dimensions without one keep their own
    shares, flattened. topic: the column that has it, else ``topic_of`` the text.

    Texts that are null or have no words weigh nothing and are not selected.
    Null sources, languages and topics count as the value ``(none)``. Repeated
    rows weigh each and are selected together. All columns of docs stay as they
    are; if one is named ``mix`` the struct is ``mix_``. No rows: no rows.
    """
    mix = fresh("mix", docs.columns)
    d = described(docs, mix, topic)
    cells = raked(_cells(d, mix), targets, rate, temper, rounds)
    keys = [F.col(c) for c in DIMENSIONS]
    cells = cells.select(F.struct(*keys).alias(fresh("cell", docs.columns)), F.col("p").alias(fresh("cell_p", docs.columns)))
    key, p = cells.columns
    cells = F.broadcast(cells) if cells.count() <= BROADCAST else cells
    out = d.join(cells, F.struct(*[F.col(f"`{mix}`.{c}") for c in DIMENSIONS]) == cells[key], "left")
    p = F.when(F.col(f"`{mix}`.n_tokens") > 0, F.coalesce(cells[p], F.lit(0.0))).otherwise(0.0)
    return out.select(*[d[f"`{c}`"] for c in docs.columns], F.struct(F.col(f"`{mix}`.*"), p.alias("p"), (draw(F.col("doc_id")) < p).alias("selected")).alias(mix))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = mixed(docs, TARGETS)
    return out.select("doc_id", "source", "lang", F.col("mix.topic").alias("topic_key"), F.col("mix.n_tokens").alias("n_tokens"), F.round("mix.p", 6).alias("p"), F.col("mix.selected").alias("selected"))


def oracle_sql() -> str:
    r"""The same in DuckDB, rounds unrolled."""
    cte = [
        rf"""d AS (SELECT doc_id, source, lang, coalesce(source, '{NONE}') AS _source, coalesce(lang, '{NONE}') AS _lang,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]{{7,}}') AS long FROM documents)""",
        "l AS (SELECT doc_id, arg_min(word, (-n, word)) AS top_word FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(long) AS word FROM d) GROUP BY ALL) GROUP BY doc_id)",
        f"e AS (SELECT d.*, CASE WHEN top_word IS NULL THEN '{NONE}' ELSE 'topic' || CAST(CAST('0x' || substr(md5(top_word), 1, 4) AS INTEGER) % {TOPICS} AS VARCHAR) END AS _topic FROM d LEFT JOIN l USING (doc_id))",
        "c AS (SELECT _source, _lang, _topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM e GROUP BY ALL)",
    ]
    columns = []
    for name in DIMENSIONS:
        c, given = f"_{name}", TARGETS.get(name, {OTHERS: 1.0})
        named = {k: v for k, v in given.items() if k != OTHERS}
        own = " ".join(["CASE", *[f"WHEN {c} = '{k}' THEN {v}" for k, v in named.items()], "END"]) if named else "CAST(NULL AS DOUBLE)"
        cte.append(f"s{c} AS (SELECT {c}, {own} AS own, pow(sum(tokens), {TEMPER}) AS flat FROM c GROUP BY {c} HAVING sum(tokens) > 0)")
        cte.append(f"u{c} AS (SELECT {c}, coalesce(own, flat / (SELECT sum(flat) FROM s{c} WHERE own IS NULL) * {given.get(OTHERS, 0.0)}) AS t FROM s{c})")
        cte.append(f"t{c} AS (SELECT {c}, t * (SELECT sum(tokens) FROM c) / (SELECT sum(t) FROM u{c}) AS t{c} FROM u{c})")
        columns.append(c)
    cte.append("w0 AS (SELECT c.*, tokens AS w, " + ", ".join(f"coalesce(t{c}, 0) AS t{c}" for c in columns) + " FROM c " + " ".join(f"LEFT JOIN t{c} USING ({c})" for c in columns) + ")")
    last = "w0"
    for r in range(ROUNDS):
        for c in columns:
            now = f"r{r}{c}"
            cte.append(f"{now} AS (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {c}) > 0 THEN w * t{c} / sum(w) OVER (PARTITION BY {c}) ELSE 0 END AS w) FROM {last})")
            last = now
        cte.append(f"k{r} AS MATERIALIZED (SELECT * REPLACE (least(w, tokens / {RATE}) AS w) FROM {last})")
        last = f"k{r}"
    cte.append(f"p AS (SELECT _source, _lang, _topic, CASE WHEN tokens > 0 THEN least(1.0, {RATE} * w / tokens) ELSE 0 END AS p FROM {last})")
    return "WITH " + ",\n".join(cte) + """
SELECT doc_id, source, lang, _topic AS topic_key, n_tokens, CASE WHEN n_tokens > 0 THEN round(p, 6) ELSE 0 END AS p,
  n_tokens > 0 AND CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < p AS selected
FROM e JOIN p USING (_source, _lang, _topic)"""
