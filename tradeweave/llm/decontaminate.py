"""Benchmark decontamination: a prefix-filtered join of word windows, native throughout.

Windows of benchmark items are sets of two-word shingles by offset. Shingles are
ordered by how rare they are in the documents; for exact containment the
rarest shingle of a window is the necessary prefix. Documents keep the places
of benchmark shingles only; places of prefix shingles name candidate windows,
bounded by position and length, and a candidate counts if all shingles of the
window stand there in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmarks of at most this many distinct shingles are matched in place and broadcast; larger ones by shuffled joins.
IN_PLACE = 20_000
#: Keys that a shingle's places are dealt to in shuffled joins.
SALT = 16
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, with A-Z in lower case only."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    t = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(t, _BETWEEN), "")


def _pairs(w: str, last: str) -> str:
    return f"transform(sequence(0, {last}), i -> concat_ws(' ', {w}[i], {w}[i + 1]))"


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """s (shingles in order), n (words), items: each distinct window of the items once."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    items = items.where("item is not null and size(w) > 0")
    w = items.select("item", F.explode(F.expr(f"transform(sequence(0, greatest(0, size(w) - {window})), i -> slice(w, i + 1, {window}))")).alias("w"))
    s = F.when(F.size("w") == 1, F.col("w")).otherwise(F.expr(_pairs("w", "size(w) - 2")))
    return w.select("item", F.size("w").alias("n"), s.alias("s")).groupBy("s", "n").agg(F.collect_set("item").alias("items"))


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)  # words have no quotes or backslashes


def _salted(rows: DataFrame) -> DataFrame:
    """Each row once for each salt: a frequent shingle's places are dealt to SALT tasks."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def _places(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), n_words, occ: place and shingle of all
    benchmark shingles of two words, in order; one: those of one word."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), words(F.col("text")).alias("w")
    ).withColumn("n_words", F.size("w"))
    some = vocabulary.limit(IN_PLACE + 1).collect()
    if len(some) <= IN_PLACE:
        two = sorted(r["s"] for r in some if " " in r["s"])
        one = sorted(r["s"] for r in some if " " not in r["s"])
        empty = "cast(array() as array<struct<pos:int,s:string>>)"
        firsts = _quoted(sorted({x.split(" ")[0] for x in two}))
        occ = (
            "transform(filter(transform(filter(sequence(0, n_words - 2), i -> w[i] in ({f})),"
            " i -> struct(i as pos, concat_ws(' ', w[i], w[i + 1]) as s)), x -> x.s in ({t})), x -> struct(x.pos as pos, x.s as s))"
        )
        found = F.expr(f"if(n_words < 2, {empty}, {occ.format(f=firsts, t=_quoted(two))})" if two else empty)
        alone = F.expr(f"if(n_words < 1, {empty}, transform(filter(sequence(0, n_words - 1), i -> w[i] in ({_quoted(one)})), i -> struct(i as pos, w[i] as s)))" if one else empty)
        return base.select("doc_id", "mark", F.col("n_words").cast("long").alias("n_words"), found.alias("occ"), alone.alias("one"))
    base = base.select("doc_id", "mark", "n_words", "w")
    pairs = F.expr("if(n_words < 2, cast(array() as array<string>), " + _pairs("w", "n_words - 2") + ")")
    rows = [base.select("doc_id", "mark", F.lit(n).alias("kind"), F.posexplode(a).alias("pos", "s")) for n, a in ((2, pairs), (1, F.col("w")))]
    rows = rows[0].unionByName(rows[1]).withColumn("salt", F.pmod("pos", F.lit(SALT)))
    rows = rows.join(_salted(vocabulary), ["s", "salt"], "left_semi")
    place = F.struct("pos", "s")
    occ = rows.groupBy("doc_id", "mark").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("kind") == k, place))).alias(n) for k, n in ((2, "occ"), (1, "one"))]
    )
    both = base.select("doc_id", "mark", F.col("n_words").cast("long").alias("n_words")).alias("a").join(
        occ.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.mark").eqNullSafe(F.col("b.mark")), "left"
    )
    none = F.expr("cast(array() as array<struct<pos:int,s:string>>)")
    return both.select("a.doc_id", "a.mark", "a.n_words", F.coalesce("b.occ", none).alias("occ"), F.coalesce("b.one", none).alias("one"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Benchmark passages in each row of docs.

    Returns doc_id, n_words, n_hit (words inside any occurrence of a window),
    n_items, items_sha256, contaminated. A window is ``window`` consecutive
    words of an item; an item of fewer words, but not none, is one window.

    Null and empty texts have no words; null or wordless items, and items
    without an id, have no windows. Items may repeat: equal ids count once.
    Repeated rows of docs return as often as they occur. Other columns are
    ignored. No items: nothing is contaminated.
    """
    windows = stored(item_windows(benchmark, window))
    vocabulary = stored(windows.select(F.explode("s").alias("s")).distinct())
    small = len(vocabulary.limit(IN_PLACE + 1).collect()) <= IN_PLACE
    held = F.broadcast if small else lambda x: x
    places = stored(_places(docs, vocabulary))
    rarity = places.select(F.explode(F.concat("occ", "one")).alias("o")).groupBy(F.col("o.s").alias("shingle")).agg(F.count("*").alias("seen"))
    rarity = stored(rarity)
    # the rarest shingle of each window; windows with a shingle that no document has can't occur
    at = windows.select("s", "n", "items", F.posexplode("s").alias("offset", "shingle")).join(held(rarity), "shingle", "left")
    prefix = at.groupBy("s", "n").agg(
        F.first("items").alias("items"), F.min(F.coalesce("seen", F.lit(0))).alias("fewest"),
        F.min_by(F.struct("shingle", "offset"), F.struct(F.coalesce("seen", F.lit(0)), "shingle", "offset")).alias("p"),
    )
    prefix = stored(prefix.where("fewest > 0").select("s", "n", "items", F.col("p.shingle").alias("shingle"), F.col("p.offset").alias("offset")))
    parts = []
    for kind, column in ((2, "occ"), (1, "one")):
        own = prefix.where(F.col("n") > 1 if kind == 2 else F.col("n") == 1)
        candidates = places.where(F.size(column) > 0)
        near = F.sequence(F.lit(0), F.size(column) - 1)
        if small:
            keys = [r["shingle"] for r in own.select("shingle").distinct().collect()]  # at most IN_PLACE
            if not keys:
                continue
            near = F.expr(f"filter(sequence(0, size({column}) - 1), j -> {column}[j].s in ({_quoted(keys)}))")
        candidates = candidates.select("doc_id", "mark", "n_words", F.col(column).alias("o"), F.explode(near).alias("j"))
        candidates = candidates.withColumn("shingle", F.expr("o[j].s")).withColumn("pos", F.expr("o[j].pos"))
        if small:
            c = candidates.join(F.broadcast(own), "shingle")
        else:
            c = candidates.withColumn("salt", F.pmod("pos", F.lit(SALT))).join(_salted(own), ["shingle", "salt"])
        fits = "pos - offset >= 0 and pos - offset + n <= n_words and j - offset >= 0 and j - offset + size(s) <= size(o)"
        c = c.where(fits).withColumn("run", F.expr("slice(o, greatest(1, j - offset + 1), size(s))"))
        c = c.where("run[size(s) - 1].pos - run[0].pos = size(s) - 1 and transform(run, x -> x.s) = s")
        parts.append(c.select("doc_id", "mark", F.struct((F.col("pos") - F.col("offset")).alias("a"), F.col("n").alias("n")).alias("hit"), "items"))
    base = places.select("doc_id", "mark", "n_words")
    if parts:
        hits = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        hits = hits.groupBy("doc_id", "mark").agg(F.collect_set("hit").alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        base = base.alias("d").join(hits.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & F.col("d.mark").eqNullSafe(F.col("h.mark")), "left").select("d.*", "hits", "items")
    else:
        base = base.withColumns({"hits": F.expr("cast(null as array<struct<a:int,n:int>>)"), "items": F.expr("cast(null as array<string>)")})
    n_hit = F.expr("size(array_distinct(flatten(transform(hits, h -> sequence(h.a, h.a + h.n - 1)))))")
    items = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    out = base.select(
        "doc_id", "n_words", F.when(F.col("hits").isNull(), 0).otherwise(n_hit).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
),
h AS (SELECT doc_id, i, bw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
