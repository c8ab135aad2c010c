"""Shared helpers: text normalisation, splits, samples, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.tables import dropped, shared_dir, stored

__all__ = ["dropped", "shared_dir", "stored"]

#: Bytes that separate words of the "letters and digits" kind: ASCII other than 0-9 A-Z a-z.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case."""
    return text.lower().split()  # bytes: only A-Z change, only ASCII whitespace splits


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case."""
    return text.translate(_ALNUM).split()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def split_of(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


#: Rows that a Python function sees at once, at most; Spark bounds the bytes of a batch.
SLICE = 1000


def binaries_of(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.binary()).to_pylist()


def binaries(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return binaries_of(batch.column(name))


def scores(fn: Callable[[list[bytes]], np.ndarray], text: str) -> Column:
    """``fn``'s double for each text of a column; null texts count as empty. No other column leaves the JVM."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        parts = [fn([t or b"" for t in binaries_of(texts.slice(at, SLICE))]) for at in range(0, len(texts), SLICE)]
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    return run(F.col(text).cast("string"))


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], schema: str
) -> DataFrame:
    """``fn`` turns slices of Arrow batches into columns by name; rows may differ in number."""
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = fn(batch.slice(at, SLICE))
                yield pa.RecordBatch.from_arrays([as_arrow(out[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def as_arrow(x: object) -> pa.Array:
    if isinstance(x, pa.ChunkedArray):
        return x.combine_chunks()
    return x if isinstance(x, pa.Array) else pa.array(x)


def fresh(name: str, columns: list[str]) -> str:
    """The name, with underscores after it until no column has it, in either case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id as long, text as string, and more columns; no others, so that none clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def sampled(df: DataFrame, key: str, rows: int, salt: str) -> DataFrame:
    """At most ``rows`` rows, chosen by the hash of the key: the same ones each time."""
    order = F.xxhash64(F.lit(salt), F.col(key))
    return df.orderBy(order, F.col(key)).limit(rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text, y of at most ``rows`` labelled rows of each label, 0 and 1.

    Ids are chosen before texts are read: only the chosen ids, 2 * rows at most,
    are broadcast to the documents, whose texts aren't shuffled. Where ids repeat,
    so that more rows than that have them, those first by a hash of id and text
    stay. Labels other than 0 and 1 are left out; of two labels of an id the
    greater counts.
    """
    y = F.col(label).cast("int")
    known = labels.where(y.isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(y).alias("y"))
    known = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(known, "doc_id"))
    chosen = [sampled(known.where(F.col("y") == v), "doc_id", rows, label) for v in (0, 1)]
    chosen = stored(chosen[0].unionByName(chosen[1]))
    found = stored(texts_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y"))
    seen = {r["y"]: r["count"] for r in found.groupBy("y").count().collect()}
    if max(seen.values(), default=0) <= rows:
        return found
    order = (F.xxhash64(F.lit(label), "doc_id", "text"), F.col("doc_id"), F.col("text"))
    kept = [found.where(F.col("y") == v).orderBy(*order).limit(rows) for v in (0, 1)]
    return stored(kept[0].unionByName(kept[1]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(
    X: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30
) -> tuple[np.ndarray, float]:
    """Dense logistic regression of a few columns by Newton steps: weights, intercept."""
    A = np.hstack([X, np.ones((len(X), 1))])
    w = np.zeros(A.shape[1])
    reg = np.full(A.shape[1], l2)
    reg[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(A @ w)
        H = (A * (p * (1 - p))[:, None]).T @ A + np.diag(reg)
        step = np.linalg.solve(H, A.T @ (y - p) - reg * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])
