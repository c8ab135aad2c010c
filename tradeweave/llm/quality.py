"""Quality by compression: zstandard dictionaries of good and bad labelled text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, fit_logistic, labelled_sample, map_batches, read, scores, sigmoid, split_of, texts_of

#: Labelled rows that dictionaries are built from, and that scores are calibrated on; at most, of each label.
SAMPLE = 1500
CHUNK = 2048  # bytes compressed at once, so that the dictionary counts all along a text
#: Chunks of the sampled texts that a dictionary is built from, at most, and of one text.
CHUNKS, CHUNKS_OF_TEXT = 3200, 40
DICTIONARY = 64 * 1024
LEVEL = 3


def chunks(text: bytes) -> list[bytes]:
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]


def sizes(texts: list[bytes], dictionaries: list[bytes]) -> np.ndarray:
    """Compressed bytes of each text with each dictionary, and without one."""
    made = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in dictionaries if d]
    made = made if len(made) == 2 else [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)] * 2
    return np.array([[sum(len(c.compress(x)) for x in chunks(t)) for c in made] for t in texts], np.float64).reshape(-1, 2)


def difference(texts: list[bytes], dictionaries: list[bytes]) -> np.ndarray:
    """Size with the bad dictionary less that with the good one, over the smaller of both; 0 for empty texts.

    Squashed to (-1, 1), so that texts which one dictionary holds whole don't decide the calibration.
    """
    s = sizes(texts, dictionaries)
    return np.tanh(10 * (s[:, 1] - s[:, 0]) / np.maximum(1, s.min(1)))


class Model:
    """The score is a sigmoid of weight * difference + bias."""

    def __init__(self, dictionaries: list[bytes], weight: float, bias: float):
        self.dictionaries, self.weight, self.bias = dictionaries, weight, bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.dictionaries:
            return np.full(len(texts), sigmoid(np.array(self.bias)))
        return sigmoid(self.weight * difference(texts, self.dictionaries) + self.bias)

    def column(self, text: str) -> Column:
        return scores(self.score, text)


def dictionary(parts: list[bytes]) -> bytes:
    """Trained on chunks; raw content where they are too few for that."""
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


def _samples(train: DataFrame) -> DataFrame:
    """y, part: at most CHUNKS chunks of each label's texts.

    Each text has its chunks in the order of a hash, CHUNKS_OF_TEXT at most; all first
    ones come before all second ones, and so on, and among these the hash of id and
    text decides, so no place in a text and no range of ids is preferred.
    """
    at = F.expr(f"sequence(0, cast(ceil(length(text) / {CHUNK}) as int) - 1)")
    mixed = F.slice(F.array_sort(F.transform(at, lambda i: F.struct(F.xxhash64("doc_id", i).alias("h"), i.alias("i")))), 1, CHUNKS_OF_TEXT)
    rows = train.select("y", F.xxhash64("doc_id", "text").alias("own"), "text", F.posexplode(mixed).alias("turn", "c"))
    rows = rows.select("y", "turn", "own", F.col("c.i").alias("at"), F.substring("text", F.col("c.i") * CHUNK + 1, F.lit(CHUNK)).alias("part"))
    kept = [rows.where(F.col("y") == v).orderBy("turn", "own", "at", "part").limit(CHUNKS) for v in (0, 1)]
    return kept[0].unionByName(kept[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learns from at most 2 * SAMPLE labelled rows of each label.

    One half of them builds the dictionaries, from at most CHUNKS chunks a label,
    the other calibrates the score by logistic regression. Labels other than 0
    and 1 are left out. Without rows of both labels, all scores are that of the
    label there is; without any, 0.5.
    """
    train = labelled_sample(docs, labels, label, 2 * SAMPLE).where("length(text) > 0")
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id", "text"), F.lit(2))
    built: list[list[bytes]] = [[], []]
    for r in _samples(train.where(half == 0)).orderBy("y", "turn", "own", "at", "part").collect():  # at most 2 * CHUNKS chunks
        built[r["y"]].append(r["part"].encode())
    if not all(built):
        seen = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
        return Model([], 0.0, 4.0 * ((1 in seen) - (0 in seen)))
    made = [dictionary(built[1]), dictionary(built[0])]
    sent = docs.sparkSession.sparkContext.broadcast(made)

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        return {"y": batch.column("y"), "x": difference(binaries(batch, "text"), sent.value)}

    rows = map_batches(train.where(half == 1).select("y", "text"), run, "y int, x double").collect()  # at most 4 * SAMPLE rows of two numbers
    rows = sorted((r["x"], r["y"]) for r in rows)
    x, target = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    if len(set(target)) < 2:
        return Model(made, 4.0, 0.0)
    centre, width = x.mean(), max(x.std(), 1e-9)
    weights, bias = fit_logistic(((x - centre) / width)[:, None], target)
    return Model(made, float(weights[0] / width), float(bias - weights[0] * centre / width))


def score_texts(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted for every row of docs.

    Null and empty texts have no difference and score as the bias does. Very long texts are
    compressed whole, in chunks. Repeated rows return as often as they occur.
    Other columns of docs are ignored.
    """

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        return {"doc_id": batch.column("doc_id"), "score": model.score([t or b"" for t in binaries(batch, "text")])}

    scored = map_batches(texts_of(docs), run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9(spark: SparkSession, sf_dir: str, modulus: int = 3, held: int = 1) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = split_of("doc_id", modulus) == held
    model = fit(docs.where(~out), labels)
    return score_texts(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")
