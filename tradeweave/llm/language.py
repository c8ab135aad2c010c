"""Language identification: a byte convolutional network, trained and applied in numpy.

Bytes fall into 64 classes, classes have embeddings; filters of widths 1 to 3
with ReLU are max-pooled over fixed-length windows, and a softmax follows. For
scoring, the response of every filter to every class triple is tabulated once
in 8 bits, so a window costs a table read per byte.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import binaries, map_batches, read, split_of, stored, texts_of

#: Labelled rows that the network learns from, at most, of each language; languages that it learns, the most frequent ones.
SAMPLE, LANGUAGES = 500, 200
WINDOWS = 4  # windows of a training text
WINDOW = 130  # bytes; pooled over the triples that start at all but the last two
WIDTHS, FILTERS, EMBED = (1, 2, 3), 16, 8
EPOCHS, BATCH, RATE = 6, 64, 0.01
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def byte_classes() -> np.ndarray:
    """Letters 0-25 in either case, digits 26, blanks 27, other ASCII 28, then 32
    classes of continuation bytes and 3 of lead bytes."""
    c = np.full(256, 28)
    for i in range(26):
        c[65 + i] = c[97 + i] = i
    c[48:58], c[[9, 10, 11, 12, 13, 32]] = 26, 27
    c[0x80:0xC0] = 29 + np.arange(64) % 32
    c[0xC0:0xC3], c[0xC3], c[0xC4:] = 61, 62, 63
    return c


CLASS_OF = byte_classes().astype(np.int32)


def windows(text: bytes) -> np.ndarray:
    """All windows of the text as classes, the last one filled up with blanks."""
    step = WINDOW - 2
    n = max(1, -(-len(text) // step))
    padded = np.full(n * step + 2, 27, np.int32)
    padded[: len(text)] = CLASS_OF[np.frombuffer(text, np.uint8)]
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


class Model:
    def __init__(self, names: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.names = names
        self.embed = rng.normal(0, 0.5, (64, EMBED))
        self.filters = [rng.normal(0, (2 / (EMBED * w)) ** 0.5, (w * EMBED, FILTERS)) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names)))
        self.out_bias = np.zeros(len(names))
        self.table = None

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy of a batch of windows, by parameter."""
        n, positions = len(x), WINDOW - 2
        e = self.embed[x]
        pooled, where, patches = [], [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            patch = np.concatenate([e[:, i : i + positions] for i in range(w)], 2)
            r = patch @ f + b
            at = r.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(r, at[:, None], 1)[:, 0], 0))
            where.append(at)
            patches.append(patch)
        h = np.hstack(pooled)
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(n), y] -= 1
        d /= n
        dh = (d @ self.out.T) * (h > 0)
        g_embed, g_filters, g_bias = np.zeros_like(self.embed), [], []
        for k, w in enumerate(WIDTHS):
            part, at = dh[:, k * FILTERS : (k + 1) * FILTERS], where[k]
            best = patches[k][np.arange(n)[:, None], at]  # n x FILTERS x w*EMBED
            g_filters.append(np.einsum("nf,nfi->if", part, best))
            g_bias.append(part.sum(0))
            back = part[:, :, None] * self.filters[k].T[None]
            for i in range(w):
                np.add.at(g_embed, x[np.arange(n)[:, None], at + i], back[:, :, i * EMBED : (i + 1) * EMBED])
        return [g_embed, *g_filters, *g_bias, h.T @ d, d.sum(0)]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        """Adam steps over shuffled batches."""
        rng = np.random.default_rng(seed)
        m = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        t = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                t += 1
                pick = order[at : at + BATCH]
                for p, g, (a, b) in zip(self.parameters(), self.gradients(x[pick], y[pick]), m, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def tabulate(self) -> None:
        """Responses of all filters to all class triples, in steps of 1/255 of each filter's largest."""
        parts = []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            r = [self.embed @ f[i * EMBED : (i + 1) * EMBED] for i in range(w)]
            r += [np.zeros((64, FILTERS))] * (3 - w)
            parts.append(np.maximum(r[0][:, None, None] + r[1][None, :, None] + r[2][None, None, :] + b, 0).reshape(-1, FILTERS))
        full = np.hstack(parts)
        self.scale = np.maximum(full.max(0), 1e-9) / 255
        self.table = np.round(full / self.scale).astype(np.uint8)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean over all windows of each text."""
        if self.table is None:
            self.tabulate()
        out = np.empty((len(texts), len(self.names)))
        at = 0
        while at < len(texts):
            to, size, triples, counts = at, 0, [], []
            while to < len(texts) and (to == at or size + len(texts[to]) < 1 << 20):
                w = windows(texts[to])
                triples.append((w[:, :-2] * 64 + w[:, 1:-1]) * 64 + w[:, 2:])
                counts.append(len(w))
                size += len(texts[to])
                to += 1
            t = np.concatenate(triples)
            h = np.empty((len(t), FILTERS * len(WIDTHS)), np.uint8)
            for i in range(0, len(t), 2048):
                self.table[t[i : i + 2048]].max(1, out=h[i : i + 2048])
            z = (h * self.scale) @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            p = z / z.sum(1, keepdims=True)
            starts = np.cumsum([0, *counts[:-1]])
            out[at:to] = np.add.reduceat(p, starts, axis=0) / np.array(counts)[:, None]
            at = to
        return out


def fit(docs: DataFrame, lang: str = "lang") -> Model:
    """Learns from at most SAMPLE rows of each of the LANGUAGES most frequent languages, WINDOWS windows of each row.

    Rows with a null language or a text without words are left out; without any
    rows the model predicts UNKNOWN. Rows are chosen by a hash of their id, and of
    rows with one id by a hash of the text. Ids are chosen before texts are read,
    so that texts aren't shuffled.
    """
    known = texts_of(docs, F.col(lang).cast("string").alias("lang")).where(F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    most = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    order = F.xxhash64(F.lit("language"), "doc_id")
    first = Window.partitionBy("lang").orderBy(order, "doc_id")
    # of a language with many ids about 4 * SAMPLE, those first in order, are ranked
    share = (order.cast("double") / 2.0**64 + 0.5) * F.col("ids") < 4 * SAMPLE
    ids = known.select("doc_id", "lang").join(F.broadcast(most.select("lang", "ids")), "lang").where(share).select("doc_id", "lang").distinct()
    ids = stored(ids.withColumn("at", F.row_number().over(first)).where(F.col("at") <= SAMPLE).select("doc_id", "lang"))  # SAMPLE * LANGUAGES rows at most
    spaced = F.expr(
        f"transform(sequence(0, {WINDOWS - 1}), i -> substring(text, cast(floor(i * greatest(0, length(text) - {WINDOW}) / {WINDOWS}) + 1 as int), {WINDOW}))"
    )
    rows = known.join(F.broadcast(ids), [known["doc_id"].eqNullSafe(ids["doc_id"]), known["lang"] == ids["lang"]])
    rows = rows.select(known["doc_id"], known["lang"], F.xxhash64("text").alias("mark"), spaced.alias("parts"))
    again = Window.partitionBy("lang").orderBy(order, "doc_id", "mark")
    rows = rows.withColumn("at", F.row_number().over(again)).where(F.col("at") <= SAMPLE).select("lang", "at", "parts").collect()  # as many as ids, again
    rows.sort(key=lambda r: (r["lang"], r["at"]))
    model = Model(sorted({r["lang"] for r in rows}) or [UNKNOWN])
    if rows:
        number = {n: i for i, n in enumerate(model.names)}
        x = [(windows(p.encode())[0], number[r["lang"]]) for r in rows for p in r["parts"] if p.strip()]
        model.fit(np.stack([a for a, _ in x]), np.array([b for _, b in x]))
    return model


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or bool(_LETTER.search(text.decode()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the probability of that language, a mean over all windows).

    Texts that are null or have no letter: UNKNOWN and score 0. Ties go to the
    language first by name. Very long texts are read whole. Repeated rows return
    as often as they occur. Other columns of docs are ignored.
    """
    def run(batch: pa.RecordBatch) -> dict[str, object]:
        texts = [t or b"" for t in binaries(batch, "text")]
        p = model.probabilities(texts)
        lettered = np.array([has_letter(t) for t in texts], bool)
        best = p.argmax(1)
        names = [model.names[i] if ok else UNKNOWN for i, ok in zip(best, lettered, strict=True)]
        score = np.where(lettered, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
        return {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": score}

    return map_batches(texts_of(docs), run, "doc_id long, lang_pred string, score double")


def op8(spark: SparkSession, sf_dir: str, modulus: int = 4, held: int = 2) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = split_of("doc_id", modulus) == held
    return predict(docs, fit(docs.where(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score")
