"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are compared vertically: bit plane p of 64 neighbours is one
machine word, differing bits of 64 pairs are added at once into carry-save
counters, and words whose 64 pairs all exceed the radius are abandoned.

``near_duplicates`` links fingerprints of 64 bits within a small radius, found
by pigeonhole keys. ``similar`` links texts by the Jaccard similarity of their
shingles: texts that share a necessary shingle are compared by fingerprints of
256 bits, and what is left is verified in full. The first misses no link; the
second passes over one only where its fingerprints differ in more than OPEN bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.traversal import label_components
from .common import binaries, dropped, map_batches, read, space_words, stored, texts_of

#: Members of a group that one task compares with each other, at most, and bytes of them.
CHUNK, CHUNK_BYTES = 2048, 16 << 20
#: Members of a larger group that every chunk of it sees.
PIVOTS = 32
#: Widest radius of the pigeonhole keys of 64 bits.
RADIUS = 8
#: Lanes of 64 bits, and differing bits of all lanes beyond which texts aren't verified. At a similarity of 0.8 the
#: differing bits have a mean of 39 and a deviation of 5.7 (48 and 6.2 at worst: four shingles of five), and
#: of unrelated texts 128 and 8: a link is passed over with a probability of 2e-7 at worst.
LANES, OPEN = 4, 80
#: Texts sampled for the order of shingles; the most frequent ORDERED of those in COMMON texts come last. Any order is complete.
SAMPLE, COMMON, ORDERED = 32768, 4, 1 << 20
#: Ids of texts, at most, that are broadcast to read these texts again; more are joined by shuffling.
BROADCAST = 1 << 20
PIECE = 1 << 18  # bytes of text whose words are held at once


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about PIECE bytes, cut at line feeds and blanks only."""
    at = 0
    while len(text) - at > PIECE:
        end = max(text.rfind(b" ", at + 1, at + PIECE), text.rfind(b"\n", at + 1, at + PIECE))
        if end < 0:
            ends = [x for x in (text.find(b" ", at + PIECE), text.find(b"\n", at + PIECE)) if x >= 0]
            end = min(ends, default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle, repeats included; of the whole sequence if it is shorter."""
    out, held = [], []
    for part in pieces(text):
        words = held + space_words(part)
        n = len(words)
        if n >= k:
            s = b" ".join(words)
            ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
            starts = [0, *(e + 1 for e in ends[: n - k])]
            out.append(np.fromiter(map(xxhash.xxh64_intdigest, (s[a:b] for a, b in zip(starts, ends[k - 1 :], strict=True)), repeat(42)), np.uint64, n - k + 1))
        held = words[max(0, n - k + 1) :] if n >= k else words
    if out:
        return np.concatenate(out)
    return np.array([xxhash.xxh64_intdigest(b" ".join(held), 42)] if held else [], np.uint64)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """A bit is 1 if set in over half the hashes; 8 * lanes bytes, big-endian words.

    Lane 0 takes the hashes as they are, further lanes remix them.
    """
    out = []
    for lane in range(lanes):
        h = hashes
        if lane:
            h = (h ^ np.uint64(lane * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(29)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 14):  # bounded memory for very long texts
            part = np.ascontiguousarray(h[at : at + (1 << 14)])
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int32)
        out.append(np.packbits(2 * ones > len(h), bitorder="little").tobytes()[::-1])
    return b"".join(out)


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, fp binary of 8 bytes) for every row of docs."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        fps = [fingerprint(shingle_hashes(t or b"", k)) for t in binaries(batch, "text")]
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(fps, pa.binary())}

    return map_batches(texts_of(docs), run, "doc_id long, fp binary")


# Keys ------------------------------------------------------------------------


def key_positions(n: int, radius: int) -> list[np.ndarray]:
    """The bit positions of each pigeonhole key.

    Cut into radius + t blocks, any pair within the radius agrees on t whole
    blocks; keys are all choices of t. t grows with the number of fingerprints,
    so that groups by chance stay small; no pair is ever missed.
    """
    t = 1
    while t < 4 and n / 2 ** (64 * t / (radius + t)) > 64:
        t += 1
    blocks = np.array_split(np.arange(64), radius + t)
    return [np.concatenate(c) for c in combinations(blocks, t)]


def bits_of(fps: np.ndarray, width: int) -> np.ndarray:
    """n x (8 * width) zeros and ones from n x width bytes."""
    return np.unpackbits(fps.reshape(-1, width), axis=1)


def keyed(distinct: DataFrame, positions: list[np.ndarray]) -> DataFrame:
    """A row (band, key, id, payload) for each key of each fingerprint; id is the fingerprint as a long."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        raw = batch.column("fp").to_pylist()
        packed = np.frombuffer(b"".join(raw), np.uint8)
        bits = bits_of(packed, 8).astype(np.int64)
        keys = [bits[:, p] @ (np.int64(1) << np.arange(len(p), dtype=np.int64)) for p in positions]
        return {
            "band": pa.array(np.repeat(np.arange(len(positions), dtype=np.int32), len(raw))),
            "key": pa.array(np.concatenate(keys)),
            "id": pa.array(np.tile(packed.view(">i8").astype(np.int64), len(positions))),
            "payload": pa.array(raw * len(positions), pa.binary()),
        }

    return map_batches(distinct, run, "band int, key long, id long, payload binary")


# Comparison ------------------------------------------------------------------


def near_roots(bits: np.ndarray, starts: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the smallest index linked to it within its group.

    bits: n x planes zeros and ones, group after group; starts: first index of
    each group. Links of different groups don't meet here. All of a group first
    meet its first one; groups that are then one class need no more.
    """
    n, planes = bits.shape
    words = -(-n // 64)
    padded = np.zeros((words * 64, planes), np.uint8)
    padded[:n] = bits
    # plane p of word w: bit j is bit p of fingerprint 64 w + j
    sliced = np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little")
    sliced = np.ascontiguousarray(sliced).view(np.uint64).reshape(planes, words)
    own = (np.uint64(0) - bits.T.astype(np.uint64)).astype(np.uint64)  # all ones where the query has 1
    sizes = np.diff(np.append(starts, n))
    ends = np.repeat(np.append(starts[1:], n), sizes)
    root = np.arange(n)

    def compare(queries: np.ndarray) -> None:
        first = queries // 64
        spans = (ends[queries] - 1) // 64 - first + 1
        todo = np.cumsum(spans)
        at = 0
        while at < len(queries):
            to = max(at + 1, int(np.searchsorted(todo, (todo[at - 1] if at else 0) + 200_000)))
            q = np.repeat(queries[at:to], spans[at:to])
            w = np.arange(len(q)) - np.repeat(np.cumsum(spans[at:to]) - spans[at:to], spans[at:to]) + np.repeat(first[at:to], spans[at:to])
            _unite(root, *_within(sliced, own, q, w, ends, radius))
            at = to

    compare(starts)
    open_ = np.bitwise_or.reduceat(root != np.repeat(starts, sizes), starts)
    rest = np.repeat(open_, sizes)
    rest[starts] = False
    compare(np.flatnonzero(rest))
    return root


def _within(sliced, own, q, w, ends, radius) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of one group that differ in at most radius bits."""
    lo, hi = np.clip(q + 1 - 64 * w, 0, 64), np.clip(ends[q] - 64 * w, 0, 64)
    full = np.uint64(2**64 - 1)
    below = lambda x: np.where(x >= 64, full, (np.uint64(1) << np.minimum(x, 63).astype(np.uint64)) - np.uint64(1))
    live = below(hi) & ~below(lo)  # pairs that count and haven't exceeded the radius
    size = int(radius + 1).bit_length()
    # counters start so that radius + 1 differing bits overflow the top counter
    start = (1 << size) - (radius + 1)
    counters = [np.full(len(q), full if start >> b & 1 else np.uint64(0)) for b in range(size)]
    for p in range(len(sliced)):
        carry = sliced[p][w] ^ own[p][q]
        for b in range(size):
            counters[b], carry = counters[b] ^ carry, counters[b] & carry
        live &= ~carry
        if p % 8 == 7:
            keep = np.flatnonzero(live)
            if len(keep) < 0.8 * len(live):  # abandon words whose pairs all exceed it
                live, q, w = live[keep], q[keep], w[keep]
                counters = [c[keep] for c in counters]
            if not len(keep):
                break
    keep = np.flatnonzero(live)
    hits = np.unpackbits(live[keep].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    r, b = np.nonzero(hits)
    return q[keep][r], 64 * w[keep][r] + b


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of the pairs in root, which is kept compressed with smallest roots."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


Compare = Callable[[list[bytes], np.ndarray], np.ndarray]


def by_bits(width: int, radius: int) -> Compare:
    """Of fingerprints of so many bytes: those within the radius are linked."""
    return lambda payloads, starts: near_roots(bits_of(np.frombuffer(b"".join(payloads), np.uint8), width), starts, radius)


def by_shingles(least: Fraction) -> Compare:
    """Of sorted sets of 64-bit hashes: those of at least this Jaccard similarity are linked."""

    def compare(payloads: list[bytes], starts: np.ndarray) -> np.ndarray:
        root = np.arange(len(payloads))
        for a, b in zip(starts, np.append(starts[1:], len(payloads)), strict=True):
            root[a:b] = a + _similar_roots([np.frombuffer(p, np.uint64) for p in payloads[a:b]], least)
        return root

    return compare


def _similar_roots(bags: list[np.ndarray], least: Fraction) -> np.ndarray:
    """Each set's smallest index linked to it: intersections are counted from postings of the shingles that recur."""
    n = np.array([len(b) for b in bags], np.int64)
    root = np.arange(len(bags))
    owner = np.repeat(root, n)
    values, inverse, df = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
    posted = owner[np.argsort(inverse, kind="stable")]
    begin = np.cumsum(df) - df
    bounds = np.append(0, np.cumsum(n))
    for i in range(len(bags) - 1):
        s = inverse[bounds[i] : bounds[i + 1]]
        s = s[df[s] > 1]
        many = df[s]
        at = np.arange(many.sum()) + np.repeat(begin[s] - np.cumsum(many) + many, many)
        both = np.bincount(posted[at], minlength=len(bags))
        # |x and y| / |x or y| >= p / q, without a division; sets without members are alike
        j = np.flatnonzero(both * (least.numerator + least.denominator) >= least.numerator * (n[i] + n))
        _unite(root, np.full(len(j), i), j)
        if not root.any():
            break
    return root


def closure(rows: DataFrame, compare: Compare, sizes: DataFrame | None = None) -> DataFrame:
    """Star edges (a, b) of ids that connect all that ``compare`` links within a group.

    rows: group (any columns but id and payload), id long, payload binary, each
    (group, id) once; sizes: _many and _bytes of each group, if they are known
    without the payloads. Pairs are never emitted; what two linked members have in
    common is an edge of a star.

    Groups above CHUNK members or CHUNK_BYTES are dealt out in chunks, and some
    members of the group are in every chunk. Then only members outside the
    group's largest class so far meet all chunks: a group of copies costs as much
    as its size, and no pair of different classes is left out.
    """
    by = [c for c in rows.columns if c not in ("id", "payload")]
    if sizes is None:
        sizes = rows.groupBy(*by).agg(F.count("*").alias("_many"), F.sum(F.length("payload")).alias("_bytes"))
    size = sizes.where("_many > 1")
    parts = F.ceil(F.greatest(F.col("_many") / CHUNK, F.col("_bytes") / CHUNK_BYTES)).cast("int")
    size = stored(size.select(*by, parts.alias("_parts")))
    rows = rows.join(size, by)
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("long")).cast("int")
    first = rows.select(*by, F.lit(-1).alias("_x"), part("_parts").alias("_y"), "id", "payload")
    big = size.where("_parts > 1")
    if big.isEmpty():
        return stored(_stars(first, compare))
    order = Window.partitionBy(*by).orderBy(F.xxhash64("id", F.lit(1)), "id")
    shown = rows.where("_parts > 1").withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= PIVOTS)
    shown = shown.select(*by, F.lit(-1).alias("_x"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_y"), "id", "payload")
    edges = stored(_stars(first.unionByName(shown), compare))
    label = label_components(edges, "a", "b").withColumnRenamed("node", "id")
    mine = stored(rows.where("_parts > 1").select(*by, "_parts", "id").join(label, "id", "left").withColumn("_class", F.coalesce("component", "id")).drop("component"))
    tally = mine.groupBy(*by, "_parts", "_class").agg(F.count("*").alias("_n"))
    most = tally.groupBy(*by, "_parts").agg(F.max_by("_class", F.struct("_n", "_class")).alias("_most"), F.sum("_n").alias("_all"), F.max("_n").alias("_in"))
    slices = F.ceil(2 * (F.col("_all") - F.col("_in")) / F.col("_all") * F.col("_parts")).cast("int")
    most = stored(most.where("_all > _in").select(*by, "_most", slices.alias("_slices")))
    open_ = rows.select(*by, "id", "payload").join(mine.join(most, by), [*by, "id"])
    outside = open_.where("_class <> _most").select(*by, part("_slices").alias("_x"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_y"), "id", "payload")
    everyone = open_.select(*by, F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_x"), part("_parts").alias("_y"), "id", "payload")
    return edges.unionByName(stored(_stars(outside.unionByName(everyone), compare)))


def _stars(rows: DataFrame, compare: Compare) -> DataFrame:
    """(a, b) for each member of a task's group and the first member linked to it."""
    by = [c for c in rows.columns if c not in ("id", "payload")]
    rows = rows.repartition(*by).sortWithinPartitions(*by, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = []
        size = 0

        def flush(last: bool) -> pa.RecordBatch | None:
            """Compares all groups held but, unless it is the last call, the one that may go on."""
            nonlocal held, size
            keys, ids = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            payloads = [p for h in held for p in h[2]]
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            cut = len(ids) if last else int(new[-1]) if len(new) else 0
            held = [(keys[cut:], ids[cut:], payloads[cut:])] if cut < len(ids) else []
            size = sum(map(len, payloads[cut:]))
            if not cut:
                return None
            root = compare(payloads[:cut], np.concatenate([[0], new[new < cut]]))
            a, b = ids[:cut], ids[:cut][root]
            moved = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[moved]), pa.array(b[moved])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in by], 1)
            payloads = batch.column("payload").to_pylist()
            held.append((keys, batch.column("id").to_numpy().astype(np.int64), payloads))
            size += sum(map(len, payloads))
            if sum(len(h[1]) for h in held) >= 16 * CHUNK or size > CHUNK_BYTES:
                if (out := flush(False)) is not None:
                    yield out
        if held:
            yield flush(True)

    return rows.mapInArrow(run, "a long, b long")


# Operators -------------------------------------------------------------------


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """Fingerprint of 64 bits and near-duplicate class of every row of docs.

    Returns doc_id, fingerprint (hex), component_id: the smallest doc_id
    reachable over links, its own included. Two fingerprints link if they differ
    in at most ``radius`` bits, 8 at most; all links are found. Exact copies share
    a fingerprint and meet once.

    Null and wordless texts have fingerprint zero, which links like any other.
    A null doc_id is never a component_id unless no other is reachable. Repeated
    rows return as often as they occur. No rows: no rows. Columns of docs other
    than doc_id and text are ignored.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the radius must be between 0 and {RADIUS}")
    marks = stored(fingerprints(docs, shingle))
    distinct = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumn("id", F.conv(F.hex("fp"), 16, -10).cast("long")))
    keys = stored(keyed(distinct.select("fp"), key_positions(distinct.count(), radius)))
    roots = label_components(closure(keys, by_bits(8, radius)), "a", "b").withColumnRenamed("node", "id")
    member = distinct.join(roots, "id", "left").select("fp", "low", F.coalesce("component", "id").alias("root"))
    low = member.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = member.join(low, "root").select("fp", "component_id")
    return marks.join(classes, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def _bag(text: bytes | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or b"", shingle))


def _ids(bags: list[np.ndarray]) -> np.ndarray:
    """The XXH64 of each set's sorted hashes, as longs."""
    return np.array([xxhash.xxh64_intdigest(b.tobytes()) for b in bags], np.uint64).view(np.int64)


def common_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of the shingles in COMMON or more of about SAMPLE distinct texts, chosen by hash; the most frequent ORDERED of them."""
    n = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod("mark", F.lit(n)) == 0).groupBy("mark").agg(F.first("text").alias("text"))

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        return {"h": np.concatenate([np.zeros(0, np.uint64), *[_bag(t, shingle) for t in binaries(batch, "text")]]).view(np.int64)}

    often = map_batches(some.select("text"), run, "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    return np.sort(np.array([r[0] for r in often.orderBy(F.desc("count"), "h").limit(ORDERED).select("h").collect()], np.int64).view(np.uint64))


def prefix(bag: np.ndarray, common: np.ndarray, least: Fraction) -> np.ndarray:
    """The first shingles of a set, rare ones before common ones, then by hash.

    Of two sets of similarity s, n and m in number, the first n - ceil(s n) + 1
    shingles of one and m - ceil(s m) + 1 of the other have one in common, in
    whatever order.
    """
    size = len(bag) - -(-len(bag) * least.numerator // least.denominator) + 1
    if len(common) and len(bag):
        late = common[np.minimum(np.searchsorted(common, bag), len(common) - 1)] == bag
        bag = np.concatenate([bag[~late], bag[late]])
    return bag[:size]


def marked(texts: DataFrame, shingle: int, common: np.ndarray, least: Fraction) -> DataFrame:
    """doc_id, mark, id (of the set of shingles), fp (LANES * 8 bytes) and keys (the prefix) of every row."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        bags = [_bag(t, shingle) for t in binaries(batch, "text")]
        keys = [prefix(b, common, least) for b in bags]
        ends = np.cumsum([0, *map(len, keys)])
        return {
            "doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "id": _ids(bags),
            "fp": pa.array([fingerprint(b, LANES) for b in bags], pa.binary()),
            "keys": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64))),
        }

    return map_batches(texts, run, "doc_id long, mark long, id long, fp binary, keys array<long>")


def similar(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, class_id) for every row of docs: the class of near-duplicates it is in.

    Texts link if the Jaccard similarity of their sets of five-word shingles is at
    least ``least``; classes are closed over links. Shingles count by their 64-bit
    hashes. Texts of fewer words are one shingle; wordless and null texts are
    alike. class_id has no meaning of its own. Rows repeat as they do in docs, and
    a null doc_id is returned like any other. Other columns are ignored.

    Equal sets meet once. Sets that share a shingle of their prefixes are compared
    by fingerprints, bit-sliced; those within OPEN bits form loose classes. Only
    texts of loose classes are read again, and within one all links are verified
    in full.
    """
    limit = Fraction(least).limit_denominator(1000)
    texts = texts_of(docs).withColumn("mark", F.xxhash64("text"))
    marks = stored(marked(texts, shingle, common_shingles(texts, shingle), limit))
    keys = marks.select("id", F.explode("keys").alias("key"))
    # a key that two sets share has two ids
    shared = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    keys = stored(keys.join(shared, "key").distinct())
    sizes = keys.groupBy("key").agg(F.count("*").alias("_many"), (F.count("*") * 8 * LANES).alias("_bytes"))
    fps = marks.groupBy("id").agg(F.first("fp").alias("payload"))
    loose = closure(keys.join(fps, "id").select("key", "id", "payload"), by_bits(8 * LANES, OPEN), sizes)
    loose = stored(label_components(loose, "a", "b").toDF("id", "loose"))
    dropped(keys)
    # one text stands for all of its set
    needed = stored(marks.select("id", "mark").join(loose, "id").groupBy("id", "loose").agg(F.min("mark").alias("mark")))
    held = F.broadcast if needed.count() <= BROADCAST else lambda x: x
    read_again = texts.join(held(needed), "mark").select("id", "loose", "text")

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        return {"loose": batch.column("loose"), "id": batch.column("id"), "payload": pa.array([_bag(t, shingle).tobytes() for t in binaries(batch, "text")], pa.binary())}

    sets = map_batches(read_again, run, "loose long, id long, payload binary").groupBy("loose", "id").agg(F.first("payload").alias("payload"))
    links = closure(stored(sets), by_shingles(limit))
    roots = label_components(links, "a", "b").toDF("id", "root")
    return marks.select("doc_id", "id").join(roots, "id", "left").select("doc_id", F.coalesce("root", "id").alias("class_id"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, 64 bits, radius 4."""
    return near_duplicates(read(spark, sf_dir, "documents"))
