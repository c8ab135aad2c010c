"""License scans: exact phrases, and fuzzy search for short notices.

A notice may occur with a bounded number of character edits. By pigeonhole a
notice cut into one more piece than that has one piece untouched, so exact
finds of the pieces locate all candidates; bounded-error matching of the regex
library then verifies the stretch around each and reports span and edits.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import alnum_words, binaries, map_batches, read, texts_of

#: Phrase and label of the exact base scan.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
#: Notice (words in lower case), label, allowed character edits.
NOTICES = (
    ("released under the mit license", "mit-notice", 3),
    ("licensed under the apache license version 2 0", "apache-notice", 4),
    ("gnu general public license", "gpl-notice", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit-grant", 6),
    ("redistribution and use in source and binary forms with or without modification", "bsd-grant", 6),
    ("this program is free software you can redistribute it and or modify", "gpl-grant", 6),
    ("mozilla public license", "mpl-notice", 2),
    ("creative commons attribution", "cc-notice", 2),
    ("all rights reserved", "reserved", 1),
)

HIT = "struct<label:string,start:int,end:int,edits:int>"


def pieces(notice: str, edits: int) -> list[bytes]:
    """edits + 1 pieces of about one length that together are the notice."""
    n, k = len(notice), edits + 1
    return [notice[n * i // k : n * (i + 1) // k].encode() for i in range(k)]


class Notices:
    """Compiled notices. Texts are words joined by single spaces."""

    def __init__(self, notices=NOTICES):
        self.items = [
            (label, edits, n.encode(), pieces(n, edits), [len(x) for x in pieces(n, edits)],
             regex.compile(b"(?e)(?:%b){e<=%d}" % (regex.escape(n.encode(), literal_spaces=True), edits)))
            for n, label, edits in notices
        ]

    def search(self, text: bytes) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of all notices found, by place; spans of a
        label don't overlap."""
        found = []
        for label, edits, notice, parts, lengths, pattern in self.items:
            near = []
            offset = 0
            for part, length in zip(parts, lengths, strict=True):
                at = text.find(part)
                while at >= 0:
                    near.append((max(0, at - offset - edits), at - offset + len(notice) + edits))
                    at = text.find(part, at + 1)
                offset += length
            end = 0
            for lo, hi in _merged(near):
                for m in pattern.finditer(text, max(lo, end), min(hi, len(text))):
                    found.append((label, m.start(), m.end(), sum(m.fuzzy_counts)))
                    end = m.end()
        return sorted(found, key=lambda x: (x[1], x[0]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def exact_places(text: bytes, phrases) -> list[tuple[int, str]]:
    """(word number, label) of each place where a phrase's words stand in a row.

    text: words joined by single spaces, one space before and after.
    """
    found = []
    for phrase, label in phrases:
        p = b" " + phrase.encode() + b" "
        at, word, seen = text.find(p), 0, 0
        while at >= 0:
            word += text.count(b" ", seen, at)
            seen = at
            found.append((word, label))
            at = text.find(p, at + 1)
    return found


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Licenses named in each row of docs.

    Returns doc_id, n_words, n_base (places of all exact phrases), first_word
    and last_word (smallest and largest word number where one starts, else
    null), base_labels, labels (those and the notices'; distinct, sorted,
    comma-joined), score (0 without any; 1 with an exact phrase; else the
    closest notice's share of unedited characters) and hits (label, span in the
    normalised text, edits).

    Null and empty texts have no words and score 0. Very long texts are scanned
    whole. Repeated rows return as often as they occur; ties of place are by
    label. Other columns of docs are ignored.
    """
    phrases, notices = tuple(phrases), tuple(notices)
    lengths = {label: len(n) for n, label, _ in notices}
    compiled = Notices(notices)

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        rows = []
        for t in binaries(batch, "text"):
            words = alnum_words(t or b"")
            s = b" " + b" ".join(words) + b" "
            base = exact_places(s, phrases)
            hits = [(label, a - 1, b - 1, e) for label, a, b, e in compiled.search(s)]
            exact = {label for _, label in base}
            at = [x for x, _ in base]
            close = max((1 - e / lengths[label] for label, _, _, e in hits), default=0.0)
            rows.append(
                (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(exact)),
                 ",".join(sorted(exact | {h[0] for h in hits})), 1.0 if base else max(0.0, close),
                 [dict(zip(("label", "start", "end", "edits"), h, strict=True)) for h in hits])
            )
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "hits")
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))]
        out = {n: pa.array([r[i] for r in rows], kinds[i]) for i, n in enumerate(names)}
        return out | {"doc_id": batch.column("doc_id")}

    return map_batches(
        texts_of(docs),
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        f"labels string, score double, hits array<{HIT}>",
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
