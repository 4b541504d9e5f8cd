"""Removal of sentences in repeated runs of consecutive sentences, all but the first occurrence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spellpanel.llm.arrays import mixed
from spellpanel.llm.common import lookup
from spellpanel.session import stage

#: Marks that end a sentence, with quote marks and brackets after them: before white space, or anywhere
#: for the full-width and Indic ones, which no blank follows.
_END = re.compile(r"[.!?\u2026\u061f\u06d4\u1362]+[\"'\u2019\u201d\u00bb)\]]*(?=\s)\s*"
                  r"|[\u3002\uff0e\uff01\uff1f\uff61\u0964\u0965]+[\"'\u2019\u201d\u00bb\u300d\u300f\uff09)\]]*\s*|\n\s*")
_WORD = re.compile(r"\S+")
#: A sentence of more words is cut after each word whose hash ends in CUT_BITS zero bits.
LONG, CUT_BITS = 16, 2
#: Words from which one unit is a run by itself.
SINGLE = 50
_LAST_ID = 9223372036854775807
#: What tells a document: its id and a hash of its text and, for rows without an id, of a number too.
OWN = ("own", "key")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_digest = xxhash.xxh3_64_intdigest


def _units(text: str, start: int, end: int) -> Iterator[int]:
    """Ends of the units of one sentence: where its own words say so, so that equal passages are cut alike."""
    cut = False
    for m in _WORD.finditer(text, start, end):
        if cut:
            yield m.start()
        cut = _digest(m.group()) & ((1 << CUT_BITS) - 1) == 0
    yield end


def segments(text: str) -> list[tuple[int, int, str, int, bool]]:
    """Start, end, blank-normalised words and word count of each unit, and whether it ends a sentence; parts without a word are none.

    A unit is a sentence, or a part of one of more than ``LONG`` words (see ``_units``), so that texts
    without sentence marks, and passages that start or end inside a sentence, have units as well.
    """
    found, at = [], 0
    for end in (*(m.end() for m in _END.finditer(text)), len(text)):
        words = text[at:end].split()
        if not words:
            continue
        if len(words) <= LONG:
            found.append((at, end, " ".join(words), len(words), True))
        else:
            start = at
            for cut in _units(text, at, end):
                own = text[start:cut].split()
                found.append((start, cut, " ".join(own), len(own), cut == end))
                start = cut
        at = end
    return found


def sentence_runs(parts: list[list[tuple]], sentences: int, words: int) -> tuple[np.ndarray, ...]:
    """Runs that start at the units of many texts (see ``segments``): text, hash, first unit and length of each.

    A run is the shortest one with the ends of ``sentences`` sentences, or with two units and ``words``
    words, or one unit of ``SINGLE`` words.  It depends on nothing before its start, so equal passages give equal runs wherever they stand.
    """
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    units = list(chain.from_iterable(parts))
    own = np.fromiter((_digest(u[2]) for u in units), np.uint64, len(units))
    total = np.cumsum([0, *(u[3] for u in units)])
    ends = np.cumsum([0, *(u[4] for u in units)])
    text = np.repeat(np.arange(len(parts)), sizes)
    at = np.arange(len(units))
    last = np.minimum(np.searchsorted(ends, ends[:-1] + sentences), np.searchsorted(total, total[:-1] + SINGLE)) - 1
    last = np.minimum(last, np.maximum(np.searchsorted(total, total[:-1] + words) - 1, at + 1))
    start = np.cumsum(sizes) - sizes
    whole = np.flatnonzero(last < (start + sizes)[text])
    n = (last - at + 1)[whole]
    hashed = np.zeros(len(whole), dtype=np.uint64)
    for k in range(int(n.max(initial=0))):  # a run has at most ``words`` units, each with a word
        more = np.flatnonzero(n > k)
        hashed[more] = mixed(hashed[more] * _STEP + own[whole[more] + k])
    return text[whole], hashed.view(np.int64), whole - start[text[whole]], n


def sentence_dedup(docs: DataFrame, sentences: int = 3, words: int = 20) -> DataFrame:
    """Every document without the sentences that a repeated run covers, unless the run is its first.

    Runs of consecutive sentences (see ``sentence_runs``) are hashed over whole texts and counted
    in one global aggregate of hashes alone; only places of repeated hashes travel further, and their first
    occurrence by id and position stays, while all other
    occurrences lose the sentences they cover.  The most frequent runs are joined back without
    a shuffle, so a passage that a third of all documents hold makes no hot task.  Long sentences are
    cut into units that count as sentences here, so texts without sentence marks and passages that start
    or end inside a sentence are compared too, up to the units at the passage's two ends.

    Returns doc_id, n_sentences, n_removed, n_runs (repeated later runs) and text, the rest.  Null
    text stays null, with no sentences; blank text stays as it is.  Rows with the same id and text are
    one document at one place: they are not removed against each other, and each loses what
    the other does.  Rows with the same id and other texts are documents each, and so is every row
    without an id; these come last, in the order of a hash.  An empty table gives no rows.
    Other columns are ignored.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            parts = [segments(t or "") for t in texts]
            text, hashed, at, n = sentence_runs(parts, sentences, words)
            offsets = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
            yield pa.record_batch({
                **{c: batch.column(c) for c in OWN}, "total": pa.array([len(p) for p in parts], pa.int64()),
                "h": pa.ListArray.from_arrays(offsets, pa.array(hashed)),
                "at": pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())),
                "n": pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32())),
            })

    every = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # rows without an id are numbered, and written so that a number is given once
    unnamed = stage(every.filter("doc_id is null").withColumn("copy", F.monotonically_increasing_id()), "sentence-unnamed")
    rows = every.filter("doc_id is not null").select("*", F.xxhash64("text").alias("key")).unionByName(
        unnamed.select("doc_id", "text", F.xxhash64("text", "copy").alias("key"))).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(_LAST_ID)).alias("own"), "key")
    scanned = stage(rows.select(*OWN, "text").mapInArrow(
        scan, "own long, key long, total long, h array<long>, at array<int>, n array<int>"), "sentence-runs")
    repeated = stage(scanned.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("times"))
                     .filter("times > 1"), "sentence-repeated")
    runs = scanned.select(*OWN, F.explode(F.arrays_zip("h", "at", "n")).alias("r")).select(
        *OWN, "r.h", F.shiftleft(F.col("r.at").cast("long"), 20).bitwiseOR(F.col("r.n")).alias("place"))
    places = stage(lookup(runs, repeated, "h", "times"), "sentence-places")
    first = places.groupBy("h").agg(F.count("*").alias("w"), F.min(F.struct(*OWN, "place")).alias("first"))
    later = lookup(places.drop("times"), first, "h", "w").filter(F.struct(*OWN, "place") != F.col("first"))
    covered = later.groupBy(*OWN).agg(F.collect_set("place").alias("places"))  # bounded by the text
    counts = scanned.select(*OWN, "total").dropDuplicates(list(OWN))
    gone = counts.join(covered, list(OWN), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, counts, texts = [], [], []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                out = {i for p in hits or () for i in range(p >> 20, (p >> 20) + (p & 0xFFFFF))}
                removed.append(len(out))
                counts.append(len(hits or ()))
                if out:
                    keep, at = [], 0
                    for i, (a, b, *_) in enumerate(segments(text)):
                        keep.append(text[at:a] if i in out else text[at:b])
                        at = b
                    text = "".join(keep) + text[at:]
                texts.append(text)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_sentences": batch.column("total"),
                "n_removed": pa.array(removed, pa.int64()), "n_runs": pa.array(counts, pa.int64()),
                "text": pa.array(texts, pa.string())})

    return rows.join(gone, list(OWN)).select("doc_id", "text", "total", "places").mapInArrow(
        cut, "doc_id long, n_sentences long, n_removed long, n_runs long, text string")
