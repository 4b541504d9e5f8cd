"""Removal of every byte covered by a long string that also starts elsewhere, by sharded suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellpanel.llm.arrays import mixed, span_hashes
from spellpanel.llm.common import lookup
from spellpanel.llm.suffixes import permuted_common_prefixes, suffix_array
from spellpanel.session import stage

#: Bytes of the strings whose hashes deal the windows out.
GRAM = 48
#: Starts of one run at most; longer runs are cut, which loses no start.
RUN = 1 << 16
#: Bytes under one suffix array, and of one group before its windows are counted by hash instead.
SHARD = 1 << 20
HOT_BYTES = 1 << 21


def window_minima(data: np.ndarray, window: int) -> np.ndarray:
    """For each start of a window the least hash of the ``GRAM``-byte strings inside the window."""
    starts = np.arange(len(data) - GRAM + 1)
    hashed = span_hashes(data, starts, starts + GRAM)
    wide = window - GRAM + 1
    padded = np.full(-(-len(hashed) // wide) * wide, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    padded[: len(hashed)] = hashed
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(data) - window + 1
    return np.minimum(back[:count], ahead[wide - 1 : wide - 1 + count]), hashed


def runs(text: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with the same least hash: first start, hash, and occurrences of it (2: two or more).

    Equal windows have equal least hashes, so they meet under the same key wherever they are.
    """
    if len(text) < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    least, hashed = window_minima(np.frombuffer(text, dtype=np.uint8), window)
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.unique(np.concatenate([[0], change, np.arange(0, len(least), RUN)]))
    after = np.append(first[1:], len(least)) + (window - GRAM)
    times = [min(2, int(np.count_nonzero(hashed[a:b] == least[a]))) for a, b in zip(first, after, strict=True)]
    return first, mixed(least[first]).view(np.int64), np.array(times)


def _hashed(text: bytes, first: np.ndarray, window: int) -> np.ndarray:
    """Hash of the bytes of each run."""
    ends = np.append(first[1:], len(text) - window + 1) + (window - 1)
    return np.array([xxhash.xxh3_64_intdigest(text[a:b]) - (1 << 63) for a, b in zip(first.tolist(), ends.tolist(), strict=True)],
                    dtype=np.int64) if len(first) else first


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """rid, key, number of window starts and the runs of each row, told by ``ph``, the hash of a run's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            found = [runs(t, window) for t in texts]
            yield pa.record_batch({
                "rid": batch.column("rid"), "key": batch.column("key"),
                "starts": pa.array([max(0, len(t) - window + 1) for t in texts], pa.int32()),
                "ph": pa.array([_hashed(t, f[0], window) for t, f in zip(texts, found, strict=True)], pa.list_(pa.int64())),
                "first": pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                "least": pa.array([f[1] for f in found], pa.list_(pa.int64())),
                "times": pa.array([f[2].astype(np.int32) for f in found], pa.list_(pa.int32())),
            })

    return docs.select("rid", "key", "text").mapInArrow(
        run, "rid string, key binary, starts int, ph array<long>, first array<int>, least array<long>, times array<int>")


def _payloads(texts: DataFrame, window: int) -> DataFrame:
    """The bytes of the places of each text: least, ph, bytes, copies, hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                yield pa.record_batch({
                    "least": pa.array([p["least"] for p in places], pa.int64()),
                    "ph": pa.array([p["ph"] for p in places], pa.int64()),
                    "bytes": pa.array([text[p["first"] : p["last"] + window] for p in places], pa.binary()),
                    "copies": pa.array([p["copies"] for p in places], pa.int64()),
                    "hot": pa.array([p["hot"] for p in places], pa.bool_()),
                })

    return texts.mapInArrow(run, "least long, ph long, bytes binary, copies long, hot boolean")


def repeated_starts(contents: list[bytes], copies: np.ndarray, window: int) -> list[np.ndarray]:
    """For each string the window starts that also occur at another place of any of the strings."""
    data = np.frombuffer(b"\xff".join(contents) + b"\xff", dtype=np.uint8)  # a byte no UTF-8 text has
    sizes = np.array([len(c) for c in contents])
    begin = np.cumsum(sizes + 1) - sizes - 1
    order = suffix_array(np.append(data.astype(np.int64) + 1, 0))[1:]
    shared = permuted_common_prefixes(data, order) >= window
    again = shared.copy()
    again[order[:-1]] |= shared[order[1:]]
    found = []
    for at, n, c in zip(begin, sizes, copies, strict=True):
        starts = n - window + 1
        found.append(np.arange(starts) if c > 1 else np.flatnonzero(again[at : at + starts]))
    return found


def as_spans(starts: np.ndarray) -> np.ndarray:
    """Flat list of first and last of each run of neighbouring starts."""
    if not len(starts):
        return starts
    gap = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)]], axis=1).ravel()


def _shard_arrays(groups: DataFrame, window: int) -> DataFrame:
    """least, ph, spans of repeated starts: a suffix array for each ``SHARD`` bytes of whole groups."""

    def flush(rows: list) -> pa.RecordBatch:
        found = repeated_starts([r[2] for r in rows], np.array([r[3] for r in rows]), window)
        kept = [(r, as_spans(s)) for r, s in zip(rows, found, strict=True) if len(s)]
        return pa.record_batch({
            "least": pa.array([r[0] for r, _ in kept], pa.int64()), "ph": pa.array([r[1] for r, _ in kept], pa.int64()),
            "spans": pa.array([s.astype(np.int32) for _, s in kept], pa.list_(pa.int32())),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("least", "ph", "bytes", "copies")), strict=True):
                if size >= SHARD and row[0] != last:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
                last = row[0]
        if held:
            yield flush(held)

    return groups.repartition("least").sortWithinPartitions("least", "ph").select(
        "least", "ph", "bytes", "copies").mapInArrow(run, "least long, ph long, spans array<int>")


def _window_hashes(groups: DataFrame, window: int) -> DataFrame:
    """The same for groups too large for one array: windows are counted by hash over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for least, ph, text in zip(*(batch.column(c).to_pylist() for c in ("least", "ph", "bytes")), strict=True):
                at = np.arange(len(text) - window + 1)
                hashed = span_hashes(np.frombuffer(text, dtype=np.uint8), at, at + window)
                yield pa.record_batch({
                    "least": pa.array(np.full(len(at), least)), "ph": pa.array(np.full(len(at), ph)),
                    "at": pa.array(at.astype(np.int32)), "h": pa.array(hashed.view(np.int64))})

    windows = groups.filter("copies = 1").select("least", "ph", "bytes").mapInArrow(
        run, "least long, ph long, at int, h long")
    partners = groups.filter("copies > 1").select("least", "ph", "bytes").mapInArrow(
        run, "least long, ph long, at int, h long")
    counts = windows.select("h", F.lit(1).alias("one")).unionByName(
        partners.select("h", F.lit(1).alias("one"))).groupBy("h").agg(F.sum("one").alias("n")).filter("n > 1")
    hits = lookup(windows, counts, "h", "n").groupBy("least", "ph").agg(F.sort_array(F.collect_list("at")).alias("at"))
    spans = F.flatten(F.transform("at", lambda a: F.array(a, a)))
    whole = groups.filter("copies > 1").select(
        "least", "ph", F.array(F.lit(0), F.octet_length("bytes") - window).alias("spans"))
    return hits.select("least", "ph", spans.alias("spans")).unionByName(whole)


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """key, spans (start, end of removed bytes), n_removed and the digest of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digests = [], [], []
            for text, parts in zip(batch.column("text").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                edge = np.zeros(len(text) + 1, dtype=np.int64)
                for p in parts:
                    flat = np.array(p["spans"], dtype=np.int64) + p["first"]
                    np.add.at(edge, flat[0::2], 1)
                    np.add.at(edge, flat[1::2] + window, -1)
                covered = np.cumsum(edge)[: len(text)] > 0
                turn = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                spans.append([{"start": int(a), "end": int(b)} for a, b in turn])
                removed.append(int(covered.sum()))
                digests.append(hashlib.sha256(np.frombuffer(text, dtype=np.uint8)[~covered].tobytes()).hexdigest())
            yield pa.record_batch({
                "key": batch.column("key"), "n_removed": pa.array(removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "left_sha256": pa.array(digests, pa.string())})

    return texts.mapInArrow(
        run, "key binary, n_removed long, spans array<struct<start:long,end:long>>, left_sha256 string")


def repeated_substrings(docs: DataFrame, window: int = 400) -> DataFrame:
    """The byte spans of every document that some ``window``-byte string repeated elsewhere covers.

    1. Equal texts are one text with a count; a text with copies is covered whole if it is
       long enough.
    2. Each window start belongs to the least hash of the ``GRAM``-byte strings in its window.
       Starts in a row with the same least hash are one run, and only runs whose hash occurs
       again can hold a repeated window.  Runs with equal bytes are merged and counted by their
       hashes; a run alone under its hash with several copies is settled, and no byte of it is moved.
    3. The bytes of the others, once each, are dealt out by that hash, so equal windows meet in one shard.  Each shard's runs
       get a suffix array by induced sorting and its permuted common prefixes; a start is
       repeated if it shares ``window`` bytes with a neighbour in the order.
    4. A hash with more than ``HOT_BYTES`` of different runs (say, a passage in a third of all
       documents, with other text on its sides) never goes to one task: its windows are
       counted by 64-bit hash, with partial sums, over all tasks.

    Returns doc_id, n_bytes, n_removed, spans (array of start and end, ascending, maximal) and
    kept_sha256 of the other bytes.  Null text counts as empty.  Null ids and repeated rows are
    documents like others.  An empty table gives no rows.  Other columns are ignored.
    """
    if window <= GRAM:
        raise ValueError(f"window must be longer than {GRAM} bytes")
    rows = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("rid"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    ).withColumn("key", F.unhex(F.md5("text")))
    slim = stage(rows.select("doc_id", "rid", "key", F.octet_length("text").cast("long").alias("n_bytes"),
                             F.sha2("text", 256).alias("sha256")), "substrings-rows")
    scanned = stage(_scan(rows, window), "substrings-runs")
    classes = stage(slim.groupBy("key").agg(F.min("rid").alias("rid"), F.count("*").alias("copies")), "substrings-classes")
    # one row for each different text
    own = scanned.join(classes.select("rid", "key"), ["rid", "key"]).dropDuplicates(["rid", "key"])
    last = F.transform("first", lambda x, i: F.coalesce(F.get(F.col("first"), i + 1), F.col("starts")) - 1)
    each = own.select("rid", "key", F.explode(F.arrays_zip("first", last.alias("last"), "least", "ph", "times")).alias("r")).select(
        "rid", "key", "r.*")
    counts = each.groupBy("least").agg(F.sum("times").alias("n")).filter("n > 1")
    places = stage(lookup(each.drop("times"), counts, "least", "n").drop("n"), "substrings-places")
    merged = stage(
        places.groupBy("least", "ph").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "key", "first", "last")).alias("one"))
        .select("least", "ph", "copies", "one.*").withColumn("starts", F.col("last") - F.col("first") + 1), "substrings-merged")
    groups = merged.groupBy("least").agg(
        F.count("*").alias("different"), F.sum(F.col("starts") + window - 1).alias("size"))
    # a run alone under its hash, with copies, is repeated as it stands; without copies only against itself
    sized = lookup(merged, groups, "least", "different")
    settled = (F.col("different") == 1) & (F.col("copies") > 1)
    hot = (F.col("size") > HOT_BYTES) & (F.col("different") > 1)
    asked = sized.filter(~settled).groupBy("rid", "key").agg(F.collect_list(
        F.struct("least", "ph", "first", "last", "copies", hot.alias("hot"))).alias("places"))  # bounded by the text
    texts = rows.select("rid", "key", "text")
    compared = stage(_payloads(texts.join(asked, ["rid", "key"]).dropDuplicates(["rid", "key"]).select("text", "places"), window),
                     "substrings-compared")
    spans = stage(
        sized.filter(settled).select("least", "ph", F.array(F.lit(0), F.col("starts") - 1).alias("spans"))
        .unionByName(_shard_arrays(compared.filter("not hot"), window))
        .unionByName(_window_hashes(compared.filter("hot"), window)), "substrings-spans")
    run = F.struct("least", "ph").alias("run")
    weighed = spans.join(merged.select("least", "ph", "copies"), ["least", "ph"]).select(run, "spans", "copies")
    parts = lookup(places.select("rid", "key", "first", run), weighed, "run", "copies").groupBy("rid", "key").agg(
        F.collect_list(F.struct("first", "spans")).alias("parts"))  # bounded by the text
    cut = _cut(texts.join(parts, ["rid", "key"]).dropDuplicates(["rid", "key"]).select("key", "text", "parts"), window)
    by_text = stage(classes.join(cut, "key", "left").filter("copies > 1 or n_removed > 0").select(
        "key", "copies", "n_removed", "spans", "left_sha256"), "substrings-cut")
    joined = lookup(slim, by_text, "key", "copies", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= window)
    part = F.col("n_removed") > 0
    none = F.array().cast("array<struct<start:long,end:long>>")
    return joined.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).when(part, F.col("n_removed")).otherwise(0).cast("long").alias("n_removed"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))))
        .when(part, F.col("spans")).otherwise(none).alias("spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).when(part, F.col("left_sha256")).otherwise(F.col("sha256"))
        .alias("kept_sha256"))


def without_spans(text: Column, spans: Column) -> Column:
    """The bytes of a text outside ascending spans, joined."""
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text).cast("long")))
    data = text.cast("binary")
    return F.aggregate(
        F.arrays_zip(starts.alias("a"), ends.alias("b")), F.lit(b""),
        lambda acc, r: F.concat(acc, F.substring(data, (r["a"] + 1).cast("int"), (r["b"] - r["a"]).cast("int"))))
