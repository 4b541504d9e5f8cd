"""Near-duplicate classes by min-max hashing, with links confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spellpanel.llm.arrays import chunks, mixed, shingles, word_hashes
from spellpanel.llm.common import components, lookup, packed, unpacked
from spellpanel.session import stage

#: Members of a bucket that meet one copy of its pivot's shingle set.
SALT_ROWS = 256


def band_count(similarity: float, rows: int, miss: float) -> int:
    """Bands needed so that a pair at the threshold shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def min_max(values: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Smallest and largest value of a set under each permutation: twice as many entries as hash functions."""
    low = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint64)
    high = np.zeros(len(factors), dtype=np.uint64)
    for at in range(0, len(values), 4096):
        hashed = factors[:, None] * values[None, at : at + 4096]
        hashed += shifts[:, None]
        hashed >>= np.uint64(32)
        np.minimum(low, hashed.min(axis=1), out=low)
        np.maximum(high, hashed.max(axis=1), out=high)
    return np.concatenate([low, high])


def signatures(docs: DataFrame, size: int, rows: int, bands: int, seed: int = 1) -> DataFrame:
    """doc_id, n_shingles, set_key (hash of the whole set) and one key per band, from whole texts."""
    draw = np.random.default_rng(seed)
    count = math.ceil(rows * bands / 2)
    factors = draw.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = draw.integers(0, 1 << 63, count, dtype=np.uint64)
    weights = draw.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n, keys, banded = [], [], []
            for a, b in chunks(texts):
                words, at = word_hashes(texts[a:b])
                for i in range(b - a):
                    found = np.unique(shingles(words[at[i] : at[i + 1]], size))
                    n.append(len(found))
                    if not len(found):
                        keys.append(None)
                        banded.append(None)
                        continue
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                    table = min_max(found, factors, shifts)[: rows * bands].reshape(bands, rows)
                    banded.append(mixed((table * weights).sum(axis=1, dtype=np.uint64) + marks).view(np.int64))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_shingles": pa.array(n, pa.int64()),
                "set_key": pa.array(keys, pa.binary()), "bands": pa.array(banded, pa.list_(pa.int64())),
            })

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and the sorted shingle hashes of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for a, b in chunks(texts):
                words, at = word_hashes(texts[a:b])
                sets = [np.unique(shingles(words[at[i] : at[i + 1]], size)).view(np.int64) for i in range(b - a)]
                yield pa.record_batch({"doc_id": ids.slice(a, b - a), "items": pa.array(sets, pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, items array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on the full sets.

    ``b`` may be the partner of very many rows: its set is repeated for every
    ``SALT_ROWS`` of them, so neither a task nor a row gathers a hot partner's pairs.
    """
    degree = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    copies = (
        degree.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b")), "b")
        .select("b", "salts", "items_b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    )
    salted = lookup(pairs, degree.withColumn("w", F.col("salts")), "b", "w").select(
        "a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    both = salted.join(copies.select("b", "salt", "items_b"), ["b", "salt"]).join(
        sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a")), "a")
    common = F.size(F.array_intersect("items_a", "items_b"))
    return both.withColumn("common", common).filter(
        100 * F.col("common") >= percent * (F.size("items_a") + F.size("items_b") - F.col("common"))).select("a", "b")


def prefixes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Prefix items of the documents whose buckets hold several components.

    Two sets with the wanted similarity share one of the first ``n - ceil(t n) + 1`` items of
    each in any common order.  Items that only one component holds come first, then rare ones:
    the former never join, and what is left of a set without them (``usable``) bounds its
    overlap with another component.
    """
    items = members.join(sets, "doc_id").select("doc_id", "component", F.size("items").alias("n"),
                                                F.explode("items").alias("item"))
    counts = items.groupBy("item").agg(
        F.count("*").alias("df"), (F.min("component") < F.max("component")).alias("crosses"))
    own = Window.partitionBy("doc_id")
    ranked = lookup(items, counts, "item", "df").withColumns({
        "place": F.row_number().over(own.orderBy("crosses", "df", "item")),
        "usable": F.sum(F.col("crosses").cast("int")).over(own).cast("int")})
    return ranked.filter(
        F.col("crosses") & (100 * F.col("usable") >= percent * F.col("n"))
        & (F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    ).select("doc_id", "component", "n", "usable", "place", "item")


def can_reach(percent: int) -> Column:
    """Whether the overlap of a and b, which share an item at these places, can still suffice.

    At the first shared item no more than the rest of either set can be common; at a later one
    the bound may fail, but then the pair is met at the first.
    """
    most = F.least("ua", "ub", F.col("na") - F.col("pa") + 1, F.col("nb") - F.col("pb") + 1)
    return (100 + percent) * most >= percent * (F.col("na") + F.col("nb"))


def _side(prefix: DataFrame, mark: str) -> DataFrame:
    names = {"doc_id": mark, "component": f"c{mark}", "n": f"n{mark}", "usable": f"u{mark}", "place": f"p{mark}"}
    return prefix.select("item", *[F.col(k).alias(v) for k, v in names.items()])


def central_pairs(prefix: DataFrame, percent: int) -> DataFrame:
    """For each item, the other components' members with the most central one of its largest component."""
    best = F.max(F.struct((F.col("usable") / F.col("n")).alias("share"), "doc_id", "component", "n", "usable", "place"))
    groups = prefix.groupBy("item", "component").agg(F.count("*").alias("size"), best.alias("best"))
    heads = groups.groupBy("item").agg(F.max(F.struct("size", "best")).alias("x"), F.sum("size").alias("w"),
                                       F.count("*").alias("parts")).filter("parts > 1").select(
        "item", "w", *[F.col(f"x.best.{k}").alias(v) for k, v in
                       (("doc_id", "b"), ("component", "cb"), ("n", "nb"), ("usable", "ub"), ("place", "pb"))])
    near = lookup(_side(prefix, "a"), heads, "item", "w")
    return near.filter((F.col("ca") != F.col("cb")) & can_reach(percent)).select("a", "b").distinct()


def crossing_pairs(prefix: DataFrame, percent: int) -> DataFrame:
    """All pairs from different components that share a prefix item and can still be similar."""
    crossing = prefix.groupBy("item").agg((F.min("component") < F.max("component")).alias("x")).filter("x").select("item")
    rest = prefix.join(crossing, "item", "left_semi")
    return _side(rest, "a").join(_side(rest, "b"), "item").filter(
        (F.col("ca") < F.col("cb")) & can_reach(percent)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = 5, miss: float = 1e-6) -> DataFrame:
    """Component of every document under "shingle sets with Jaccard similarity of ``percent`` or more".

    A document's set is its distinct ``size``-word shingles (A-Z lower-cased); with fewer
    words the whole sequence; without words it is empty and linked with nothing.

    1. Equal sets are one class, so copies meet in an aggregate and never in pairs.
    2. Min-max hashing: each hash function gives the smallest and the largest value of a set,
       two signature entries for one evaluation.  Entries are banded; the number of bands makes
       a pair at the threshold share no band with probability ``miss`` at most.
    3. In every bucket all classes are compared with one pivot, on full sets.
    4. Documents whose buckets still hold several components meet by prefix filtering: first
       with the most central member of a group, then, across the components that are left, all
       that can still be similar.  So a link is not lost because a pivot was a poor one,
       and no bucket is expanded into all pairs.

    Returns doc_id, n_shingles, component_id (smallest id reachable), kept.  Rows with the
    same id are one document.  A null id takes the component of its class of equal sets, null
    if there is no other id, and is kept only then.  An empty table gives no rows; other
    columns are ignored.
    """
    bands = band_count(percent / 100, rows, miss)
    signed = stage(signatures(docs, size, rows, bands), "neardup-signatures")
    classes = stage(
        signed.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("w")),
        "neardup-classes")
    reps = classes.filter("rep is not null").select(F.col("rep").alias("doc_id"), "set_key")
    unique = signed.join(reps, ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id", "set_key"])
    keyed = unique.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    order = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("pivot"), F.col("n").alias("pn"))
    buckets = keyed.groupBy("band").agg(F.min(order).alias("p"), F.count("*").alias("w")).filter("w > 1").select(
        "band", "w", "p.pivot", "p.pn")
    shared = stage(lookup(keyed, buckets, "band", "w").select("doc_id", "n", "band", "pivot", "pn"), "neardup-buckets")
    pairs = stage(
        shared.filter((F.col("doc_id") != F.col("pivot"))
                      & (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")))
        .select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct(), "neardup-pairs")
    ids = shared.select("doc_id").distinct()
    sets = stage(shingle_sets(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), size)
                 .dropDuplicates(["doc_id"]), "neardup-sets")
    links = stage(confirmed(pairs, sets, percent), "neardup-links")
    found = stage(components(links, "neardup-round"), "neardup-components")

    def placed(df: DataFrame, found: DataFrame) -> DataFrame:
        return df.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
            "component", F.coalesce("component", "doc_id"))

    def merged(found: DataFrame, further: DataFrame) -> DataFrame:
        """The components with the links among further pairs; the same ones where there are none."""
        extra = None if further.isEmpty() else stage(confirmed(further, sets, percent), "neardup-links")
        if extra is None or extra.isEmpty():
            return found
        known = found.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        return stage(components(extra.unionByName(known), "neardup-round"), "neardup-components")

    seen = shared.select("doc_id", "band").join(placed(ids, found), "doc_id")
    several = seen.groupBy("band").agg((F.min("component") < F.max("component")).alias("x")).filter("x").select("band")
    unsettled = seen.join(several, "band", "left_semi").select("doc_id", "component").distinct()
    prefix = stage(prefixes(stage(unsettled, "neardup-unsettled"), sets, percent), "neardup-prefix")
    # outliers of a large group first meet its most central member, so that few are left for the full comparison
    central = stage(central_pairs(prefix, percent).join(pairs, ["a", "b"], "left_anti"), "neardup-central")
    found = merged(found, central)
    prefix = placed(prefix.drop("component"), found)
    rest = crossing_pairs(prefix, percent).join(pairs, ["a", "b"], "left_anti").join(central, ["a", "b"], "left_anti")
    final = merged(found, stage(rest, "neardup-rest")).withColumnRenamed("node", "rep")
    named = lookup(signed.select("doc_id", "n_shingles", "set_key"), classes, "set_key", "w", "left")
    joined = named.join(final.groupBy("rep").agg(F.min("component").alias("component")), "rep", "left")
    # an empty set is its own component, and so is a class without links
    return joined.select(
        "doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"),
                                    F.col("doc_id").isNull() & F.col("component_id").isNull()))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = 5, miss: float = 1e-6) -> DataFrame:
    """One document of each component, with all columns: the one with the smallest id.

    Rows without an id take part under a hash of their text from the top of the ids, so that a document
    with an id is kept before one without.  All columns stay, whatever their names.
    """
    last = F.lit(9223372036854775807) - F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1))
    own = F.coalesce(F.col("doc_id").cast("long"), last)
    kept = near_duplicates(docs.select(own.alias("doc_id"), "text"), size, percent, rows, miss).filter(
        "kept").select(F.col("doc_id").alias("_id")).distinct()
    keyed = packed(docs, own.alias("_id"))
    return unpacked(keyed.join(kept, "_id", "left_semi").dropDuplicates(["_id"]), docs.columns)
