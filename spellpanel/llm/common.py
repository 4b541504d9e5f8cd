"""Helpers the training-data operators share: names, prefix sums, components, keyed lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spellpanel.session import stage

#: A word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

#: Keys of a lookup that are broadcast because they are the most frequent ones.
HOT_KEYS = 1000


def packed(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """The given columns and the whole input row as one struct, ``_row``, so that no column of it clashes with own ones."""
    every = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(*columns, F.struct(*every).alias("_row"))


def unpacked(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """The input rows of ``packed`` again, under their own names."""
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in names])


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, bucket: str, order: Sequence[Column], values: Sequence[str],
                within: Sequence[str] = ()) -> DataFrame:
    """Add ``<value>_before``: the sum over all rows that come earlier in the global order.

    ``bucket`` is a text column whose ascending order agrees with ``order`` and which
    has a fixed number of values.  Totals per bucket (one row each, a bound that does
    not grow with the rows) are summed in bucket order and added to the running sums
    inside the bucket, so no task sees more than one bucket.  With ``within`` the sums
    start anew for each value of those columns.
    """
    keys = [*within, bucket]
    totals = df.groupBy(*keys).agg(*[F.sum(v).alias(f"{v}_t") for v in values])
    earlier = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"{k}_o") for k in keys],
        *[F.coalesce(F.sum(f"{v}_t").over(earlier), F.lit(0)).alias(f"{v}_o") for v in values],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"{v}_i") for v in values])
    on = [F.col(k).eqNullSafe(F.col(f"{k}_o")) for k in keys]
    joined = summed.join(offsets, on, "left")
    return joined.select(*df.columns, *[(F.col(f"{v}_i") + F.col(f"{v}_o")).alias(f"{v}_before") for v in values])


def lookup(facts: DataFrame, dims: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Join facts with one row per key, where a few keys may hold most of the facts.

    The ``HOT_KEYS`` keys with the largest weight (a fixed number of rows, so safe to
    broadcast) are joined without a shuffle; all others are shuffled, and none of them
    holds more than a thousandth of the rows.  ``how`` is inner or left.
    """
    hot = dims.orderBy(F.col(weight).desc(), F.col(key)).limit(HOT_KEYS)
    marked = facts.join(F.broadcast(hot.select(F.col(key), F.lit(True).alias("_hot"))), key, "left")
    first = marked.filter("_hot").drop("_hot").join(F.broadcast(hot), key, "inner")
    rest = marked.filter("_hot is null").drop("_hot").join(dims, key, how)
    columns = [*facts.columns, *[c for c in dims.columns if c != key]]
    return first.select(*columns).unionByName(rest.select(*columns))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest reachable id of every node of the edge list (a, b): columns node, component.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edge
    list no longer changes.  Each step is one aggregate and one join over the edges,
    and each result is written to the shared folder, so a lost executor costs one step.
    Rows with a null end and loops are ignored; an empty list gives no rows.
    """
    def mark(e: DataFrame) -> tuple:
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def star(e: DataFrame, both: bool) -> DataFrame:
        # every node with its neighbours; for the small star only the smaller ones
        near = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if both:
            near = near.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        linked = near.join(low, "u")  # one row a node on one side, so a hot node's partition can be split
        if both:
            out = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
                low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = stage(now, name)
    seen = mark(now)
    while seen[0]:
        now = stage(star(star(now, True), False), name)
        last, seen = seen, mark(now)
        if last == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b"), F.col("b")).distinct())
