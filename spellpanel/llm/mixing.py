"""Mixing sources to target weights by distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spellpanel.llm.common import packed, prefix_sums, unpacked, word_count
from spellpanel.session import stage


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
                   epochs: float = 2.0) -> DataFrame:
    """Target per source: ``share`` of all sizes dealt by weight, none above ``epochs`` times its source.

    ``sizes`` has source and source_size, one row a source.  Sources take the weights in
    turn by code point, null last.  Sharing the excess anew until no target is above its
    limit ends at ``min(limit, weight * level)``; the level follows from the sources sorted
    by limit over weight, so no loop is needed.
    """
    turn = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    spots = F.array(*[F.lit(float(w)) for w in weights])
    weighed = (
        sizes.withColumn("place", F.row_number().over(turn) - 1)
        .withColumn("weight", F.get(spots, F.col("place") % len(weights)))
        .withColumn("limit", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
    )
    by_ratio = Window.orderBy("ratio", "place")
    before, here_on = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = (
        weighed.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                    / F.sum("weight").over(here_on))
        .withColumn("full", F.col("ratio") <= F.col("level"))
    )
    # the first source below its limit sets the level for all later ones
    first = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(by_ratio)
    return levels.select(
        "source", "source_size", "weight",
        F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * first).alias("target"),
    )


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0,
                seed: str = "mix", digits: int = 3, size: Column | None = None) -> DataFrame:
    """Mix all documents so that each source's words come to its target exactly (rounded to a word).

    Every document gets the key MD5(seed, doc_id).  Within a source, rows are ranged by
    the first ``digits`` hex digits of the key and sorted inside a range; distributed
    prefix sums of the sizes then tell where the budget is used up.  Full passes over the
    source are taken first, and the rest of the budget is cut at the document that crosses
    it, which gives only as many words as are left.

    Returns doc_id, source, size, source_size, target, taken and rank_before (words of the
    source before the document in key order).  Null or blank text: size 0, taken 0.  A
    null source is a source of its own.  Repeated rows count as often as they occur, in a
    defined order.  An empty table gives no rows.  Other columns are ignored.
    """
    count = word_count(F.col("text")) if size is None else size
    slim = stage(docs.select(
        F.col("doc_id"), F.col("source"), count.alias("size"),
        F.md5(F.concat_ws(" ", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
        .alias("key"),
    ), "mix-sizes")
    targets = source_targets(
        slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    ranged = slim.withColumn("range", F.substring("key", 1, digits))
    placed = prefix_sums(ranged, "range", [F.col("key"), F.col("doc_id"), F.col("size")], ["size"], within=["source"])
    t = targets.select(F.col("source").alias("of"), "source_size", "target")
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - passes * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("size_before")))
    return placed.join(t, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (passes * F.col("size") + part).cast("long").alias("taken"),
        F.col("size_before").cast("long").alias("rank_before"),
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
                    epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """The documents of the mix, with their own columns: one row for each pass that takes words of it.

    The document at the cut is kept whole, so a source is over its target by less than one
    document.  Documents without words are in no pass.  All columns stay, whatever their names.
    """
    mix = mix_sources(docs.select("doc_id", "source", "text"), weights, share, epochs, seed)
    copies = mix.filter("taken > 0").groupBy("doc_id", "source", "size").agg(
        F.sum(F.ceil(F.col("taken") / F.col("size"))).alias("_copies"), F.count("*").alias("_rows"))
    sized = packed(docs, "doc_id", "source", word_count(F.col("text")).alias("_size"))
    keys = copies.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_of_size"),
                         F.floor((F.col("_copies") + F.col("_rows") - 1) / F.col("_rows")).cast("int").alias("_times"))
    on = [F.col("doc_id").eqNullSafe(F.col("_id")), F.col("source").eqNullSafe(F.col("_source")),
          F.col("_size") == F.col("_of_size")]
    passes = F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_pass")
    return unpacked(sized.join(keys, on).select("_row", passes), docs.columns)
