"""Balanced contiguous shards by global prefix sums of byte sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spellpanel.llm.common import prefix_sums
from spellpanel.session import stage

#: Bytes a row takes beside its text.
ROW_BYTES = 16


def shard_documents(docs: DataFrame, shards: int = 40, tolerance: float = 0.05, digits: int = 3) -> DataFrame:
    """Cut the documents into ``shards`` runs of near equal bytes.

    Rows are put in one global order, the MD5 of the text, and each row's place is the
    sum of the sizes before it: totals of the ``16 ** digits`` key ranges, plus the
    running sum inside a range.  Cuts fall at equal targets of that sum.  Equal texts
    are neighbours in the order and stay in one shard, unless together they exceed
    ``tolerance`` of a shard; such groups (at most ``shards / tolerance`` of them) are
    ordered by the MD5 of text and id instead, and so spread over all key ranges.

    Returns doc_id, size, text_crc32, law (always ``bytes``), shard, slot (gapless from
    0 in each shard) and grown_shard (null: the law does not depend on the shard count).
    Null text: size 16, no checksum; empty text: size 16, checksum 0.  Null doc_id counts
    as its own id.  Repeated rows are kept, each with its own slot.  An empty table gives no
    rows.  Other columns of the input are ignored, whatever their names.
    """
    slim = stage(docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("text_key"),
    ), "shard-sizes")
    total = slim.agg(F.sum("size").alias("total"))
    groups = slim.groupBy("text_key").agg(F.sum("size").alias("group_size"))
    # the total is one row, and no more than shards / tolerance groups can be this large
    large = groups.join(F.broadcast(total)).filter(
        F.col("group_size") * shards > F.lit(tolerance) * F.col("total")).select("text_key", F.lit(True).alias("large"))
    salted = F.md5(F.concat_ws(" ", "text_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    keyed = (
        slim.join(F.broadcast(large), "text_key", "left")
        .withColumn("key", F.when(F.col("large"), salted).when(F.col("text_key") == "", F.md5(F.lit(b""))).otherwise(
            F.col("text_key")))
        .select("doc_id", "size", "text_crc32", "key", F.substring("key", 1, digits).alias("range"), F.lit(1).alias("n"))
    )
    placed = prefix_sums(keyed, "range", [F.col("key"), F.col("doc_id"), F.col("size")], ["size", "n"])
    group = Window.partitionBy("range", "key")
    middle = F.min("size_before").over(group) + F.sum("size").over(group) / 2
    cut = stage(
        placed.join(F.broadcast(total))
        .withColumn("shard", F.least(F.floor(middle * shards / F.col("total")), F.lit(shards - 1)).cast("int")),
        "shard-rows",
    )
    starts = cut.groupBy("shard").agg(F.min("n_before").alias("first"))  # one row a shard
    return cut.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("n_before") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
