"""Exact token-length histogram and the answers its suffix sums give."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spellpanel.llm.common import prefix_sums
from spellpanel.session import stage

#: Largest vocabulary file that is sent to the executors.
MAX_VOCABULARY = 32 << 20
#: Lengths per range of the prefix sums.
RANGE = 1024

# Fixed value: the split pattern the public byte-level vocabularies were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[int, object] = {}


def token_lengths(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """One row a document: n_tokens of its whole text; 0 for null and empty texts.

    The driver reads the rank file (checked to be below ``MAX_VOCABULARY``) and broadcasts it, so
    executors need no copy.  Strings of special tokens count as ordinary text.
    """
    if os.path.getsize(vocabulary) > MAX_VOCABULARY:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY} bytes")
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        raw = sent.value
        name = hash(raw)
        if name not in _encodings:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
            _encodings[name] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encoding = _encodings[name]
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"n_tokens": pa.array(n, pa.int64())})

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens and n_docs: every length that occurs."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def histogram_answers(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit, what the corpus holds below and above it.

    docs_within and tokens_within count the documents of at most that length, docs_over and
    tokens_over the longer ones, truncated_tokens is the total if every document is cut at the
    limit, and quantile the share of documents within.  Between two rows the answers follow
    from the lower one: documents over it stay, and each adds a token per step.
    """
    ranged = stage(histogram.select(
        "n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
        F.lpad(F.floor(F.col("n_tokens") / RANGE).cast("string"), 15, "0").alias("range")), "token-histogram")
    totals = ranged.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    placed = prefix_sums(ranged, "range", [F.col("n_tokens")], ["n_docs", "tokens"]).join(F.broadcast(totals))
    within, tokens = F.col("n_docs_before") + F.col("n_docs"), F.col("tokens_before") + F.col("tokens")
    return placed.select(
        "n_tokens", "n_docs", within.alias("docs_within"), (F.col("all_docs") - within).alias("docs_over"),
        tokens.alias("tokens_within"), (F.col("all_tokens") - tokens).alias("tokens_over"),
        (tokens + (F.col("all_docs") - within) * F.col("n_tokens")).alias("truncated_tokens"),
        (within / F.col("all_docs")).alias("quantile"))


def at_limits(answers: DataFrame, limits: Sequence[int]) -> DataFrame:
    """limit_tokens, docs_over and truncated_tokens for any context limits, in one pass over the answers table."""
    row = F.struct("n_tokens", "docs_over", "truncated_tokens")
    each = answers.agg(
        F.max(F.col("docs_within") + F.col("docs_over")).alias("docs"),
        F.array(*[F.struct(F.lit(int(x)).cast("long").alias("limit_tokens"),
                           F.max(F.when(F.col("n_tokens") <= x, row)).alias("b")) for x in limits]).alias("all"))
    found = each.select("docs", F.explode("all").alias("x")).select("docs", "x.limit_tokens", "x.b")
    below = F.col("b.truncated_tokens") + F.col("b.docs_over") * (F.col("limit_tokens") - F.col("b.n_tokens"))
    return found.select(
        "limit_tokens", F.coalesce("b.docs_over", "docs", F.lit(0)).alias("docs_over"),
        F.coalesce(below, F.col("docs") * F.col("limit_tokens"), F.lit(0)).alias("truncated_tokens"))


def quantile_lengths(answers: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share and the least length that at least this share of the documents does not exceed."""
    return answers.agg(F.array(*[
        F.struct(F.lit(float(x)).alias("share"),
                 F.min(F.when(F.col("quantile") >= x, F.col("n_tokens"))).alias("n_tokens"))
        for x in shares]).alias("all")).select(F.explode("all").alias("x")).select("x.share", "x.n_tokens")


def token_answers(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``histogram_answers`` of all documents.

    Null and empty texts are documents of length 0; repeated rows count each; an empty table gives
    no rows; other columns are ignored.
    """
    return histogram_answers(length_histogram(token_lengths(docs, vocabulary, pattern)))
