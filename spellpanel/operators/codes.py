"""Code lists per record: occurrence numbers, joined text, list filters, hits."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spellpanel.functions.nulls import sql_text
from spellpanel.operators.relational import MAX_ROWS_PER_KEY, positions_to_columns, row_in_group


def number_codes(long: DataFrame, max_rows_per_record: int | None = MAX_ROWS_PER_KEY) -> DataFrame:
    """Occurrence number ``num`` of each code within its record, in ``ord`` order."""
    return row_in_group(long, ["id"], ["ord", "code"], "num", max_rows_per_record)


def codes_wide(long: DataFrame, n: int, prefix: str) -> DataFrame:
    """One column per occurrence, ``prefix1``..``prefixN``."""
    return positions_to_columns(number_codes(long), "id", "num", "code", n, prefix)


def code_arrays(long: DataFrame) -> DataFrame:
    """All codes of a record as an ordered array (the master form)."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "code")))
    return long.groupBy("id").agg(F.transform(ordered, lambda s: s["code"]).alias("codes"))


def attach_codes(records: DataFrame, dx: DataFrame, px: DataFrame) -> DataFrame:
    """Add ``tnrdiagall`` and ``tnrprocall``: primary code first, then the
    secondary ones, comma-joined without missing entries."""
    out = records
    for long, primary, name in ((dx, "DIAG_01", "tnrdiagall"), (px, "OPERTN_01", "tnrprocall")):
        arrays = code_arrays(long).withColumnRenamed("codes", "_codes")
        out = (
            out.join(arrays, "id", "left")
            .withColumn(name, F.concat_ws(",", F.array(primary), F.coalesce("_codes", F.array().cast("array<string>"))))
            .drop("_codes")
        )
    return out


def pattern_test(pattern: str, column: str = "code") -> str:
    """SQL text of "the code matches": for plain alternatives a set of prefixes per length.

    A code has its only letter in front, so an alternative that starts with a letter can match
    at the start alone.
    """
    codes = pattern.lstrip("^").split("|")
    if not all(re.fullmatch(r"[A-Z][0-9]+", c) for c in codes):
        return f"{column} rlike {sql_text(pattern)}"
    by_length: dict[int, list[str]] = {}
    for c in codes:
        by_length.setdefault(len(c), []).append(c)
    return "(" + " or ".join(
        f"substring({column}, 1, {n}) in ({', '.join(map(sql_text, group))})" for n, group in sorted(by_length.items())
    ) + ")"


def code_hits(long: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Per record, one boolean per named pattern: some code of it matches.

    One pass over the rows: each code becomes a bit mask by set lookups, and masks combine
    before the only shuffle, so a record with any number of codes costs one short
    row, no code list is gathered and no code is a join key.
    """
    names = list(patterns)
    groups = [names[i : i + 60] for i in range(0, len(names), 60)]
    masks = []
    for g, group in enumerate(groups):
        bits = [f"if({pattern_test(patterns[name])}, {1 << bit}L, 0L)" for bit, name in enumerate(group)]
        masks.append(F.expr(f"coalesce({' | '.join(bits)}, 0L)").alias(f"_m{g}"))
    found = long.select("id", *masks).groupBy("id").agg(*[F.bit_or(f"_m{g}").alias(f"_m{g}") for g in range(len(groups))])
    return found.select(
        "id",
        *[
            F.expr(f"(_m{g} & {1 << bit}L) <> 0L").alias(name)
            for g, group in enumerate(groups)
            for bit, name in enumerate(group)
        ],
    )


def filter_by_code_list(
    records: DataFrame, code_list: DataFrame, text: str = "tnrprocall", column: str = "intermediate"
) -> DataFrame:
    """Records whose code text holds an element starting with a listed code.

    Codes start with their only letter, so a match anywhere in the text is a
    match at the start of an element.  Different texts are cut into the prefixes of
    their elements and semi-joined, for lists of any length; white space in the
    list is ignored.  Records need no id.
    """
    wanted = code_list.select(F.regexp_replace(column, r"\s+", "").alias("prefix")).filter("prefix <> ''").distinct()
    prefixes = (
        records.select(F.col(text).alias("_text")).distinct()
        .select("_text", F.explode(F.array_distinct(F.split("_text", ","))).alias("e"))
        .select("_text", F.explode(F.sequence(F.lit(1), F.greatest(F.length("e"), F.lit(1)))).alias("n"), "e")
        .select("_text", F.expr("substring(e, 1, n)").alias("prefix"))
    )
    hits = prefixes.join(wanted, "prefix", "left_semi").select("_text").distinct()
    return records.join(hits, records[text] == hits["_text"], "left_semi")


def keep_records(long: DataFrame, ids: DataFrame) -> DataFrame:
    """Code rows of the wanted records."""
    return long.join(ids.select("id"), "id", "left_semi")


def union_years(parts: Sequence[DataFrame]) -> DataFrame:
    """Code tables of several years as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
