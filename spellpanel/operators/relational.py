"""General operators: next-row lookup, global ids, audits, quantiles, reshapes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spellpanel.functions.nulls import nulls_last, sort_struct
from spellpanel.session import drop_part, freed_shuffles, stage_large, staged_large

# Rows of one key that a single task may hold before the work is sliced.
MAX_ROWS_PER_KEY = 1_000_000


# Parts in which joins of wide tables are made one after the other, so that the shuffles of one part exist at a time.
SLICES = 8
SLICE = "_slice"


def sliced(df: DataFrame, key: str) -> DataFrame:
    """Add the slice of each row: rows with the same key, or without one, share it."""
    return df.withColumn(SLICE, F.pmod(F.xxhash64(key), F.lit(SLICES)).cast("int"))


def slices(*tables: DataFrame) -> Iterator[list[DataFrame]]:
    """Slice after slice of tables that ``staged_large`` holds by :data:`SLICE`: what a key joins or groups is in one of them.

    A slice's files go when the next one is asked for.
    """
    for i in range(SLICES):
        yield [t.filter(F.col(SLICE) == i).drop(SLICE) for t in tables]
        for t in tables:
            drop_part(t, f"{SLICE}={i}")


def keys_over(df: DataFrame, keys: str | Sequence[str], max_rows: int) -> DataFrame | None:
    """Keys with more rows than the bound, or None when there are none.

    One pruned pass over the key columns; counts combine before the shuffle.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows).select(*keys)
    with freed_shuffles(df.sparkSession):
        return None if hot.isEmpty() else hot


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition under which a missing key equals a missing key."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys where NULL matches NULL, keeping one copy of each key."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys])
    out = left.join(r, cond, how)
    if how in ("full", "full_outer", "outer", "right"):
        out = out.withColumns({k: F.coalesce(F.col(k), F.col(f"_r_{k}")) for k in keys})
    return out.drop(*[f"_r_{k}" for k in keys])


def next_row(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    values: Sequence[str],
    max_rows_per_key: int | None = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """Add ``_next``: the named values of the following row of the same key.

    Ordinary keys take one window.  If some key has more rows than the bound,
    its rows are cut into slices by the first two order columns; the follower
    of a slice's last row is the first row of the key's next slice, which is
    looked up in the (pre-aggregated) table of slice heads.  Both ways give the
    same result.  ``None`` skips the check.
    """
    payload = F.struct(*values)
    hot = None if max_rows_per_key is None else keys_over(df, key, max_rows_per_key)
    if hot is None:
        w = Window.partitionBy(key).orderBy(*nulls_last(order))
        return df.withColumn("_next", F.lead(payload).over(w))

    hot = hot.withColumnRenamed(key, "_hot_key").withColumn("_hot", F.lit(True))
    marked = (
        df.join(hot, df[key].eqNullSafe(hot["_hot_key"]), "left")
        .drop("_hot_key")
        .withColumns({f"_s{i}": F.when(F.col("_hot"), F.col(c)) for i, c in enumerate(order[:2])})
    )
    slices = ["_s0", "_s1"]
    w = Window.partitionBy(key, *slices).orderBy(*nulls_last(order))
    inside = marked.withColumn("_inside", F.lead(payload).over(w))
    heads = (
        marked.filter("_hot")
        .groupBy(key, *slices)
        .agg(F.min(F.struct(sort_struct(order).alias("o"), payload.alias("p"))).alias("h"))
        .withColumn(
            "_after", F.lead("h.p").over(Window.partitionBy(key).orderBy(*nulls_last(slices)))
        )
        .drop("h")
    )
    joined = join_null_safe(inside, heads, [key, *slices], "left")
    return joined.withColumn("_next", F.coalesce("_inside", "_after")).drop(
        "_inside", "_after", "_hot", *slices
    )


def with_position(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """1-based position of every row in a total order, over the whole table.

    Range partitioning sorts without a single-task window.  The input is staged
    because range partitioning first samples it; the sorted table is staged so
    the layout cannot change between counting and numbering; the input goes then.  Only one row count
    per partition travels through the driver.
    """
    cols = nulls_last(order)
    with staged_large(df, f"{name}-input") as rows:
        laid_out = (
            rows.repartitionByRange(*cols)
            .sortWithinPartitions(*cols)
            .withColumn("_pos", F.monotonically_increasing_id())
        )
        frozen = stage_large(laid_out, name)
    part = F.shiftright(F.col("_pos"), 33).cast("int")
    with freed_shuffles(df.sparkSession):
        counts = sorted(
            (r["p"], r["n"]) for r in frozen.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        )
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    lookup = df.sparkSession.createDataFrame(offsets, "_part INT, _before BIGINT")
    in_part = F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        frozen.withColumn("_part", part)
        .join(F.broadcast(lookup), "_part", "left")  # a row a partition
        .withColumn(name, in_part + F.col("_before") + 1)
        .drop("_part", "_pos", "_before")
    )


def dense_group_id(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Number the groups 1..n by their first row in a total order; NULL is a key value.

    The rows are read twice, so they are staged.
    """
    df = stage_large(df, f"{name}-rows")
    rest = [c for c in order if c not in keys]  # a key is constant within its group
    first = df.groupBy(*keys).agg(F.min(sort_struct(rest)).alias("_f")) if rest else df.select(*keys).distinct()
    groups = first.select(*keys, *[F.col(f"_f.k{i}").alias(c) for i, c in enumerate(rest)])
    numbered = with_position(groups, order, name).drop(*rest)
    return join_null_safe(df, numbered, keys, "left")


def row_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    max_rows_per_key: int | None = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """1-based row number within each group, in a total order.

    A window while every group fits the bound; otherwise the global position
    minus the group's first position, which no single task has to hold.
    """
    if max_rows_per_key is None or keys_over(df, keys, max_rows_per_key) is None:
        w = Window.partitionBy(*keys).orderBy(*nulls_last(order))
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))
    placed = with_position(df, [*keys, *order], "_position")
    starts = placed.groupBy(*keys).agg(F.min("_position").alias("_start"))
    return (
        join_null_safe(placed, starts, keys, "left")
        .withColumn(name, F.col("_position") - F.col("_start") + 1)
        .drop("_position", "_start")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep each key's first row in a total order; copies combine before the shuffle."""
    picked = df.groupBy(*keys).agg(first_row(df, keys, order).alias("f"))
    return picked.select(*keys, *first_values(df, keys, order)).select(*df.columns)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Aggregate: a group's first row in an order, each column once; :func:`first_values` unpacks it."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return F.min(F.struct(sort_struct(order).alias("o"), *[F.col(f"`{c}`") for c in rest]))


def first_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], row: str = "f") -> list[Column]:
    """The columns other than the keys, in their order, from what :func:`first_row` found."""
    at = {c: f"o.k{i}" for i, c in enumerate(order)}
    return [F.col(f"{row}.{at.get(c, f'`{c}`')}").alias(c) for c in df.columns if c not in keys]


def group_extreme(df: DataFrame, keys: Sequence[str], col: str, strict: bool = False) -> DataFrame:
    """Rows that carry their group's minimum (ties kept, duplicates dropped).

    Aggregate and join back, so a large group is reduced before it moves.
    ``strict`` drops a group in which any value is missing.
    """
    from spellpanel.functions.nulls import strict_min

    low = df.groupBy(*keys).agg((strict_min(col) if strict else F.min(col)).alias("_low"))
    joined = join_null_safe(df.distinct(), low, keys, "left")
    return joined.filter(F.col(col) == F.col("_low")).drop("_low")


def fan_out(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise when a lookup would duplicate rows."""
    with freed_shuffles(df.sparkSession):
        unique = fan_out(df, keys).isEmpty()
    if not unique:
        raise ValueError(f"keys {list(keys)} are not unique")
    return df


def quantile(df: DataFrame, col: str, p: float, approx: bool = False) -> DataFrame:
    """One-row table ``q`` with the linearly interpolated quantile.

    The exact form first counts equal values, so what is gathered is bounded by
    the number of distinct values (days of stay).  ``approx`` suits columns
    with an unbounded number of distinct values.
    """
    if approx:
        return df.agg(F.percentile_approx(col, F.lit(p), F.lit(100_000)).cast("double").alias("q"))
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.percentile(F.col(col), F.lit(p), F.col("_n")).alias("q"))


def count_steps(units: DataFrame, unit: str, steps: dict[str, Column]) -> DataFrame:
    """Units left after each of a chain of conditions, in one job.

    ``units`` has one row per unit; a step keeps the units for which its own
    and all earlier conditions hold.
    """
    kept, measures = F.lit(True), []
    for i, (label, cond) in enumerate(steps.items(), 1):
        kept = kept & F.coalesce(cond, F.lit(False))
        measures.append(
            F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"), F.count_if(kept).alias("n_units"))
        )
    return units.agg(F.array(*measures).alias("m")).select(F.inline("m"))


def positions_to_columns(
    df: DataFrame, key: str, position: str, value: str, n: int, prefix: str
) -> DataFrame:
    """Long to wide by occurrence number with a declared number of columns.

    A position past the last column raises when the plan runs, so nothing is lost silently.
    """
    cols = [F.max(F.when(F.col(position) == i, F.col(value))).alias(f"{prefix}{i}") for i in range(1, n + 1)]
    beyond = F.raise_error(F.concat(F.lit(f"more than {n} values for {key} "), F.col(key).cast("string")))
    wide = df.groupBy(key).agg(F.max(position).alias("_last"), *cols)
    first = F.when(F.col("_last") > n, beyond).otherwise(F.col(f"{prefix}1")).alias(f"{prefix}1")
    return wide.select(key, first, *[f"{prefix}{i}" for i in range(2, n + 1)])


def group_shares(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Value over its group total, the total being NULL if any value is missing.

    Totals are aggregated and joined back instead of windowed, so no group has
    to fit one task.
    """
    from spellpanel.functions.nulls import ratio, strict_sum

    totals = df.groupBy(*keys).agg(strict_sum(value).alias("_total"))
    joined = join_null_safe(df, totals, keys, "left")
    return joined.withColumn(name, ratio(value, "_total")).drop("_total")
