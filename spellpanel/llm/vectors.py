"""Near-duplicate embeddings: sign hashes of random hyperplanes, exact cosines, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellpanel.llm.common import components
from spellpanel.session import stage

#: Share of pairs at the very threshold that may meet in no table; pairs above it meet more surely.
MISS = 1e-3
#: Vectors compared with each other at once; a fuller bucket is cut into blocks.
BLOCK = 1024
#: A bucket with more than this share of all vectors gets a ball, so there are at most so many balls.
BALLS = 1000
#: Bits of a sign hash at least, and at most.
LEAST_BITS, MOST_BITS = 8, 40
SEED = 13


def hash_plan(n: int, threshold: float, miss: float = MISS, block: int = BLOCK) -> tuple[int, int]:
    """Bits and tables for up to ``n`` vectors of one label.

    Buckets of unlike vectors hold a quarter of a block on average, whatever n; tables are as many as
    leave a pair at the threshold without a common bucket with probability ``miss``.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1.0, 4 * n / block)))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-meet))


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of length one in double precision; scaled first, so that nothing overflows."""
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sign_hashes(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """One number for each row and table: on which side of its hyperplanes the row lies."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], tables * bits))
    sides = (x @ planes > 0).reshape(len(x), tables, bits)
    return sides @ (1 << np.arange(bits, dtype=np.int64))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(dims == dim)))


def usable(embedding: Column, label: Column) -> Column:
    """The rows that can have links: a label, and a vector with finite components that are not all zero."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _signed(distinct: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                signs = sign_hashes(unit_rows(part.column("embedding"), dim), bits, tables, seed)
                lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * tables, signs.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "signs"])

    schema = ", ".join(f"{c} {t}" for c, t in distinct.dtypes) + ", signs array<long>"
    return distinct.mapInArrow(run, schema)


def _balls(signed: DataFrame, n: int, threshold: float, block: int, balls: int) -> DataFrame:
    """Add ``ball``: a number shared only by vectors that are surely linked, or null.

    The buckets of the first table that hold more than ``max(block, n / balls)`` vectors (so at most
    ``balls``) send their mean directions to all tasks; a vector joins the first of its label, by number of vectors, that
    lies within half the threshold's angle.  Two vectors of a ball are then within the whole angle.
    """
    first = F.element_at("signs", 1)
    hot = signed.groupBy("label", "dim", first.alias("sign")).agg(F.count("*").alias("m")).filter(
        F.col("m") > max(block, n / balls)).orderBy(F.col("m").desc(), "label", "dim", "sign").collect()
    if not hot:
        return signed.withColumn("ball", F.lit(None).cast("int"))
    place = {(h["label"], h["dim"], h["sign"]): k for k, h in enumerate(hot)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in _by_dim(batch):
                x = unit_rows(part.column("embedding"), dim)
                at = np.array([place.get((a, dim, s), -1) for a, s in zip(part.column("label").to_pylist(), part.column("sign").to_pylist())])
                for k in np.unique(at[at >= 0]).tolist():
                    held[k] = held.get(k, 0) + x[at == k].sum(axis=0)
        for k, v in held.items():
            yield pa.record_batch({"k": pa.array([k] * len(v), pa.int32()), "pos": pa.array(range(len(v)), pa.int32()), "v": pa.array(v)})

    added = signed.select("label", "dim", "embedding", first.alias("sign")).mapInArrow(sums, "k int, pos int, v double")
    centers: dict[tuple, list] = {}
    means = [np.zeros(h["dim"]) for h in hot]
    for r in added.groupBy("k", "pos").agg(F.sum("v").alias("v")).collect():
        means[r["k"]][r["pos"]] = r["v"]
    for k, (h, v) in enumerate(zip(hot, means)):
        if np.linalg.norm(v) > 0:
            centers.setdefault((h["label"], h["dim"]), []).append((k, v / np.linalg.norm(v)))
    near = math.cos(math.acos(threshold) / 2) + 1e-9
    sent = signed.sparkSession.sparkContext.broadcast({g: (np.array([k for k, _ in v]), np.array([c for _, c in v])) for g, v in centers.items()})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                labels = part.column("label").dictionary_encode()
                codes = labels.indices.to_numpy()
                ball = np.full(len(part), -1)
                for code, label in enumerate(labels.dictionary.to_pylist()):
                    if (found := sent.value.get((label, dim))) is not None:
                        rows = np.flatnonzero(codes == code)
                        close = unit_rows(part.column("embedding").take(pa.array(rows)), dim) @ found[1].T >= near
                        ball[rows] = np.where(close.any(axis=1), found[0][close.argmax(axis=1)], -1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ball, pa.int32(), mask=ball < 0)], [*part.schema.names, "ball"])

    schema = ", ".join(f"{c} {t}" for c, t in signed.dtypes) + ", ball int"
    return signed.mapInArrow(assign, schema)


_BUCKET = ["label", "dim", "tab", "sign"]
_GROUP = [*_BUCKET, "task"]


def _comparisons(placed: DataFrame, block: int) -> DataFrame:
    """Rows of every bucket, dealt into groups of at most about two blocks that are compared apart.

    A bucket of at most ``block`` rows is one group.  A fuller one is cut by ball and then by hash into blocks,
    and each two blocks meet in a group (``side`` tells them apart), unless both are of one ball: its vectors
    need no comparison, so a large group of near copies costs work in proportion to its size.
    """
    rows = placed.select("did", "w", "label", "dim", "ball", "embedding", "signs", F.posexplode("signs").alias("tab", "sign"))
    light = placed.select("label", "dim", "ball", F.posexplode("signs").alias("tab", "sign"))
    counts = light.groupBy(*_BUCKET, "ball").agg(F.count("*").alias("m"))
    full = counts.groupBy(*_BUCKET).agg(F.sum("m").alias("total")).filter(F.col("total") > block).drop("total")
    cut = counts.join(full, _BUCKET, "left_semi").select(
        *_BUCKET, F.coalesce("ball", F.lit(-1)).alias("part"), F.ceil(F.col("m") / block).cast("int").alias("parts"))
    cut = stage(cut, "vector-blocks")
    each = cut.select(*_BUCKET, "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("piece"))
    one = each.withColumn("me", F.struct("part", "piece"))
    two = each.select(*_BUCKET, F.struct("part", "piece").alias("other"))
    met = one.join(two, _BUCKET).filter("me <= other and not (me.part >= 0 and me.part = other.part)")
    name = F.concat_ws(".", "me.part", "me.piece", "other.part", "other.piece").alias("task")
    # every block with the groups it goes to
    sides = stage(
        met.select(*_BUCKET, "me.part", "me.piece", name, F.lit(0).alias("side")).unionByName(
            met.filter("me <> other").select(*_BUCKET, "other.part", "other.piece", name, F.lit(1).alias("side"))), "vector-meetings")
    marked = rows.join(cut.withColumnRenamed("part", "_part"),
                       [rows[c] == cut[c] for c in _BUCKET] + [F.coalesce(rows["ball"], F.lit(-1)) == F.col("_part")], "left").select(
        *[rows[c] for c in rows.columns], F.col("_part").alias("part"),
        F.expr("pmod(xxhash64(did), parts)").cast("int").alias("piece"))
    small = marked.filter("part is null").select(*rows.columns, F.lit("").alias("task"), F.lit(0).alias("side"))
    large = marked.filter("part is not null").join(sides, [*_BUCKET, "part", "piece"]).select(*rows.columns, "task", "side")
    return small.unionByName(large)


def _linked(groups: DataFrame, threshold: float) -> DataFrame:
    """did, n (weight of the vectors it is linked with) and root (a vector of its component) from the groups."""

    def compare(g: pa.RecordBatch) -> pa.RecordBatch | None:
        if len(g) < 2:
            return None
        dim, tab = g.column("dim")[0].as_py(), g.column("tab")[0].as_py()
        x, side = unit_rows(g.column("embedding"), dim), g.column("side").to_numpy()
        did, w = g.column("did").to_numpy(), g.column("w").to_numpy().astype(np.float64)
        ball = g.column("ball").fill_null(-1).to_numpy()
        signs = np.asarray(g.column("signs").flatten()).reshape(len(g), -1)[:, :tab]
        i, j = (np.flatnonzero(side == s) for s in ((0, 1) if side.any() else (0, 0)))
        ok = x[i] @ x[j].T >= threshold
        ok &= ~((ball[i][:, None] == ball[j]) & (ball[i] >= 0)[:, None])
        ok &= did[i][:, None] != did[j]
        r, c = np.nonzero(ok)
        if tab and len(r):  # a pair counts in the first table where it meets
            ok[r, c] = ~(signs[i[r]] == signs[j[c]]).any(axis=1)
        if not ok.any():
            return None
        n = np.zeros(len(g))
        n[i] += ok @ w[j]
        if side.any():
            n[j] += w[i] @ ok
        root, before = np.arange(len(g)), None
        while before is None or (root != before).any():
            before = root.copy()
            root[i] = np.minimum(root[i], np.where(ok, root[j], len(g)).min(axis=1))
            root[j] = np.minimum(root[j], np.where(ok, root[i][:, None], len(g)).min(axis=0))
        hit = n > 0
        return pa.record_batch({"did": pa.array(did[hit], pa.int64()), "n": pa.array(n[hit].astype(np.int64), pa.int64()),
                                "root": pa.array(did[root[hit]], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        for batch in batches:
            whole = pa.Table.from_batches([*open_, batch]).combine_chunks().to_batches()[0]
            new = np.zeros(len(whole) - 1, dtype=bool)
            for c in _GROUP:
                v = whole.column(c)
                new |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
            at = [0, *(np.flatnonzero(new) + 1).tolist()]
            for lo, hi in zip(at[:-1], at[1:]):
                if (out := compare(whole.slice(lo, hi - lo))) is not None:
                    yield out
            open_ = [whole.slice(at[-1])]
        if open_ and (out := compare(open_[0])) is not None:
            yield out

    return groups.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, "did long, n long, root long")


def near_vectors(vectors: DataFrame, threshold: float = 0.93, miss: float = MISS, block: int = BLOCK,
                 balls: int = BALLS, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Rows are linked if their labels are equal and not null and the cosine of their vectors, in double
    precision, is at least ``threshold``.  Pairs are found by sign hashes of random hyperplanes in several tables
    (``hash_plan``; all rows, no cap) and every one is checked exactly, or follows from the angles to
    a ball's centre.  Equal vectors are compared once and count by their number.  No pair is written:
    groups give numbers of links and one edge a vector.

    A row whose label is null, or whose vector is null, empty, all zero or holds a null or
    non-finite component links with nothing, and vectors of different lengths do not link.  component_id is
    the smallest vec_id in reach; rows without a vec_id link and are counted, and have a null component_id only if nothing
    with an id is in reach.  Repeated rows are vectors of their own.  Other columns are ignored; an empty table
    gives no rows.
    """
    rows = stage(vectors.select(
        F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"), F.col("embedding"),
        usable(F.col("embedding"), F.col("label")).alias("usable")), "vectors")
    good = rows.filter("usable").withColumn("dim", F.size("embedding"))
    key = ["label", "embedding"]
    distinct = good.groupBy(*key).agg(F.min("rid").alias("did"), F.count("*").alias("w"), F.min("vec_id").alias("low"),
                                      F.first("dim").alias("dim"))
    distinct = stage(distinct.select("did", "w", "low", "label", "dim", "embedding"), "vectors-distinct")
    sizes = distinct.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    bits, tables = hash_plan(sizes["most"] or 1, threshold, miss, block)
    signed = stage(_signed(distinct.drop("low"), bits, tables, seed), "vectors-signed")
    placed = stage(_balls(signed, sizes["all"] or 0, threshold, block, balls), "vectors-placed")
    linked = stage(_linked(_comparisons(placed, block), threshold), "vectors-linked")
    ball = placed.filter("ball is not null").groupBy("ball").agg(F.sum("w").alias("ball_w"), F.min("did").alias("root"))
    members = placed.filter("ball is not null").select("did", "w", "ball").join(ball, "ball")
    edges = linked.select(F.col("did").alias("a"), F.col("root").alias("b")).unionByName(
        members.select(F.col("did").alias("a"), F.col("root").alias("b"))).filter("a <> b")
    whole = components(edges, "vector-components")
    counted = linked.select("did", "n").unionByName(members.select("did", (F.col("ball_w") - F.col("w")).alias("n"))).groupBy("did").agg(
        F.sum("n").alias("n"))
    reach = distinct.select("did", "low").join(whole.select(F.col("node").alias("did"), "component"), "did")
    lowest = reach.groupBy("component").agg(F.min("low").alias("lowest"))
    table = distinct.select("did", "w", "low").join(counted, "did", "left").join(
        whole.select(F.col("node").alias("did"), "component"), "did", "left").join(lowest, "component", "left").select(
        "did", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("lowest", "low").alias("lowest"))
    own = good.select("rid", *key).join(distinct.select(*key, "did"), key).select("rid", "did")
    found = rows.select("rid", "vec_id").join(own.join(table, "did"), "rid", "left")
    component = F.coalesce("lowest", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                        F.col("vec_id").eqNullSafe(component).alias("kept"))
