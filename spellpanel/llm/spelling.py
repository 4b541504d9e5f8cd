"""Spelling variants: words one code point apart, found through numbered trie nodes."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellpanel.session import stage

#: Letters of a word; A to Z are lower-cased, nothing else is.
LETTERS = re.compile("[a-zÀ-ÿ]+")
#: A word has at least this many code points and occurrences.
MIN_LENGTH, MIN_COUNT = 6, 5
#: A form has at least so many times the occurrences of its variant.
RATIO = 5
#: Distinct words a task counts before it sends them.
FLUSH = 500_000


def corpus_words(docs: DataFrame, typo: int | None = None, min_length: int = MIN_LENGTH,
                 min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: letter runs of the whole texts that are long and frequent enough.

    With ``typo``, one in that many (document, run) cases loses a code point, chosen by the checksum of
    ``<doc_id>:<run>`` (a null id is written as nothing).  Null and empty texts have no words; repeated
    rows count each.  Every task counts before it sends, so a very common word moves once a task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: Counter) -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                found = Counter(LETTERS.findall(text.encode().lower().decode()))  # bytes know ASCII letters only
                lead = zlib.crc32(("" if doc_id is None else str(doc_id)).encode() + b":")
                for word, n in found.items():
                    if len(word) < min_length:
                        continue
                    h = zlib.crc32(word.encode(), lead) if typo else 1
                    if typo and h % typo == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= FLUSH:
                    yield counted(held)
                    held = Counter()
        if held:
            yield counted(held)

    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def number_nodes(words: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``place`` (rank of ``column`` in code-point order, from 0) and ``nodes`` (trie nodes of its prefixes).

    ``nodes`` has the number of each prefix's node from length 1 on; equal prefixes, and only those, have
    equal numbers; the root is 0.  Words are range-sorted; a task numbers the nodes its words open
    beyond the prefix shared with the word before.  One row per task (its first and last word and the
    nodes of the last), which the driver folds, then says which nodes of its first word a task shares
    with those before it: as many rows as there are tasks, whatever the number of words.
    ``column`` must hold different non-null values.
    """
    names = [f for f in words.columns if f != column]

    def shared(a: str, b: str) -> int:
        if b.startswith(a):
            return len(a)
        low, high = 0, min(len(a), len(b))
        while low < high:  # the longest common prefix by bisection, so that slices compare at native speed
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
        return low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, path, opened, seen = "", [], 0, 0
        for batch in batches:
            out = []
            for word in batch.column(column).to_pylist():
                keep = shared(last, word)
                path = path[:keep] + list(range(opened + 1, opened + 1 + len(word) - keep))
                opened, last = opened + len(word) - keep, word
                out.append(path)
            yield pa.record_batch({
                **{c: batch.column(c) for c in kept},
                "_row": pa.array(range(seen, seen + len(out)), pa.int64()), "_nodes": pa.array(out, pa.list_(pa.int64()))})
            seen += len(out)

    kept = [*names, column, "_part"]
    types = {**dict(words.dtypes), "_part": "int"}
    ordered = words.repartitionByRange(column).sortWithinPartitions(column).withColumn("_part", F.spark_partition_id())
    local = stage(ordered.select(*kept).mapInArrow(
        run, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", _row long, _nodes array<long>"), name)

    # a row for each task, in order: how far its first word lies inside the trie before it
    heads = local.groupBy("_part").agg(
        F.min_by(column, "_row").alias("first"), F.max_by(column, "_row").alias("last"), F.count("*").alias("rows"),
        F.max(F.array_max("_nodes")).alias("nodes"), F.max_by("_nodes", "_row").alias("path")).orderBy("_part").collect()
    places, opened, rows, last, path = [], 0, 0, "", []
    for h in heads:
        keep = shared(last, h["first"])
        carried = path[:keep]
        places.append((h["_part"], rows, opened, carried))
        # local numbers 1, 2, ... of the first word's prefixes are those of the trie before, up to the shared length
        path = [carried[x - 1] if x <= keep else x + opened for x in h["path"]]
        opened, rows, last = opened + (h["nodes"] or 0), rows + h["rows"], h["last"]
    known = words.sparkSession.createDataFrame(places, "_part int, _rows long, _opened long, _carried array<long>")
    number = F.transform("_nodes", lambda x: F.when(
        x <= F.size("_carried"), F.element_at("_carried", x.cast("int"))).otherwise(x + F.col("_opened")))
    return local.join(F.broadcast(known), "_part").select(
        *names, column, (F.col("_row") + F.col("_rows")).alias("place"), number.alias("nodes"))


def _best(n: Column, place: Column) -> Column:
    """Larger for more occurrences, then for the word that comes first."""
    return F.struct(n.alias("n"), (-place).alias("before"))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, place, n_near and best (n and negative place of the best near word; null without one).

    Word and n come from ``words``.  Each word enters the dictionary under (prefix node, suffix node) for every
    position that is skipped, and for every position where something could be inserted.  Skips that meet
    differ by a replaced code point; a skip and an insertion place that meet, by an inserted one.  A key
    names all of a word but one code point, so it has at most one row for each letter and one more: lists
    of rows are bounded by the alphabet, and no pair is written.
    """
    forward = number_nodes(words, "word", "forward-trie")
    turned = number_nodes(forward.select("word", F.col("place").alias("id"), F.reverse("word").alias("turned")).drop("word"),
                          "turned", "reversed-trie")
    both = stage(forward.withColumnRenamed("nodes", "p").join(
        turned.select(F.col("id").alias("place"), F.reverse("nodes").alias("s")), "place"), "trie-nodes")

    # p[k - 1] is the node of the first k code points, s[k] that of what follows them
    def node(nodes: str, at: Column) -> Column:
        return F.coalesce(F.get(F.col(nodes), at), F.lit(0).cast("long"))

    letter = lambda k: F.get(F.col("letters"), k)
    spots = F.transform(F.sequence(F.lit(0), F.length("word")), lambda k: F.struct(
        k.alias("k"), node("p", k - 1).alias("prefix"), node("s", k).alias("rest"), node("s", k + 1).alias("skip"),
        # of equal letters in a row the first stands for their deletion
        F.when(k == F.length("word"), -1).when((k == 0) | (letter(k) != letter(k - 1)), 2).otherwise(1).alias("kind")))
    rows = both.withColumn("letters", F.split("word", "")).select("place", "n", F.explode(spots).alias("x"))
    keyed = rows.select("place", "n", "x.prefix", F.explode(F.array(
        F.struct(F.col("x.rest").alias("suffix"), F.lit(0).alias("kind")),
        F.struct(F.col("x.skip").alias("suffix"), F.col("x.kind").alias("kind")),
    )).alias("y")).select("place", "n", "prefix", "y.suffix", "y.kind").filter("kind >= 0")
    grouped = keyed.groupBy("prefix", "suffix").agg(
        F.collect_list(F.struct("n", (-F.col("place")).alias("before"), "kind")).alias("rows")).filter(F.size("rows") > 1)
    # kind 0: the place of an insertion (one at most), 1 and 2: a skip, 2 if it stands for a deletion
    whole = F.filter("rows", lambda r: r["kind"] == 0)
    skips = F.reverse(F.array_sort(F.filter("rows", lambda r: r["kind"] > 0)))
    leads = F.filter("skips", lambda r: r["kind"] == 2)
    plain = lambda r: F.struct(r["n"].alias("n"), r["before"].alias("before"))
    prepared = grouped.select(whole.alias("whole"), skips.alias("skips")).select("whole", "skips", leads.alias("leads"))
    one = F.when(F.size("whole") > 0, plain(F.get("whole", F.lit(0))))
    top = plain(F.get("skips", F.lit(0)))
    second = F.when(F.size("skips") > 1, plain(F.get("skips", F.lit(1))))
    seen = F.transform("skips", lambda r: F.struct(
        (-r["before"]).alias("place"),
        (F.size("skips") - 1 + F.when(r["kind"] == 2, F.size("whole")).otherwise(0)).cast("long").alias("near"),
        F.greatest(F.when(plain(r) == top, second).otherwise(top), F.when(r["kind"] == 2, one)).alias("best")))
    for_whole = F.transform("whole", lambda r: F.struct(
        (-r["before"]).alias("place"), F.size("leads").cast("long").alias("near"),
        F.when(F.size("leads") > 0, plain(F.get("leads", F.lit(0)))).alias("best")))
    each = prepared.select(F.explode(F.concat(seen, for_whole)).alias("z")).select("z.*").filter("near > 0")
    found = each.groupBy("place").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))
    return both.select("word", "n", "place").join(found, "place", "left").select(
        "word", "n", "place", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "best")


def spelling_variants(docs: DataFrame, typo: int | None = None, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n: the frequent words and what they are variants of.

    Two words are near if one inserted, deleted or replaced code point makes them equal.  A word's form is its
    near word of the largest n (ties: first in code-point order) if that has ``ratio`` times its n, else
    null; root follows forms to the last.  Null and empty texts have no words, repeated rows count
    each, other columns are ignored, an empty table gives no rows.
    """
    near = stage(near_words(stage(corpus_words(docs, typo), "words")), "near-words")
    linked = near.select("word", "n", "n_near", "place", F.when(
        F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("form"))
    # forms grow in n by the ratio at each step, so the chains are short; each round doubles what is followed
    step = stage(linked.filter("form is not null").select("place", (-F.col("form.before")).alias("to")), "forms")
    while True:
        ahead = step.select(F.col("place").alias("to"), F.col("to").alias("next"))
        moved = stage(step.join(ahead, "to", "left").select("place", F.coalesce("next", "to").alias("to"),
                                                            F.col("next").isNotNull().alias("moved")), "roots")
        step = moved.select("place", "to")
        if moved.filter("moved").isEmpty():
            break
    named = near.select(F.col("place").alias("to"), F.col("word").alias("to_word"))
    roots = step.join(named, "to").select("place", F.col("to_word").alias("root"))
    forms = linked.filter("form is not null").select("place", (-F.col("form.before")).alias("to"), F.col("form.n").alias("form_n"))
    forms = forms.join(named, "to").select("place", F.col("to_word").alias("form"), "form_n").join(roots, "place")
    return near.select("word", "n", "n_near", "place").join(forms, "place", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
