"""Quality rules whose cutoffs carry a bound on the share of good documents they reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spellpanel.llm.common import BLANKS, packed, unpacked, words_of
from spellpanel.session import stage

SYMBOLS = "#*$%&|<>"

#: Statistic and the cutoffs it may get; a document is rejected when it is above the cutoff.
RULES = {
    "symbol_share": (0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 1.5, 2.0),
    "repeat_share": (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45),
    "dup_line_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "long_words": (5.5, 5.75, 6.0, 6.25, 6.5, 7.0, 7.5, 8.0),
    "short_words": (-4.5, -4.25, -4.0, -3.75, -3.5, -3.25, -3.0, -2.5),
}


def text_statistics(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of a whole text.

    Everything is built-in functions on the one row.  Windows of three words are hashed,
    sorted inside the row and compared with their neighbours, so a long text costs
    n log n and nothing is shuffled.  Null and blank texts give zeros.
    """
    whole = F.coalesce(text, F.lit(""))

    def windows(w: Column) -> Column:
        n = F.greatest(F.size(w) - 2, F.lit(0))
        pairs = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(pairs, F.slice(w, 3, n), lambda h, c: F.xxhash64(h, c))

    def repeated(s: Column) -> Column:
        places = F.filter(
            F.transform(s, lambda e, i: F.when(
                (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]), e["p"])),
            lambda p: p.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))

    def of_words(w: Column) -> Column:
        placed = F.sort_array(F.transform(windows(w), lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        # a one-element array names a value once, so that it is not computed for each use
        return F.struct(F.size(w).alias("n"), F.get(F.transform(F.array(placed), repeated), F.lit(0)).alias("r"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))

    by_words = F.get(F.transform(F.array(words_of(text)), of_words), F.lit(0))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    by_lines = F.get(F.transform(F.array(lines), of_lines), F.lit(0))
    return {
        "by_words": by_words,
        "by_lines": by_lines,
        "word_chars": F.length(F.translate(whole, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
    }


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """One row a document: the kept columns, the statistics, base_failed."""
    rows = docs.select(*keep, *[c.alias(n) for n, c in text_statistics(F.col("text")).items()])
    return rows.select(
        *keep,
        F.col("by_words.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("by_lines.n").cast("long").alias("n_lines"),
        (F.col("by_lines.n") - F.col("by_lines.d")).cast("long").alias("n_dup_lines"),
        F.col("by_words.r").cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def measures() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "long_words": F.col("word_chars") / words,
        "short_words": -(F.col("word_chars") / words),
    }


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1 by Stirling's series at x + 8; absolute error below 1e-9."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z)
    shift = F.log(x)
    for step in range(1, 8):
        shift = shift + F.log(x + step)
    return series - shift


def lower_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exact to rounding; 1 from the mean on, where no bound can hold.

    Sums the terms from k downwards.  They fall faster than a normal density, so after
    12 standard deviations the rest is below the rounding of the sum.
    """
    top = (log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
           + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    steps = F.least(k, F.ceil(12 * F.sqrt(n * p)) + 60).cast("int")
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(acc: Column, j: Column) -> Column:
        i = k - j + 1
        t = acc["t"] * i / (n - i + 1) * ((1 - p) / p)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    down = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top) * F.aggregate(down, start, add, lambda acc: acc["s"]))


def risk_controlled_cutoffs(stats: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05,
                            confidence: float = 0.95) -> DataFrame:
    """The cutoff of each rule and stratum: columns stratum, rule, cutoff (null: the rule is off).

    The labelled documents that pass the base rules are the holdout; they set no cutoff
    beforehand, since the candidates are fixed values.  A candidate is admissible when the
    exact binomial (Clopper-Pearson) upper bound on the share of good documents it rejects
    is at most ``risk / rules``, at a level of ``(1 - confidence) / (strata * candidates)``:
    Bonferroni over every test made.  So with the stated confidence no stratum loses more
    than ``risk`` of its good documents to all rules together.  Among the admissible
    candidates the one that best separates bad from good is taken, the mildest in a tie.
    All labels count; one document with several labels has its lowest quality.
    """
    quality = labels.groupBy("doc_id").agg(F.min("quality").alias("_quality")).filter("_quality in (0, 1)")
    held = stats.filter(~F.col("base_failed")).join(quality, "doc_id")
    cut = {r: F.array(*[F.lit(float(c)) for c in v]) for r, v in RULES.items()}
    value = measures()

    def reached(rule: str) -> Column:
        return F.size(F.filter(cut[rule], lambda c: value[rule] > c))

    passed = held.select(
        F.col(stratum).alias("stratum"), "_quality",
        F.explode(F.array(*[
            F.struct(F.lit(r).alias("rule"), cut[r].alias("cutoffs"), reached(r).alias("reached"))
            for r in RULES])).alias("x"),
    )
    counted = passed.groupBy("stratum", "x.rule", "x.cutoffs", "x.reached").agg(
        F.sum("_quality").alias("good"), F.sum(1 - F.col("_quality")).alias("bad"))
    tests = counted.select("stratum").distinct().agg(
        (F.count(F.lit(1)) * sum(len(v) for v in RULES.values())).alias("tests"))
    each = Window.partitionBy("stratum", "rule")
    table = counted.withColumns({"n_good": F.sum("good").over(each), "n_bad": F.sum("bad").over(each)}).select(
        "stratum", "rule", "good", "bad", "n_good", "n_bad", F.posexplode("cutoffs").alias("place", "cutoff"), "reached")
    rejected = table.groupBy("stratum", "rule", "place", "cutoff", "n_good", "n_bad").agg(
        F.sum(F.when(F.col("reached") > F.col("place"), F.col("good")).otherwise(0)).alias("lost"),
        F.sum(F.when(F.col("reached") > F.col("place"), F.col("bad")).otherwise(0)).alias("caught"))
    tail = lower_tail(F.col("lost").cast("double"), F.col("n_good").cast("double"), risk / len(RULES))
    judged = rejected.join(F.broadcast(tests)).withColumns({
        "safe": (tail <= (1 - confidence) / F.col("tests")) & (F.col("caught") > 0),
        "gain": F.col("caught") / F.greatest("n_bad", F.lit(1)) - F.col("lost") / F.greatest("n_good", F.lit(1)),
    })
    best = F.max(F.when(F.col("safe") & (F.col("gain") > 0), F.struct("gain", "place", "cutoff")))
    return judged.groupBy("stratum", "rule").agg(best["cutoff"].alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05,
                  confidence: float = 0.95) -> DataFrame:
    """Every document with its statistics, base_failed and kept.

    Null or blank text fails the base rules (no words).  A null stratum is a stratum of its
    own.  A stratum without labels, or with too few for the bound, has no active rule, so
    only the base rules reject there.  Repeated rows are judged each.  Empty tables give
    no rows, or no active rule.  Other columns of either table are ignored.
    """
    stats = stage(with_statistics(docs.select("doc_id", F.col(stratum).alias("_stratum"), "text"),
                                  "doc_id", "_stratum"), "quality-statistics")
    cutoffs = risk_controlled_cutoffs(stats, labels.select("doc_id", "quality"), "_stratum", risk, confidence)
    wide = cutoffs.groupBy(F.col("stratum").alias("of")).pivot("rule", list(RULES)).agg(F.first("cutoff"))
    joined = stats.join(wide, F.col("_stratum").eqNullSafe(F.col("of")), "left")
    value = measures()
    hit = F.lit(False)
    for rule in RULES:
        hit = hit | F.coalesce(value[rule] > F.col(rule), F.lit(False))
    return joined.select(
        "doc_id", F.col("_stratum").alias(stratum), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", (~F.col("base_failed") & ~hit).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05,
                   confidence: float = 0.95) -> DataFrame:
    """The documents that pass, with all their columns, whatever their names; the text is read once more, not shuffled.

    Nulls, repeated rows and empty tables are taken as in ``quality_rules``.
    """
    stats = with_statistics(packed(docs, "doc_id", F.col(stratum).alias("_stratum"), "text"), "doc_id", "_stratum", "_row")
    slim = stage(stats.drop("_row"), "quality-statistics")
    cutoffs = stage(risk_controlled_cutoffs(slim, labels.select("doc_id", "quality"), "_stratum", risk, confidence),
                    "quality-cutoffs")
    wide = cutoffs.groupBy(F.col("stratum").alias("_of")).pivot("rule", list(RULES)).agg(F.first("cutoff"))
    value = measures()
    hit = F.lit(False)
    for rule in RULES:
        hit = hit | F.coalesce(value[rule] > F.col(f"_cut.{rule}"), F.lit(False))
    cut = wide.select("_of", F.struct(*RULES).alias("_cut"))
    judged = stats.join(cut, F.col("_stratum").eqNullSafe(F.col("_of")), "left").filter(~F.col("base_failed") & ~hit)
    return unpacked(judged, docs.columns)
