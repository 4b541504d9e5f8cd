"""Language identification with error-correcting output codes over character n-grams."""

from __future__ import annotations

import itertools
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellpanel.llm.arrays import chunks, mixed

#: Hash buckets of the n-grams of one to three letters.
FEATURES = 1 << 15
#: Labelled documents per language, on average, whose bit errors set the decoding weights.
WEIGHT_SAMPLE = 2000
#: n-grams beyond which more text no longer sharpens a bit.
EVIDENCE = 200.0
UNKNOWN = "und"

_TABLE = 0x3000
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(_TABLE)]))
    return _letters[0]


def has_letter(points: np.ndarray) -> bool:
    """Whether a letter is among the code points; a combining mark, digit or sign by itself is none."""
    return any(unicodedata.category(chr(c))[0] == "L" for c in np.unique(points))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
    """n-gram buckets of all texts, where each text's start, and whether it has a letter.

    Texts are lower-cased, and every run of other characters counts as blanks.
    """
    parts = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    lettered = [t is not None and has_letter(p) for t, p in zip(texts, parts, strict=True)]
    blank = np.full(2, 32, dtype=np.uint32)
    joined = np.concatenate([x for p in parts for x in (p, blank)]).astype(np.uint64)
    low = joined < _TABLE
    keep = ~low
    keep[low] = _is_letter()[joined[low].astype(np.int64)]
    joined[~keep] = 32
    bounds = np.cumsum([0, *(len(p) + 2 for p in parts)])
    shift = np.uint64(21)
    one = joined[:-2]
    two = (one << shift) | joined[1:-1]
    three = (two << shift) | joined[2:]
    found = np.empty(3 * len(one), dtype=np.int64)
    for k, g in enumerate((one, two, three)):
        found[k::3] = (mixed(g + np.uint64(k << 1)) & np.uint64(FEATURES - 1)).astype(np.int64)
    return found, np.minimum(bounds * 3, len(found)), lettered


def code_words(languages: int, seed: int = 7) -> np.ndarray:
    """Matrix of -1 and 1, a row a language: every split for up to 7 languages, else random ones far apart."""
    if languages <= 7:
        rest = itertools.product((-1, 1), repeat=languages - 1)
        return np.array([(1, *r) for r in rest if -1 in r], dtype=np.float64).T.reshape(languages, -1)
    draw = np.random.default_rng(seed)
    length, best, chosen = math.ceil(10 * math.log2(languages)), -1, None
    for _ in range(100):
        m = draw.choice((-1.0, 1.0), (languages, length))
        if (np.abs(m.sum(axis=0)) == languages).any():
            continue
        apart = (length - m @ m.T) / 2 + np.eye(languages) * length
        if apart.min() > best:
            best, chosen = apart.min(), m
    return chosen


@dataclass
class LanguageCode:
    """Languages, their code words, log-odds of each n-gram for each bit, and decoding weights."""

    names: list[str]
    codes: np.ndarray
    odds: np.ndarray
    weights: np.ndarray

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, list[bool]]:
        """Log-odds of each bit, a row a text."""
        found, at, lettered = grams(texts)
        sums = np.zeros((len(texts), self.odds.shape[1]))
        for i in range(len(texts)):
            own = found[at[i] : at[i + 1]]
            for k in range(0, len(own), 1 << 16):
                sums[i] += self.odds[own[k : k + (1 << 16)]].sum(axis=0)
            sums[i] *= min(1.0, EVIDENCE / max(len(own), 1))
        return sums, lettered

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest code word by weighted logistic loss: its place, its share of belief, and the runner-up's."""
        loss = np.logaddexp(0, -self.codes[None] * margins[:, None, :])
        total = (loss * self.weights[None]).sum(axis=2)
        belief = np.exp(total.min(axis=1, keepdims=True) - total)
        belief /= belief.sum(axis=1, keepdims=True)
        order = np.sort(belief, axis=1)
        second = order[:, -2] if belief.shape[1] > 1 else np.zeros(len(belief))
        return belief.argmax(axis=1), order[:, -1], second


def fit(labelled: DataFrame, code: str = "lang", sample: int = WEIGHT_SAMPLE) -> LanguageCode | None:
    """Learn from all rows with a text and a language.

    n-grams are counted over every labelled row in one aggregate (languages times
    ``FEATURES`` rows reach the driver, whatever the input).  A bit's classifier is the
    log-odds of an n-gram between the languages on its two sides, each language with equal
    say.  The weights of loss-weighted decoding come from the bit accuracies on a hash-chosen
    sample of about ``sample`` rows a language.  None if there is nothing to learn from.
    """
    rows = labelled.filter(F.col(code).isNotNull() & F.col("text").isNotNull()).select(
        F.col(code).alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in chunks([t.encode() for t in texts], 1 << 18):
                found, at, _ = grams(texts[a:b])
                for i in range(a, b):
                    own = held.setdefault(langs[i], np.zeros(FEATURES, dtype=np.int64))
                    own += np.bincount(found[at[i - a] : at[i - a + 1]], minlength=FEATURES)
        for lang, own in held.items():
            hit = np.flatnonzero(own)
            yield pa.record_batch({"lang": pa.array([lang] * len(hit), pa.string()), "gram": pa.array(hit, pa.int32()),
                                   "n": pa.array(own[hit], pa.int64())})

    table = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")).toPandas()
    names = sorted(table["lang"].unique())
    if not names:
        return None
    counts = np.zeros((len(names), FEATURES))
    counts[np.searchsorted(names, table["lang"].to_numpy(dtype=str)), table["gram"]] = table["n"]
    chance = (counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * FEATURES)
    if len(names) == 1:
        return LanguageCode(names, np.ones((1, 1)), np.zeros((FEATURES, 1), dtype=np.float32), np.ones((1, 1)))
    codes = code_words(len(names))
    odds = np.stack([
        np.log(chance[codes[:, b] > 0].mean(axis=0)) - np.log(chance[codes[:, b] < 0].mean(axis=0))
        for b in range(codes.shape[1])], axis=1).astype(np.float32)
    model = LanguageCode(names, codes, odds, np.full(codes.shape, 1 / codes.shape[1]))

    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # text hash against a share per language: no sort, no group in one task; one row a language
    chosen = rows.join(F.broadcast(sizes), "lang").filter(
        F.pmod(F.xxhash64("text"), F.lit(1 << 30)) * F.col("n") < F.lit(sample << 30)).select("lang", "text")

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros(model.codes.shape)
        n = np.zeros(len(names))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = np.searchsorted(names, batch.column("lang").to_pylist())
            for a, b in chunks([t.encode() for t in texts], 1 << 18):
                margins, _ = model.margins(texts[a:b])
                for i, m in zip(own[a:b], margins, strict=True):
                    right[i] += model.codes[i] * m > 0
                    n[i] += 1
        for i in np.flatnonzero(n):
            yield pa.record_batch({"i": pa.array([i], pa.int32()), "right": pa.array([right[i]], pa.list_(pa.float64())),
                                   "n": pa.array([n[i]])})

    scored = chosen.mapInArrow(hits, "i int, right array<double>, n double").select(
        "i", "n", F.posexplode("right").alias("b", "r")).groupBy("i", "b").agg(F.sum("r") / F.sum("n")).collect()
    weights = np.full(codes.shape, 0.5)
    for i, b, share in scored:
        weights[i, b] = max(share, 0.01)
    model.weights = weights / weights.sum(axis=1, keepdims=True)
    return model


def predict(docs: DataFrame, model: LanguageCode | None, *keep: str, margin: float = 0.2) -> DataFrame:
    """The kept columns with lang_pred, score and ambiguous, from the whole text alone.

    ``und`` with score 0 for null texts, texts without a letter, and everything if the model
    is None.  ``ambiguous``: the runner-up's belief is within ``margin`` of the best.
    """
    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes),
                        "lang_pred string, score double, ambiguous boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            names, scores, doubt = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
            for a, b in chunks([(t or "").encode() for t in texts], 1 << 18) if model else ():
                margins, lettered = model.margins(texts[a:b])
                best, score, second = model.decode(margins)
                for i in range(b - a):
                    if lettered[i]:
                        names[a + i], scores[a + i] = model.names[best[i]], score[i]
                        doubt[a + i] = score[i] - second[i] < margin
            yield pa.record_batch({**{c: batch.column(c) for c in keep}, "lang_pred": pa.array(names, pa.string()),
                                   "score": pa.array(scores), "ambiguous": pa.array(doubt)})

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether an id is in the fold that is never learned from; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the other folds and predict every document: doc_id, held_out, lang_pred, score, ambiguous.

    Rows without an id are predicted but not learned from.  An empty table gives no rows.
    Repeated rows are predicted each; other columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(rows.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return predict(rows.drop("lang"), model, "doc_id", "held_out")
