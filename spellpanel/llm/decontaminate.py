"""Benchmark passages in documents: latent semantic retrieval, then common subsequences and answers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spellpanel.llm.arrays import chunks, mixed, word_hashes
from spellpanel.llm.common import packed, unpacked
from spellpanel.session import stage

#: Words per half of the passages that shape the latent space: a passage is two halves, and passages overlap by one.
HALF = 12
#: Sizes of the windows that are searched, each with its doubles; an item meets those nearest to its length.
WINDOWS = (4, 6)
#: Hash buckets of the words.
FEATURES = 1 << 15
#: Latent dimensions, and extra ones of the random projection.
RANK, EXTRA = 64, 16
#: Tasks a core that multiply all passages, features per block of a product, and chunks of texts multiplied at once.
PRODUCT_TASKS, BLOCK, JOINED = 2, 512, 8
#: Benchmark items sent to the tasks together; a larger benchmark goes in several blocks.
ITEM_BLOCK = 5_000
#: Share of the largest eigenvalue up to which another one is rounding noise.
NOISE = 1e-6
#: Cosine in the latent space from which a passage is looked at.
COSINE = 0.45
#: Share of the distinct text pieces from which a word is common, and registers of 32 bits that count the pieces of a word.
COMMON, REGISTERS = 0.002, 64


def window_size(n: int) -> int:
    """The window size nearest to n words."""
    sizes = [w << k for w in WINDOWS for k in range(max(n, 2).bit_length())]
    return min(sizes, key=lambda w: (abs(np.log(w / n)), w))


def windows(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of the windows of ``size`` words, a quarter apart, of texts that start at ``at``.

    The last window of a text ends with it, and a shorter text is one window.
    """
    lengths, step = np.diff(at), size // 4
    last = np.maximum(lengths - size, 0)
    times = np.where(lengths > 0, 1 - -last // step, 0)
    text = np.repeat(np.arange(len(lengths)), times)
    k = np.arange(len(text)) - np.repeat(np.cumsum(times) - times, times)
    start = at[:-1][text] + np.minimum(k * step, last[text])
    return text, start, np.minimum(start + size, at[1:][text])


def distinct_counts(seen: np.ndarray) -> np.ndarray:
    """Estimated number of distinct pieces behind each sketch of ``REGISTERS`` x 32 bits.

    Counts that leave a third of the registers empty come from the number of empty ones (Whang et al.,
    1990), which is nearly exact for few pieces, larger ones from the ranks (Flajolet and Martin, 1985).
    """
    bits = np.pad(seen.reshape(len(seen), REGISTERS, 32), ((0, 0), (0, 0), (0, 1)))
    mean = bits.argmin(axis=2).mean(axis=1)  # lowest rank not seen
    ranked = REGISTERS / 0.77351 * (np.exp2(mean) - np.exp2(-1.75 * mean))
    empty = REGISTERS - bits.any(axis=2).sum(axis=1)
    return np.where(empty > REGISTERS / 3, REGISTERS * np.log(REGISTERS / np.maximum(empty, 1)), ranked)


def word_weights(docs: DataFrame) -> tuple[np.ndarray, int]:
    """TF-IDF weight of each feature, and the number of words of all documents.

    Texts are cut into pieces at words whose hash ends in three zero bits, and the distinct pieces that
    hold a feature are counted by a sketch over all documents, so a passage with many copies does not make
    its own words common.  Sketches are united by bitwise or, so the weights depend neither on the
    order of rows nor on the tasks.  Words in more than ``COMMON`` of the pieces weigh next to nothing.
    One aggregate gives ``FEATURES`` + 1 rows at most; the last one sketches all pieces.  The tasks estimate
    the counts, and only those numbers come to the driver.
    """
    sketch = [f"s{i}" for i in range(REGISTERS // 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n_words = np.zeros((FEATURES + 1, REGISTERS * 32), dtype=bool), 0
        flat = seen.reshape(-1)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts):
                words, at = word_hashes(texts[a:b])
                if not len(words):
                    continue
                starts = np.unique(np.concatenate([np.flatnonzero((words[:-1] & np.uint64(7)) == 0) + 1, at[:-1]]))
                starts = starts[starts < len(words)]
                piece = mixed(np.add.reduceat(words, starts))
                rest = (piece >> np.uint64(8)) | np.uint64(1 << 31)
                rank = np.log2((rest & (~rest + np.uint64(1))).astype(np.float64)).astype(np.int64)
                cell = (piece & np.uint64(REGISTERS - 1)).astype(np.int64) * 32 + rank
                features = (words & np.uint64(FEATURES - 1)).astype(np.int64)
                flat[features * (REGISTERS * 32) + np.repeat(cell, np.diff(np.append(starts, len(words))))] = True
                seen[FEATURES, cell] = True
                n_words += len(words)
        hit = np.flatnonzero(seen.any(axis=1))
        packed = np.packbits(seen[hit], axis=1).view(np.int64)
        yield pa.record_batch({
            "feature": pa.array(hit, pa.int32()), "n": pa.array(np.where(hit == FEATURES, n_words, 0), pa.int64()),
            **{c: pa.array(packed[:, i].copy(), pa.int64()) for i, c in enumerate(sketch)}})

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            united = np.stack([batch.column(c).to_numpy() for c in sketch], axis=1).view(np.uint8)
            found = [distinct_counts(np.unpackbits(united[k : k + BLOCK], axis=1)) for k in range(0, len(united), BLOCK)]
            yield pa.record_batch({"feature": batch.column("feature"), "n": batch.column("n"),
                                   "count": pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())})

    rows = docs.select(F.col("text").cast("binary")).mapInArrow(
        run, ", ".join(["feature int", "n long", *(f"{c} long" for c in sketch)])).groupBy("feature").agg(
        F.sum("n").alias("n"), *[F.bit_or(c).alias(c) for c in sketch]).mapInArrow(
        estimate, "feature int, n long, count double").toPandas()
    counts = np.zeros(FEATURES + 1)
    counts[rows["feature"].to_numpy()] = rows["count"].to_numpy()
    pieces = counts[FEATURES]
    idf = np.log((1 + pieces) / (1 + counts[:FEATURES])) + np.log(min(1.0, max(COMMON, 20 / max(pieces, 1))))
    return np.maximum(idf, 0.05), int(rows["n"].sum())


def halves(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the halves of all texts that start at ``at``, the halves that begin a passage, and those with a second half.

    A passage is a half and the next one of the same text.  A short end joins the half before it, and a
    text of one half is one passage.
    """
    lengths = np.diff(at)
    times = np.where(lengths > 0, -(-np.maximum(lengths - HALF // 2, 1) // HALF), 0)
    text = np.repeat(np.arange(len(lengths)), times)
    k = np.arange(len(text)) - np.repeat(np.cumsum(times) - times, times)
    two = k + 1 < times[text]
    return at[:-1][text] + k * HALF, np.flatnonzero(two | (times[text] == 1)), np.flatnonzero(two)


def group_sums(values: np.ndarray, which: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[which], row by row, of the groups of ``which`` that begin at ``starts`` and cover it.

    The groups are taken by falling size and their members rank by rank, so that no list of all members
    is made; the few largest groups are finished one at a time.
    """
    sizes = np.diff(np.append(starts, len(which)))
    order = np.argsort(-sizes, kind="stable")
    first, falling = starts[order], -sizes[order]
    total = values.take(which[first], axis=0, mode="clip")  # no place is outside; clip lets take write without a copy
    member = np.empty_like(total)
    rank, left = 1, int(np.searchsorted(falling, -1))
    while left > 64:
        total[:left] += values.take(which[first[:left] + rank], axis=0, out=member[:left], mode="clip")
        rank += 1
        left = int(np.searchsorted(falling, -rank))
    for i in range(left):
        for k in range(first[i] + rank, first[i] - falling[i], 4096):
            total[i] += values[which[k : min(k + 4096, first[i] - falling[i])]].sum(axis=0)
    out = np.empty_like(total)
    out[order] = total
    return out


def joined_words(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``word_hashes`` of ``JOINED`` neighbouring chunks at a time: a feature in several of them is added up once."""
    parts = [(a, b) for a, b in chunks(texts)]
    for k in range(0, len(parts), JOINED):
        found = [word_hashes(texts[a:b]) for a, b in parts[k : k + JOINED]]
        before = np.cumsum([0, *(len(words) for words, _ in found)])
        yield (np.concatenate([words for words, _ in found]),
               np.concatenate([*(at[:-1] + n for (_, at), n in zip(found, before)), before[-1:]]))


def passage_product(words: np.ndarray, at: np.ndarray, weight: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features, and their rows of A'A right, for the unit TF-IDF rows A of all passages of the texts.

    ``side`` holds the rows of the right matrix times their weight; the rows returned still lack their
    feature's weight.  A passage's image is the sum of its halves, so each word is read and written once.
    """
    features = (words & np.uint64(FEATURES - 1)).astype(np.uint16)
    start, first, two = halves(at)
    norm = np.add.reduceat((weight * weight)[features], start)  # squared
    norm[two] += norm[two + 1]
    image = group_sums(side, features, start)
    image[two] += image[two + 1]
    image /= np.maximum(norm, 1e-18)[:, None]
    back, before = image, image[two]
    back[np.setdiff1d(np.arange(len(start)), first, assume_unique=True)] = 0
    back[two + 1] += before
    half = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(words))))
    by = np.argsort(features, kind="stable")
    ordered = features[by]
    each = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[each], group_sums(back, half[by], each)


def _gram_product(texts: DataFrame, weight: np.ndarray, side: np.ndarray) -> np.ndarray:
    """A' A right for the TF-IDF rows A of all passages: partial products per task, summed by block of features.

    ``side`` holds the rows of the right matrix times their weight.  The sums are written, and the driver
    reads them a few blocks at a time into the one matrix it returns.
    """
    width = side.shape[1]
    context = texts.sparkSession.sparkContext
    sent = context.broadcast((weight, side))
    fields = "block int, part binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, side = sent.value
        total = np.zeros((FEATURES, width))
        for batch in batches:
            for words, at in joined_words(batch.column("text").to_pylist()):
                if len(words):
                    features, rows = passage_product(words, at, weight, side)
                    total[features] += rows
        for k in range(0, FEATURES, BLOCK):
            part = total[k : k + BLOCK].astype(np.float32)
            if part.any():
                part *= weight[k : k + BLOCK, None]
                yield pa.record_batch({"block": pa.array([k], pa.int32()), "part": pa.array([part.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # the blocks of one task, however many parts they have
        for batch in batches:
            for k, part in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(part, dtype=np.float32).astype(np.float64)
        for k, part in total.items():
            yield pa.record_batch({"block": pa.array([k], pa.int32()),
                                   "part": pa.array([part.astype(np.float32).tobytes()], pa.binary())})

    tasks = PRODUCT_TASKS * context.defaultParallelism  # each sends one matrix, so input splits share them
    parts = texts.select(F.col("text").cast("binary")).coalesce(tasks).mapInArrow(run, fields)
    summed = stage(parts.repartition("block").mapInArrow(add, fields), "leaks-product")
    sent.destroy()
    out = np.zeros((FEATURES, width), dtype=np.float32)
    for r in summed.toLocalIterator():  # FEATURES x width numbers, whatever the corpus
        out[r["block"] : r["block"] + BLOCK] = np.frombuffer(r["part"], dtype=np.float32).reshape(-1, width)
    return out


def orthonormal(image: np.ndarray) -> np.ndarray:
    """Orthonormal basis of the columns: QR of each ``BLOCK`` rows, then of their triangles, so only a block is copied at a time."""
    width, blocks = image.shape[1], range(0, len(image), BLOCK)
    basis = np.empty(image.shape)
    triangles = np.empty((len(blocks), width, width))
    for i, k in enumerate(blocks):
        basis[k : k + BLOCK], triangles[i] = np.linalg.qr(image[k : k + BLOCK].astype(np.float64))
    turns = np.linalg.qr(triangles.reshape(-1, width))[0].reshape(-1, width, width)
    for k, turn in zip(blocks, turns, strict=True):
        basis[k : k + BLOCK] = basis[k : k + BLOCK] @ turn
    return basis


def latent_space(docs: DataFrame, benchmark: DataFrame, idf: np.ndarray, seed: int = 5) -> np.ndarray:
    """FEATURES x RANK matrix from words to the latent space, with idf weights, by randomised SVD.

    A random matrix is multiplied with A'A (one power step), made orthonormal, and turned to
    the eigenvectors of the small projected matrix.  A holds all passages of the benchmark and of
    the corpus; it is not stored, both products read the texts.  The driver works block by block and
    holds one double and two single precision matrices at most.
    """
    texts = benchmark.select("text").unionByName(docs.select("text"))
    width, weight, draw = RANK + EXTRA, idf.astype(np.float32), np.random.default_rng(seed)
    blocks = [slice(k, k + BLOCK) for k in range(0, FEATURES, BLOCK)]
    side = np.empty((FEATURES, width), dtype=np.float32)
    for k in blocks:
        side[k] = draw.standard_normal((BLOCK, width))
    side *= weight[:, None]
    basis = orthonormal(_gram_product(texts, weight, side))
    side[:] = basis
    side *= weight[:, None]
    image = _gram_product(texts, weight, side)
    small = sum(basis[k].T @ image[k].astype(np.float64) for k in blocks)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(values)[::-1][:RANK]
    # left singular vectors: no direction outweighs another, so the language of a text does not decide
    # directions below the rounding of the single-precision products are noise and get none
    real = values[top] > values[top[0]] * NOISE
    columns = turn[:, top] * np.where(real, 1 / np.sqrt(np.where(real, values[top], 1)), 0)
    space = np.empty((FEATURES, RANK), dtype=np.float32)
    for k in blocks:
        space[k] = idf[k, None] * (basis[k] @ columns)
    return space


def running_sums(values: np.ndarray, which: np.ndarray, dtype: type) -> np.ndarray:
    """Sums of the first 0, 1, ... rows of values[which]: inside blocks of 16 rows, then over the blocks."""
    sums = np.zeros((1 + -(-len(which) // 16) * 16, values.shape[1]), dtype=dtype)
    values.astype(dtype, copy=False).take(which, axis=0, out=sums[1 : len(which) + 1], mode="clip")
    blocks = sums[1:].reshape(-1, 16, values.shape[1])
    for k in range(1, 16):
        blocks[:, k] += blocks[:, k - 1]
    blocks[1:] += np.cumsum(blocks[:-1, -1], axis=0)[:, None]
    return sums[: len(which) + 1]


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    answer: np.ndarray

    def __post_init__(self) -> None:
        self.listed = self.words.tolist()
        self.own = set(self.listed)


def answer_words(text: str) -> str:
    """The part of an item that gives its answer away: its last sentence, or its last words if that is short or all."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip()]
    if len(parts) > 1 and len(parts[-1].split()) >= 3:
        return parts[-1]
    return " ".join(text.split()[-5:])


class Places:
    """Where words stand in a sorted vocabulary: a table of their low bits, and a search where several words share an entry."""

    def __init__(self, vocabulary: np.ndarray) -> None:
        self.vocabulary = vocabulary
        self.mask = np.uint64((1 << min(24, len(vocabulary).bit_length() + 4)) - 1)
        entry = (vocabulary & self.mask).astype(np.int64)
        self.table = np.zeros(int(self.mask) + 1, dtype=np.int32)
        self.table[entry] = np.arange(len(vocabulary))
        self.several = np.bincount(entry, minlength=len(self.table)) > 1

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words the vocabulary has, and the places of those."""
        entry = (words & self.mask).astype(np.int64)
        place = self.table[entry]
        rest = np.flatnonzero(self.several[entry])
        place[rest] = np.minimum(np.searchsorted(self.vocabulary, words[rest]), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[place] == words)
        return hit, place[hit]


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = places.get(x)
        if hit is not None:
            kept = row & hit
            row = ((row + kept) | (row - kept)) & full
    return len(a) - row.bit_count()


def _find(docs: DataFrame, items: list[Item], space: np.ndarray, share: float, loose: float,
          cosine: float) -> tuple[DataFrame, Broadcast]:
    """Verified pairs of documents and a block of items, and what their tasks are sent."""
    vectors = np.stack([space[(i.words & np.uint64(FEATURES - 1)).astype(np.int64)].sum(axis=0) for i in items])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    sizes = np.array([window_size(len(i.words)) for i in items])
    levels = [(int(w), np.flatnonzero(sizes == w), vectors[sizes == w].T.copy()) for w in np.unique(sizes)]
    vocabulary, flat = np.unique(np.concatenate([i.words for i in items]), return_inverse=True)
    lengths = np.array([len(i.words) for i in items])
    least = min(share, loose)
    # the fewest different words that can be enough words of some item
    falling = [np.sort(np.unique(i.words, return_counts=True)[1])[::-1] for i in items]
    fewest = min(int(np.searchsorted(np.append(0, np.cumsum(x)), least * x.sum())) for x in falling)
    sent = docs.sparkSession.sparkContext.broadcast((items, levels, Places(vocabulary), flat, lengths, space))

    def verify(words: np.ndarray, first: int, last: int, item: Item) -> tuple[int, bool, int] | None:
        """Common words, whether the answer is among them, and where the region starts."""
        n = len(item.words)
        a, b = max(0, first - n), min(len(words), last + n)
        region = words[a:b]
        held = item.own.intersection(region.tolist())
        if sum(map(held.__contains__, item.listed)) < least * n:
            return None
        common = common_length(item.words, region)
        answered = common_length(item.answer, region) == len(item.answer)
        if common >= share * n or (common >= loose * n and answered):
            return common, answered, a
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, levels, places_of, flat, lengths, space = sent.value
        first_word = np.cumsum(lengths) - lengths

        def possible(words: np.ndarray, at: np.ndarray) -> dict[int, np.ndarray]:
            """The texts that have enough words of some item anywhere, and those items; no other text can be verified."""
            hit, place = places_of.find(words)
            bounds, found = np.searchsorted(hit, at).tolist(), {}
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if b - a < fewest:
                    continue
                held = np.zeros(len(places_of.vocabulary), dtype=np.int32)
                held[place[a:b]] = 1
                able = np.add.reduceat(held[flat], first_word) >= least * lengths
                if able.any():
                    found[i] = able
            return found

        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            rows = []
            for a, b in chunks(texts):
                words, at = word_hashes(texts[a:b])
                able = possible(words, at)
                if not able:
                    continue
                chosen = np.array(list(able))
                mine = np.zeros(b - a, dtype=bool)
                mine[chosen] = True
                words, at = words[np.repeat(mine, np.diff(at))], np.append(0, np.cumsum(np.diff(at)[chosen]))
                known = [set(np.flatnonzero(x).tolist()) for x in able.values()]
                # running sums, so that a window of any size is one difference
                sums = running_sums(space, (words & np.uint64(FEATURES - 1)).astype(np.int64),
                                    np.float32 if len(words) < 1 << 17 else np.float64)
                best: dict[tuple[int, int], list] = {}
                for size, which, columns in levels:
                    text, start, end = windows(at, size)
                    wanted = set(which.tolist())
                    able_here = np.array([not wanted.isdisjoint(x) for x in known])[text]
                    text, start, end = text[able_here], start[able_here], end[able_here]
                    for k in range(0, len(text), 4096):
                        placed = sums[end[k : k + 4096]] - sums[start[k : k + 4096]]
                        norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", placed, placed)), 1e-9)
                        near = placed @ columns
                        near /= norm[:, None]
                        for p, q in zip(*(x.tolist() for x in np.nonzero(near >= cosine))):
                            i, item = int(text[k + p]), int(which[q])
                            if item in known[i]:
                                best.setdefault((i, item), []).append((float(near[p, q]), int(start[k + p] - at[i]), int(end[k + p] - at[i])))
                for (i, item), places in best.items():
                    # neighbouring windows share their region: the best one of each region is enough
                    text_words = words[at[i] : at[i + 1]]
                    places.sort(reverse=True)
                    tried: list[int] = []
                    reach = len(own[item].words) // 2
                    for score, first, last in places:
                        if any(abs(first - t) <= reach for t in tried):
                            continue
                        tried.append(first)
                        found = verify(text_words, first, last, own[item])
                        if found:
                            rows.append((ids[a + int(chosen[i])], own[item].item_id, score, *found, len(own[item].words)))
                            break
            yield pa.record_batch({
                "doc_id": pa.array([r[0] for r in rows], pa.int64()), "item_id": pa.array([r[1] for r in rows], pa.int64()),
                "cosine": pa.array([r[2] for r in rows], pa.float64()),
                "common_words": pa.array([r[3] for r in rows], pa.int64()),
                "answered": pa.array([r[4] for r in rows], pa.bool_()),
                "region": pa.array([r[5] for r in rows], pa.int64()),
                "item_words": pa.array([r[6] for r in rows], pa.int64())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        run, "doc_id long, item_id long, cosine double, common_words long, answered boolean, region long, item_words long"), sent


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, loose: float = 0.6,
                 cosine: float = COSINE) -> DataFrame:
    """Pairs of documents and benchmark items whose passage the document holds, verbatim or paraphrased.

    1. Frequencies of hashed words, over all documents (``word_weights``).
    2. A latent space from a distributed randomised SVD of the TF-IDF passages of all texts (``latent_space``).
    3. Windows of whole documents, as long as an item and a quarter apart (``windows``), are placed
       in it and compared with the items of that length, which go to the tasks in blocks of
       ``ITEM_BLOCK``; the cosine selects.  A document without enough words of any such item, wherever they
       stand, cannot pass step 4 and is not placed.
    4. A selected region counts if the longest common subsequence with the item has ``share`` of its
       words, or ``loose`` of them and the item's answer (its last sentence) whole.

    Returns doc_id, item_id, cosine (of the window that led there), common_words, answered, region
    (first word), item_words: one row a pair.  Null or blank texts, on either side, match nothing;
    rows with the same id are one document, for which the row with most common words stays.  Empty
    tables give no rows.  Other columns are ignored.
    """
    return _pairs(docs, benchmark, share, loose, cosine)[0]


def _pairs(docs: DataFrame, benchmark: DataFrame, share: float, loose: float,
           cosine: float) -> tuple[DataFrame, list[Broadcast]]:
    """The rows of ``contaminated``, and what their tasks are sent: kept by the driver until destroyed."""
    keyed = benchmark.select("item_id", F.col("text").cast("string"))
    idf, _ = word_weights(docs)
    space = latent_space(docs, keyed, idf)
    found = None
    block: list[Item] = []
    sent: list[Broadcast] = []

    def add() -> None:
        nonlocal found, block
        part, tables = _find(docs, block, space, share, loose, cosine)
        sent.append(tables)
        found, block = part if found is None else found.unionByName(part), []

    for row in keyed.filter("text is not null").toLocalIterator():
        own, _ = word_hashes([row["text"].encode()])
        if len(own):
            answer, _ = word_hashes([answer_words(row["text"]).encode()])
            block.append(Item(row["item_id"], own, answer))
        if len(block) == ITEM_BLOCK:
            add()
    if block:
        add()
    if found is None:
        return docs.sparkSession.createDataFrame([], (
            "doc_id long, item_id long, cosine double, common_words long, answered boolean, region long, item_words long")), sent
    best = F.max(F.struct("common_words", "cosine", "answered", "region", "item_words")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.cosine", "b.common_words", "b.answered", "b.region", "b.item_words"), sent


def decontaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, loose: float = 0.6,
                   cosine: float = COSINE) -> DataFrame:
    """The documents that hold no benchmark item, with all columns, whatever their names; each row is judged by its own text."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found, sent = _pairs(docs.select(key.alias("doc_id"), "text"), benchmark, share, loose, cosine)
    hit = stage(found.select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    for tables in sent:  # the keys are written
        tables.destroy()
    return unpacked(packed(docs, key.alias("_key")).join(hit, "_key", "left_anti"), docs.columns)
