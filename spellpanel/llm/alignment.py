"""Two tokenizers over the same texts: which tokens overlap, in groups, and how often corpus-wide."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spellpanel.llm.arrays import chunks
from spellpanel.session import stage

#: Largest vocabulary file that is sent to the executors.
MAX_VOCABULARY = 32 << 20
#: Steps of the merge in one piece.
PIECE = 1 << 16
#: Text that is encoded at once; a longer text is a chunk of its own.
CHUNK = 1 << 19
#: Characters of distinct pieces whose tokens a task remembers.
KNOWN = 1 << 21
#: A pair with more than this share of all (document, pair) rows is looked up in a broadcast; there
#: can be no more such pairs than the share's inverse.
HOT = 200_000
#: Ids of either vocabulary are below this, so that a pair fits 40 bits.
MAX_ID = 1 << 20

GROUPS = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"

_loaded: dict[tuple, tuple] = {}


# ------------------------------------------------------------------ the merge


def path_bounds(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two ascending arrays crosses every ``size``-th diagonal.

    Entry p says how many elements of a and of b come before piece p (equal elements: a's first).
    All diagonals are searched at once by bisection, without merging anything before them.
    """
    d = np.append(np.arange(0, len(a) + len(b), size), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (free := np.flatnonzero(low < high)).size:
        mid = (low[free] + high[free]) // 2
        right = a[mid] <= b[d[free] - 1 - mid]
        low[free], high[free] = np.where(right, mid + 1, low[free]), np.where(right, high[free], mid)
    return low, d - low


def piece_overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int):
    """Links and cuts of one piece of the merge of two series of token ends.

    Each distinct end closes a stretch that one token of a and one of b cover, and each overlapping
    pair covers one stretch.  The piece that holds the end (a's copy, if both have it) gives the link;
    the piece that holds b's copy of a shared end gives the cut, as numbers of tokens up to it.
    """
    own_a, own_b = a[i0:i1], b[j0:j1]
    to_b, to_a = j0 + np.searchsorted(own_b, own_a), i0 + np.searchsorted(own_a, own_b)
    shared = np.zeros(len(own_b), dtype=bool)
    inside = to_a < i1
    shared[inside] = a[to_a[inside]] == own_b[inside]
    cut = to_a + 1
    if i0 and len(own_b) and a[i0 - 1] == own_b[0]:  # the shared end's other copy is the last of the piece before
        shared[0], cut[0] = True, i0
    at = np.arange(j0, j1)
    link_a = np.concatenate([np.arange(i0, i1), to_a[~shared]])
    link_b = np.concatenate([to_b, at[~shared]])
    return link_a, link_b, cut[shared], at[shared] + 1


def overlaps(a: np.ndarray, b: np.ndarray, size: int = PIECE):
    """All links (tokens of a, tokens of b) and the cuts in order; a group that spans pieces ends at its cut."""
    i, j = path_bounds(a, b, size)
    found = [piece_overlaps(a, b, *x) for x in zip(i[:-1], i[1:], j[:-1], j[1:])]
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found))


# ---------------------------------------------------------------- the tokenizers


def _byte_of() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: visible ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


def _read(path: str) -> bytes:
    if os.path.getsize(path) > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY} bytes")
    with open(path, "rb") as f:
        return f.read()


def _load(raw_a: bytes, raw_b: bytes):
    """Both tokenizers and the bytes of each of their ids, once a worker."""
    key = (hash(raw_a), hash(raw_b))
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        first = tokenizers.Tokenizer.from_buffer(raw_a)
        first.encode_special_tokens = True
        byte = _byte_of()
        special = {k: t.content.encode() for k, t in first.get_added_tokens_decoder().items()}
        entries = {k: w for w, k in first.get_vocab(with_added_tokens=True).items()}
        bytes_a = [special.get(k) or bytes(byte[c] for c in entries.get(k, "")) for k in range(max(entries) + 1)]
        second = sentencepiece.SentencePieceProcessor(model_proto=raw_b)
        bytes_b = [
            bytes([int(p[3:5], 16)]) if second.is_byte(k) else p.replace("▁", " ").encode()
            for k, p in enumerate(second.id_to_piece(list(range(second.get_piece_size()))))
        ]
        if max(len(bytes_a), len(bytes_b)) > MAX_ID:
            raise ValueError(f"a vocabulary has more than {MAX_ID} ids")
        _loaded[key] = first, bytes_a, second, bytes_b
    return _loaded[key]


_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def split_text(text: str, size: int = CHUNK) -> list[str]:
    """Parts of about ``size`` characters that a byte-level tokenizer encodes alike apart and together.

    A lone space between other characters always starts a pre-token, so parts begin there; a text
    without one in reach stays whole.
    """
    parts, start = [], 0
    while len(text) - start > size and (m := _SINGLE_SPACE.search(text, start + size)):
        parts.append(text[start : m.start()])
        start = m.start()
    return [*parts, text[start:]]


def _encode_first(first, texts: list[str]) -> list[list[int]]:
    if len(texts) > 1:
        return [e.ids for e in first.encode_batch_fast(texts, add_special_tokens=False)]
    return [[i for x in split_text(t) for i in first.encode_batch_fast([x], add_special_tokens=False)[0].ids] for t in texts]


class Remembered:
    """Ids of texts by the first tokenizer, which is asked once for each distinct piece between lone spaces.

    A lone space starts a pre-token (see ``split_text``), so a text's tokens are those of its pieces.  Tokenizers
    that do more than split at the byte-level pattern encode whole texts.
    """

    def __init__(self, first, bytes_a: list[bytes], len_a: np.ndarray, limit: int = KNOWN) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        self.first, self.bytes_a, self.len_a, self.limit = first, bytes_a, len_a, limit
        split = first.pre_tokenizer
        self.apart = (first.normalizer is None and isinstance(split, ByteLevel) and split.use_regex
                      and not split.add_prefix_space and not first.model.dropout
                      and all(t.special for t in first.get_added_tokens_decoder().values()))
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.held = 0
        self.ids, self.sizes, self.same = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_a.__getitem__, ids))

    def _add(self, pieces: list[str]) -> None:
        """Tokens of new pieces: together if they give all bytes back, so that lengths tell them apart, else one by one."""
        self.held += sum(map(len, pieces))
        plain = [p for p in pieces if p and p.strip() == p]
        joined = "".join([" " + p for p in plain])
        ids = _encode_first(self.first, [joined])[0] if plain else []
        if self._bytes(ids) == joined.encode():
            ends = np.cumsum(self.len_a[np.array(ids, dtype=np.int64)])
            lengths = map(len, plain if joined.isascii() else [p.encode() for p in plain])
            last = np.searchsorted(ends, np.cumsum(np.fromiter(lengths, np.int64, len(plain)) + 1))
            self._keep(plain, ids, np.diff(last, prepend=-1), np.ones(len(plain), dtype=bool))
            pieces = [p for p in pieces if not p or p.strip() != p] if len(plain) < len(pieces) else []
        if pieces:
            whole = [" " + p for p in pieces]
            found = _encode_first(self.first, whole)
            self._keep(pieces, list(chain.from_iterable(found)), np.array(list(map(len, found))),
                       np.array([self._bytes(x) == t.encode() for x, t in zip(found, whole, strict=True)]))

    def _keep(self, pieces: list[str], ids: list[int], sizes: np.ndarray, same: np.ndarray) -> None:
        self.place.update(zip(pieces, range(len(self.place), len(self.place) + len(pieces))))
        self.ids = np.append(self.ids, np.array(ids, dtype=np.int64))
        self.sizes, self.same = np.append(self.sizes, sizes.astype(np.int64)), np.append(self.same, same)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of a space and each text; none if the text is empty or the ids do not give it back byte by byte."""
        if not self.apart:
            whole = [" " + t if t else "" for t in texts]
            found = _encode_first(self.first, whole)
            return [np.array(x if self._bytes(x) == t.encode() else [], np.int64) for x, t in zip(found, whole, strict=True)]
        if self.held > self.limit:
            self.forget()
        pieces = [_SINGLE_SPACE.split(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(pieces))
        if new := list(set(flat).difference(self.place)):
            self._add(new)
        which = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        sizes, begin = self.sizes[which], (np.cumsum(self.sizes) - self.sizes)[which]
        at = np.append(0, np.cumsum(sizes))
        ids = self.ids[np.repeat(begin - at[:-1], sizes) + np.arange(at[-1])]
        bounds = np.cumsum([0, *map(len, pieces)])
        wrong = np.diff(np.append(0, np.cumsum(~self.same[which]))[bounds]) > 0
        found = [ids[a:b] for a, b in zip(at[bounds[:-1]].tolist(), at[bounds[1:]].tolist(), strict=True)]
        for k in np.flatnonzero(wrong).tolist():
            if self._bytes(found[k].tolist()) != (" " + texts[k]).encode():
                found[k] = ids[:0]
        return found


def _digits(n: int) -> np.ndarray:
    """Decimal digits of 0 to n - 1, one row each, zero bytes after the last digit."""
    width = len(str(n))
    return np.array([str(k).encode() for k in range(n)], dtype=f"S{width}").view(np.uint8).reshape(n, width)


# -------------------------------------------------------------------- the chunks


def _starts(tokens: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([0, *map(len, tokens)])


def aligned_chunk(ids_a: list[np.ndarray], ids_b: list[np.ndarray], len_a: np.ndarray, len_b: np.ndarray,
                  digits: np.ndarray, size: int = PIECE):
    """Counts, group strings and distinct links of texts laid end to end (both series end with each text).

    Returns n_groups, n_links, group strings, and for each text its distinct pairs
    (``a * MAX_ID + b``, ascending) with their numbers of occurrences.
    """
    at_a, at_b = _starts(ids_a), _starts(ids_b)
    flat_a, flat_b = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64, copy=False) for x in (ids_a, ids_b))
    link_a, link_b, cut_a, cut_b = overlaps(np.cumsum(len_a[flat_a]), np.cumsum(len_b[flat_b]), size)
    n = len(ids_a)
    groups = np.searchsorted(cut_a, at_a, "right")  # groups that end by the start of each text
    of = np.repeat(np.arange(n), np.diff(at_a))[link_a]  # text of each link
    n_links = np.bincount(of, minlength=n)

    # place of each token in the string: by group, a's tokens first
    i, j = np.arange(len(flat_a)), np.arange(len(flat_b))
    group_a, group_b = (np.cumsum(np.bincount(cut, minlength=len(x) + 1))[:-1] for cut, x in ((cut_a, i), (cut_b, j)))
    place_a, place_b = i + np.append(0, cut_b)[group_a], j + cut_a[group_b]
    ids = np.empty(len(i) + len(j), dtype=np.int64)
    mark = np.full(len(ids), ord(","), dtype=np.uint8)
    ids[place_a], ids[place_b] = flat_a, flat_b
    mark[place_a[cut_a - 1]], mark[place_b[cut_b - 1]] = ord("|"), ord(";")
    ends = (at_a + at_b)[1:]
    mark[ends[np.diff(at_a) > 0] - 1] = 0
    cells = np.concatenate([digits[ids], mark[:, None]], axis=1)
    used = np.append(0, np.cumsum(np.count_nonzero(digits, axis=1)[ids] + (mark > 0)))
    text = cells[cells != 0]
    strings = pa.StringArray.from_buffers(
        n, pa.py_buffer(used[at_a + at_b].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text)))

    key = np.sort(((of << 40) | (flat_a[link_a] * MAX_ID + flat_b[link_b])).astype(np.int64))
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(key)))
    pairs = key[first] & ((1 << 40) - 1)
    bounds = np.searchsorted(key[first] >> 40, np.arange(n + 1))
    return np.diff(groups), n_links, strings, [
        (pairs[x:y], times[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]


def packed(pairs: np.ndarray) -> bytes:
    """Pairs as five bytes each."""
    return pairs.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(raw: list[bytes]) -> np.ndarray:
    out = np.zeros((sum(map(len, raw)) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, 5)
    return out.view("<i8").ravel()


# ----------------------------------------------------------------- the operator


def align_tokens(docs: DataFrame, vocabulary_a: str, model_b: str, size: int = PIECE) -> DataFrame:
    """Token groups and links of each row of ``docs`` (doc_id, text; other columns are ignored).

    The first tokenizer (a byte-level ``tokenizers`` file) encodes a space and the text, the second
    (a ``sentencepiece`` model, which adds that space itself) the text, both without special tokens.
    The ends of their tokens are merged along a merge path: bisections on diagonals cut the merge into
    pieces of ``size`` steps, each piece gives its links and cuts alone, and cuts stitch the pieces
    into groups.  Columns: rid (own number of the row), doc_id, n_a, n_b, n_groups, n_links, groups
    (``a1,a2|b1;a3|b2,b3``), pairs and times (distinct linked id pairs, see ``unpacked``, and four bytes
    each for their occurrences).

    A null or empty text, and one that either tokenizer does not give back byte by byte, has zeros
    and an empty string.  Rows count by themselves, whatever their ids.  Long texts are encoded in
    parts that do not change the tokens.  An empty table gives no rows.
    """
    raw = docs.sparkSession.sparkContext.broadcast((_read(vocabulary_a), _read(model_b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, bytes_a, second, bytes_b = _load(*raw.value)
        len_a, len_b = (np.array([len(x) for x in v], dtype=np.int64) for v in (bytes_a, bytes_b))
        digits = _digits(max(len(bytes_a), len(bytes_b)))
        encoder = Remembered(first, bytes_a, len_a)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in chunks([t.encode() for t in texts], CHUNK):
                ids_a, ids_b = encoder.encode(texts[lo:hi]), second.encode(texts[lo:hi], out_type="numpy", num_threads=1)
                for k, t in enumerate(texts[lo:hi]):
                    if not len(ids_a[k]) or b"".join(map(bytes_b.__getitem__, ids_b[k].tolist())) != b" " + t.encode():
                        ids_a[k], ids_b[k] = ids_a[k][:0], ids_b[k][:0]
                n_groups, n_links, strings, links = aligned_chunk(ids_a, ids_b, len_a, len_b, digits, size)
                yield pa.record_batch({
                    "rid": batch.column("rid").slice(lo, hi - lo), "doc_id": batch.column("doc_id").slice(lo, hi - lo),
                    "n_a": pa.array([len(x) for x in ids_a], pa.int64()), "n_b": pa.array([len(x) for x in ids_b], pa.int64()),
                    "n_groups": pa.array(n_groups, pa.int64()), "n_links": pa.array(n_links, pa.int64()), "groups": strings,
                    "pairs": pa.array([packed(p) for p, _ in links], pa.binary()),
                    "times": pa.array([t.astype("<i4").tobytes() for _, t in links], pa.binary())})

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, GROUPS)


def pair_counts(aligned: DataFrame, flush: int = 1 << 21) -> DataFrame:
    """pair, n (rows of ``aligned`` that hold it linked) and best (no pair of the same first id has a larger n).

    A task counts up to ``flush`` pairs before it sends them, so a frequent pair moves once a task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held):
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch({"pair": pa.array(pair, pa.int64()), "n": pa.array(n, pa.int64())})

        held, total = [], 0
        for batch in batches:
            held.append(unpacked(batch.column("pairs").to_pylist()))
            total += len(held[-1])
            if total >= flush:
                yield counted(held)
                held, total = [], 0
        if total:
            yield counted(held)

    counts = stage(aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")),
                   "alignment-counts")
    first = F.shiftright("pair", MAX_ID.bit_length() - 1)
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, first == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_scores(aligned: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """rid, n_best and count_sum over the links of each row of ``aligned`` that has links.

    Pairs that hold more than one part in ``hot`` of all (row, pair) entries, so at most ``hot`` pairs, are
    looked up in a broadcast where the row is; only the others are shuffled, and none of those is frequent.
    """
    total = F.lit(counts.agg(F.sum("n")).first()[0] or 0)
    often = counts.filter(F.col("n") * hot > total).toArrow()
    order = np.argsort(often["pair"].to_numpy())
    sent = aligned.sparkSession.sparkContext.broadcast(tuple(often[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            raw = batch.column("pairs").to_pylist()
            pairs = unpacked(raw)
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), dtype="<i4").astype(np.int64)
            sizes = np.array([len(x) // 5 for x in raw], dtype=np.int64)
            of = np.repeat(np.arange(len(raw)), sizes)
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            there = known[at] == pairs if len(known) else np.zeros(len(pairs), dtype=bool)
            sums, hits = np.zeros(len(raw), dtype=np.int64), np.zeros(len(raw), dtype=np.int64)
            np.add.at(sums, of[there], times[there] * n[at[there]])
            np.add.at(hits, of[there], times[there] * best[at[there]])
            rid = batch.column("rid").to_numpy()
            rest = ~there
            none = int(rest.sum())
            yield pa.record_batch({
                "rid": pa.array(np.concatenate([rid, rid[of[rest]]]), pa.int64()),
                "pair": pa.concat_arrays([pa.nulls(len(raw), pa.int64()), pa.array(pairs[rest], pa.int64())]),
                "times": pa.array(np.concatenate([np.zeros(len(raw), dtype=np.int64), times[rest]]), pa.int64()),
                "n_best": pa.array(np.concatenate([hits, np.zeros(none, dtype=np.int64)]), pa.int64()),
                "count_sum": pa.array(np.concatenate([sums, np.zeros(none, dtype=np.int64)]), pa.int64())})

    found = stage(aligned.select("rid", "pairs", "times").mapInArrow(
        run, "rid long, pair long, times long, n_best long, count_sum long"), "alignment-lookups")
    rare = found.filter("pair is not null").select("rid", "pair", "times").join(counts, "pair").select(
        "rid", F.when(F.col("best"), F.col("times")).otherwise(0).cast("long").alias("n_best"),
        (F.col("times") * F.col("n")).alias("count_sum"))
    both = found.filter("pair is null").select("rid", "n_best", "count_sum").unionByName(rare)
    return both.groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_digest(docs: DataFrame, vocabulary_a: str, model_b: str) -> DataFrame:
    """One row a document: the counts of ``align_tokens`` and ``link_scores`` and the SHA-256 of the groups."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    kept = stage(align_tokens(docs, vocabulary_a, model_b).select(
        "rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "pairs", "times", digest), "alignment")
    scores = link_scores(kept, stage(pair_counts(kept), "alignment-pairs"))
    return kept.drop("pairs", "times").join(scores, "rid").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
