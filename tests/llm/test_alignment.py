"""Token alignment against a plain count of overlaps."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from spellpanel.llm import alignment as A

VOCABULARY, MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string"


def brute_overlaps(a, b):
    links, cuts, start = [], [], 0
    spans = lambda e: list(zip([0, *e[:-1]], e))
    for i, (s, t) in enumerate(spans(a)):
        for j, (u, v) in enumerate(spans(b)):
            if max(s, u) < min(t, v):
                links.append((i, j))
    for i, x in enumerate(a):
        if x in b:
            cuts.append((i + 1, b.index(x) + 1))
    return sorted(links), cuts


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_pieces_give_the_whole_merge(size):
    draw = np.random.default_rng(size)
    for _ in range(30):
        end = int(draw.integers(1, 60))
        a, b = (np.unique(np.append(draw.integers(1, end + 1, draw.integers(0, end + 1)), end)) for _ in range(2))
        i, j = A.path_bounds(a, b, size)
        assert (np.diff(i) + np.diff(j) <= size).all() and (i[-1], j[-1]) == (len(a), len(b))
        la, lb, ca, cb = A.overlaps(a, b, size)
        assert (sorted(zip(la.tolist(), lb.tolist())), list(zip(ca.tolist(), cb.tolist()))) == brute_overlaps(a.tolist(), b.tolist())


def brute_digest(rows):
    import sentencepiece
    import tokenizers

    first = tokenizers.Tokenizer.from_file(VOCABULARY)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    byte = A._byte_of()
    docs = []
    for doc_id, text in rows:
        ia = first.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = second.encode(text) if text else []
        wa = [bytes(byte[c] for c in first.id_to_token(k)) for k in ia]
        wb = [bytes([int(p[3:5], 16)]) if second.is_byte(k) else p.replace("▁", " ").encode()
              for k, p in zip(ib, second.id_to_piece(ib))]
        if not text or b"".join(wa) != (" " + text).encode() or b"".join(wb) != (" " + text).encode():
            docs.append((doc_id, [], [], [], []))
            continue
        docs.append((doc_id, ia, ib, *brute_overlaps(np.cumsum([len(x) for x in wa]).tolist(), np.cumsum([len(x) for x in wb]).tolist())))
    count = Counter(p for _, ia, ib, links, _ in docs for p in {(ia[i], ib[j]) for i, j in links})
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for doc_id, ia, ib, links, cuts in docs:
        pairs = [(ia[i], ib[j]) for i, j in links]
        parts, x, y = [], 0, 0
        for i, j in cuts:
            parts.append(",".join(map(str, ia[x:i])) + "|" + ",".join(map(str, ib[y:j])))
            x, y = i, j
        text = ";".join(parts)
        out.append((doc_id, len(ia), len(ib), len(cuts), len(links), sum(count[p] == most[p[0]] for p in pairs),
                    sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


ODD = [(None, None), (None, ""), (1, "x"), (1, "x"), (2, " "), (3, "a▁b"), (4, "<s> <|endoftext|> <0x0A>\n\t"),
       (5, "naïve café 😀 数字 １２"), (6, "á ﻿ ​"), (None, "x y"), (7, "  lead and trail  ")]


def test_digest_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    rows = ODD + [(d, (t or "")[:400]) for d, t in rows]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", rid int, pairs string").repartition(3)
    got = [tuple(r) for r in A.alignment_digest(docs, VOCABULARY, MODEL).collect()]
    order = lambda r: tuple(map(str, r))
    assert sorted(got, key=order) == sorted(brute_digest(rows), key=order)


def test_rare_and_frequent_pairs_agree(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = A.align_tokens(docs, VOCABULARY, MODEL, 100).cache()
    counts = A.pair_counts(kept, flush=1000).cache()
    one, all_rare, all_hot = (sorted(map(tuple, A.link_scores(kept, counts, h).collect())) for h in (50, 0, 10**9))
    assert one == all_rare == all_hot


def test_long_texts_split_without_a_trace():
    import tokenizers

    first = tokenizers.Tokenizer.from_file(VOCABULARY)
    first.encode_special_tokens = True
    text = " Some words, then 12 more:  two blanks\n\nand lines. Don't split 'em. x y " * 50 + "q" * 5000 + " end"
    for size in (1, 10, 333, 10**6):
        parts = A.split_text(text, size)
        assert "".join(parts) == text
        assert [i for p in parts for i in first.encode(p, add_special_tokens=False).ids] == first.encode(text, add_special_tokens=False).ids


def test_empty_table_and_long_word(spark):
    assert A.alignment_digest(spark.createDataFrame([], SCHEMA), VOCABULARY, MODEL).count() == 0
    rows = [(1, "ab" * 40_000), (2, "z " * 300_000)]
    got = {r["doc_id"]: r for r in A.alignment_digest(spark.createDataFrame(rows, SCHEMA), VOCABULARY, MODEL).collect()}
    assert got[1]["n_groups"] > 0 and got[2]["n_links"] >= 300_000 and got[2]["n_best"] <= got[2]["n_links"]


def test_pieces_remembered_give_the_tokens_of_whole_texts():
    with open(MODEL, "rb") as f, open(VOCABULARY, "rb") as g:
        first, bytes_a, _, _ = A._load(g.read(), f.read())
    len_a = np.array([len(x) for x in bytes_a])
    texts = [
        "Some words, then 12 more:  two blanks\n\nand lines. Don't split 'em. x y ", "", " ", "  lead", "trail \n ", "\n a \n b\n",
        "tab\t x \t y\x1c z \x1f q  r  s 　 t", "café 你好 <|endoftext|> a<|endoftext|> b", "end", "\u0085 n ​ m", "some some words",
    ] * 2
    whole = [first.encode(" " + t, add_special_tokens=False).ids if t else [] for t in texts]
    for limit in (0, 10**9):  # forgotten before each call, and kept
        told = A.Remembered(first, bytes_a, len_a, limit)
        assert told.apart
        for part in (slice(0, 9), slice(5, None), slice(0, None)):
            assert [x.tolist() for x in told.encode(texts[part])] == whole[part]
    asked = []

    class Counting:
        def __getattr__(self, name):
            return getattr(first, name)

        def encode_batch_fast(self, batch, **options):
            asked.extend(batch)
            return first.encode_batch_fast(batch, **options)

    told = A.Remembered(Counting(), bytes_a, len_a)
    told.encode(["one two two one"] * 100)
    assert sum(map(len, asked)) == len(" one two")
    missing = [b"" if x == b" two" else x for x in bytes_a]  # a token that does not give its bytes back
    told = A.Remembered(first, missing, len_a)
    assert [len(x) for x in told.encode(["one two", "one", "two three"])] == [0, 1, 0]
