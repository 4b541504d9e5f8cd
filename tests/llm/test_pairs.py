"""Near-duplicate classes, substring removal and sentence runs against brute force."""

import random

import numpy as np
import pytest

import brute
from spellpanel.llm import neardup, sentences, substrings
from spellpanel.llm.suffixes import permuted_common_prefixes, suffix_array

SCHEMA = "doc_id long, text string"
ODD = [(900, None), (901, ""), (902, "  \n\t"), (903, "one"), (904, "one"), (905, "two words"), (906, "ONE")]


def words(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices("abcdefgh", k=4)) for _ in range(n)]


def family(n, seed):
    """Copies of one text with more and more words changed, so that similarity runs from 1 down."""
    base, draw, out = words(120, seed), random.Random(seed), []
    for i in range(n):
        w = list(base)
        for _ in range(i % 12):
            w[draw.randrange(len(w))] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def texts():
    rows = [(i, t) for i, t in enumerate(family(40, 1) + family(25, 2))]
    rows += [(100 + i, " ".join(words(80, 50 + i))) for i in range(20)]
    rows += [(200 + i, rows[3][1]) for i in range(10)]
    return rows + ODD


@pytest.mark.parametrize("size,percent,rows", [(3, 85, 6), (5, 80, 5)])
def test_classes_equal_brute_force(spark, texts, size, percent, rows):
    got = neardup.near_duplicates(spark.createDataFrame(texts, SCHEMA), size, percent, rows).collect()
    want = brute.near_duplicates(texts, size, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_one_document_of_each_group_stays(spark, texts):
    docs = spark.createDataFrame([(*t, t[0], "x") for t in texts], SCHEMA + ", component_id long, kept string")
    kept = neardup.deduplicated(docs.unionByName(docs.limit(5)))
    want = brute.near_duplicates(texts, 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if d == c)
    assert kept.columns == docs.columns


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicates(none).count() == 0
    assert substrings.repeated_substrings(none).count() == 0
    assert sentences.sentence_dedup(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "z"), (None, None)], SCHEMA)
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in neardup.near_duplicates(rows).collect())
    assert got == [("4", "4", True), ("None", "4", False), ("None", "None", True), ("None", "None", True)]


def long_texts():
    draw = random.Random(5)
    passage = " ".join(words(30, 9))
    rows = []
    for i in range(30):
        parts = [" ".join(words(draw.randrange(5, 60), 1000 + i))]
        if i % 3 == 0:
            parts.append(passage[: draw.randrange(60, len(passage))])
        if i % 5 == 0:
            parts.append("spam " * draw.randrange(1, 60))
        parts.append(" ".join(words(20, 2000 + i)))
        rows.append((i, " ".join(parts)))
    return rows + [(50, rows[0][1]), (51, rows[0][1]), (52, "é" * 300), (None, rows[1][1])] + ODD


@pytest.mark.parametrize("hot", [1 << 21, 100])
def test_substrings_equal_brute_force(spark, monkeypatch, hot):
    """With a tiny bound every group of runs takes the way of the hot ones."""
    monkeypatch.setattr(substrings, "HOT_BYTES", hot)
    rows = long_texts()
    got = substrings.repeated_substrings(spark.createDataFrame(rows, SCHEMA), 64).collect()
    want = brute.repeated_substrings(rows, 64)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got} == want
    assert sum(r["n_removed"] for r in got) > 1000


def test_suffix_arrays():
    draw = np.random.default_rng(0)
    for _ in range(200):
        b = draw.integers(0, draw.integers(1, 5), draw.integers(1, 50)).astype(np.uint8)
        s = bytes(b)
        order = suffix_array(np.append(b.astype(np.int64) + 1, 0))[1:]
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        shared = permuted_common_prefixes(b, order)
        for x, y in zip(order[:-1], order[1:]):
            k = 0
            while k < len(s) - max(x, y) and s[x + k] == s[y + k]:
                k += 1
            assert shared[y] == k


def test_sentence_runs(spark):
    lead = "The first sentence stands here. A second one follows it. Then comes a third."
    rows = [(1, f"Opening words. {lead} Closing one."), (2, f"Other start! {lead} Other end."),
            (3, "Opening words. Nothing else is shared."), (4, lead), (5, None), (6, ""), (7, "No end mark")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", n_removed string")
    got = {r["doc_id"]: r for r in sentences.sentence_dedup(docs).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3, 4)] == [0, 3, 0, 3]
    assert got[2]["text"] == "Other start! Other end." and got[1]["text"] == rows[0][1]
    assert got[5]["text"] is None and got[6]["text"] == "" and got[4]["text"] == ""
    again = sentences.sentence_dedup(docs.unionByName(docs)).collect()
    assert sorted(r["n_removed"] for r in again if r["doc_id"] in (1, 2)) == [0, 0, 3, 3]


def test_runs_equal_a_plain_loop():
    """Runs of many texts at once are those that a loop over each text's units finds; equal units give equal hashes."""
    texts = [" ".join(words(90, 50)), "A b. C d! E f? G h.", "", "One two.\n" * 9, "x " * 200, " ".join(words(7, 51)) + ". " + " ".join(words(60, 52))]
    parts = [sentences.segments(t) for t in texts]
    want = []
    for t, units in enumerate(parts):
        for i in range(len(units)):
            for k in range(i, len(units)):
                run = units[i : k + 1]
                n_words = sum(len(u[2].split()) for u in run)
                if sum(u[4] for u in run) == 3 or (len(run) > 1 and n_words >= 20) or n_words >= sentences.SINGLE:
                    want.append((t, i, len(run), tuple(u[2] for u in run)))
                    break
    text, hashed, at, n = (x.tolist() for x in sentences.sentence_runs(parts, 3, 20))
    assert list(zip(text, at, n)) == [w[:3] for w in want]
    assert len(set(hashed)) == len({w[3] for w in want}) == len(set(zip(hashed, (w[3] for w in want))))


def test_passages_without_sentence_ends(spark):
    """Copies of one sentence, passages that start and end inside a sentence, and other sentence marks."""
    one, inner = " ".join(words(70, 31)), " ".join(words(60, 32))
    quoted = " ".join(f'"{" ".join(words(4, 40 + i))}."' for i in range(4))
    marks = "".join(f"{a}\u3002" for a in ("\u5929\u5730", "\u7384\u9ec4", "\u5b87\u5b99", "\u6d2a\u8352"))
    rows = [(1, one), (2, one), (3, " ".join(words(40, 33)) + " " + inner + " " + " ".join(words(40, 34))),
            (4, " ".join(words(30, 35)) + " " + inner + " " + " ".join(words(30, 36)) + ". Its end."),
            (5, quoted), (6, f"Before it! {quoted}"), (7, marks), (8, f"\u4e2d {marks}"), (9, "same1 " * 80), (10, "same1 " * 80)]
    got = {r["doc_id"]: r["text"] for r in sentences.sentence_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == rows[i - 1][1] for i in (1, 3, 5, 7, 9)) and got[2] == "" and got[10] == ""
    left = set(got[4].split())
    assert len(left & set(inner.split())) <= 20 and set(words(20, 35)) <= left and "end." in left
    assert got[6] == "Before it! " and got[8].startswith("\u4e2d") and len(got[8]) < 8


def test_rows_without_id(spark):
    """Rows without an id, and rows of one id with different texts, are documents each; of equal ones one stays."""
    lead = "The first sentence stands here. A second one follows it. Then comes a third."
    last = "The end has its own words. They stand once in here. So they do stay."
    other = "Its own start is this. Its own middle is that. Its own end is not a copy."
    rows = [(None, lead), (None, lead), (None, other), (None, f"Some more. {lead}"), (7, lead), (8, other), (8, last), (None, None)]
    got = [(r["doc_id"], r["text"]) for r in sentences.sentence_dedup(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = [(None, ""), (None, ""), (None, ""), (None, "Some more. "), (7, lead), (8, other), (8, last), (None, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    alone = sentences.sentence_dedup(spark.createDataFrame([(None, lead)] * 5 + [(None, last)], SCHEMA)).collect()
    assert sorted(r["text"] for r in alone) == sorted([lead, "", "", "", "", last])


def test_near_copies_without_id(spark):
    base = family(12, 77)
    rows = [(3, base[0]), (None, base[1]), (None, base[0]), (None, " ".join(words(90, 78))), (None, None), (None, None)]
    kept = [(r["doc_id"], r["text"]) for r in neardup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [rows[0], rows[3], rows[4]]))
