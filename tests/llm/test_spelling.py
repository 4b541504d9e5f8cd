"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from spellpanel.llm import spelling as S

SCHEMA = "doc_id long, text string"


def brute_words(rows, typo):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typo and h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def near(u, w):
    if len(u) == len(w):
        return sum(a != b for a, b in zip(u, w)) == 1
    u, w = sorted((u, w), key=len)
    return len(w) == len(u) + 1 and any(w[:k] + w[k + 1 :] == u for k in range(len(w)))


def brute(rows, typo):
    words = brute_words(rows, typo)
    form, out = {}, set()
    around = {w: [u for u in words if near(u, w)] for w in words}
    for w, n in words.items():
        best = min(around[w], key=lambda u: (-words[u], u), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(around[w]), words.get(form[w])))
    return out


def corpus(seed):
    draw = random.Random(seed)
    base = ["".join(draw.choices("abcÀéÿ", k=draw.randrange(5, 12))) for _ in range(40)]
    rows = []
    for i in range(400):
        out = []
        for _ in range(60):
            w = draw.choice(base[: 1 + int(len(base) * draw.random() ** 3)])
            for _ in range(draw.choice([0, 0, 0, 0, 0, 0, 0, 1, 2])):
                k = draw.randrange(len(w))
                w = draw.choice([w[:k] + w[k + 1 :], w[:k] + draw.choice("abé") + w[k:], w[:k] + "c" + w[k + 1 :]])
            out.append(draw.choice([w, w.upper() if w.isascii() else w, w.capitalize()]))
        rows.append((i if i % 7 else None, draw.choice([" ", "-", "9 "]).join(out)))
    return rows + [(900, None), (901, ""), (902, "  \n"), (903, "aaaaaa " * 9 + "aaaaaaa " * 60 + "aaaaaaaa " * 400), (903, "bbbbbb " * 7)]


@pytest.mark.parametrize("typo", [None, 7, 199])
def test_variants_equal_brute_force(spark, typo):
    rows = corpus(typo or 1)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n int, place string").repartition(5)
    got = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in S.spelling_variants(docs, typo).collect()}
    want = brute(rows, typo)
    assert got == want and any(r[1] and r[1] != r[2] for r in want)


def test_nodes_stand_for_prefixes(spark):
    draw = random.Random(3)
    words = sorted({"".join(draw.choices("ab", k=draw.randrange(1, 14))) for _ in range(900)} | {"q" * 5000, "q" * 4999 + "r"})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many ranges, so that nodes cross them
    try:
        df = S.number_nodes(spark.createDataFrame([(w, len(w)) for w in words], "word string, n long"), "word", "test-trie")
        rows = sorted(df.collect(), key=lambda r: r["place"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["word"] for r in rows] == words and [r["place"] for r in rows] == list(range(len(words)))
    number = {}
    for r in rows:
        for k, x in enumerate(r["nodes"]):
            assert number.setdefault(r["word"][: k + 1], x) == x
    assert len(set(number.values())) == len(number) and 0 not in number.values()


def test_nothing_to_find(spark):
    assert S.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert S.spelling_variants(spark.createDataFrame([(1, "word"), (None, None)], SCHEMA)).count() == 0
    row = S.spelling_variants(spark.createDataFrame([(1, ("x" * 20_000 + " ") * 5)], SCHEMA)).collect()[0]
    assert (row["form"], row["root"], row["n"], row["n_near"], row["form_n"]) == (None, "x" * 20_000, 5, 0, None)
