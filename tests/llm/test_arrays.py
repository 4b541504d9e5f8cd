"""Array helpers against plain loops."""

import re

import numpy as np

from spellpanel.llm import decontaminate as D
from spellpanel.llm.arrays import word_hashes

TEXTS = [b"The cat sat", None, b"", b" \tTHE\x0bcat\n\nAZ@[`az{ \x1c\x1f\x08\x0e \xc3\x80\xe2\x80\xa8 ", b"x", b"sat the"]


def test_word_hashes_tell_words_apart_like_a_split():
    for lower in (True, False):
        fold = (lambda t: re.sub(rb"[A-Z]", lambda m: m[0].lower(), t)) if lower else (lambda t: t)
        split = [re.findall(rb"[^\x20\x09-\x0d]+", fold(t or b"")) for t in TEXTS]
        words, at = word_hashes(TEXTS, lower)
        assert np.diff(at).tolist() == [len(x) for x in split]
        flat = [w for x in split for w in x]
        one = {w: word_hashes([w], lower)[0][0] for w in flat}
        assert words.tolist() == [one[w] for w in flat] and len(set(one.values())) == len(one)


def test_places_of_words_with_shared_entries():
    rng = np.random.default_rng(2)
    vocabulary = np.unique(np.concatenate([rng.integers(0, 1 << 60, 300), np.arange(1, 40) << 40]).astype(np.uint64))
    places = D.Places(vocabulary)
    assert places.several.any()
    words = np.concatenate([rng.permutation(np.repeat(vocabulary, 2)), rng.integers(0, 1 << 60, 500).astype(np.uint64),
                            np.arange(40, 60).astype(np.uint64) << np.uint64(40)])
    hit, place = places.find(words)
    assert hit.tolist() == [i for i, w in enumerate(words) if w in set(vocabulary)]
    assert (vocabulary[place] == words[hit]).all()


def test_product_of_joined_chunks_is_that_of_all_passages():
    rng = np.random.default_rng(3)
    long = b" ".join(b"w%d" % k for k in rng.integers(0, 3000, 100_000))  # several chunks
    texts = [long[i : i + 60_000] for i in range(0, len(long), 60_000)] + [b"", None, b"one"]
    found = list(D.joined_words(texts))
    words, at = word_hashes(texts)
    assert len(found) == 1 and (found[0][0] == words).all() and (found[0][1] == at).all()
    weight = rng.random(D.FEATURES).astype(np.float32) + 0.1
    right = rng.standard_normal((D.FEATURES, 4)).astype(np.float32)
    features, rows = D.passage_product(words, at, weight, right * weight[:, None])
    got, want = np.zeros((D.FEATURES, 4)), np.zeros((D.FEATURES, 4))
    got[features] = rows
    start, first, two = D.halves(at)
    after = np.append(start[1:], len(words))
    for h in first:
        end = after[h + 1] if h in set(two.tolist()) else after[h]
        f = (words[start[h] : end] & np.uint64(D.FEATURES - 1)).astype(int)
        parts = after[h] - start[h]
        norm = (weight[f] ** 2).sum()
        assert parts > 0
        np.add.at(want, f, (right[f] * weight[f][:, None]).sum(axis=0) / norm)
    np.testing.assert_allclose(got, want, rtol=1e-3, atol=1e-4)
