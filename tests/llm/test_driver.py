"""What the driver holds and plans while the training-data operators run."""

import os
import tracemalloc

import numpy as np

from spellpanel.llm import decontaminate, neardup

SCHEMA = "doc_id long, text string"


def texts(n):
    pick = np.random.default_rng(8).integers(0, 900, (n, 60))
    return [(i, " ".join(f"word{k}" for k in row)) for i, row in enumerate(pick)]


def test_leaks_are_removed_within_a_few_matrices_of_driver_memory(spark, monkeypatch):
    rows = texts(400)
    items = spark.createDataFrame([(1, rows[7][1]), (2, rows[90][1])], "item_id long, text string")
    docs = spark.createDataFrame(rows, SCHEMA)
    context, sent = type(spark.sparkContext), []
    made = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(x := made(self, value)) or x)
    decontaminate.word_weights(docs)  # modules that are loaded once
    tracemalloc.start()
    kept = decontaminate.decontaminated(docs, items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {r["doc_id"] for r in kept.collect()} == set(range(400)) - {7, 90}
    # one matrix of doubles and two of single precision, and what reading a few blocks takes
    assert peak < 2.6 * 8 * decontaminate.FEATURES * (decontaminate.RANK + decontaminate.EXTRA)
    assert len(sent) == 3 and not any(os.path.exists(x._path) for x in sent)


def test_orthonormal_spans_the_columns():
    image = np.random.default_rng(1).standard_normal((4 * decontaminate.BLOCK, 20)).astype(np.float32)
    image[decontaminate.BLOCK : 2 * decontaminate.BLOCK] = 0
    basis = decontaminate.orthonormal(image)
    want, _ = np.linalg.qr(image.astype(np.float64))
    np.testing.assert_allclose(basis.T @ basis, np.eye(20), atol=1e-12)
    np.testing.assert_allclose(basis @ (basis.T @ want), want, atol=1e-12)


def test_components_are_not_computed_again_without_further_links(spark, monkeypatch):
    rows = texts(40)
    rows += [(100 + i, t + " end") for i, t in rows[:10]]
    calls, components = [], neardup.components
    monkeypatch.setattr(neardup, "components", lambda *a: calls.append(a) or components(*a))
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i % 100 for i, _ in rows}
    assert len(calls) == 1
