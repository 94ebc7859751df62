"""Exact search and citations against plain numpy, and on odd vectors."""

import numpy as np
import pytest

from assaygrid.operators import retrieval


@pytest.mark.parametrize("tile", [7, 1024])
def test_nearest_of_odd_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(retrieval, "TILE", tile)
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (80, 6)).astype(float)  # many ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(90, None), (91, []), (92, [0.0] * 6), (93, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (94, [float("nan")] * 6), (95, [1.0, 2.0]), (96, [2.0, 1.0])]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(3)
    queries = corpus.where("doc_id in (1, 2, 3, 90, 91, 92, 93, 94, 95)").withColumnRenamed("doc_id", "query_id")
    got = {}
    for r in retrieval.top_k(queries, corpus, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["similarity"]))
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in rows if x and all(c is not None and np.isfinite(c) for c in x) and any(x)}
    assert set(got) == {q for q in (1, 2, 3, 95) if q in unit}
    for q, found in got.items():
        all_of = sorted(((round(float(unit[q] @ u), 9), d) for d, u in unit.items() if len(u) == len(unit[q])), key=lambda p: (-p[0], p[1]))[:5]
        assert [s for _, s in found] == pytest.approx([s for s, _ in all_of], abs=1e-4)
        assert [d for d, _ in found] == [d for _, d in all_of]
