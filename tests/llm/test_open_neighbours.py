import numpy as np
import pytest

from filigree.llm import vectors as V
from tests.llm.test_pairs import cloud, want_pairs


@pytest.mark.parametrize("size,tile,whole,flat,least", [
    (200, 12_000, 12_000, 1024, 0.9), (10_000, 12_000, 12_000, 1024, 1.0), (10_000, 150, 12_000, 1024, 1.0), (40, 12_000, 12_000, 4, 0.9),
    (150, 12_000, 60, 1024, 0.8), (150, 120, 60, 1024, 0.8),
])
def test_every_vector_gets_its_nearest_however_far(spark, monkeypatch, size, tile, whole, flat, least):
    monkeypatch.setattr(V, "WHOLE", whole)
    monkeypatch.setattr(V, "FLAT", flat)
    monkeypatch.setattr(V, "OPEN_LIST_SIZE", size)
    monkeypatch.setattr(V, "TILE", tile)
    x = cloud()
    far = np.random.default_rng(9).standard_normal((40, 24)).astype("f4")
    x = np.vstack([x, far])
    rows = [(f"{i:05d}", [float(y) for y in v]) for i, v in enumerate(x)] + [("x", [0.0] * 24), ("y", None)]
    df = spark.createDataFrame(rows, "id string, v array<float>").repartition(4)
    got = {}
    for r in V.similar_vectors(df, "id", "v", min_cosine=None, m=3).orderBy("id", "place").collect():
        got.setdefault(int(r.id), []).append(int(r.other))
    want = want_pairs(x, list(range(len(x))), 5, -1)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    found = np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want])
    assert found >= least - 0.001
