"""The neighbour search against brute force."""

import math

import numpy as np
import pytest

from graphnet_spark.llm import nn_descent

SCHEMA = "vec_id long, embedding array<float>, label int, node string, score double, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "n", 0.5, 3) for i, v in rows], SCHEMA).repartition(3)


def expected(rows, top=20, every=20):
    """Of each query, all candidates from the nearest."""
    lengths = [len(v) for _, v in rows if usable(v)]
    d = max(sorted(set(lengths), reverse=True), key=lengths.count) if lengths else 0
    kept = {}
    for i, v in rows:
        if i is not None and usable(v) and len(v) == d:
            v = tuple(np.float32(v).tolist())
            kept[i] = min(kept.get(i, v), v)
    out = {}
    for q, v in kept.items():
        if q % every == 0:
            scored = []
            for i, w in kept.items():
                if i != q:
                    total = 0.0
                    for x, y in zip(v, w):
                        total += x * y
                    scored.append((-total, i))
            out[q] = [(i, -s) for s, i in sorted(scored)[:top]]
    return out


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_small_tables_have_every_candidate(spark, sf):
    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(5) * (1 + i % 3)) for i in range(0, 41)]
    rows += [(i, rows[3][1]) for i in range(41, 90)]  # copies
    rows += [(100, None), (120, []), (140, [0, 0, 0, 0, 0]), (160, [1, None, 1, 1, 1]), (180, [1, float("nan"), 1, 1, 1]), (200, [1, float("inf"), 1, 1, 1]), (None, rows[0][1])]
    rows += [(220, [1, 2]), (5, rows[5][1]), (7, [9, 9, 9, 9, 9]), (-20, rows[3][1])]
    got = nn_descent.op11_nn_descent(spark, sf(embeddings=table(spark, rows)))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert answers(got) == expected(rows)


def test_fewer_candidates_than_asked_for(spark, sf):
    rows = [(0, [1, 0]), (1, [1, 1]), (20, [2, 1])]
    assert answers(nn_descent.op11_nn_descent(spark, sf(embeddings=table(spark, rows)))) == expected(rows)
    alone = table(spark, [(0, [1.0, 2.0])])
    assert nn_descent.op11_nn_descent(spark, sf(embeddings=alone)).count() == 0


def test_empty_table(spark, sf):
    assert nn_descent.op11_nn_descent(spark, sf(embeddings=table(spark, []))).count() == 0


@pytest.mark.parametrize("norms", [False, True])
def test_recall_and_exact_scores(spark, sf, norms):
    """One group of equal vectors holds a third of all rows; with norms, vectors differ in length by up to four times."""
    r = np.random.default_rng(2)
    centres = r.standard_normal((8, 24))
    v = centres[r.integers(0, 8, 2400)] + r.standard_normal((2400, 24))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * (r.uniform(0.5, 2, (2400, 1)) if norms else 1)
    rows = [(i, v[i]) for i in range(2400)] + [(i, v[7]) for i in range(2400, 3600)]
    want = expected(rows)
    got = answers(nn_descent.op11_nn_descent(spark, sf(embeddings=table(spark, rows))))
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (20 * len(want))
    assert found >= 0.95
    exact = {q: dict(x) for q, x in expected(rows, top=4000).items()}
    for q, x in got.items():
        assert all(exact[q][i] == s for i, s in x) and x == sorted(x, key=lambda y: (-y[1], y[0]))


def test_packed_vectors_open_to_about_the_same():
    v = np.random.default_rng(3).standard_normal((50, 64)).astype(np.float32)
    extra = np.linspace(0, 9, 50)
    out = nn_descent.opened(nn_descent.packed(v, extra))
    assert np.abs(out[:, :-1] - v).max() <= np.abs(v).max() / 250 and np.allclose(out[:, -1], extra)


def test_rows_of_a_key_stay_together():
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(4).integers(0, 40, 500))
    for step in (1, 3, 50, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + step])], names=["k"]) for a in range(0, 500, step)]
        parts = [b.column(0).to_pylist() for b in nn_descent.of_keys(iter(batches))]
        assert sum(parts, []) == keys.tolist()
        assert all(a[-1] != b[0] for a, b in zip(parts, parts[1:], strict=False))
