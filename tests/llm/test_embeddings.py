"""Links of embeddings against brute force."""

import numpy as np
import pytest

from icetally.llm import embeddings


def brute(rows, threshold):
    good = {}
    for i, (vec, v) in enumerate(rows):
        x = np.array([np.nan if c is None else c for c in v or []], dtype=np.float64)
        if vec is not None and len(x) and np.isfinite(x).all() and x.any():
            good[i] = x / np.linalg.norm(x)
    linked = [
        (i, j)
        for i in good
        for j in good
        if i < j and len(good[i]) == len(good[j]) and float(good[i] @ good[j]) >= threshold
    ]
    counts = dict.fromkeys(range(len(rows)), 0)
    for i, j in linked:
        counts[i] += 1
        counts[j] += 1
    root = {r[0]: r[0] for r in rows}
    while True:
        before = dict(root)
        for i, j in linked:
            a, b = rows[i][0], rows[j][0]
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    return sorted(((r[0], counts[i], root[r[0]]) for i, r in enumerate(rows)), key=str)


def make(n, dim, seed):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        v = rng.normal(size=dim)
        v /= np.linalg.norm(v)
        out.append(v)
        for _ in range(rng.integers(0, 4)):
            step = rng.normal(size=dim) / np.sqrt(dim)
            out.append(v + rng.choice([0.0, 0.1, 0.28, 0.33, 0.4]) * step)
    hot = out[0]
    out += [hot + 0.02 * rng.normal(size=dim) / np.sqrt(dim) for _ in range(n // 4)]
    out += [2 * out[1], out[1], out[1]]
    order = rng.permutation(len(out))
    return [(int(i), [float(np.float32(c)) for c in v]) for i, v in zip(order, out)]


@pytest.mark.parametrize("cell", [20, 10**6])
def test_links(spark, monkeypatch, cell):
    monkeypatch.setattr(embeddings, "CHUNK", 48)
    monkeypatch.setattr(embeddings.Cells.__init__, "__defaults__", (cell,))
    rows = make(300, 48, 3)
    odd = [None, [], [0.0] * 48, [float("nan")] * 48, [None] * 48, [1.0, 2.0], [2.0, 4.0], [float("inf")] * 48]
    rows += [(10_000 + i, v) for i, v in enumerate(odd)] + [(None, rows[0][1])]
    rows += [(20_000, rows[5][1]), (20_000, rows[9][1])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, n int, name string")
    got = sorted(((r[0], r[1], r[2]) for r in embeddings.links(frame).collect()), key=str)
    want = brute(rows, 0.95)
    wanted, found = sum(w[1] for w in want), sum(g[1] for g in got)
    assert found <= wanted and found >= 0.999 * wanted
    assert [g[0] for g in got] == [w[0] for w in want]
    if cell > 1000:
        assert got == want


def test_no_pair_of_wide_vectors_is_lost():
    """Vectors of 768 dimensions that differ in four of them: one end of each pair visits the other's home."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(600, 4))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    step = rng.normal(size=base.shape)
    step -= (step * base).sum(axis=1, keepdims=True) * base
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    near = 0.952 * base + np.sqrt(1 - 0.952**2) * step
    rows = np.pad(np.concatenate((base, near)), ((0, 0), (0, 764)))
    cells = embeddings.Cells(list(rows), len(rows), 0.95, 40)
    home, there = cells.places(rows)
    i, j = np.nonzero(np.triu(rows @ rows.T >= 0.95, 1))
    apart = home[i] != home[j]
    assert apart.sum() > 100
    assert (there[i, home[j]] | there[j, home[i]]).all()


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.links(none).collect() == []


def test_recall_on_the_table(spark):
    import duckdb

    rows = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.1/embeddings.parquet'").fetchall()
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= 0.95).sum(axis=1) - 1
    got = embeddings.op8_embedding_near_dedup(spark, "/root/testdata/sf0.1").toPandas()
    by_id = dict(zip(got.vec_id, got.n_links))
    found = np.array([by_id[r[0]] for r in rows])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
