import numpy as np
import pytest

from statforge.operators import reduction
from statforge.plans import models

RNG = np.random.default_rng(4)


@pytest.mark.parametrize("size", [1, 2])
@pytest.mark.parametrize("scale", [1e-4, 1.0, 30.0])
def test_repulsion_on_a_grid_is_close_to_that_of_all_pairs(size, scale):
    y = RNG.normal(size=(1500, size)) * scale
    force, total = reduction.repulsion(y)
    for widest, most in ((1.0, 0.06), (0.25, 0.002)):
        got, all_ = reduction.grid_repulsion(y, widest)
        assert all_ == pytest.approx(total, rel=0.01) and np.linalg.norm(got - force) < most * np.linalg.norm(force)


def test_layouts_without_pairs_keep_neighbours_together(monkeypatch):
    monkeypatch.setattr(reduction, "repulsion", None)
    n = 1200
    x = np.concatenate([RNG.normal(size=(n // 2, 5)), RNG.normal(size=(n // 2, 5)) + 12])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :15]
    y = reduction.layout(near, np.take_along_axis(d, near, axis=1), 2, 5.0, 0.5, 400, 1)
    apart = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    np.fill_diagonal(apart, np.inf)
    assert ((apart.argmin(axis=1) < n // 2) == (np.arange(n) < n // 2)).mean() > 0.98
    assert np.mean([len(set(a) & set(b)) for a, b in zip(near, np.argsort(apart, axis=1)[:, :15])]) > 5


@pytest.mark.parametrize("name", ["tsne", "diffusion_map"])
def test_registered_layouts_take_all_their_iterations(spark, monkeypatch, name):
    seen = []

    class Made:
        embedding = None

    monkeypatch.setattr(reduction, name, lambda *args, **kw: seen.append(kw) or Made())
    models.BOOK.queries[name](spark, "/root/testdata/sf0.001")
    assert "iterations" not in seen[0]


def test_diffusion_maps_settle_where_eigenvalues_are_close(spark):
    n = 150
    x = np.linspace(0, 30, n) + RNG.normal(size=n) * 0.01  # a chain: the leading eigenvalues nearly meet
    k = np.exp(-((x[:, None] - x[None]) ** 2))
    k[k < 1e-4] = 0
    rows = [(i, j, float(k[i, j])) for i, j in zip(*np.nonzero(k))]
    kernel = spark.createDataFrame([(int(i), int(j), v) for i, j, v in rows], "i bigint, j bigint, value double")
    m = reduction.diffusion_map(kernel, 2)
    d = k.sum(axis=1)
    values, vecs = np.linalg.eigh(k / np.sqrt(np.outer(d, d)))
    assert np.allclose(m.eigenvalues, values[::-1][1:3], atol=1e-7)
    got = m.embedding.orderBy("i").toPandas()
    for c, at in (("dm0", -2), ("dm1", -3)):
        want = vecs[:, at] * values[at] / np.sqrt(d)
        assert abs(got[c].to_numpy() @ want) / np.linalg.norm(got[c]) / np.linalg.norm(want) > 0.9999
