import numpy as np
import pytest
from pyspark.sql import functions as F

from statforge.errors import InvalidLabels, InvalidParameter, NotConverged, TooLarge
from statforge.operators import bayes, clusters, compose, linear, neighbours, reduction, svm, trees
from statforge.operators.dataset import Dataset
from statforge.streaming.incremental import fit_stream, packed, parquet_stream, unpacked

RNG = np.random.default_rng(3)
X = RNG.normal(size=(400, 3)) + [0, 2, -1]
NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    y = X @ [1.0, -2.0, 0.5] + 3 + RNG.normal(size=400) * 0.1
    rows = [(i, *map(float, X[i]), float(y[i]), bool(X[i, 0] + X[i, 1] > 2), int(np.argmax(X[i] - [0, 2, -1]))) for i in range(400)]
    return spark.createDataFrame(rows, "row_id bigint, a double, b double, c double, y double, t boolean, k int").repartition(3).cache()


def columns(df, *names):
    return df.orderBy("row_id").select(*names).toPandas().to_numpy()


def vectors(spark, points):
    return spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(points)], "vec_id bigint, embedding array<double>")


@pytest.mark.parametrize("metric,cells", [("l2", 10**6), ("l1", 10**6), ("linf", 10**6), ("lp", 10**6), ("wasserstein", 10**6), ("l2", 1), ("wasserstein", 1)])
def test_neighbours_equal_brute_force_on_both_paths(spark, metric, cells):
    x = RNG.normal(size=(50, 4))
    df = vectors(spark, x)
    d = np.array([[{"l2": np.sqrt(((p - q) ** 2).sum()), "l1": np.abs(p - q).sum(), "linf": np.abs(p - q).max(), "lp": (np.abs(p - q) ** 3).sum() ** (1 / 3), "wasserstein": np.abs(np.cumsum(p - q)).sum()}[metric] for q in x] for p in x])
    got = neighbours.k_nearest(df, df, 3, metric=metric, p=3.0, cells=cells, block=30).collect()
    want = {(i, int(j)) for i in range(50) for j in np.argsort(d[i], kind="stable")[:3]}
    assert {(r.query, r.id) for r in got} == want
    near = neighbours.within_range(df, df, 1.2, metric=metric, p=3.0, cells=cells, block=30).collect()
    assert {(r.query, r.id) for r in near} == {(i, j) for i in range(50) for j in range(50) if d[i, j] < 1.2} and len(near) == (d < 1.2).sum()


def test_silhouette_of_one_label_and_by_tiles(spark):
    df = vectors(spark, RNG.normal(size=(40, 2))).withColumn("label", (F.col("vec_id") % 3).cast("int"))
    a, b = neighbours.silhouette(df).first()[0], neighbours.silhouette(df, cells=1, block=25).first()[0]
    assert a == pytest.approx(b) and neighbours.silhouette(df.withColumn("label", F.lit(1))).first()[0] == 1.0


def test_least_squares(frame):
    y = columns(frame, "y")[:, 0]
    want = np.linalg.lstsq(np.column_stack([X, np.ones(400)]), y, rcond=None)[0]
    m = linear.ols(frame, NAMES, "y")
    assert np.allclose([*m.weights, m.intercept], want)
    assert np.allclose(linear.ols(frame, NAMES, "y", intercept=False).weights, np.linalg.lstsq(X, y, rcond=None)[0])


@pytest.mark.parametrize("ratio", [0.0, 0.4, 1.0])
def test_elastic_net_meets_its_optimality_conditions(frame, ratio):
    y = columns(frame, "y")[:, 0]
    m = linear.elastic_net(frame, NAMES, "y", 0.3, ratio, tolerance=1e-12, iterations=5000)
    g = X.T @ (y - y.mean() - X @ m.weights) / 400 - 0.3 * (1 - ratio) * m.weights
    on = m.weights != 0
    assert np.allclose(g[on], 0.3 * ratio * np.sign(m.weights[on]), atol=1e-6) and (np.abs(g[~on]) <= 0.3 * ratio + 1e-6).all()
    multi = linear.multi_task_elastic_net(frame, NAMES, ["y"], 0.3, ratio, tolerance=1e-12, iterations=5000)
    assert np.allclose(multi.weights[:, 0], m.weights, atol=1e-6) and (ratio == 0 or m.duality_gap < 1e-6 * 400 * y.var())


def test_lars_ends_at_least_squares(frame):
    y = columns(frame, "y")[:, 0]
    m = linear.lars(frame, NAMES, "y")
    assert np.allclose(m.weights, np.linalg.lstsq(X, y - y.mean(), rcond=None)[0], atol=1e-6) and m.alphas[0] == pytest.approx(np.abs(X.T @ (y - y.mean())).max() / 400)


def test_isotonic_fit_is_monotone_and_pools_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (3.0, 2.0), (4.0, 6.0)], "x double, y double")
    m = linear.isotonic(df, "x", "y")
    assert m.x.tolist() == [1.0, 3.0, 4.0] and m.y.tolist() == pytest.approx([1, 7 / 3, 6])
    got = m.predict(spark.createDataFrame([(0.0,), (2.0,), (9.0,)], "x double")).collect()
    assert [r.prediction for r in got] == pytest.approx([1, 1 + (7 / 3 - 1) / 2, 6])


@pytest.mark.parametrize("power,link", [(0.0, None), (1.0, None), (1.5, None), (2.0, None), (0.0, "log")])
def test_generalised_models_have_no_gradient_left(frame, power, link):
    df = frame.withColumn("z", F.exp(0.3 * F.col("a") + 0.2 * F.col("b")) + 0.1)
    z, m = columns(df, "z")[:, 0], linear.tweedie(df, NAMES, "z", power, 0.5, link, tolerance=1e-7)
    e = X @ m.weights + m.intercept
    mu, slope = (e, 1) if m.link == "identity" else (np.exp(e), np.exp(e))
    r = -(z - mu) / mu**power * slope
    assert abs(r.sum()) < 1e-3 and np.allclose(X.T @ r + 0.5 * m.weights, 0, atol=1e-3)


def test_generalised_models_check_their_input(frame):
    with pytest.raises(InvalidParameter):
        linear.tweedie(frame, NAMES, "y", 0.5)
    with pytest.raises(InvalidLabels):
        linear.tweedie(frame, NAMES, "y", 2.0)


def test_logistic_models_have_no_gradient_left(frame):
    t = columns(frame, "t")[:, 0].astype(float)
    m = linear.logistic(frame, NAMES, "t", tolerance=1e-8)
    p = 1 / (1 + np.exp(-(X @ m.weights + m.intercept)))
    assert np.allclose(X.T @ (p - t) + m.weights, 0, atol=1e-5) and abs((p - t).sum()) < 1e-5
    assert (columns(m.predict(frame), "prediction")[:, 0] == (p >= 0.5)).all()
    k = columns(frame, "k")[:, 0].astype(int)
    mm = linear.multi_logistic(frame, NAMES, "k", tolerance=1e-7)
    e = X @ mm.weights + mm.intercepts
    q = np.exp(e) / np.exp(e).sum(axis=1, keepdims=True)
    assert np.allclose(X.T @ (q - np.eye(3)[k]) + mm.weights, 0, atol=1e-4)
    assert np.allclose(np.stack(columns(mm.predict_probabilities(frame), "probabilities")[:, 0]), q)
    with pytest.raises(InvalidLabels):
        linear.logistic(frame, NAMES, "k")


def test_bayes_in_two_batches_equals_one(frame):
    whole = bayes.gaussian_nb(frame, NAMES, "k", smoothing=0.0)
    first = bayes.gaussian_nb(frame.filter("row_id < 150"), NAMES, "k", smoothing=0.0)
    both = bayes.gaussian_nb(frame.filter("row_id >= 150"), NAMES, "k", smoothing=0.0, model=first)
    assert all(np.allclose(whole.variances[c], both.variances[c]) and np.allclose(whole.means[c], both.means[c]) for c in whole.classes)
    assert np.allclose(np.stack(columns(both.predict_proba(frame), "proba")[:, 0]).sum(axis=1), 1)
    assert unpacked(packed(both)).counts == both.counts
    assert (columns(whole.predict(frame), "prediction")[:, 0] == columns(frame, "k")[:, 0]).mean() > 0.8


def test_followed_leader_learns(frame):
    m = None
    for _ in range(8):
        m = bayes.ftrl(frame, NAMES, "t", alpha=0.1, l1=0.0, l2=0.0, model=m)
    p = columns(m.predict(frame), "probability")[:, 0].astype(float)
    assert ((p > 0.5) == columns(frame, "t")[:, 0].astype(bool)).mean() > 0.7


def grown(x, y, idx, depth, most):
    """A tree by brute force: a predicted label for each row of idx."""
    labels, counts = np.unique(y[idx], return_counts=True)
    gini = lambda r: 1 - ((np.unique(y[r], return_counts=True)[1] / len(r)) ** 2).sum()
    best = None
    if depth < most and len(idx) >= 2:
        for f in range(x.shape[1]):
            v = np.unique(x[idx, f])
            for lo, hi in zip(v[:-1], v[1:]):
                if hi - lo >= 1e-5:
                    a, b = idx[x[idx, f] <= lo], idx[x[idx, f] > lo]
                    s = round(len(b) / len(idx) * gini(b) + len(a) / len(idx) * gini(a), 12)
                    if best is None or s < best[0]:
                        best = (s, a, b)
    if best is None or gini(idx) - best[0] < 1e-5:
        return {int(i): labels[np.argmax(counts)] for i in idx}
    return grown(x, y, best[1], depth + 1, most) | grown(x, y, best[2], depth + 1, most)


def test_tree_equals_brute_force(frame):
    few = frame.filter("row_id < 120")
    tree = trees.decision_tree(few, NAMES, "k", params=trees.TreeParams(max_depth=3))
    want = grown(X[:120], columns(few, "k")[:, 0].astype(int), np.arange(120), 0, 3)
    assert columns(tree.predict(few), "prediction")[:, 0].tolist() == [want[i] for i in range(120)]
    assert tree.max_depth() <= 3 and sum(tree.feature_importance()) == pytest.approx(1) and "forest" in tree.to_tikz(legend=True)
    assert tree.num_leaves() == sum(n.leaf for n in tree.iter_nodes())


def test_ensembles(frame):
    ds = Dataset(frame.filter("row_id < 100"), tuple(NAMES), ("t",))
    shallow = trees.TreeParams(max_depth=2)
    for model in (trees.random_forest(ds, 3, 1.0, 1.0, params=shallow), trees.ada_boost(ds, 3)):
        got = columns(model.predict(ds.df), "prediction", "t")
        assert (got[:, 0] == got[:, 1]).mean() > 0.75


def test_lloyd_by_hand_and_errors(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (11.0,)], "x double")
    m = clusters.kmeans(df, ["x"], 2, init=np.array([[0.0], [10.0]]), tolerance=1e-9)
    assert m.centroids[:, 0] == pytest.approx([0.5, 10.5], abs=1e-6) and m.counts.tolist() == [2, 2]
    with pytest.raises(NotConverged):
        clusters.kmeans(df, ["x"], 2, init=np.array([[0.0], [5.0]]), iterations=1)
    with pytest.raises(InvalidParameter):
        clusters.kmeans(df, ["x"], 0)
    model, _ = clusters.kmeans_update(None, df.limit(2), ["x"], 2, init=np.array([[0.0], [10.0]]))
    assert model.centroids[1, 0] == 10.0


@pytest.mark.parametrize("cells", [10**6, 1])
def test_dbscan_equals_brute_force(spark, cells):
    x = np.concatenate([RNG.normal(size=(30, 2)) * 0.3, RNG.normal(size=(30, 2)) * 0.3 + 4, RNG.uniform(-5, 9, (20, 2))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) < 0.5
    core = d.sum(axis=1) >= 4
    label, n = {}, 0
    for i in range(len(x)):
        if core[i] and i not in label:
            todo = [i]
            while todo:
                p = todo.pop()
                if label.setdefault(p, n) == n and core[p]:
                    todo += [int(q) for q in np.flatnonzero(d[p]) if q not in label]
            n += 1
    got = {r.id: r.cluster for r in clusters.dbscan(vectors(spark, x), 4, 0.5, cells=cells).collect()}
    assert got == {i: label.get(i) for i in range(len(x))}


def test_optics_and_linkage(spark):
    x = np.array([[0.0], [0.1], [0.2], [5.0], [5.1], [5.2]])
    rows = clusters.optics(vectors(spark, x), 2).orderBy("position").collect()
    assert sorted(r.id for r in rows) == list(range(6)) and rows[0].reachability is None and [r.id for r in rows if r.reachability and r.reachability > 1] in ([3], [5], [4])
    kernel = neighbours.dense_kernel(vectors(spark, x), "gaussian", 2.0)
    got = {r.id: r.cluster for r in clusters.hierarchical(kernel).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    with pytest.raises(TooLarge):
        clusters.hierarchical(kernel, most=3)


def test_mixture_separates_blobs(spark):
    x = np.concatenate([RNG.normal(size=(150, 2)), RNG.normal(size=(150, 2)) * 0.5 + 8])
    df = spark.createDataFrame(x.tolist(), "a double, b double")
    m = clusters.gaussian_mixture(df, ["a", "b"], 2)
    assert sorted(m.weights.round(2)) == [0.5, 0.5] and np.allclose(np.sort(m.means[:, 0]), [x[:150, 0].mean(), x[150:, 0].mean()], atol=0.01)


def test_svm_meets_its_conditions(frame):
    few = frame.filter("row_id < 80")
    x, t = X[:80], columns(few, "t")[:, 0].astype(bool)
    m = svm.svc(few, NAMES, "t", eps=1e-6)
    f, y = x @ m.weights() - m.rho, np.where(t, 1, -1)
    assert abs(m.coefficients.sum()) < 1e-8 and (np.abs(m.coefficients) <= 1 + 1e-12).all()
    value = 0.5 * m.weights() @ m.weights() + np.maximum(0, 1 - y * f).sum()
    assert value == pytest.approx(-m.objective, rel=1e-4)  # no duality gap
    w = svm.linear_svc(few, NAMES, "t")
    f2 = x @ w.weights + w.intercept
    assert 0.5 * w.weights @ w.weights + np.maximum(0, 1 - y * f2).sum() <= value * 1.02
    nu = svm.svc(few, NAMES, "t", c=None, nu=0.3, kernel=svm.Kernel("gaussian", 5.0), eps=1e-6, probabilities=True)
    p = columns(nu.predict_probability(few), "probability")[:, 0].astype(float)
    assert ((p > 0.5) == t).mean() > 0.9
    out = svm.one_class(few, NAMES, 0.2, svm.Kernel("gaussian", 5.0), eps=1e-6).predict(few)
    assert 0.6 < columns(out, "prediction")[:, 0].astype(bool).mean() < 0.95
    for r in (svm.svr(few, NAMES, "y", c=10.0, eps=1e-4), svm.svr(few, NAMES, "y", c=10.0, nu=0.5, eps=1e-4)):
        assert np.abs(columns(r.predict_value(few), "prediction")[:, 0].astype(float) - columns(few, "y")[:, 0]).mean() < 0.2


def test_composition(frame):
    p = compose.platt_fit(frame.withColumn("v", F.col("a") + F.col("b") - 2), "v", "t")
    assert p.a < 0 and p.predict(frame.withColumn("v", F.lit(5.0)), "v").first().probability > 0.99
    ch = compose.chain(frame, "y", lambda d, t: linear.ols(d, ["a"], t), lambda d, t: linear.ols(d, ["b", "c"], t))
    rest = columns(ch.predict(frame), "prediction", "y").astype(float)
    assert np.abs(rest[:, 0] - rest[:, 1]).mean() < 0.2
    with pytest.raises(InvalidParameter):
        compose.chain(frame, "y", None, None, 0.0)


def test_reduction(spark, frame):
    m = reduction.pca(frame, NAMES, 3)
    s = np.linalg.svd(X - X.mean(axis=0), compute_uv=False)
    assert np.allclose(m.sigma, s) and m.explained_variance_ratio().sum() == pytest.approx(1)
    back = columns(m.inverse_transform(m.transform(frame)), *[f"back_{c}" for c in NAMES]).astype(float)
    assert np.allclose(back, X)
    assert reduction.least_dimensions(1000, 0.1) == 5920
    with pytest.raises(InvalidParameter):
        reduction.random_projection(frame, NAMES, dimensions=4)
    ica = reduction.fast_ica(frame, NAMES, function="logcosh_textbook")
    assert np.allclose(np.cov(columns(ica.predict(frame), "ic0", "ic1", "ic2").astype(float).T, ddof=0), np.eye(3), atol=1e-6)
    full = reduction.pls_regression(frame, NAMES, ["y"], 3)
    assert np.allclose(columns(full.predict(frame), "prediction_y")[:, 0].astype(float), columns(linear.ols(frame, NAMES, "y").predict(frame), "prediction")[:, 0].astype(float), atol=1e-6)
    two = frame.withColumn("z", F.col("b") * F.col("b") + 3 * F.col("c"))
    for fit in (reduction.pls_canonical, reduction.pls_cca):
        model = fit(two, NAMES, ["y", "z"], 2)
        xs = columns(model.transform(two), "xs0", "xs1", "ys0", "ys1").astype(float)
        assert abs(np.corrcoef(xs[:, 0], xs[:, 2])[0, 1]) > 0.9 and abs(np.corrcoef(xs[:, 0], xs[:, 1])[0, 1]) < 1e-3


def test_diffusion_map_equals_dense_eigenvectors(spark):
    x = RNG.normal(size=(30, 2))
    kernel = neighbours.dense_kernel(vectors(spark, x), "gaussian", 2.0)
    m = reduction.diffusion_map(kernel, 2, iterations=12)
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 2)
    d = k.sum(axis=1)
    values, vecs = np.linalg.eigh(k / np.sqrt(np.outer(d, d)))
    assert np.allclose(m.eigenvalues, values[::-1][1:3], atol=1e-3)
    got = m.embedding.orderBy("i").toPandas()["dm0"].to_numpy()
    want = vecs[:, -2] * values[-2] / np.sqrt(d)
    assert abs(got @ want) / np.sqrt((got @ got) * (want @ want)) > 0.99


def test_layout_keeps_neighbours_together(spark):
    x = np.concatenate([RNG.normal(size=(20, 3)) * 0.1, RNG.normal(size=(20, 3)) * 0.1 + 5])
    y = reduction.tsne(vectors(spark, x), iterations=150).orderBy("id").toPandas()[["t0", "t1"]].to_numpy()
    inner = np.linalg.norm(y[:20] - y[:20].mean(axis=0), axis=1).mean()
    assert np.linalg.norm(y[:20].mean(axis=0) - y[20:].mean(axis=0)) > inner
    with pytest.raises(InvalidParameter):
        reduction.tsne(vectors(spark, x[:5]))


def test_streams_learn_each_file_once(spark, frame, tmp_path):
    frame.select("a", "b", "c", "k").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = parquet_stream(spark, str(tmp_path / "in"))
    query, models = fit_stream(stream, tmp_path.name, lambda df, m: bayes.gaussian_nb(df, NAMES, "k", smoothing=0.0, model=m), str(tmp_path / "state"))
    query.awaitTermination()
    m, whole = models.latest(), bayes.gaussian_nb(frame, NAMES, "k", smoothing=0.0)
    assert len(models.versions()) == 3 and m.counts == whole.counts and all(np.allclose(m.variances[c], whole.variances[c]) for c in m.classes)


def test_kernels_and_their_operations(spark):
    x = RNG.normal(size=(25, 3))
    df = vectors(spark, x)
    k = neighbours.dense_kernel(df, "polynomial", 1.0, 2.0)
    want = (x @ x.T + 1) ** 2
    assert {(r.i, r.j): round(r.value, 9) for r in k.collect()} == {(i, j): round(float(want[i, j]), 9) for i in range(25) for j in range(25)}
    assert neighbours.kernel_size(k) == 25 and neighbours.kernel_upper_triangle(k).count() == 300 and neighbours.kernel_column_of(k, 3).count() == 25
    sparse = {(r.i, r.j) for r in neighbours.sparse_kernel(df, 2, "gaussian").select("i", "j").collect()}
    near = np.argsort(((x[:, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, 1:3]
    edges = {(i, int(j)) for i in range(25) for j in near[i]}
    assert sparse == edges | {(j, i) for i, j in edges} | {(i, i) for i in range(25)}


def test_registered_fits_read_every_coordinate(spark):
    from statforge.plans import models

    d = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, label = np.array(df.embedding.tolist(), float), df.label.to_numpy()
    classes = np.unique(label)
    joint = np.stack([np.log((label == c).mean()) - 0.5 * (np.log(2 * np.pi * (v := x[label == c].var(axis=0) + 1e-9 * x.var(axis=0).max())) + (x - x[label == c].mean(axis=0)) ** 2 / v).sum(axis=1) for c in classes], axis=1)
    p = np.exp(joint - joint.max(axis=1, keepdims=True))
    got = np.array([r.proba for r in models.BOOK.queries["naive_bayes_proba"](spark, d).orderBy("vec_id", "label").collect()]).reshape(len(x), -1)
    assert np.allclose(got, p / p.sum(axis=1, keepdims=True), atol=1e-4)
    assert {f"e{i}" for i in range(1, 64)} <= {str(v) for r in models.BOOK.queries["lars"](spark, d).collect() for v in r}
