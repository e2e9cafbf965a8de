import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statforge.errors import InvalidParameter, MismatchedShapes, NotEnoughSamples
from statforge.functions import text as tx
from statforge.operators import metrics, scaling
from statforge.operators.dataset import Dataset
from statforge.operators.rows import indexed, median, quantile, running
from statforge.operators.vectorize import CountVectorizer, tf_idf
from statforge.sources import files, generate


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(v), float(w)) for i, (v, w) in enumerate(zip(rng.normal(size=500).round(2), rng.random(500)))]
    return spark.createDataFrame(rows, "k bigint, v double, w double"), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


@pytest.mark.parametrize("bucket", [40, 1_000_000])
def test_running_totals_and_row_numbers_are_the_same_in_any_number_of_buckets(numbers, bucket):
    df, v, w = numbers
    got = running(df, ["v", "k"], {"s": F.col("w")}, rows_a_bucket=bucket).orderBy("v", "k").toPandas()
    order = np.lexsort((np.arange(500), v))
    assert np.allclose(got["s"], np.cumsum(w[order]))
    rows = indexed(df, ["v", "k"], rows_a_bucket=bucket).orderBy("row_id").toPandas()
    assert rows["row_id"].tolist() == list(range(500)) and rows["k"].tolist() == order.tolist()


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.937, 1.0])
@pytest.mark.parametrize("most", [20, 10**6])
def test_quantiles_are_exact(numbers, q, most):
    df, v, _ = numbers
    assert quantile(df, F.col("v"), q, most) == pytest.approx(np.quantile(v, q))


def test_quantiles_of_nothing_and_of_one_value(spark):
    with pytest.raises(NotEnoughSamples):
        median(spark.createDataFrame([(None,)], "v double"), F.col("v"))
    assert median(spark.createDataFrame([(3.0,)] * 7 + [(None,)], "v double"), F.col("v")) == 3.0


def dataset(spark, n=10):
    rows = [(i, float(i), float(i % 3), "ab"[i % 2], 1.0 + i % 2) for i in range(n)]
    return Dataset.of(spark.createDataFrame(rows, "k bigint, x double, y double, t string, w double"), ["x", "y"], ["t"], "w", order=["k"])


def test_splits_follow_the_order_of_rows(spark):
    ds = dataset(spark)
    first, rest = ds.split_with_ratio(0.75)
    assert [r.k for r in first.df.orderBy("k").collect()] == list(range(8)) and rest.nsamples() == 2 and rest.weight == "w"
    folds = ds.fold(3)
    assert [sorted(r.k for r in v.df.collect()) for _, v in folds] == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    assert all(t.nsamples() == 7 for t, _ in folds)  # the tenth row always trains
    assert sorted({(r.chunk, r.k) for r in ds.sample_chunks(4).collect()})[-1] == (1, 7)


def test_labels_and_weights(spark):
    ds = dataset(spark)
    assert ds.labels() == ["a", "b"]
    assert {r.label: r.weight for r in ds.label_frequencies(F.col("x") < 5).collect()} == {"a": 3.0, "b": 4.0}
    assert ds.with_labels(["b"]).nsamples() == 5
    assert ds.one_vs_all().filter("t").count() == 10
    assert ds.shuffle().weight is None and sorted(r.k for r in ds.shuffle().df.collect()) == list(range(10))
    assert ds.with_records(ds.df, ["x"]).weight is None and ds.with_targets(ds.df, ["y"]).weight == "w"
    with pytest.raises(MismatchedShapes):
        ds.with_feature_names(["only"])


def test_bootstraps_draw_with_replacement(spark):
    ds = dataset(spark)
    sample, picked = next(ds.bootstrap(20, 3))
    rows = sample.df.collect()
    assert len(rows) == 20 and len(sample.features) == 3 and {r._source for r in rows} <= set(range(10))
    assert all(r[sample.features[0]] == (float(r._source) if picked[0] == 0 else float(r._source % 3)) for r in rows)
    assert [len(next(ds.bootstrap_samples(4)).df.collect())] == [4]


def test_scalers_on_constant_and_zero_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0.0), (3.0, 5.0, 0.0)], "a double, b double, c double")
    cols = ["a", "b", "c"]
    assert [tuple(r) for r in scaling.standard_scaler(df, cols).transform(df).collect()] == [(-1.0, 0.0, 0.0), (1.0, 0.0, 0.0)]
    assert [tuple(r) for r in scaling.min_max_scaler(df, cols, 5, 10).transform(df).collect()] == [(5.0, 5.0, 5.0), (10.0, 5.0, 5.0)]
    assert scaling.max_abs_scaler(df, cols).transform(df).first()["c"] == 0.0
    with pytest.raises(InvalidParameter):
        scaling.min_max_scaler(df, cols, 2, 1)
    with pytest.raises(NotEnoughSamples):
        scaling.standard_scaler(df.limit(0), cols)
    assert math.isnan(scaling.norm_scaled(spark.createDataFrame([(0.0, 0.0)], "a double, b double"), ["a", "b"]).first()["a"])


@pytest.mark.parametrize("kind", ["pca", "zca", "cholesky"])
def test_whitened_covariance_is_the_identity(spark, kind):
    x = np.random.default_rng(0).normal(size=(300, 3)) @ np.array([[2.0, 0.5, 0], [0, 1, 0.3], [0, 0, 0.1]]) + 7
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    y = scaling.whitener(df, ["a", "b", "c"], kind).transform(df).toPandas().to_numpy()
    assert np.allclose(np.cov(y.T), np.eye(3), atol=1e-6) and np.allclose(y.mean(axis=0), 0, atol=1e-9)


def test_binary_scores_by_hand(spark):
    pred, truth = [0, 1, 1, 1, 0, 1], [0, 0, 1, 1, 1, 0]
    m = metrics.confusion_matrix(spark.createDataFrame(list(zip(pred, truth)), "p int, t int"), "p", "t")
    assert m.members == (1, 0) and m.matrix.tolist() == [[2, 2], [1, 1]]
    assert m.precision() == pytest.approx(2 / 3) and m.recall() == 0.5 and m.accuracy() == 0.5
    assert m.recall_textbook() == m.precision() and m.f1_score() == pytest.approx(4 / 7)
    assert "2" in str(m)


def test_roc_of_a_perfect_and_of_a_constant_score(spark):
    good = spark.createDataFrame([(0.1, False), (0.2, False), (0.8, True), (0.9, True)], "s double, t boolean")
    assert metrics.area_under_curve(good, "s", "t").first()[0] == 1.0
    flat = spark.createDataFrame([(0.5, False), (0.5, True)], "s double, t boolean")
    assert metrics.area_under_curve(flat, "s", "t").first()[0] == 0.5
    assert [(r.tp, r.fp) for r in metrics.roc(flat, "s", "t").collect()] == [(0.0, 0.0), (1.0, 1.0)]


def test_ngrams_stop_when_words_run_out(spark):
    df = spark.createDataFrame([("a b c",), ("a",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.ngrams(tx.tokens(F.col("t"), r"\w+"), 2, 3)).collect()]
    assert got == [["a b", "a b c", "b c"], [], [], []]


def test_vocabulary_rules(spark):
    docs = spark.createDataFrame([(1, "aa bb cc"), (2, "aa bb"), (3, "aa ﬁne"), (4, None)], "doc_id bigint, text string")
    words = lambda how: {r.term: r.df for r in how.fit(docs).words().collect()}
    assert words(CountVectorizer()) == {"aa": 3, "bb": 2, "cc": 1, "fine": 1}  # the ligature is decomposed
    assert words(CountVectorizer(document_frequency=(0.5, 1.0))) == {"aa": 3, "bb": 2}
    assert words(CountVectorizer(max_features=3, stopwords=("aa",))) == {"bb": 2, "fine": 1, "cc": 1}
    assert words(CountVectorizer(tokenizer=lambda t: t.split("b"), normalise=False))["aa "] == 2
    fitted = CountVectorizer().fit_vocabulary(docs, ["cc", "zz"])
    assert [tuple(r) for r in fitted.transform(docs).collect()] == [(1, "cc", 1)]
    w = {(r.doc_id, r.term): r.tf_idf for r in tf_idf(CountVectorizer().fit(docs), docs, "textbook").collect()}
    assert w[1, "aa"] == pytest.approx(math.log(4 / 4)) and w[1, "cc"] == pytest.approx(math.log(4 / 2))
    with pytest.raises(InvalidParameter):
        CountVectorizer(ngrams=(2, 1)).fit(docs)


def test_csv_and_text_sources(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv").write_text("x;y\n1;2.5\n-3;4\n")
    assert sorted(tuple(r) for r in files.csv_table(spark, str(tmp_path / "a.csv"), separator=";").collect()) == [(-3.0, 4.0), (1.0, 2.5)]
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("7,8\n")
    assert files.csv_table(spark, str(tmp_path / "b.csv.gz"), ["p", "q"], has_headers=False).first().asDict() == {"p": 7.0, "q": 8.0}
    (tmp_path / "c.txt").write_bytes("Größe".encode("latin-1"))
    assert files.text_files(spark, [str(tmp_path / "c.txt")], "latin-1").first().text == "Größe"
    assert files.text_files(spark, [str(tmp_path / "c.txt")], "ascii", "ignore").first().text == "Gre"
    with pytest.raises(InvalidParameter):
        files.text_files(spark, ["x"], "no-such-charset")


def test_generators_have_the_right_shapes(spark):
    b = generate.blobs(spark, 400, [[0.0, 0.0], [10.0, -10.0]]).groupBy("blob").agg(F.count("x0"), F.avg("x0"), F.avg("x1"), F.stddev("x0")).orderBy("blob").collect()
    assert [r[1] for r in b] == [400, 400] and abs(b[1][2] - 10) < 0.2 and abs(b[1][3] + 10) < 0.2 and abs(b[0][4] - 1) < 0.1
    r = generate.rings2d(spark, [(1.0, 2.0), (5.0, 6.0)], 101).selectExpr("ring", "sqrt(x * x + y * y) as r").collect()
    assert len(r) == 102 and all((1 <= x.r <= 2) if x.ring == 0 else (5 <= x.r <= 6) for x in r)
    assert generate.convoluted_rings(spark, [(1.0, 2.0)], 10).selectExpr("max(x * x + y * y + z * z)").first()[0] <= 4.0001
    assert generate.swissroll(spark, 3.0, 1.0, 50).selectExpr("max(z) <= 3").first()[0]
    assert generate.make_dataset(spark, 5, 2, 1).columns == ["row_id", "x0", "x1", "y0"]
