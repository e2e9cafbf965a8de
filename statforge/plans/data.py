"""Queries of dataset transforms, scaling, text and metrics."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import drawn_number, drawn_sql, normal_sql, uniform_sql
from ..operators import metrics, reduction, scaling
from ..operators.dataset import Dataset
from ..operators.linear import ols
from ..operators.vectorize import CountVectorizer, tf_idf
from ..sources import files, generate
from ..sources.store import shared_dir, table
from .common import LINE, Book, listed, rounded

BOOK = Book()


def _orders(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset.of(table(spark, sf_dir, "orders"), ["o_totalprice"], ["o_orderpriority"], order=["o_orderkey"])


# Scaling. l_lineitem rows have no key: all columns are returned.


def _scaled(fit):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
        return rounded(fit(df), LINE)

    return query


def _scaled_sql(expr: str, stats: str) -> str:
    cols = ", ".join(f"round({expr.format(c=c)}, 6) + 0.0 as {c}" for c in LINE)
    made = ", ".join(stats.format(c=c) for c in LINE)
    return f"with s as (select {made} from lineitem) select l_orderkey, l_linenumber, {cols} from lineitem, s"


_MEAN_DEV = "avg({c}) as m_{c}, stddev_pop({c}) as d_{c}"
_LOW_HIGH = "min({c}) as a_{c}, max({c}) as b_{c}"
BOOK.add("standard_scaler", _scaled_sql("({c} - m_{c}) / d_{c}", _MEAN_DEV))(_scaled(lambda df: scaling.standard_scaler(df, LINE).transform(df)))
BOOK.add("standard_scaler_no_mean", _scaled_sql("({c} - m_{c}) / d_{c} + m_{c}", _MEAN_DEV))(_scaled(lambda df: scaling.standard_scaler(df, LINE, with_mean=False).transform(df)))
BOOK.add("standard_scaler_no_std", _scaled_sql("{c} - m_{c}", _MEAN_DEV))(_scaled(lambda df: scaling.standard_scaler(df, LINE, with_std=False).transform(df)))
BOOK.add("min_max_scaler", _scaled_sql("({c} - a_{c}) / (b_{c} - a_{c})", _LOW_HIGH))(_scaled(lambda df: scaling.min_max_scaler(df, LINE).transform(df)))
BOOK.add("min_max_scaler_range", _scaled_sql("({c} - a_{c}) / (b_{c} - a_{c}) * 5 + 5", _LOW_HIGH))(_scaled(lambda df: scaling.min_max_scaler(df, LINE, 5.0, 10.0).transform(df)))
BOOK.add("max_abs_scaler", _scaled_sql("{c} / b_{c}", "max(abs({c})) as b_{c}"))(_scaled(lambda df: scaling.max_abs_scaler(df, LINE).transform(df)))
for _kind, _norm in (("l1", "abs(l_quantity) + abs(l_extendedprice) + abs(l_discount) + abs(l_tax)"), ("l2", "sqrt(l_quantity^2 + l_extendedprice^2 + l_discount^2 + l_tax^2)"), ("max", "greatest(abs(l_quantity), abs(l_extendedprice), abs(l_discount), abs(l_tax))")):
    BOOK.add(f"norm_scaler_{_kind}", "select l_orderkey, l_linenumber, " + ", ".join(f"round({c} / ({_norm}), 9) + 0.0 as {c}" for c in LINE) + " from lineitem")(
        lambda spark, sf_dir, k=_kind: rounded(scaling.norm_scaled(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE), LINE, k), LINE, 9)
    )


@BOOK.add(
    "whitening_cholesky",
    """
with m as (select avg(l_quantity) as mq, avg(l_discount) as md, var_samp(l_quantity) as a, covar_samp(l_quantity, l_discount) as b, var_samp(l_discount) as c from lineitem),
-- the inverse covariance [[c, -b], [-b, a]] / det as R'R, R upper
r as (select mq, md, sqrt(c / (a * c - b * b)) as r11, (-b / (a * c - b * b)) / sqrt(c / (a * c - b * b)) as r12, a / (a * c - b * b) as s22 from m),
t as (select *, sqrt(s22 - r12 * r12) as r22 from r)
select l_orderkey, l_linenumber, round(r11 * (l_quantity - mq) + r12 * (l_discount - md), 6) + 0.0 as l_quantity, round(r22 * (l_discount - md), 6) + 0.0 as l_discount
from lineitem, t
""",
)
def whitening_cholesky(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(scaling.whitener(df, ["l_quantity", "l_discount"], "cholesky").transform(df), ["l_quantity", "l_discount"])


for _kind in ("pca", "zca"):
    BOOK.add(f"whitening_{_kind}")(
        lambda spark, sf_dir, k=_kind: scaling.whitener(table(spark, sf_dir, "lineitem"), LINE, k).transform(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE))
    )

_PAIR = "r as (select l_orderkey, l_linenumber, l_quantity as x, l_extendedprice / 1000 as y from lineitem), m as (select avg(x) as mx, avg(y) as my, var_samp(x) as a, covar_samp(x, y) as b, var_samp(y) as c from r)"
_EIGEN = _PAIR + """, l as (select *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) as l0, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) as l1 from m),
v as (select *, b / sqrt(b * b + (l0 - a) ** 2) as u, (l0 - a) / sqrt(b * b + (l0 - a) ** 2) as w from l)"""


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


@BOOK.add(
    "whitening_zca_pair",
    f"""
with {_PAIR}, t as (select *, sqrt(a * c - b * b) as s, sqrt(a + c + 2 * sqrt(a * c - b * b)) as q from m),
-- the inverse root of [[a, b], [b, c]] is q times the inverse of [[a + s, b], [b, c + s]]
i as (select *, q / ((a + s) * (c + s) - b * b) as f from t)
select l_orderkey, l_linenumber, round(f * ((c + s) * (x - mx) - b * (y - my)), 6) + 0.0 as x, round(f * ((a + s) * (y - my) - b * (x - mx)), 6) + 0.0 as y from r, i
""",
)
def whitening_zca_pair(spark, sf_dir):
    df = _pair(spark, sf_dir)
    return rounded(scaling.whitener(df, ["x", "y"], "zca").transform(df), ["x", "y"])


@BOOK.add(
    "whitening_pca_pair",
    f"with {_EIGEN} select l_orderkey, l_linenumber, round(abs(u * (x - mx) + w * (y - my)) / sqrt(l0), 6) + 0.0 as x, round(abs(w * (x - mx) - u * (y - my)) / sqrt(l1), 6) + 0.0 as y from r, v",
)
def whitening_pca_pair(spark, sf_dir):
    """Components by falling variance, without their signs."""
    df = _pair(spark, sf_dir)
    out = scaling.whitener(df, ["x", "y"], "pca").transform(df)
    return rounded(out.withColumns({c: F.abs(c) for c in ("x", "y")}), ["x", "y"])


@BOOK.add("pca_pair", f"with {_EIGEN} select l_orderkey, l_linenumber, round(abs(u * (x - mx) + w * (y - my)), 5) + 0.0 as pc0, round(abs(w * (x - mx) - u * (y - my)), 5) + 0.0 as pc1 from r, v")
def pca_pair(spark, sf_dir):
    """Projections on both components, without their signs."""
    df = _pair(spark, sf_dir)
    out = reduction.pca(df, ["x", "y"], 2).transform(df)
    return rounded(out.select("l_orderkey", "l_linenumber", F.abs("pc0").alias("pc0"), F.abs("pc1").alias("pc1")), ["pc0", "pc1"], 5)


# Dataset transforms


@BOOK.add(
    "split_with_ratio",
    """
with r as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos, count(*) over () as n from orders)
select o_orderkey, case when pos < ceil(n * 0.9) then 'train' else 'valid' end as side from r
""",
)
def split_with_ratio(spark, sf_dir):
    first, rest = _orders(spark, sf_dir).split_with_ratio(0.9)
    return first.df.select("o_orderkey", F.lit("train").alias("side")).union(rest.df.select("o_orderkey", F.lit("valid").alias("side")))


@BOOK.add(
    "fold",
    """
with r as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos, count(*) over () as n from orders)
select o_orderkey, (pos // (n // 7))::integer as fold from r where pos // (n // 7) < 7
""",
)
def fold(spark, sf_dir):
    parts = [valid.df.select("o_orderkey", F.lit(i).alias("fold")) for i, (_, valid) in enumerate(_orders(spark, sf_dir).fold(7))]
    return reduce(DataFrame.union, parts)


@BOOK.add("sample_chunks", "with r as (select event_id, row_number() over (order by event_id) - 1 as pos, count(*) over () as n from events) select event_id, (pos // 300)::bigint as chunk from r where pos < n // 300 * 300")
def sample_chunks(spark, sf_dir):
    return Dataset.of(table(spark, sf_dir, "events"), ["value"], order=["event_id"]).sample_chunks(300).select("event_id", "chunk")


@BOOK.add("label_counts", "select 'l_returnflag' as target, l_returnflag as label, count(*) as n from lineitem group by all union all select 'l_linestatus', l_linestatus, count(*) from lineitem group by all")
def label_counts(spark, sf_dir):
    return Dataset(table(spark, sf_dir, "lineitem"), LINE, ("l_returnflag", "l_linestatus")).label_counts()


@BOOK.add("combined_labels", "select l_returnflag as label from lineitem union select l_linestatus from lineitem")
def combined_labels(spark, sf_dir):
    return Dataset(table(spark, sf_dir, "lineitem"), LINE, ("l_returnflag", "l_linestatus")).combined_labels()


@BOOK.add("label_frequencies", "select l_returnflag as label, round(sum(l_quantity), 4) as weight from lineitem where l_discount > 0.05 group by 1")
def label_frequencies(spark, sf_dir):
    ds = Dataset(table(spark, sf_dir, "lineitem"), LINE, ("l_returnflag",), weight="l_quantity")
    return rounded(ds.label_frequencies(F.col("l_discount") > 0.05), ["weight"], 4)


@BOOK.add("one_vs_all", "select o_orderkey, label, o_orderpriority = label as target from orders, (select distinct o_orderpriority as label from orders)")
def one_vs_all(spark, sf_dir):
    ds = Dataset(table(spark, sf_dir, "orders"), ("o_totalprice",), ("o_orderpriority",))
    return ds.one_vs_all().select("o_orderkey", "label", F.col("o_orderpriority").alias("target"))


@BOOK.add("map_targets", "select o_orderkey, o_orderpriority in ('1-URGENT', '2-HIGH') as target from orders")
def map_targets(spark, sf_dir):
    ds = Dataset(table(spark, sf_dir, "orders"), ("o_totalprice",), ("o_orderpriority",))
    return ds.map_targets(lambda c: c.isin("1-URGENT", "2-HIGH")).df.select("o_orderkey", F.col("o_orderpriority").alias("target"))


@BOOK.add("with_labels", "select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '5-LOW')")
def with_labels(spark, sf_dir):
    ds = Dataset(table(spark, sf_dir, "orders"), ("o_totalprice",), ("o_orderpriority",))
    return ds.with_labels(["1-URGENT", "5-LOW"]).df.select("o_orderkey", "o_orderpriority")


@BOOK.add("feature_iter", "select p_partkey, 'p_size' as feature, p_size::double as value from part union all select p_partkey, 'p_retailprice', p_retailprice from part")
def feature_iter(spark, sf_dir):
    return Dataset(table(spark, sf_dir, "part"), ("p_size", "p_retailprice"), row_id="p_partkey").long_features()


_PLACED = "with r as (select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) - 1 as pos from orders), n as (select count(*) as n from orders)"


@BOOK.add("shuffle", _PLACED + f" select row_number() over (order by {drawn_sql('pos', 42)}, pos) - 1 as row_id, o_orderkey from r")
def shuffle(spark, sf_dir):
    return _orders(spark, sf_dir).shuffle().df.select("row_id", "o_orderkey")


_PICKED = [("p_size", "p_retailprice")[drawn_number(43, 0, i) % 2] for i in range(3)]


@BOOK.add(
    "bootstrap",
    "with r as (select *, row_number() over (order by p_partkey) - 1 as pos, count(*) over () as n from part), "
    f"d as (select k as row_id, {drawn_sql(42, 0, 'k')} % n as source from (select any_value(n) as n from r), lateral (select unnest(range(n)) as k)) "
    + f"select row_id, source, {', '.join(f'{c} as {c}__{i}' for i, c in enumerate(_PICKED[:2]))} from d join r on source = pos",
)
def bootstrap(spark, sf_dir):
    ds = Dataset.of(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], ["p_brand"], order=["p_partkey"])
    sample, _ = next(ds.bootstrap(ds.nsamples(), 2))
    return sample.df.select("row_id", "_source", *sample.features).withColumnRenamed("_source", "source")


@BOOK.add("bootstrap_samples", _PLACED + f", d as (select k as row_id, {drawn_sql(42, 0, 'k')} % n as source from n, lateral (select unnest(range(n)) as k)) select row_id, o_orderkey, o_totalprice from d join r on source = pos")
def bootstrap_samples(spark, sf_dir):
    ds = _orders(spark, sf_dir)
    return next(ds.bootstrap_samples(ds.nsamples())).df.select("row_id", "o_orderkey", "o_totalprice")


@BOOK.add("bootstrap_features", f"select p_partkey, {', '.join(f'{c} as {c}__{i}' for i, c in enumerate(_PICKED))} from part")
def bootstrap_features(spark, sf_dir):
    ds = Dataset(table(spark, sf_dir, "part"), ("p_size", "p_retailprice"), row_id="p_partkey")
    sample, _ = next(ds.bootstrap_features(3))
    return sample.df.select("p_partkey", *sample.features)


@BOOK.add(
    "cross_validate",
    """
with r as (select o_totalprice / 1000 as y, (o_custkey % 100)::double as x, row_number() over (order by o_orderkey) - 1 as pos, count(*) over () as n from orders),
f as (select y, x, pos // (n // 5) as fold from r),
k as (select unnest(range(5)) as fold),
fit as (select k.fold, regr_slope(y, x) as slope, regr_intercept(y, x) as base, avg(y) as mean from f, k where f.fold <> k.fold group by k.fold),
score as (select fold, avg(abs(y - (base + slope * x))) as linear, avg(abs(y - (sxy / sxx * x))) as through_zero from f join fit using (fold)
  join (select k.fold, sum(x * y) as sxy, sum(x * x) as sxx from f, k where f.fold <> k.fold group by k.fold) z using (fold) group by fold)
select 0 as model, round(avg(linear), 6) as mean_absolute_error from score union all select 1, round(avg(through_zero), 6) from score
""",
)
def cross_validate(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("y"), (F.col("o_custkey") % 100).cast("double").alias("x"))
    ds = Dataset.of(df, ["x"], ["y"], order=["o_orderkey"])
    fits = [lambda d, i=i: ols(d.df, d.features, "y", intercept=i) for i in (True, False)]
    found = ds.cross_validate(5, fits, lambda m, valid: m.predict(valid.df).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0])
    return listed(spark, [(i, round(v, 6)) for i, v in enumerate(found)], "model int, mean_absolute_error double")


# Sources


@BOOK.add("csv_gz_scan", "select o_orderkey::double as o_orderkey, o_totalprice from orders")
def csv_gz_scan(spark, sf_dir):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").write.option("header", True).option("compression", "gzip").csv(path)
    return files.csv_table(spark, path, ["o_orderkey", "o_totalprice"])


@BOOK.add("text_files_scan", "select c_mktsegment as text, count(*) as n from customer group by 1")
def text_files_scan(spark, sf_dir):
    path = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    table(spark, sf_dir, "customer").select("c_mktsegment").coalesce(4).write.text(path)
    lines = files.text_files(spark, [path]).select(F.explode(F.split("text", "\n")).alias("text")).filter("text != ''")
    return lines.groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def _made(name: str, sql: str, make, columns: list[str]) -> None:
    BOOK.add(name, sql)(lambda spark, sf_dir: rounded(make(spark), columns))


_CENTRES = [[0.0, 0.0], [5.0, 5.0], [-5.0, 5.0]]
_made(
    "generate_blobs",
    "with b as (select k as row_id, k // 500 as blob from range(1500) t(k)) select row_id, "
    + ", ".join(f"round([{', '.join(str(c[j]) for c in _CENTRES)}][blob + 1] + {normal_sql(42, 'row_id', j)}, 6) + 0.0 as x{j}" for j in range(2))
    + ", blob::integer as blob from b",
    lambda spark: generate.blobs(spark, 500, _CENTRES),
    ["x0", "x1"],
)
_made(
    "generate_dataset",
    "select k as row_id, " + ", ".join([f"round({uniform_sql(42, 'k', j)}, 6) + 0.0 as x{j}" for j in range(4)] + [f"round({uniform_sql(43, 'k', j)}, 6) + 0.0 as y{j}" for j in range(2)]) + " from range(1000) t(k)",
    lambda spark: generate.make_dataset(spark, 1000, 4, 2),
    ["x0", "x1", "x2", "x3", "y0", "y1"],
)
_made(
    "generate_swissroll",
    f"with p as (select k as row_id, 10 * {uniform_sql(42, 'k', 0)} as phi from range(1000) t(k)) select row_id, round(phi * cos(phi), 6) + 0.0 as x, round(phi * sin(phi), 6) + 0.0 as y, round(10 * {uniform_sql(42, 'row_id', 1)}, 6) as z from p",
    lambda spark: generate.swissroll(spark, 10.0, 1.0, 1000),
    ["x", "y", "z"],
)
_RINGS = [(0.0, 3.0), (10.0, 13.0)]
_RINGED = f"with p as (select k as row_id, (k // 500)::integer as ring, 10 * (k // 500) + 3 * {uniform_sql(42, 'k', 0)} as r, 2 * pi() * {uniform_sql(42, 'k', 1)} as phi, 2 * pi() * {uniform_sql(42, 'k', 2)} as theta from range(1000) t(k))"
_made(
    "generate_rings",
    _RINGED + " select row_id, round(r * sin(theta) * cos(phi), 6) + 0.0 as x, round(r * sin(theta) * sin(phi), 6) + 0.0 as y, round(r * cos(theta), 6) + 0.0 as z, ring from p",
    lambda spark: generate.convoluted_rings(spark, _RINGS, 1000),
    ["x", "y", "z"],
)
_made("generate_rings2d", _RINGED + " select row_id, round(r * cos(phi), 6) + 0.0 as x, round(r * sin(phi), 6) + 0.0 as y, ring from p", lambda spark: generate.rings2d(spark, _RINGS, 1000), ["x", "y"])


# Text

_WORD = r"[\p{L}\p{M}\p{N}_]{2,}"
_PLAIN = CountVectorizer(normalise=False)
_TALK = "select conv_id * 1000 + turn as doc_id, text from conversations"


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


@BOOK.add("count_vectorizer", f"select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) as term from documents) group by all")
def count_vectorizer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _PLAIN.fit(docs).transform(docs)


@BOOK.add("count_vectorizer_nfkd")
def count_vectorizer_nfkd(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return CountVectorizer().fit(docs).transform(docs)


@BOOK.add("count_files", f"select term, count(*) as tf from (select unnest(regexp_extract_all(lower(c_mktsegment), '{_WORD}')) as term from customer) group by 1")
def count_files(spark, sf_dir):
    path = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    table(spark, sf_dir, "customer").select("c_mktsegment").coalesce(4).write.text(path)
    counted = _PLAIN.fit_files(spark, [path]).transform_files(spark, [path])
    return counted.groupBy("term").agg(F.sum("tf").alias("tf"))


@BOOK.add(
    "vocabulary_filtered",
    f"""
with t as (select distinct doc_id, term from (select doc_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) as term from documents)),
n as (select count(*) as n from documents)
select term, count(*) as df from t group by term
having count(*) between (select trunc(0.01 * n) from n) and (select trunc(0.5 * n) from n) and term not in ('the', 'and', 'of', 'le', 'la')
order by df desc, term desc limit 500
""",
)
def vocabulary_filtered(spark, sf_dir):
    how = CountVectorizer(normalise=False, document_frequency=(0.01, 0.5), stopwords=("the", "and", "of", "le", "la"), max_features=500)
    return how.fit(table(spark, sf_dir, "documents")).words()


@BOOK.add("fixed_vocabulary", f"select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) as term from documents) where term in ('der', 'die', 'le', 'la', 'the') group by all")
def fixed_vocabulary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _PLAIN.fit_vocabulary(docs, ["der", "die", "le", "la", "the"]).transform(docs)


@BOOK.add(
    "ngram_counts",
    f"""
with w as (select doc_id, regexp_extract_all(lower(text), '{_WORD}') as ws from ({_TALK})),
g as (select doc_id, unnest(ws) as term from w union all
  select doc_id, ws[i] || ' ' || ws[i + 1] from w, unnest(range(1, len(ws))) u(i))
select doc_id, term, count(*) as tf from g group by all
""",
)
def ngram_counts(spark, sf_dir):
    docs = _talk(spark, sf_dir)
    return CountVectorizer(normalise=False, ngrams=(1, 2)).fit(docs).transform(docs)


for _method, _idf in (("smooth", "ln((1 + n) / (1 + df)) + 1"), ("non_smooth", "ln(n / df) + 1"), ("textbook", "ln(n / (1 + df))")):
    _sql = f"""
with t as (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) as term from ({_TALK})) group by all),
d as (select term, count(*)::double as df from t group by term), n as (select count(*)::double as n from conversations)
select doc_id, term, round(tf * ({_idf}), 6) + 0.0 as tf_idf from t join d using (term), n
"""
    BOOK.add(f"tf_idf_{_method}", _sql)(
        lambda spark, sf_dir, m=_method: rounded(tf_idf(_PLAIN.fit(_talk(spark, sf_dir)), _talk(spark, sf_dir), m), ["tf_idf"])
    )


# Metrics

_REGRESSION = """
with r as (select {a} as a, {b} as b from lineitem), m as (select avg(b) as bm from r)
select {head} round(max(abs(a - b)), 6) as max_error, round(avg(abs(a - b)), 6) as mean_absolute_error, round(avg((a - b)^2), 6) as mean_squared_error,
  round(avg((ln(1 + a) - ln(1 + b))^2), 6) as mean_squared_log_error, round(median(abs(a - b)), 6) as median_absolute_error,
  round(avg(abs((a - b) / a)), 6) as mean_absolute_percentage_error, round(200 * avg(abs(b - a) / (abs(a) + abs(b))), 6) as symmetric_mape,
  round(1 - sum((a - b)^2) / (sum((b - bm)^2) + 1e-10), 6) as r2, round(1 - (sum((a - b)^2) - avg(b - a)) / (sum((b - bm)^2) + 1e-10), 6) as explained_variance
from r, m
"""
_NAMES = ["max_error", "mean_absolute_error", "mean_squared_error", "mean_squared_log_error", "median_absolute_error", "mean_absolute_percentage_error", "symmetric_mape", "r2", "explained_variance"]


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") * 1.5).alias("a1"), (F.col("l_extendedprice") / 1000).alias("b1"), (F.col("l_tax") + 0.03).alias("a2"), (F.col("l_discount") + 0.01).alias("b2")
    )


@BOOK.add("regression_metrics", _REGRESSION.format(a="l_quantity * 1.5", b="l_extendedprice / 1000", head=""))
def regression_metrics(spark, sf_dir):
    return rounded(metrics.regression_metrics(_guesses(spark, sf_dir), "a1", "b1"), _NAMES)


@BOOK.add(
    "regression_metrics_multi_target",
    "select * from (" + _REGRESSION.format(a="l_quantity * 1.5", b="l_extendedprice / 1000", head="0 as target,") + ") union all select * from (" + _REGRESSION.format(a="l_tax + 0.03", b="l_discount + 0.01", head="1 as target,") + ")",
)
def regression_metrics_multi_target(spark, sf_dir):
    return rounded(metrics.regression_metrics_by_target(_guesses(spark, sf_dir), [("a1", "b1"), ("a2", "b2")]), _NAMES)


_FLAG = "case when l_discount > 0.07 then 'R' when l_discount > 0.03 then 'N' else 'A' end"


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        F.when(d > 0.07, "R").when(d > 0.03, "N").otherwise("A").alias("guess"), F.col("l_returnflag").alias("truth"), (d > 0.05).alias("is_guess"), (F.col("l_returnflag") == "R").alias("is_truth")
    )


_COUNTS = f"with c as (select {_FLAG} as p, l_returnflag as t from lineitem), l as (select distinct unnest([p, t]) as x from c)"


@BOOK.add("confusion_matrix", _COUNTS + " select a.x as prediction, b.x as truth, count(c.p) as n from l a cross join l b left join c on c.p = a.x and c.t = b.x group by all")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_counts(_flags(spark, sf_dir), "guess", "truth")


@BOOK.add(
    "binary_scores",
    """
with m as (select count(*) filter (where p and t)::double as tp, count(*) filter (where p and not t)::double as fp, count(*) filter (where not p and t)::double as fn, count(*) filter (where not p and not t)::double as tn
  from (select l_discount > 0.05 as p, l_returnflag = 'R' as t from lineitem)),
s as (select *, tp / (tp + fn) as p, tp / (tp + fp) as r from m)
select round(p, 6) as precision, round(r, 6) as recall, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(2 * p * r / (p + r), 6) as f1, round(1.25 * p * r / (0.25 * p + r), 6) as f_beta,
  round((tp * tn - fp * fn) / sqrt(tp + fp) / sqrt(tp + fn) / sqrt(tn + fp) / sqrt(tn + fn), 6) + 0.0 as mcc from s
""",
)
def binary_scores(spark, sf_dir):
    found = metrics.scores(metrics.confusion_matrix(_flags(spark, sf_dir), "is_guess", "is_truth"))
    return listed(spark, [[round(v, 6) + 0.0 for v in found.values()]], ", ".join(f"{k} double" for k in found))


@BOOK.add(
    "multi_class_scores",
    _COUNTS
    + """, k as (select l.x, count(*) filter (where p = x and t = x)::double as hit, count(*) filter (where p = x)::double as said, count(*) filter (where t = x)::double as have, count(*)::double as n from c, l group by l.x),
s as (select avg(hit / have) as p, avg(hit / said) as r, sum(hit) as hits, any_value(n) as n, sum(said * have) as sh, sum(said * said) as ss, sum(have * have) as hh from k)
select round(p, 6) as precision, round(r, 6) as recall, round(hits / n, 6) as accuracy, round(2 * p * r / (p + r), 6) as f1, round(1.25 * p * r / (0.25 * p + r), 6) as f_beta,
  round((hits * n - sh) / sqrt(n * n - ss) / sqrt(n * n - hh), 6) + 0.0 as mcc from s
""",
)
def multi_class_scores(spark, sf_dir):
    found = metrics.scores(metrics.confusion_matrix(_flags(spark, sf_dir), "guess", "truth"))
    return listed(spark, [[round(v, 6) + 0.0 for v in found.values()]], ", ".join(f"{k} double" for k in found))


@BOOK.add("split_one_vs_all", _COUNTS + " select x as label, count(*) filter (where p = x and t = x) as tp, count(*) filter (where p = x and t <> x) as fp, count(*) filter (where p <> x and t = x) as fn, count(*) filter (where p <> x and t <> x) as tn from c, l group by x")
def split_one_vs_all(spark, sf_dir):
    m = metrics.confusion_matrix(_flags(spark, sf_dir), "guess", "truth")
    return listed(spark, [(c, *map(int, part.matrix.ravel())) for c, part in zip(m.members, m.one_vs_all())], "label string, tp bigint, fp bigint, fn bigint, tn bigint")


@BOOK.add("split_one_vs_one", _COUNTS + " select a.x as a, b.x as b, count(*) filter (where p = a.x and t = a.x) as tp, count(*) filter (where p = a.x and t = b.x) as fp, count(*) filter (where p = b.x and t = a.x) as fn, count(*) filter (where p = b.x and t = b.x) as tn from c, l a, l b where a.x <= b.x group by all")
def split_one_vs_one(spark, sf_dir):
    m = metrics.confusion_matrix(_flags(spark, sf_dir), "guess", "truth")
    pairs = [(a, b) for i, a in enumerate(m.members) for b in m.members[i:]]
    return listed(spark, [(a, b, *map(int, part.matrix.ravel())) for (a, b), part in zip(pairs, m.one_vs_one())], "a string, b string, tp bigint, fp bigint, fn bigint, tn bigint")


_SCORED = "with r as (select value / (1 + value) as s, event_type = 'purchase' as t from events)"


def _scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("value") / (1 + F.col("value"))).alias("s"), (F.col("event_type") == "purchase").alias("t"))


_CURVE = _SCORED + """, g as (select s, count(*) filter (where t)::double as pos, count(*) filter (where not t)::double as neg from r group by s),
c as (select s, sum(pos) over w - pos as tp, sum(neg) over w - neg as fp, sum(pos) over () as ap, sum(neg) over () as an from g window w as (order by s)),
curve as (select s as threshold, tp / ap as tp, fp / an as fp from c where s > 1e-10 union all select null, 1.0, 1.0)"""


@BOOK.add("roc_curve", _CURVE + " select threshold, round(tp, 9) as tp, round(fp, 9) as fp from curve")
def roc_curve(spark, sf_dir):
    return rounded(metrics.roc(_scored_events(spark, sf_dir), "s", "t"), ["tp", "fp"], 9)


@BOOK.add("area_under_curve", _CURVE + ", o as (select tp, fp, lag(tp) over w as tp0, lag(fp) over w as fp0 from curve window w as (order by threshold nulls last)) select round(sum((tp - tp0) * (fp + fp0) / 2), 6) as auc from o")
def area_under_curve(spark, sf_dir):
    return rounded(metrics.area_under_curve(_scored_events(spark, sf_dir), "s", "t"), ["auc"])


@BOOK.add("log_loss", _SCORED + " select round(avg(case when t then -ln(p) else -ln(1 - p) end), 6) as log_loss from (select t, least(greatest(s, 1.1920928955078125e-07), 1 - 1.1920928955078125e-07) as p from r)")
def log_loss(spark, sf_dir):
    return rounded(metrics.log_loss(_scored_events(spark, sf_dir), "s", "t"), ["log_loss"])


@BOOK.add("pearson_correlation", " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) + 0.0 as correlation from lineitem" for i, a in enumerate(LINE) for b in LINE[i + 1 :]))
def pearson_correlation(spark, sf_dir):
    return rounded(metrics.pearson(table(spark, sf_dir, "lineitem"), LINE), ["correlation"])


@BOOK.add("pearson_p_values")
def pearson_p_values(spark, sf_dir):
    return metrics.pearson_p_values(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], iterations=20)
