import hashlib
import math
from collections import Counter

import pytest

from statforge.llm import mixing


def count_of(i, text, mean, seed=mixing.SEED):
    own = hashlib.md5(f"{seed}|{'' if i is None else i}|{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
    return mixing.poisson_count((int(own[:13], 16) + 0.5) / 16**13, mean)


def test_counts_equal_the_inverse_distribution(make):
    rows = [(i, "word " * (i % 7 + 1), "big" if i % 4 else "small") for i in range(600)]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t)
    for targets in (None, {"big": 0.2, "small": 0.8}, {"small": 1.0}, {"big": 0.05, "small": 0.95, "none": 3.0}):
        aim = {s: n**0.5 for s, n in sizes.items()} if targets is None else {s: targets[s] for s in sizes if s in targets}
        total = sum(aim.values())
        mean = {s: aim[s] / total * sum(sizes.values()) / sizes[s] for s in aim}
        want = Counter()
        for i, t, s in rows:
            if s in mean and (n := count_of(i, t, mean[s])):
                want[i] = n
        got = mixing.mixed(make(rows), targets).collect()
        assert Counter(r.doc_id for r in got) == want
        assert {(r.doc_id, r._copy) for r in got} == {(i, c + 1) for i, n in want.items() for c in range(n)}


def test_shares_reach_their_targets(make):
    rows = [(i, "x" * 10, f"s{i % 10 // 4}") for i in range(4000)]
    got = mixing.mixed(make(rows), {"s0": 0.2, "s1": 0.3, "s2": 0.5}).groupBy("source").count().collect()
    total = sum(r["count"] for r in got)
    assert total == pytest.approx(4000, rel=0.06)
    assert {r.source: r["count"] / total for r in got} == pytest.approx({"s0": 0.2, "s1": 0.3, "s2": 0.5}, abs=0.03)


def test_shuffle_repeats_and_mixes(make):
    rows = [(i, "t", "a") for i in range(400)]
    a = [(r.doc_id, r._copy) for r in mixing.mixed(make(rows)).collect()]
    b = {(r.doc_id, r._copy) for r in mixing.mixed(make(rows[::-1])).collect()}
    assert set(a) == b and a != sorted(a)


def test_large_means(make):
    rows = [(i, "x", "rare") for i in range(5)] + [(100 + i, "y" * 100, "rest") for i in range(100)]
    got = Counter(r.source for r in mixing.mixed(make(rows), {"rare": 0.5, "rest": 0.5}).select("source").collect())
    assert got["rare"] == pytest.approx(5002, rel=0.05)


def plain_count(u, mean):
    """The inverse distribution, each term from its logarithm."""
    k, c = 0, 0.0
    while (c := c + math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))) < u and k < 20 * mean + 100:
        k += 1
    return k


def test_large_means_are_drawn_whole(make):
    for mean in (15.9, 16.0, 17.3, 32.0, 100.0, 700.0, 5000.5):
        for u in (1e-9, 0.001, 0.1, 0.5, 0.77, 0.999, 1 - 1e-9):
            assert mixing.poisson_count(u, mean) == plain_count(u, mean), (u, mean)
    rows = [(i, "x", "rare") for i in range(300)] + [(1000 + i, "y" * 96, "rest") for i in range(100)]
    # 300 documents of 1 letter beside 9600 letters: 16.5 copies of each, or 32
    for share in (0.5, 32 * 300 / 9900):
        got = Counter(r.doc_id for r in mixing.mixed(make(rows), {"rare": share, "rest": 1 - share}).filter("source = 'rare'").select("doc_id").collect())
        n = [got[i] for i in range(300)]
        mean = sum(n) / 300
        assert mean == pytest.approx(share * 33, rel=0.06)
        assert sum((x - mean) ** 2 for x in n) / 299 == pytest.approx(mean, rel=0.3)


def test_sql_draws_large_means_alike(spark, tmp_path):
    import duckdb

    from statforge.llm.queries import OP6_SQL, op6_poisson_mixing

    rows = [(i, "x" * (i % 3 + 1), "en", "rare", 1) for i in range(20)] + [(100 + i, "y" * 5000, "en", "rest", 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert max(r.rate for r in mixing.rates(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()) > 60
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = Counter(con.sql(f"select doc_id, copy, round(shuffle_key, 9) from ({OP6_SQL})").fetchall())
    got = Counter((r.doc_id, r.copy, round(r.shuffle_key, 9)) for r in op6_poisson_mixing(spark, str(tmp_path)).collect())
    assert got == want and len(got) > 1000


def test_columns_of_any_name_stay(spark):
    names = ["_own", "_count", "_copy", "_order", "__order", "_src", "_cdf", "row", "own", "from", "u", "start", "cdf", "count", "copy", "turn", "size", "rate", "aim", "SOURCE_"]
    rows = [(i, f"t{i}", "a" if i % 3 else None, *[f"{n}{i}" for n in names]) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    got = mixing.mixed(df, {"a": 1.0})
    assert got.columns == df.columns + ["__copy", "___order"]
    assert {tuple(r)[:-2] for r in got.collect()} <= set(rows) and got.count() > 10
    assert mixing.mixed(df, numbered=False).columns == df.columns


def test_odd_rows(odd, empty):
    got = mixing.mixed(odd)
    assert got.columns == odd.columns + ["_copy", "_order"]
    got.collect()
    assert mixing.mixed(empty).count() == 0
    assert {r.source for r in mixing.rates(odd).collect()} == {"a", None}
