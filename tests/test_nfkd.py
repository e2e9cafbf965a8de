import tracemalloc
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from statforge.functions import text as tx

TEXTS = ["plain", None, "", "ﬁn ①", "éé Å", "\U0001d400" * 3, "ẛ̣"]


def test_slices_decompose_as_texts_do(spark, monkeypatch):
    want = [None if t is None else unicodedata.normalize("NFKD", t) for t in TEXTS]
    for size in (1, 4, 1 << 20):
        monkeypatch.setattr(tx, "SLICE", size)
        for kind in (pa.string(), pa.large_string()):
            assert tx.decomposed(pa.array(TEXTS, kind)).to_pylist() == want
            assert tx.decomposed(pa.array([], kind)).to_pylist() == []
            assert tx.decomposed(pa.array(["x", *TEXTS], kind).slice(1)).to_pylist() == want
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(tx.nfkd(F.col("t"))).collect()] == want


def test_few_texts_are_decoded_at_once():
    texts = pa.array(["é" + "word " * 2000] * 4000)  # 40 MB
    tracemalloc.start()
    tx.decomposed(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6
