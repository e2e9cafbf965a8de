import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from statforge.llm import search
from statforge.llm.textops import WORD_PATTERN


def brute(docs, queries, k):
    words = {i: re.findall(WORD_PATTERN, t.lower()) for i, t in docs if t is not None}
    df = Counter(w for ws in words.values() for w in set(ws))
    n, mean = len(words), sum(map(len, words.values())) / max(1, len(words))
    out = []
    for q, t in queries:
        if t is None or q is None:
            continue
        ask = Counter(re.findall(WORD_PATTERN, t.lower()))
        scores = []
        for i, ws in words.items():
            tf = Counter(ws)
            s = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, c in ask.items() if tf[w])
            if s > 0:
                scores.append((-round(s, 6), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def corpus(n=700, seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{int(rnd.paretovariate(0.8))}" for _ in range(3000)]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 80)))) for i in range(n)]
    docs += [(n + i, docs[i][1]) for i in range(30)]  # ties
    queries = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 12)))) for i in range(25)] + [(90, None), (91, ""), (None, "w1"), (92, "neverseen")]
    return docs, queries


def test_equals_brute_force(make, spark):
    docs, queries = corpus()
    asked = spark.createDataFrame(queries, "item_id long, text string")
    got = search.top_k(make(docs), asked, k=5, block=16)
    assert sorted(tuple(r)[:1] + (r.doc_id, r.score, r["rank"]) for r in got.collect()) == brute(docs, queries, 5)


def test_query_groups(make, spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_GROUP", 7)
    docs, queries = corpus(200, 4)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    got = search.top_k(make(docs), asked, k=3)
    assert sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in got.collect()) == brute(docs, queries, 3)


def test_blocks_are_pruned():
    """Blocks whose bound is below the k-th score are never scored."""
    rng = np.random.default_rng(0)
    blocks = []
    for b in range(50):
        high = 30 if b == 7 else 1
        blocks.append({"ids": [b * 2, b * 2 + 1], "lengths": [40, 40], "ends": [1, 2], "words": [0, 0], "counts": [high, high]})
    schema = pa.schema([("ids", pa.list_(pa.int64()))] + [(c, pa.list_(pa.int32())) for c in ("lengths", "ends", "words", "counts")])
    scorer = search.Scorer(np.array([[1.0]]), 40.0, 2)
    scorer.add(pa.RecordBatch.from_pylist(blocks, schema))
    assert [i for _, i in scorer.best[0]] == [14, 15] and scorer.scored == 1
    assert rng is not None


def test_odd_rows(odd, empty, make, spark):
    asked = spark.createDataFrame([(1, "one fox haus"), (1, "texte")], "item_id long, text string")
    rows = search.top_k(odd, asked, k=10).collect()
    assert {r.doc_id for r in rows} == {1, None, 4, 8}
    assert search.top_k(empty, asked).count() == 0
    assert search.top_k(odd, asked.limit(0)).count() == 0
