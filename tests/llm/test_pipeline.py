"""The pipeline against a plain Python version of each of its stages."""

import hashlib
import random
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from statforge.llm import mixing, packing, privacy, quality
from tests.llm.test_neardup import brute as brute_pairs
from tests.llm.test_neardup import groups
from tests.llm.test_packing import naive
from tests.llm.test_quality import plain_score, texts
from tests.llm.test_tokens import reference


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark, make):
    path = str(tmp_path_factory.mktemp("tables"))
    rnd = random.Random(6)
    rows = [(i, f"{t} call 743-555-{1000 + i}" if i % 5 == 0 else t, f"s{i % 3}") for i, t, _ in texts(160)]
    for i in range(160, 200):
        _, t, s = rows[rnd.randrange(160)]
        rows.append((i, t if i % 2 else t + " tail", s))
    labels = [(i, int(g), 0) for i, _, g in texts(160) if i % 2]
    make(rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, labels


def plain(rows, labels, weights):
    good = {i: g > 0 for i, g, _ in labels}
    score = [plain_score(t, weights) for _, t, _ in rows]
    known = [s for (i, _, _), s in zip(rows, score) if i in good]
    level = np.mean([not g for g in good.values()]) * (1 - quality.SPARE)
    bar = sorted(known)[max(0, int(np.ceil(level * len(known))) - 1)]
    rows = [r for r, s in zip(rows, score) if s > bar + 1e-8]
    after_quality = {r[0] for r in rows}
    keep = set(groups([r[0] for r in rows], brute_pairs(rows)).values())
    rows = [r for r in rows if r[0] in keep]
    rows = [(i, privacy.conceal(t), s) for i, t, s in rows]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t)
    root = sum(n**0.5 for n in sizes.values())
    mixed = []
    for i, t, s in rows:
        mean = sizes[s] ** 0.5 / root * sum(sizes.values()) / sizes[s]
        own = hashlib.md5(f"{mixing.SEED}|{i}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
        mixed += [(i, t)] * mixing.poisson_count((int(own[:13], 16) + 0.5) / 16**13, mean)

    def hashed(text):
        h = xxhash.xxh64(text.encode(), seed=42).intdigest()
        return h - (h >> 63 << 64)

    _, encoder = reference()
    rows, copies = [], Counter()
    for i, t in mixed:
        copies[i, t] += 1
        turn = xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()
        for x in (hashed(t), copies[i, t]):
            turn = xxhash.xxh64(struct.pack("<q", x), seed=turn).intdigest()
        rows.append((turn - (turn >> 63 << 64), len(encoder.encode_ordinary(t)), i))
    rows.sort()
    mixed = [(i, n) for _, n, i in rows]
    places = naive([n for _, n in mixed], packing.WINDOW)
    return after_quality, keep, Counter((mixed[k][0], w, b, n) for k, w, b, n in places)


def weights_of(spark, path):
    return quality.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))


def test_whole_pipeline(spark, folder):
    path, rows, labels = folder
    after_quality, keep, want = plain(rows, labels, weights_of(spark, path))
    got = corpus_pipeline.run(spark, path).collect()
    assert len(after_quality) > 100 and len(keep) < len(after_quality)
    assert Counter((r.doc_id, r.window, r.begin, r.length) for r in got) == want


def test_each_stage(spark, folder):
    path, rows, labels = folder
    after_quality, keep, _ = plain(rows, labels, weights_of(spark, path))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        seen.append({r.doc_id for r in docs.collect()})
    assert seen[0] == after_quality and seen[1] == seen[2] == keep and seen[3] <= keep
    assert len(corpus_pipeline.STAGES) == 5


def test_odd_documents(spark, folder, odd, empty):
    path, _, _ = folder
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, path)
        docs.collect()
