import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from statforge.llm import quality


def texts(n=400, seed=2):
    rnd = random.Random(seed)
    words = ["the", "house", "of", "river", "walks", "under", "blue", "morning", "and", "gentle"] + [f"word{chr(97 + i)}" for i in range(26)]
    rows = []
    for i in range(n):
        body = [rnd.choice(words) for _ in range(rnd.randint(15, 200))]
        kind = i % 8
        if kind == 0:
            t = " ".join(w.upper() + "!!" for w in body)
        elif kind == 1:
            t = " ".join(w + rnd.choice(["***", "###", "%%%"]) for w in body)
        else:
            t = " ".join(body).capitalize() + "."
        rows.append((i, t, kind > 1))
    return rows


@pytest.fixture(scope="module")
def data(make, spark):
    rows = texts()
    docs = make([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, g in rows if i % 3], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_held_out_accuracy(data):
    rows, docs, labels = data
    got = {r.doc_id: r.keep for r in quality.judged(docs, labels).collect()}
    held = [(got[i], g) for i, _, g in rows if i % 3 == 0]
    assert np.mean([a == b for a, b in held]) >= 0.97
    assert all(a for a, b in held if b)


def test_filter_agrees_with_the_scores(data):
    _, docs, labels = data
    keep = {r.doc_id for r in quality.judged(docs, labels).collect() if r.keep}
    out = quality.filtered(docs, labels)
    assert {r.doc_id for r in out.collect()} == keep
    assert out.columns == docs.columns


def test_pairs_loss_has_no_slope_at_the_fit():
    rng = np.random.default_rng(0)
    x, good = rng.normal(size=(300, 3)), rng.random(300) < 0.6
    x[good, 1] += 1.5
    w = np.array(quality.fit_pairs(x, good))
    assert w[1] > 0.5
    win, lose = quality.pairs_of(np.flatnonzero(good), np.flatnonzero(~good))

    def loss(v):
        return sum(math.log1p(math.exp(-(x[a] - x[b]) @ v)) for a, b in zip(win, lose)) / len(win) + 0.5e-4 * v @ v

    for step in np.eye(3) * 1e-4:
        assert abs(loss(w + step) - loss(w - step)) / 2e-4 < 1e-5
    assert all(loss(w) <= loss(w + rng.normal(size=3) * 0.05) for _ in range(20))


def plain_score(text, weights):
    """The score of one text, word by word and byte by byte; None without words."""
    words = [w for w in re.split("[\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]+", (text or "").lower()) if w]
    raw = (text or "").encode()
    if not words:
        return None
    n = len(words)
    shape = [math.tanh(4 * sum(a == b for a, b in zip(words, words[1:])) / n), min(1, len(set(words)) / n**0.75), math.tanh(len(raw) / n / 10), math.log1p(n) / 12]
    total = 0.0
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        h = (a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) & 0xFFFFFFFF
        h ^= h >> 15
        total += weights[4 + ((h * 0x2C1B3C6D & 0xFFFFFFFF) >> 23)]
    return sum(a * b for a, b in zip(shape, weights)) + 32 * total / max(1, len(raw) - 2)


def test_scores_equal_plain_ones(data):
    rows, docs, labels = data
    weights = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.scored(docs, weights).collect()}
    assert all(got[i] == pytest.approx(plain_score(t, weights), abs=1e-6) for i, t, _ in rows)
    mixed = ["", None, "x", "!!!", "ÄÖ ä", "one one two"] + [t for _, t, _ in rows[:9]]
    whole = quality.score_array(pa.array(mixed), weights).to_pylist()
    assert whole == [quality.score_array(pa.array([t], pa.string()), weights)[0].as_py() for t in mixed]
    assert all((a is None) == (plain_score(t, weights) is None) and (a is None or a == pytest.approx(plain_score(t, weights), abs=1e-6)) for a, t in zip(whole, mixed))


def test_repeated_labels_and_long_texts(make, spark):
    long = "a gentle river walks under the blue morning. " * 20_000
    rows = [(i, t) for i, t, _ in texts(80)] + [(900, long), (901, long.upper().replace(" ", "!! "))]
    labels = spark.createDataFrame([(i, int(g)) for i, _, g in texts(80)] * 3, "doc_id long, quality int")
    got = {r.doc_id: r.keep for r in quality.judged(make(rows), labels).collect()}
    assert got[900] and not got[901]


def test_odd_rows(odd, empty, spark, data):
    labels = spark.createDataFrame([(1, 1), (8, 0), (99, 1), (None, 1), (4, None)], "doc_id long, quality int")
    got = [(r.doc_id, r.score is None, r.keep) for r in quality.judged(odd, labels).collect()]
    assert sorted(x[0] or 0 for x in got if x[1]) == [0, 2, 3, 5, 7] and not any(x[2] for x in got if x[1])
    none = labels.limit(0)
    assert quality.filtered(odd, none).count() == 7
    assert quality.filtered(empty, labels).count() == 0


def test_features_of_batches_and_singles_agree():
    t = [r[1] for r in texts(40)] + ["", None, "x"]
    whole, _ = quality.features(pa.array(t))
    assert all(np.allclose(whole[i], quality.features(pa.array([t[i]], pa.string()))[0][0]) for i in range(len(t)))
