import random
import tracemalloc

import numpy as np
import pyarrow as pa

from statforge.llm.neardup import _units, components, deduplicated, linked, signatures, signed, unit_pairs


def corpus(seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared = [rnd.choice(vocab) for _ in range(60)]
    rows, n = [], 0
    for g in range(40):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([4, 40, 150, 300]))]
        if g % 3 == 0:
            base = base[:40] + shared + base[40:]
        for c in range(rnd.choice([1, 1, 2, 9])):
            copy = list(base)
            for _ in range(c and len(copy) // 40):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((n, " ".join(copy)))
            n += 1
    return rows


def brute(rows, matches=36):
    ids = [r[0] for r in rows]
    sig, has = signatures(pa.array([r[1] for r in rows], pa.string()))
    same = (sig[:, None, :] == sig[None, :, :]).sum(axis=2)
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])): int(same[i, j]) for i in range(len(rows)) for j in range(i) if has[i] and has[j] and same[i, j] >= matches}


def classes(rows, pairs):
    """(id, class, links) of each row from all pairs of ids."""
    root = groups([i for i, _ in rows], pairs)
    count = {i: 0 for i, _ in rows}
    for a, b in pairs:
        count[a] += 1
        count[b] += 1
    return sorted((i, root[i], count[i]) for i, _ in rows)


def found(df):
    return sorted(((r.doc_id, r.class_id, r.links) for r in linked(df).collect()), key=str)


def groups(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_classes_and_links_equal_brute_force(make):
    rows = corpus()
    want = brute(rows)
    assert found(make(rows)) == sorted(classes(rows, want), key=str)
    assert len(want) > 50


def test_links_between_signatures_equal_brute_force(make):
    rows = corpus()
    want = brute(rows)
    docs = signed(make(rows), "doc_id", "text", 64, 3)
    unit = {r.doc_id: r.unit for r in docs.collect()}
    got = {(r.a, r.b): r.matches for r in unit_pairs(_units(docs).select("unit", "sig"), 64, 36).collect()}
    assert got == {tuple(sorted((unit[a], unit[b]))): n for (a, b), n in want.items() if unit[a] != unit[b]}


def test_copies_are_counted(make):
    base = [f"w{i}" for i in range(80)]
    text, near = " ".join(base), " ".join(base[:-1] + ["other"])
    rows = [(i, text) for i in (1, 2, 3)] + [(4, near), (5, near), (6, "something else entirely")] + corpus(5)[100:]
    assert found(make(rows)) == sorted(classes(rows, brute(rows)), key=str)
    assert found(make([(i, text) for i in range(60)])) == sorted(((i, 0, 59) for i in range(60)), key=str)


def test_repeated_rows_and_null_ids_count(make):
    base = [f"w{i}" for i in range(80)]
    text, near = " ".join(base), " ".join(base[:-1] + ["other"])
    got = found(make([(1, text), (1, near), (2, text), (2, near), (2, near), (None, text), (3, None)]))
    assert got == sorted([(1, 1, 5)] * 2 + [(2, 1, 5)] * 3 + [(None, 1, 5), (3, None, 0)], key=str)


def test_small_tiles(make, monkeypatch):
    from statforge.llm import neardup

    monkeypatch.setattr(neardup, "TILE", 3)
    rows = corpus(8)
    assert found(make(rows)) == sorted(classes(rows, brute(rows)), key=str)


def test_columns_of_any_name_stay(spark, make):
    names = ["_th", "_nth", "_kept_id", "kept_id", "kept_th", "row", "own_id", "own_th", "again", "unit", "sig", "root", "k", "n", "th", "doc_a", "links", "class_id", "no_id"]
    rows = [(i % 37, t, *[f"{n}{i}" for n in names]) for i, (_, t) in enumerate(corpus(4)[:60])]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = deduplicated(df)
    assert got.columns == df.columns
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) == deduplicated(df.select("doc_id", "text")).count() > 5 and set(got) <= set(rows)


def test_one_of_each_group_stays(make):
    rows = corpus(4)
    want = set(groups([r[0] for r in rows], brute(rows)).values())
    got = deduplicated(make(rows))
    assert {r.doc_id for r in got.collect()} == want
    assert got.columns == make(rows).columns


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (300, 200), (400, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == groups({x for e in edges for x in e}, edges)


def test_odd_rows(odd, empty, make):
    got = {(r.doc_id, r.links, r.class_id) for r in linked(odd).collect()}
    assert {(1, 2, 1), (None, 2, 1), (None, 0, None), (2, 0, None), (4, 0, 4), (8, 0, 8)} <= got and linked(odd).count() == odd.count()
    kept = [(r.doc_id, r.text) for r in deduplicated(odd).collect()]
    texts = [t for _, t in kept]
    assert texts.count("one two three four five") == 1 and (1, "one two three four five") in kept
    assert {(2, None), (3, ""), (None, None), (5, "   \n "), (7, "!!! ???"), (8, "ein Haus am See"), (8, "un autre texte ici")} <= set(kept)
    assert linked(empty).count() == 0 and deduplicated(empty).count() == 0
    assert deduplicated(make([(None, "same old text here"), (None, "same old text here")])).count() == 1


def test_signing_takes_little_memory():
    rnd = random.Random(2)
    text = " ".join(str(rnd.randrange(10**6)) for _ in range(300))
    texts = pa.array([text] * (8_000_000 // len(text)))
    tracemalloc.start()
    sig, has = signatures(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert has.all() and (sig == sig[0]).all()
    assert peak < 90_000_000 + sig.nbytes


def test_groups_are_verified_in_little_memory():
    from statforge.llm.neardup import TILE, confirmed

    rng = np.random.default_rng(1)
    sig = rng.integers(0, 2, (TILE, 64))
    tracemalloc.start()
    a, b, count = confirmed(np.ones((TILE, TILE), bool), sig, 44)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000 and (a < b).all() and count.min() >= 44
    same = (sig[:200, None] == sig[None, :200]).sum(axis=2)
    want = {(i, j): same[i, j] for i in range(200) for j in range(i + 1, 200) if same[i, j] >= 44}
    assert {(i, j): n for i, j, n in zip(a, b, count) if j < 200} == want


def test_signature_recall():
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(5000)}" for _ in range(400)]
    hits = 0
    for _ in range(50):
        copy = list(base)
        for _ in range(12):
            copy[rnd.randrange(400)] = "edited"
        sig, _ = signatures(pa.array([" ".join(base), " ".join(copy)]))
        hits += np.sum(sig[0] == sig[1]) >= 36
    assert hits >= 48
