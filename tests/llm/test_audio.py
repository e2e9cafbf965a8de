import numpy as np

from statforge.llm import audio


def tune(seed, notes=90, at=0):
    rng = np.random.default_rng(seed)
    t = np.arange(audio.HOP * 2) / audio.RATE
    freq = 440 * 2 ** (rng.integers(0, 12, notes) / 12)
    return np.concatenate([np.sin(2 * np.pi * f * t) * 8000 for f in freq])[at:]


def pcm(x, noise=0.0, seed=0):
    x = x + np.random.default_rng(seed).normal(size=len(x)) * noise
    return x.astype(np.int16).tobytes()


def recordings():
    rows = []
    for s in range(8):
        base = tune(s)
        rows += [(s * 10, pcm(base)), (s * 10 + 1, pcm(base[audio.HOP * 40 :], 300, s)), (s * 10 + 2, pcm(base, 100, s))]
    return rows + [(500, b""), (501, None), (502, pcm(np.zeros(200))), (503, pcm(np.zeros(40000)))]


def prints_of(a):
    return audio.fingerprint(audio.chroma(np.frombuffer(a or b"", np.int16) / 32768.0))


def test_alignment_equals_brute_force(spark):
    rows = recordings()
    df = spark.createDataFrame(rows, "rec_id long, audio binary")
    got = {(r.rec_a, r.rec_b): (r.offset, r.overlap, r.bit_errors) for r in audio.aligned(audio.fingerprints(df, "rec_id", "audio")).collect()}
    data = {i: prints_of(a) for i, a in rows}
    want = {(a, b): m for a in data for b in data if a < b and len(data[a]) and len(data[b]) and (m := audio.compare(data[a], data[b]))}
    assert want and got == want
    assert {(s * 10, s * 10 + 1) for s in range(8)} <= set(got)
    assert all(a // 10 == b // 10 for a, b in got)
    assert got[0, 1][0] == -40


def test_repeated_integers_align_like_brute_force(spark):
    held = np.sin(2 * np.pi * 440 * np.arange(30000) / audio.RATE) * 8000
    loop = np.tile(tune(3, 4), 12)
    rows = recordings() + [(504, pcm(np.zeros(40000))), (505, pcm(np.zeros(30000))), (506, pcm(held)), (507, pcm(held)), (508, pcm(loop)), (509, pcm(loop[audio.HOP * 8 :]))]
    df = spark.createDataFrame(rows, "rec_id long, audio binary")
    got = {(r.rec_a, r.rec_b): (r.offset, r.overlap, r.bit_errors) for r in audio.aligned(audio.fingerprints(df, "rec_id", "audio")).collect()}
    data = {i: prints_of(a) for i, a in rows}
    assert got == {(a, b): m for a in data for b in data if a < b and len(data[a]) and len(data[b]) and (m := audio.compare(data[a], data[b]))}
    assert {(503, 504), (503, 505), (504, 505), (506, 507), (508, 509)} <= set(got) and got[503, 504][0] == 0


def plain_compare(a, b):
    """Votes pair by pair, bits one by one."""
    votes = {}
    for i, x in enumerate(a.tolist()):
        for j in np.flatnonzero(b == x).tolist():
            votes[j - i] = votes.get(j - i, 0) + 1
    if not votes or max(votes.values()) < audio.VOTES:
        return None
    o = min((o for o, n in votes.items() if n == max(votes.values())), key=lambda o: (abs(o), o))
    at = [i for i in range(len(a)) if 0 <= i + o < len(b)]
    share = round(sum(bin(int(a[i]) & 0xFFFFFFFF ^ int(b[i + o]) & 0xFFFFFFFF).count("1") for i in at) / max(1, 32 * len(at)), 6)
    return (o, len(at), share) if len(at) >= audio.LEAST_OVERLAP and share <= audio.MOST_ERRORS else None


def test_histogram_and_comparison_equal_plain_ones(monkeypatch):
    rng = np.random.default_rng(4)
    for size in (3, 40, 200):
        a, b = (np.repeat(rng.integers(0, 5, size), rng.integers(1, 4, size)).astype(np.int32) for _ in "ab")
        want = np.zeros(len(a) + len(b), np.int64)
        for i, x in enumerate(a):
            np.add.at(want, np.flatnonzero(b == x) - i + len(a), 1)
        for most in (1 << 20, 7):
            monkeypatch.setattr(audio, "_MEETINGS", most)
            assert (audio.histogram(a, b) == want).all()
        assert audio.compare(a, b) == plain_compare(a, b)
    a, b = prints_of(pcm(tune(1))), prints_of(pcm(tune(1), 300))
    assert audio.compare(a, b) == plain_compare(a, b) is not None and audio.compare(a, a)[0] == 0


def test_pure_tones_in_small_tiles_and_meetings(spark, monkeypatch):
    t = np.arange(30 * audio.RATE) / audio.RATE
    rows = recordings()[:12] + [(600 + 10 * k + c, pcm(np.sin(2 * np.pi * f * t[: len(t) - 5000 * c]) * 8000)) for k, f in enumerate((1000, 500, 250)) for c in range(2)]
    rows += [(700, rows[0][1]), (701, pcm(tune(3)[: 20 * audio.HOP]))]
    df = spark.createDataFrame(rows, "rec_id long, audio binary")
    data = {i: prints_of(a) for i, a in rows}
    want = {(a, b): m for a in data for b in data if a < b and len(data[a]) and len(data[b]) and (m := plain_compare(data[a], data[b]))}
    for tile, meetings in ((1 << 16, 1 << 20), (300, 50)):
        monkeypatch.setattr(audio, "TILE", tile)
        monkeypatch.setattr(audio, "_MEETINGS", meetings)
        got = {(r.rec_a, r.rec_b): (r.offset, r.overlap, r.bit_errors) for r in audio.aligned(audio.fingerprints(df, "rec_id", "audio")).collect()}
        assert got == want
    assert {(600, 601), (610, 611), (620, 621), (0, 700)} <= set(want)


def test_best_offsets_equal_plain_ones(monkeypatch):
    rng = np.random.default_rng(2)
    for meetings in (1 << 20, 20):
        monkeypatch.setattr(audio, "_MEETINGS", meetings)
        for two in (False, True):
            parts = [rng.integers(0, 9, rng.integers(20, 60)).astype(np.int32) for _ in range(8)]
            rec = np.repeat(np.arange(8), [len(p) for p in parts])
            side = (1 + rec % 2) * two
            a, b, o, alone = audio.best_offsets(np.concatenate(parts), np.concatenate([np.arange(len(p)) for p in parts]), rec, side, rec // 4, 9)
            got = dict(zip(zip(a.tolist(), b.tolist()), o.tolist())) | {(min(x), max(x)): None for x in alone}
            for i in range(8):
                for j in range(i + 1, 8):
                    if i // 4 != j // 4 or two and i % 2 == j % 2:
                        assert (i, j) not in got
                        continue
                    count = audio.histogram(parts[i], parts[j])
                    want = min((k - len(parts[i]) for k in np.flatnonzero(count == count.max()).tolist()), key=lambda k: (abs(k), k))
                    if (i, j) not in got or got[i, j] is not None:
                        assert got.get((i, j)) == (want if count.max() >= 9 else None)


def test_integral_image_equals_plain_sums():
    c = audio.chroma(tune(3, 30) / 32768)
    assert np.allclose(np.linalg.norm(c, axis=1), 1)
    whole = audio.fingerprint(c)
    assert all(audio.fingerprint(c[i : i + audio.WIDTH])[0] == whole[i] for i in range(len(whole)))


def test_classes_and_odd_rows(spark):
    rows = recordings() + [(None, recordings()[0][1]), (505, recordings()[0][1]), (506, pcm(tune(1)[: 30 * audio.HOP]))]
    df = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows], "rec_id long, audio binary, prints string, unit double, class_id int")
    got = audio.recordings_aligned(df).collect()
    data = [prints_of(a) for _, a in rows]
    links = [sum(i != j and len(a) > 0 and len(b) > 0 and plain_compare(a, b) is not None for j, b in enumerate(data)) for i, a in enumerate(data)]
    assert sorted((str(r.rec_id), r.links) for r in got) == sorted((str(i), n) for (i, _), n in zip(rows, links))
    by = {r.rec_id: r for r in got}
    assert all(by[s * 10 + c].class_id == s * 10 for s in range(8) for c in range(3)) and by[505].class_id == by[None].class_id == 0
    assert by[1].best.rec == 0 and by[1].best.offset == 40 and (by[0].best.rec, by[505].best.rec) == (2, 2)
    assert by[500].class_id is None and by[501].prints == [] and by[503].links == 0 and by[503].class_id == 503
    assert audio.recordings_aligned(df.limit(0)).count() == 0


def test_a_very_long_recording(spark):
    whole = np.tile(tune(5, 40), 30)
    df = spark.createDataFrame([(1, pcm(whole)), (2, pcm(whole[audio.HOP * 500 : -40000])), (3, pcm(np.zeros(len(whole))))], "rec_id long, audio binary")
    got = {r.rec_id: r for r in audio.recordings_aligned(df).collect()}
    assert got[1].links == got[2].links == 1 and got[3].links == 0 and got[2].best.bit_errors == 0


def test_close_vectors_sound_alike(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=64)
    rows = [(1, base.tolist()), (2, (base + rng.normal(size=64) * 0.05).tolist()), (3, rng.normal(size=64).tolist()), (4, None), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = audio.aligned(audio.fingerprints(df, "vec_id", "embedding", decode=audio.rendered)).collect()
    assert [(r.rec_a, r.rec_b) for r in got] == [(1, 2)]
