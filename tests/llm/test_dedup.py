import random
import re

import numpy as np
import pytest
import xxhash

from siltworks.llm import common, embeddings, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a b c", "A b c d", "a b c d e É É é", "a\x85b c d e f", "x " * 200])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_golay_words_at_distance_two_share_an_index():
    golay, rng = simhash.Golay(), random.Random(1)
    assert np.bincount(golay.weight).tolist() == [1, 23, 253, 1771]
    for _ in range(3000):
        a = rng.getrandbits(23)
        b = a ^ sum(1 << k for k in rng.sample(range(23), rng.randint(0, 2)))
        (ia, ib), (ha, hb) = golay.indices(np.array([a, b]))
        assert set(ia[ha]) & set(ib[hb])
        if bin(a ^ b).count("1") <= 1:
            assert ia[0] in ib[hb] or ib[0] in ia[ha]
            assert ia[0] in ib[hb] and ib[0] in ia[ha]


def test_any_four_bits_leave_a_common_key():
    golay, rng = simhash.Golay(), random.Random(2)
    for _ in range(4000):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4)))
        fps = np.array([a, b], np.uint64).view(np.int64)
        key, fp = simhash.keys(fps, golay)
        assert set(key[fp == fps[0]]) & set(key[fp == fps[1]])


@pytest.mark.parametrize("tile", [simhash.TILE, 60, 4])
def test_links_connect_what_all_links_do(spark, tile):
    rng = random.Random(3)
    fps = [0, (1 << 64) - 1]
    for _ in range(40):
        fps.append(rng.getrandbits(64))
        for _ in range(rng.choice([1, 2, 30])):
            fps.append(fps[-1] ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 6))))
    fps = sorted(set(np.array(fps, np.uint64).view(np.int64).tolist()))
    whole = np.array(fps)
    pairs = [(a, int(b)) for a in fps for b in whole[simhash.apart(whole, np.int64(a)) <= 4] if b > a]
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), tile=tile)
    got = [tuple(r) for r in got.collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 4 for a, b in got)
    assert brute_components(fps, got) == brute_components(fps, pairs)


def test_near_duplicates_of_whole_table(spark, docs):
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    assert {i: r.fp & (1 << 64) - 1 for i, r in rows.items()} == fps
    ids = sorted(fps)
    pairs = [(a, b) for a in ids for b in ids if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4]
    assert {i: r.component_id for i, r in rows.items()} == brute_components(ids, pairs)


def test_near_duplicates_of_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 3), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 3)]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.schema == odd.schema or [f.name for f in kept.schema] == odd.columns
    assert sorted((r.doc_id or 0, r._id) for r in kept.collect()) == [(0, "clash"), (1, "clash"), (3, "clash"), (5, "clash")]
    assert simhash.one_of_each(odd.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (200, 199), (199, 200)]
    got = dict(map(tuple, common.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    want = dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 150), 100) | {199: 199, 200: 199}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stored_tables_can_be_swept(spark):
    held = common.stored(spark.range(3).toDF("a"))
    assert held.count() == 3 and held.inputFiles()
    common.drop_stored(held)
    with pytest.raises(Exception, match="(?i)not.*exist|no such file|NOT_FOUND"):
        spark.read.parquet(held.inputFiles()[0].rsplit("/", 1)[0]).count()


def test_scratch_keeps_only_what_is_read(spark):
    import os

    at = common._own_dir(spark).removeprefix("file:")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    with common.scratch(spark) as keep:
        gone = common.stored(spark.range(2).toDF("a"))
        read = common.stored(spark.range(3).toDF("a"))
        with common.scratch(spark) as inner:
            deep = inner(common.stored(spark.range(1).toDF("a")).join(read, "a"))
            common.stored(gone)
        result = keep(deep.where("a >= 0"))
    assert result.count() == 1 and len(set(os.listdir(at)) - before) == 2


def brute_vectors(rows, cosine=0.98):
    good = {}
    for i, x, label in rows:
        if x is None or label is None or not x or any(v is None or not np.isfinite(v) for v in x) or not any(x):
            continue
        good[i] = (label, np.array(x, float))
    links = {i: set() for i, _, _ in rows}
    for a, (la, xa) in good.items():
        for b, (lb, xb) in good.items():
            if a != b and la == lb and len(xa) == len(xb) and xa @ xb / np.sqrt((xa @ xa) * (xb @ xb)) >= cosine:
                links[a].add(b)
    comp = brute_components(list(links), [(a, b) for a in links for b in links[a]])
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


@pytest.mark.parametrize("tile", [embeddings.TILE, 7])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(30):
        base = rng.standard_normal(16)
        for s in (0, 0, 0.05, 0.07, 0.09, 0.12):
            rows.append((len(rows), (base + s * rng.standard_normal(16)).astype(np.float32).tolist(), k % 2))
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [None] + [1.0] * 15, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] + [1.0] * 15, 0)]
    rows += [(905, rows[0][1], None), (906, rows[0][1][:8], 0), (907, [], 0), (908, [1e-30] * 16, 0), (909, [2e-30] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'clash' as n_links", "1 as key")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, tile=tile).collect()}
    assert got == brute_vectors(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_any_magnitude(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal(8)
    rows = [(k, (base * f).tolist(), 0) for k, f in enumerate((1e200, 1e-200, 1.0, 3e300, 1e-300))]
    rows += [(10 + k, ((base + rng.standard_normal(8) * 0.1) * f).tolist(), 0) for k, f in enumerate((1e200, 1e-200, 1.0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    unit = [(i, (np.array(x) / np.abs(x).max()).tolist(), label) for i, x, label in rows]
    assert got == brute_vectors(unit) and got[0][0] >= 4


@pytest.mark.parametrize("tile", [embeddings.TILE, 16])
def test_pairs_near_the_threshold_are_recomputed(spark, tile):
    """Every pair about the threshold, half of them links: the integers can tell few of them."""
    rng = np.random.default_rng(10)
    rows = []
    for k in range(60):
        base = rng.standard_normal(12)
        turn = np.linalg.qr(np.column_stack([base, rng.standard_normal(12)]))[0][:, 1] * np.linalg.norm(base)
        rows.append((2 * k, base.tolist(), 0))
        cosine = 0.98 + rng.uniform(-0.004, 0.004)
        rows.append((2 * k + 1, (base * cosine + turn * np.sqrt(1 - cosine**2)).tolist(), 0))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, tile=tile).collect()}
    want = brute_vectors(rows)
    assert got == want and 20 < sum(n for n, _, _ in want.values()) < 100


def test_embeddings_repeated_and_missing_ids(spark):
    x = [1.0, 2.0]
    df = spark.createDataFrame([(1, x, 0), (1, x, 0), (None, x, 0), (None, [5.0, -1.0], 0)], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in embeddings.near_duplicates(df).collect())
    assert got == [(0, 0, 0), (0, 2, 1), (1, 2, 1), (1, 2, 1)]


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((50, 9)), rng.standard_t(2, (60, 9))
    ux, sx, qx, ex, _ = embeddings.quantised(x)
    uy, sy, qy, ey, ky = embeddings.quantised(y)
    near = (qx.astype(float) @ qy.T.astype(float)) * sx[:, None] * sy
    assert (np.abs(ux @ uy.T - near) <= ey + ex[:, None] * ky + 1e-12).all()
