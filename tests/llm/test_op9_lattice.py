import numpy as np

from engramma.llm import op9_lattice as m


def brute(rows, threshold=0.95):
    sound = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if s else None for (_, v), s in zip(rows, sound, strict=True)]
    n = len(rows)
    link = [[j for j in range(n) if j != i and sound[i] and sound[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    comp = [None] * n
    for i in range(n):
        if comp[i] is None:
            stack, seen = [i], {i}
            while stack:
                for j in link[stack.pop()]:
                    if j not in seen:
                        seen.add(j)
                        stack.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            for j in seen:
                comp[j] = (min(ids) if ids else None,)
    return sorted((rows[i][0] if rows[i][0] is not None else -1, len(link[i]), comp[i][0] if comp[i][0] is not None else -1, comp[i][0] == rows[i][0]) for i in range(n))


def got_rows(df):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1, r.kept) for r in df.collect())


def sample(n=260, dim=64, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i and rng.random() < 0.6:
            base = np.array(rows[int(rng.integers(0, len(rows)))][1])
            v = base + rng.normal(size=dim) * np.linalg.norm(base) / np.sqrt(dim) * rng.choice([0, 0.1, 0.2, 0.3])
        else:
            v = rng.normal(size=dim)
        rows.append((i, [float(x) for x in v.astype(np.float32)]))
    return rows


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    near = m.decode(x)
    assert (np.abs(near.sum(1) % 2) < 1e-9).all()
    assert (((x - near) ** 2).sum(1) <= ((x[:, None] - near[:, None] - m.ROOTS) ** 2).sum(2).min(1) + 1e-9).all()
    assert len(m.ROOTS) == 240 and ((x - near) ** 2).sum(1).max() <= 1 + 1e-9


def test_against_brute_force(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, []), (902, [0.0] * 64), (903, [nan] + [1.0] * 63), (904, [None] + [1.0] * 63), (905, [inf] * 64), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1.0] * 64), (908, [1.0] * 64), (909, [1e30] * 64)]
    rows = sample() + odd
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, n_links int").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got_rows(m.near_duplicates(df)) == brute(rows)
    assert m.near_duplicates(df.limit(0)).count() == 0


def test_tiles(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=32)
    rows = [(i, [float(x) for x in (base + rng.normal(size=32) * 0.17).astype(np.float32)]) for i in range(150)] + [(1000 + i, [float(x) for x in base.astype(np.float32)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    old, m.TILE = m.TILE, 16
    try:
        got = got_rows(m.near_duplicates(df))
    finally:
        m.TILE = old
    want = brute(rows)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want) and {r[2] for r in got} == {r[2] for r in want}
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_tiled_buckets(spark, monkeypatch):
    """Closures carry the constants, so a small BUCKET cuts the hot cells of near copies into tiles."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=48)
    rows = [(i, [float(x) for x in (base + rng.normal(size=48) * 0.1).astype(np.float32)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows)
    monkeypatch.setattr(m, "BUCKET", 40)
    assert got_rows(m.near_duplicates(df)) == want


def test_recall_near_threshold():
    n, c = 1500, 0.951
    for dim in (64, 384, 1024):
        rng = np.random.default_rng(dim)
        a = rng.normal(size=(n, dim))
        a /= np.linalg.norm(a, axis=1)[:, None]
        b = rng.normal(size=(n, dim))
        b -= (a * b).sum(1)[:, None] * a
        b = c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b, axis=1)[:, None]
        key, word = m.cells(np.concatenate([a, b]), m.Lattice()), m.sketches(np.concatenate([a, b]), 20)
        p, q = key[:n], key[n:]
        hit = ((p == q[:, :, :1]).any(2) | (q == p[:, :, :1]).any(2)).any(1)
        hit &= np.bitwise_count(word[:n] ^ word[n:]).sum(1) <= m.sketch_bound(0.95)
        assert hit.mean() > 0.97


def test_full_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got_rows(m.op9_lattice_neardup(spark, sf)) == brute(rows)


def test_every_setting_finds_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    for dim in (64, 384):
        a = rng.normal(size=(600, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        r = rng.normal(size=a.shape)
        r -= (r * a).sum(1, keepdims=True) * a
        r /= np.linalg.norm(r, axis=1, keepdims=True)
        b = 0.951 * a + np.sqrt(1 - 0.951**2) * r
        for setting in m.SETTINGS:
            x, y = m.cells(a, m.Lattice(*setting)), m.cells(b, m.Lattice(*setting))
            met = ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any((1, 2)).mean()
            assert met >= 0.97, (setting, dim, met)


def test_larger_tables_get_finer_lattices():
    scales = [m.Lattice.for_rows(10**k).scale for k in range(3, 11)]
    assert scales == sorted(scales) and scales[0] == 6.0 and len(set(scales)) >= 4
    n = 10**9  # comparisons a vector, against the coarsest lattice
    assert m.Lattice.for_rows(n).unlike() < m.Lattice().unlike() / 25
