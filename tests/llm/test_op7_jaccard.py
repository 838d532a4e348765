import random
import re

from engramma.llm import op7_jaccard as m


def brute(rows, percent=90, k=3):
    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [grams(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                comp[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    name = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    none = lambda x: -1 if x is None else x
    return sorted((none(d), len(sets[i]), none(name[root(i)])) for i, (d, _) in enumerate(rows))


def sample(seed=2, groups=14):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    common = " ".join(rng.choice(vocab) for _ in range(12))
    rows, at = [], 0
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 90, 200]))]
        for _ in range(rng.choice([1, 1, 3, 9, 25])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            text = (common + "\n" if rng.random() < 0.5 else "") + " ".join(own)
            rows.append((at, text.upper() if rng.random() < 0.2 else text))
            at += 1
    return rows


def compare(spark, rows, percent=90, k=3):
    none = lambda x: -1 if x is None else x
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, node string, n int").repartition(3)
    got = sorted((none(r.doc_id), r.n_shingles, none(r.component_id)) for r in m.jaccard_components(df, k=k, percent=percent).collect())
    assert got == brute(rows, percent, k)


def test_against_brute_force(spark):
    rows = sample()
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "one two"), (907, "a b c"), (None, "a b c"), (None, "null alone x y z"), (None, None)]
    rows += [(910, "dup id one two three four"), (910, "dup id one two three four"), (910, "other text under one id here"), (911, "long " * 30000 + "end")]
    compare(spark, rows)


def test_tiles_and_column_blocks(spark, monkeypatch):
    old = m.TILE, m.COLUMNS
    m.TILE, m.COLUMNS = 8, 50
    try:
        compare(spark, sample(5, 8))
    finally:
        m.TILE, m.COLUMNS = old


def test_other_lengths_and_bounds(spark):
    compare(spark, sample(7, 10), 80, 5)
    compare(spark, sample(8, 8), 60, 1)


def test_empty(spark):
    assert m.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_full_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, m.op7_ngram_jaccard(spark, sf).collect())) == brute(rows)


def test_tiles_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(m, "TILE_SHINGLES", 300)  # a group of long texts falls into many tiles, however few they are
    compare(spark, sample(5, 6), 80)
