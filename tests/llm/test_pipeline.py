import random
import re
from collections import defaultdict

import corpus_pipeline
from engramma.llm import op1_suffix, op4_packing, op6_quality
from tests.llm import test_op7_jaccard, test_op8_lines

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def good(text):
    words = re.findall(WORD, text)
    chars = sum(map(len, words))

    def windows(n):
        at = defaultdict(list)
        for i in range(len(words) - n + 1):
            at[tuple(words[i : i + n])].append(i)
        return [v for v in at.values() if len(v) > 1]

    many = {i + d for v in windows(8) for i in v for d in range(8)}
    if len(words) < 20 or 100 * len(many) > 30 * len(words):
        return False
    seen, twice = set(), 0
    for s in text.split("\n"):
        if re.search(WORD, s):
            twice += sum(map(len, re.findall(WORD, s))) if s in seen else 0
            seen.add(s)
    if 100 * twice > 30 * chars:
        return False
    for n, most in op6_quality.Rules().max_later_ngram_chars_percent:
        later = {i + d for v in windows(n) for i in v[1:] for d in range(n)}
        if 100 * sum(len(words[i]) for i in later) > most * chars:
            return False
    return True


def filled(rows):
    return [(d, t) for d, t in rows if re.search(WORD, t)]


def brute(rows):
    rows = [(d, t) for d, t in rows if t is not None and good(t)]
    gone = test_op8_lines.brute(rows)
    rows = filled([(d, "\n".join(s for n, s in enumerate(t.split("\n")) if n not in set(gone[d]))) for d, t in rows])
    component = {d: c for d, _, c in test_op7_jaccard.brute(rows, corpus_pipeline.PERCENT, corpus_pipeline.SHINGLE)}
    rows = [(d, t) for d, t in rows if component[d] == d]
    seen, out = set(), []
    for d, t in rows:
        raw, cut = t.encode(), []
        for i in range(len(raw) - op1_suffix.LENGTH + 1):
            w = raw[i : i + op1_suffix.LENGTH]
            if w in seen:
                cut.append(i)
            seen.add(w)
        mark = set()
        for i in cut:
            mark.update(range(i, i + op1_suffix.LENGTH))
        out.append((d, bytes(b for i, b in enumerate(raw) if i not in mark).decode("utf-8", "ignore")))
    return filled(out)


def packed(rows):
    largest = max(op4_packing.Sizes().lengths)
    pieces = sorted((d, min(largest, len(t.encode()) - i)) for d, t in rows for i in range(0, len(t.encode()), largest))
    rest = [len(t.encode()) - largest * ((len(t.encode()) - 1) // largest) for _, t in sorted(rows)]
    full = sum(n == largest for _, n in pieces) - sum(n == largest for n in rest)
    sizes = op4_packing.Sizes()
    return pieces, full * sizes.cost(largest) + sum(sizes.cost(size) for size, _ in op4_packing.pack(rest))


def check(got, rows):
    pieces, cost = packed(rows)
    assert sorted((r.doc_id, r.piece_len) for r in got) == pieces
    assert sum(op4_packing.Sizes().cost(size) for _, size in {(r.bin_id, r.bin_size) for r in got}) == cost


def test_full_table(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    check(corpus_pipeline.run(spark, SF).collect(), brute(rows))


def test_planted_rows(spark, tmp_path):
    rng = random.Random(9)
    words = lambda n: " ".join("w%d" % rng.randrange(5000) for _ in range(n))
    shared = words(60)
    base = words(200)
    near = base.split(" ")
    near[50] = "changed"
    rows = [(0, base), (1, base), (2, " ".join(near)), (3, words(100) + " " + shared + " " + words(50)), (4, words(30) + " " + shared + " " + words(30)), (5, "too short"), (6, None), (7, ""), (8, "rep eat " * 300), (9, words(150))]
    rows += [(10 + i, words(40) + "\n" + base[:300] + "\n" + words(40)) for i in range(5)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(rows)
    check(got, want)
    assert {0, 3, 4, 9} <= {d for d, _ in want} and not {1, 2, 5, 6, 7, 8} & {d for d, _ in want}


def test_equal_ids_null_ids_and_clashing_columns(spark, tmp_path):
    rng = random.Random(12)
    words = lambda n: " ".join("v%d" % rng.randrange(5000) for _ in range(n))
    a, b, c, d = (words(120) for _ in range(4))
    near = a.split(" ")
    near[60] = "changed"
    rows = [(1, a), (2, " ".join(near)), (2, b), (2, b), (3, c), (None, d), (None, d), (None, None), (4, a), (5, c + "\n" + words(90))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, lines int, _gone string, _d int, _k int, k string, lone string"
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 2, 3, "y", "z") for i, t in rows], schema)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns and docs.where("lines <> 1 or _gone <> 'x' or _d <> 2 or _k <> 3 or k <> 'y' or lone <> 'z'").count() == 0, name
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in docs.collect())
    assert [g[0] for g in got] == [-1, 1, 2, 3, 5] and dict(got)[2] == b and dict(got)[1] == a and dict(got)[-1] == d
    assert c not in dict(got)[5] and len(dict(got)[5].split()) == 90
    packed_ = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece_len) for r in packed_) == [(i, len(t.encode())) for i, t in got]


def test_a_very_long_text_and_a_map_column(spark, tmp_path):
    rng = random.Random(14)
    words = lambda n: " ".join("u%d" % rng.randrange(60_000) for _ in range(n))
    long = "\n".join(words(12) for _ in range(12_000))
    short = words(200)
    rows = [(1, long, {"a": 1}), (2, short, {"b": 2}), (2, short, {"a": 2}), (3, long.split("\n")[77] + "\n" + words(90), None), (4, words(60) + "\n" + long[500:1500], {"c": None})]
    df = spark.createDataFrame([(d, t, "en", "s", len(t), tags) for d, t, tags in rows], "doc_id long, text string, lang string, source string, n_chars long, tags map<string,int>")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
    got = {r.doc_id: r for r in docs.collect()}
    assert got[1].text == long and got[1].tags == {"a": 1} and got[2].tags == {"a": 2} and len(got[3].text.split()) == 90 and got[4].tags == {"c": None}
    assert long[600:700] not in got[4].text
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.piece_len for r in out if r.doc_id == 1) == len(long.encode())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "substrings", "packing"]
