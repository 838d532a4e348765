import random
import time

from pyspark.sql import functions as F

from engramma.llm import op8_lines as m


def close(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :] or a == b


def brute(rows, min_bytes=1, near=5):
    """rows in order of documents; numbers of the lines that go."""
    lines = [(d, n, s) for d, text in rows for n, s in enumerate(x.strip(" \t\r\x0b\x0c") for x in (text or "").split("\n"))]
    lines = [x for x in lines if len(x[2].encode()) >= min_bytes]
    gone = {d: set() for d, _ in rows}
    for i, (d, n, s) in enumerate(lines):
        w = s.split(" ")
        for _, _, r in lines[:i]:
            v = r.split(" ")
            if r == s or (max(len(w), len(v)) >= near and close(w, v)):
                gone[d].add(n)
                break
    return {d: sorted(x) for d, x in gone.items()}


def result(df):
    return {r.o: r.gone for r in m.removed_lines(df).collect()}


def sample(seed):
    rng = random.Random(seed)
    vocab = ["word%d" % i for i in range(60)]
    pool = [[rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 10, 14, 20]))] for _ in range(12)]
    rows = []
    for d in range(40):
        out = []
        for _ in range(rng.randrange(0, 7)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 1, 1, 2])):
                i, op = rng.randrange(len(w)), rng.randrange(3)
                if op == 0:
                    w[i] = rng.choice(vocab)
                elif op == 1 and len(w) > 2:
                    del w[i]
                else:
                    w.insert(i, rng.choice(vocab))
            out.append(rng.choice(["", "  "]) + " ".join(w) + rng.choice(["", "\t", "\r"]))
        rows.append((d, "\n".join(out)))
    return rows


def test_against_brute_force(spark, monkeypatch):
    for seed, direct in ((1, 128), (2, 9), (4, 0)):
        monkeypatch.setattr(m, "DIRECT", direct)
        rows = sample(seed)
        want = {d: x for d, x in brute(rows).items() if x}
        df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, s string, n int").repartition(4)
        assert result(df) == want


def test_texts_and_odd_rows(spark):
    line = "one two three four five six seven eight nine ten eleven"
    rows = [(None, line), (1, f"{line}\nshort\n{line} \nend"), (2, None), (3, ""), (4, line.replace("five", "5")), (4, line.replace("five", "5")), (5, "a\n" + line + " twelve thirteen"), (6, "é" * 90000 + " x")]
    df = spark.createDataFrame([(*r, 9, "x", "y") for r in rows], "doc_id long, text string, lines int, _g string, k string")
    got = m.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "lines", "_g", "k", "_lines"] and m.dedup_lines(df, report=None).columns == df.columns
    texts = sorted((r.doc_id or 0, r.text or "", r._lines.removed) for r in got.collect())
    assert [x for x in texts if x[0] != 6] == [
        (0, "", 1), (1, f"{line}\nshort\nend", 1), (2, "", 0), (3, "", 0), (4, "", 1), (4, "", 1), (5, "a\n" + line + " twelve thirteen", 0)]
    assert m.removed_lines(df.limit(0)).count() == 0


def test_hot_template(spark):
    rows = [(i, f"page {i} of the same long template line with many words in it") for i in range(300)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == {i: [0] for i in range(1, 300)}


def test_long_lines_take_time_in_proportion(spark):
    words = ["w%d" % (i * i % 9973) for i in range(60_000)]
    other = words[:30_000] + words[30_001:]
    apart = words[:10] + ["x"] + words[11:40_000] + ["y"] + words[40_001:]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(apart))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.perf_counter()
    assert result(df) == {2: [0]}
    assert time.perf_counter() - began < 30


def seconds(spark, n):
    lines = [f"{i} b{i % 97} c{i % 89} d{i % 83} e{i % 79} f{i % 73} g{i % 71}" for i in range(n // 2)]
    text = "\n".join(f"{a}\n{a} more" for a in lines)  # every second line goes
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    got = m.dedup_lines(df).head()
    assert got.text == "\n".join(lines) and got.lines.removed == n // 2
    return time.perf_counter() - began


def test_many_lines_in_one_document_take_time_in_proportion(spark):
    seconds(spark, 1000)  # starts what runs
    small, large = seconds(spark, 20_000), seconds(spark, 80_000)
    assert large < 8 * small, (small, large)


def test_similarity_of_short_lines(spark):
    rows = [(1, "a b c d e\na b c d\na b c"), (2, "a b c d x"), (3, "a b x d"), (4, "a b c d e f"), (5, "a x c")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == {1: [1], 2: [0], 4: [0]}


def test_colliding_hashes_hide_nothing(spark, monkeypatch):
    """All variants of a line get one hash: the least line of the key is mostly no neighbour."""
    monkeypatch.setattr(m, "DIRECT", 0)
    monkeypatch.setattr(m, "variant_hashes", lambda s: F.transform(F.sequence(F.lit(0), F.size(F.split(s, " "))), lambda i: F.lit(7).cast("long")))
    rows = sample(3)
    want = {d: x for d, x in brute(rows).items() if x}
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_native(spark):
    plan = m.op8_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
