import itertools
import re
from collections import Counter

import duckdb

from engramma.llm import op11_audit as m


def brute(docs, labels):
    """Documents removed one order at a time."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    parts = {}
    for d, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), d is not None and least[text] < d]
        parts.setdefault(source or "", []).append((dict(zip("ABCDE", fails, strict=True)), d in good, d in toxic))
    out, shapley = {}, Counter()
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                lost = [r for r in left if r[0][f]]
                stay = [r for r in left if not r[0][f]]
                failing = [r for r in rows if r[0][f]]
                shapley[part, f] += len(lost)
                out[part, "".join(order), k + 1] = [len(stay), len(lost), len(failing) - len(lost), sum(sum(r[0].values()) == 1 for r in failing), sum(r[1] for r in lost), sum(r[2] for r in lost), f]
                left = stay
    return {k: (*v[:6], shapley[k[0], v[6]]) for k, v in out.items()}


def result(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in m.COUNTS) for r in df.collect()}


LONG = " ".join(f"w{i}" for i in range(300))
DOCS = [
    (0, LONG, "a"), (1, LONG, "a"), (1, LONG, "a"), (1, LONG + " x", "a"), (2, LONG, "b"), (3, "the " * 400, "a"), (4, "THE " * 400, None), (5, None, "a"), (6, "", "b"), (7, " \t\n ", "b"),
    (None, LONG, "a"), (None, LONG, "b"), (None, None, None), (8, "a#b " + LONG, "a"), (9, "50% OFF | NOW", ""), (10, "é\x00 ñ " * 5000, "b"), (11, "x\x0by\x0cz\r" * 90, "b"), (12, LONG.upper(), "a"), (3, "the " * 400, "b"),
]
LABELS = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (3, None, 1), (5, 1, None), (None, 1, 1), (12, 0, 1), (99, 1, 1), (9, 1, 1)]


def test_equals_removal_one_by_one(spark):
    docs = spark.createDataFrame([(*r, 1, "z") for r in DOCS], "doc_id long, text string, source string, n int, part string").repartition(3)
    labels = spark.createDataFrame([(*r, "z") for r in LABELS], "doc_id long, quality int, toxic int, part string")
    got = result(m.audit(m.failure_sets(m.failures(docs), labels)))
    assert got == brute(DOCS, LABELS)
    assert len(got) == 600 * len({s or "" for _, _, s in DOCS})


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert result(m.audit(m.failure_sets(m.failures(docs), labels))) == brute(DOCS, [])
    assert m.audit(m.failure_sets(m.failures(docs.limit(0)), labels)).count() == 0


def test_word_rows_are_not_shuffled(spark):
    plan = m.word_counts(m._rows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id", "text", "source"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    with duckdb.connect() as con:
        for name in ("documents", "labels"):
            con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
        rows = con.execute(f"select part, filter_order, step, {', '.join(m.COUNTS)} from ({m.SQL})").fetchall()
    got = result(m.op11_filter_audit(spark, sf))
    assert got == {r[:3]: r[3:] for r in rows}
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    assert got == brute([(r.doc_id, r.text, r.source) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_skewed_ids_and_sources(spark):
    """A third of all rows with one null id, a third with one text."""
    docs = [(None, f"t{i} " * 3, "a") for i in range(300)] + [(i, LONG, f"s{i % 7}") for i in range(300)] + [(i, f"u{i}", "a") for i in range(300, 600)]
    got = result(m.audit(m.failure_sets(m.failures(spark.createDataFrame(docs, "doc_id long, text string, source string")), spark.createDataFrame([(i, i % 2, 0) for i in range(600)], "doc_id long, quality int, toxic int"))))
    assert got == brute(docs, [(i, i % 2, 0) for i in range(600)])
