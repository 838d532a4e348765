import random
from collections import defaultdict

from engramma.llm import op4_packing as m


def trial(lengths, order, k, size):
    """Tokens of a bin opened by order[k], with the largest later pieces that fit, one after another."""
    used = lengths[order[k]]
    for i in order[k + 1 :]:
        if lengths[i] and used + lengths[i] <= size:
            used += lengths[i]
    return used


def plain(lengths, sizes, opened):
    """Best-fit decreasing, by trying every bin; opened None: every size is tried for each new bin."""
    bins = []
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    for k, i in enumerate(order):
        fit = [(b["free"], n) for n, b in enumerate(bins) if b["free"] >= lengths[i]]
        if fit:
            n = min(fit)[1]
        else:
            able = [c for c in sizes.lengths if c >= lengths[i]]
            if opened is None:
                used = {c: trial(lengths, order, k, c) for c in able}
                size = min(able, key=lambda c: (sizes.cost(sizes.least(used[c])) / max(used[c], 1), -c))
            else:
                size = opened if opened >= lengths[i] else min(able)
            bins.append({"free": size, "in": []})
            n = len(bins) - 1
        bins[n]["in"].append(i)
        bins[n]["free"] -= lengths[i]
    return [b["in"] for b in bins]


def test_pack_is_best_of_plain():
    rng = random.Random(1)
    sizes = m.Sizes((16, 32, 64), 4)
    better = 0
    for _ in range(80):
        lengths = [rng.randrange(0, 65) if rng.random() < 0.6 else rng.randrange(0, 12) for _ in range(rng.randrange(0, 60))]
        cost = lambda bins: sum(sizes.cost(sizes.least(sum(lengths[i] for i in b))) for b in bins)
        assert m.best_fit(lengths, sizes) == plain(lengths, sizes, None)
        uniform = min(cost(plain(lengths, sizes, c)) for c in sizes.lengths)
        got = m.pack(lengths, sizes)
        assert sum(sizes.cost(size) for size, _ in got) == min(uniform, cost(plain(lengths, sizes, None)))
        better += cost(plain(lengths, sizes, None)) < uniform
        assert sorted(i for _, b in got for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= size for size, b in got)
    assert better


def test_rows_are_whole(spark):
    rows = [(1, "a" * 40000), (2, None), (3, ""), (None, "xy"), (5, "b" * 16384), (6, "c" * 32768)] + [(7, "dup")] * 300 + [(i, "z" * i) for i in range(10, 300)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bin_id int")
    got = m.pack_rows(docs.selectExpr("doc_id", "cast(coalesce(octet_length(text), 0) as long) n_tokens"), group=100).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.copy].append((r.piece, r.piece_start, r.piece_len))
        bins[r.bin_id].append(r)
    assert len(pieces) == len(rows)
    for (d, _), p in pieces.items():
        p.sort()
        assert [x[0] for x in p] == list(range(len(p)))
        assert all(a[1] + a[2] == b[1] for a, b in zip(p, p[1:], strict=False))
    assert sum(p[2] for v in pieces.values() for p in v) == sum(len(t or "") for _, t in rows)
    sizes = m.Sizes()
    for b in bins.values():
        b.sort(key=lambda r: (r.bin_offset, r.piece_len))
        at = 0
        for r in b:
            assert r.bin_offset == at
            at += r.piece_len
        assert b[0].bin_used == at and b[0].bin_size == sizes.least(at)
    assert m.pack_documents(docs.limit(0)).count() == 0


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(m, "COPIES", 8)
    rows = spark.createDataFrame([(1, 10)] * 77 + [(None, 5)] * 16 + [(2, 0)], "doc_id long, n_tokens long")
    got = m.pack_rows(rows, group=20).collect()
    assert sorted(r.copy for r in got if r.doc_id == 1) == list(range(77)) and sorted(r.copy for r in got if r.doc_id is None) == list(range(16)) and len(got) == 94


def test_query_against_plain_packing(spark):
    """The registered query, bin by bin: its groups are found by their bins' numbers and packed again the plain way."""
    sizes, largest = m.Sizes(), max(m.Sizes().lengths)
    docs = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "coalesce(octet_length(text), 0)").collect()}
    got = m.op4_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    assert sum(r.piece_len for r in got) == sum(docs.values())
    groups = defaultdict(list)
    for r in got:
        groups[r.bin_id >> 24].append(r)
    for rows in groups.values():
        ids = sorted({r.doc_id for r in rows})
        full = {d: docs[d] // largest - (docs[d] % largest == 0 and docs[d] > 0) for d in ids}
        rest = [docs[d] - full[d] * largest for d in ids]
        best = min(([(sizes.least(sum(rest[i] for i in b)), sorted(ids[i] for i in b)) for b in plain(rest, sizes, c)] for c in (None, *sorted(sizes.lengths, reverse=True))),
                   key=lambda bins: sum(sizes.cost(x) for x, _ in bins))
        bins = defaultdict(list)
        for r in rows:
            bins[r.bin_id, r.bin_size].append(r)
        mine = sorted((size, sorted(r.doc_id for r in b)) for (_, size), b in bins.items() if any(r.piece == full[r.doc_id] for r in b))
        assert mine == sorted(best)
        whole = [r for b in bins.values() if not any(r.piece == full[r.doc_id] for r in b) for r in b]
        assert len(whole) == sum(full.values()) and all(r.piece_len == r.bin_size == largest for r in whole)
