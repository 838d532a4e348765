import zlib

import numpy as np

from engramma.llm import op3_langid as m

SF = "/root/testdata/sf0.001"


def test_gradients_are_right():
    net = m.ByteGru(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 101, (5, 4)), np.array([0, 1, 2, 0])
    states = net.states
    net.states = lambda d, x, keep=False: _in_doubles(net, d, x, keep)
    _, g = net.gradients(x, y)
    for k, w in net.p.items():
        for i in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(4)] + ([(98, 1), (99, 5)] if k[0] == "x" else []):
            old, eps = w[i], 1e-5
            w[i] = old + eps
            up, _ = net.gradients(x, y)
            w[i] = old - eps
            down, _ = net.gradients(x, y)
            w[i] = old
            assert abs((up - down) / (2 * eps) - g[k][i]) < 1e-5, (k, i)
    assert states is not None


def _in_doubles(net, d, x, keep):
    h = net.h
    table, u = net.p[f"x{d}"].T, net.p[f"u{d}"]
    out, gates = np.zeros((len(x) + 1, h, x.shape[1])), []
    for t in range(len(x)):
        zr = 1 / (1 + np.exp(-(u[: 2 * h] @ out[t] + table[: 2 * h, x[t]])))
        n = np.tanh(u[2 * h :] @ (zr[h:] * out[t]) + table[2 * h :, x[t]])
        out[t + 1] = (1 - zr[:h]) * n + zr[:h] * out[t]
        gates.append((zr, n))
    return (out, gates) if keep else out


def slowly(net, body):
    """Probabilities of one text, position by position: each window of WINDOW bytes with CONTEXT on both sides, blanks beyond the text."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    total, n = np.zeros(len(net.labels)), 0
    for begin in range(0, len(body), m.WINDOW):
        at = range(begin - m.CONTEXT, begin + m.WINDOW + m.CONTEXT)
        x = [body[i] if 0 <= i < len(body) else 32 for i in at]
        states = {}
        for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            h, table, u = np.zeros(net.h), net.p[f"x{d}"].astype(float), net.p[f"u{d}"].astype(float)
            for i in order:
                row = table[x[i]]
                z, r = sig(u[: net.h] @ h + row[: net.h]), sig(u[net.h : 2 * net.h] @ h + row[net.h : 2 * net.h])
                new = np.tanh(u[2 * net.h :] @ (r * h) + row[2 * net.h :])
                h = z * h + (1 - z) * new
                states[d, i] = h
        for i, place in enumerate(at):
            if begin <= place < min(begin + m.WINDOW, len(body)) and (x[i] >= 128 or chr(x[i]).isalpha()):
                out = net.p["w"].astype(float) @ np.concatenate([states["f", i], states["b", i]]) + net.p["c"][:, 0]
                p = np.exp(out - out.max())
                total, n = total + p / p.sum(), n + 1
    return total / max(n, 1)


def test_predictions_position_by_position(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = m.train(docs)
    texts = {r.doc_id: r.text for r in docs.where("length(text) < 900").limit(40).collect()} | {90001: "é", 90002: "a" * 97, 90003: "1 2 3", 90004: " "}
    odd = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in m.predict(odd, net).collect():
        want = slowly(net, texts[r.doc_id].encode())
        if not any(c.isalpha() for c in texts[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert abs(want.max() - r.score) < 1e-4 and abs(want[net.labels.index(r.lang_pred)] - want.max()) < 1e-4


def test_sample_is_bounded_and_repeatable(spark):
    rows = [(7, "the same row", "en")] * 500 + [(i, f"text number {i}", "en") for i in range(100, 900)] + [(i, "ein text", "de") for i in range(1000, 1004)] + [(7, "x" * 50000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.lang, r.spot, bytes(r.windows)) for r in m.sample(docs, per_language=50).collect())
    again = sorted((r.lang, r.spot, bytes(r.windows)) for r in m.sample(docs.repartition(7), per_language=50).collect())
    assert got == again and sum(r[0] == "en" for r in got) == 50 and all(len(r[2]) <= m.WINDOWS * 112 for r in got)
    free = [i for i in range(1000, 1004) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sum(r[0] == "de" for r in got) == len(free)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = m.op3_language_id(spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(i, "the and of thing " * 9, "en") for i in range(12)] + [(i, "le est une avec " * 9, "fr") for i in range(20, 32)]
    rows += [(40, None, "fr"), (41, "", "en"), (42, "123 !? 9", "en"), (None, "the and of", None), (43, "the thing", None), (43, "the thing", None), (44, "the of and " * 60000, "en")]
    docs = spark.createDataFrame([(*r, True, 1.0) for r in rows], "doc_id long, text string, lang string, held_out boolean, score double")
    got = {r.doc_id: r for r in m.predict(docs, m.train(docs)).collect()}
    assert [got[i].lang_pred for i in (40, 41, 42)] == ["und"] * 3 and got[40].score == 0
    assert got[None].held_out is False and got[44].lang_pred == "en"
    empty = docs.limit(0)
    assert m.predict(empty, m.train(empty)).count() == 0
    assert {r.lang_pred for r in m.predict(docs, m.train(empty)).collect()} == {"und"}
