"""Language identification by a bidirectional gated recurrent network over bytes.

Training is numpy backpropagation through time on a bounded sample; every position
of a text gets language probabilities, and their mean over the letter positions is
the document's distribution.  Texts are read whole, cut into windows of `WINDOW`
bytes (each with `CONTEXT` bytes on either side that warm the states up and are not
pooled); windows of many documents are run as one batch.  No shuffle.

The sample: of distinct rows that may be learned from, each language gives the
`SAMPLE_PER_LANGUAGE` with the smallest hashes of id and text (a documented bound). Executors cut up to
`WINDOWS` windows of `WINDOW` + 2 `CONTEXT` bytes from each, and only those reach the driver: about 230 kB a language.

Defined cases: null or empty text, or text with no letter: `und`, score 0. Null
`doc_id` is not held out and not learned from; null `lang` is never learned from.
If nothing can be learned (empty table), all rows are `und`. Repeated rows give
repeated results and are learned from once; texts of any length are read whole, a block at a time; other columns are ignored and never clash.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramma.llm.common import blocks, bounded_batches

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
SAMPLE_PER_LANGUAGE = 256
HIDDEN, WINDOW, CONTEXT = 8, 96, 8
WINDOWS = 8  # of a row in the sample
BATCH_WINDOWS = 4096


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class ByteGru:
    """Two GRUs over bytes, one in each direction, and a softmax at each position.

    The input weights are a table by byte, so a position costs one row and one
    small product; arrays are hidden x batch, which keeps the gates contiguous.
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        self.labels, self.h = labels, hidden
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = f(256, 3 * hidden)  # update, reset, candidate
            self.p[f"u{d}"] = f(3 * hidden, hidden)
        self.p["w"] = f(len(labels), 2 * hidden)
        self.p["c"] = np.zeros((len(labels), 1), np.float32)

    def states(self, d: str, x: np.ndarray, keep: bool = False):
        """States (time, hidden, batch) of one direction; x is (time, batch) and already in its order."""
        h, (t_n, b) = self.h, x.shape
        table, u = np.ascontiguousarray(self.p[f"x{d}"].T), self.p[f"u{d}"]
        u_zr, u_n = u[: 2 * h], u[2 * h :]
        out = np.empty((t_n + 1, h, b), np.float32)
        out[0] = 0
        gates = [] if keep else None
        for t in range(t_n):
            prev, row = out[t], table.take(x[t], axis=1)
            zr = u_zr @ prev
            zr += row[: 2 * h]
            _sigmoid(zr)
            z, r = zr[:h], zr[h:]
            n = u_n @ (r * prev)
            n += row[2 * h :]
            np.tanh(n, out=n)
            step = prev - n
            step *= z
            np.add(step, n, out=out[t + 1])
            if keep:
                gates.append((zr, n))
        return (out, gates) if keep else out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (time, labels, batch) at every position of x (time, batch)."""
        forward = self.states("f", x)[1:]
        backward = self.states("b", x[::-1])[1:][::-1]
        out = self.p["w"][:, : self.h] @ forward
        out += self.p["w"][:, self.h :] @ backward
        out += self.p["c"]
        out -= out.max(1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(1, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Cross-entropy of all positions and its gradients by backpropagation through time."""
        h, (t_n, b) = self.h, x.shape
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        runs = {"f": (x, *self.states("f", x, True)), "b": (x[::-1], *self.states("b", x[::-1], True))}
        both = np.concatenate([runs["f"][1][1:], runs["b"][1][1:][::-1]], 1)
        out = self.p["w"] @ both + self.p["c"]
        out -= out.max(1, keepdims=True)
        prob = np.exp(out)
        prob /= prob.sum(1, keepdims=True)
        loss = float(-np.log(prob[:, y, np.arange(b)] + 1e-9).mean())
        prob[:, y, np.arange(b)] -= 1
        prob /= t_n * b
        g["w"] = np.einsum("tlb,thb->lh", prob, both, optimize=True)
        g["c"] = prob.sum((0, 2))[:, None]
        top = np.swapaxes(self.p["w"], 0, 1) @ prob
        for d, into in (("f", top[:, :h]), ("b", top[::-1, h:])):
            xs, states, gates = runs[d]
            u = self.p[f"u{d}"]
            u_z, u_r, u_n = u[:h], u[h : 2 * h], u[2 * h :]
            g_z, g_r, g_n = g[f"u{d}"][:h], g[f"u{d}"][h : 2 * h], g[f"u{d}"][2 * h :]
            carry = np.zeros((h, b), np.float32)
            for t in range(t_n - 1, -1, -1):
                zr, n = gates[t]
                z, r, prev = zr[:h], zr[h:], states[t]
                carry = carry + into[t]
                d_n = carry * (1 - z) * (1 - n * n)
                d_z = carry * (prev - n) * z * (1 - z)
                back = u_n.T @ d_n
                d_r = back * prev * r * (1 - r)
                g_n += d_n @ (r * prev).T
                g_z += d_z @ prev.T
                g_r += d_r @ prev.T
                np.add.at(g[f"x{d}"], xs[t], np.concatenate([d_z, d_r, d_n]).T)
                carry = carry * z + back * r + u_z.T @ d_z + u_r.T @ d_r
        return loss, g

    def fit(self, windows: np.ndarray, y: np.ndarray, steps: int = 260, batch: int = 128, rate: float = 0.02, seed: int = 11) -> float:
        """Adam on random batches of windows (n, time); returns the last loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        by_label = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        loss = 0.0
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(ix, batch // len(by_label) + 1) for ix in by_label])
            loss, g = self.gradients(np.ascontiguousarray(windows[pick].T), y[pick])
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, w in self.p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return loss

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities (documents, labels) over the letter bytes of each document."""
        n_docs, n_labels = len(offsets) - 1, len(self.labels)
        total, weight = np.zeros((n_docs, n_labels)), np.zeros(n_docs)
        sizes = np.diff(offsets)
        per = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(n_docs), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        begin = offsets[doc] + nth * WINDOW
        steps = np.arange(-CONTEXT, WINDOW + CONTEXT)[:, None]
        for i in range(0, len(doc), BATCH_WINDOWS):
            d, at = doc[i : i + BATCH_WINDOWS], begin[i : i + BATCH_WINDOWS] + steps
            inside = (at >= offsets[d]) & (at < offsets[d + 1])
            x = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 32)
            mid = slice(CONTEXT, CONTEXT + WINDOW)
            mask = (inside[mid] & LETTER[x[mid]]).astype(np.float32)
            prob = self.probabilities(x)[mid]
            got = np.einsum("tlb,tb->bl", prob, mask)
            np.add.at(total, d, got)
            np.add.at(weight, d, mask.sum(0))
        return total / np.maximum(weight, 1)[:, None]


LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def cut_windows(body: np.ndarray, most: int = WINDOWS) -> np.ndarray:
    """Training windows (n, bytes) spread over a whole text."""
    size = WINDOW + 2 * CONTEXT
    if len(body) < size:
        body = np.concatenate([body, np.full(size - len(body), 32, np.uint8)])
    at = np.unique(np.linspace(0, len(body) - size, most).astype(int))
    return body[at[:, None] + np.arange(size)]


def learnable(docs: DataFrame, id_col: str, lang_col: str, text_col: str) -> DataFrame:
    body = F.col(text_col).cast("string")
    rows = bounded_batches(docs).select(
        F.col(lang_col).cast("string").alias("lang"), body.alias("body"),
        F.crc32(F.col(id_col).cast("string").cast("binary")).alias("fold"), F.xxhash64(F.col(id_col).cast("long"), body).alias("spot"),
    )
    return rows.where((F.col("fold") % 3 != 1) & F.col("lang").isNotNull() & F.col("body").rlike(r"\p{L}"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(lang, spot, windows): the training rows of each language, in windows."""
    rows = learnable(docs, id_col, lang_col, text_col)
    # about how many distinct rows a language has; a share of them passes before texts are cut, by an expression: joining by language would bring all texts of one together
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("spot", 0.02).alias("n")).collect()  # a row for each language, as the model has an output for each
    if not sizes:
        return rows.select("lang", "spot", F.lit(b"").alias("windows")).limit(0)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 1.6 * per_language / r["n"]))])
    picked = rows.where(F.col("spot").cast("double") / F.lit(2.0**64) + F.lit(0.5) < share[F.col("lang")])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = [cut_windows(np.frombuffer(x.as_buffer(), np.uint8)).tobytes() for x in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("spot"), pa.array(got, pa.binary())], ["lang", "spot", "windows"])

    cut = picked.select("lang", "spot", F.col("body").cast("binary").alias("body")).mapInArrow(run, "lang string, spot long, windows binary")
    once = cut.groupBy("lang", "spot").agg(F.min("windows").alias("windows"))
    first = Window.partitionBy("lang").orderBy("spot")
    return once.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language).drop("r")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> ByteGru | None:
    rows = sorted((r["lang"], r["spot"], bytes(r["windows"])) for r in sample(docs, id_col, text_col, lang_col, per_language).collect())
    if not rows:
        return None
    labels = sorted({r[0] for r in rows})
    windows = [np.frombuffer(r[2], np.uint8).reshape(-1, WINDOW + 2 * CONTEXT) for r in rows]
    model = ByteGru(labels)
    model.fit(np.concatenate(windows), np.repeat([labels.index(r[0]) for r in rows], [len(w) for w in windows]))
    return model


def predict(docs: DataFrame, model: ByteGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; reads whole texts."""
    state = docs.sparkSession.sparkContext.broadcast(pickle.dumps((model.labels, model.h, model.p) if model else None))  # a few kB

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = pickle.loads(state.value)
        own = None
        if held:
            own = ByteGru(held[0], held[1])
            own.p = held[2]
        for batch in batches:
            for block in blocks(batch.column(1), 1 << 19):
                ids, fold, letter = (batch.column(k).slice(block.first, block.n) for k in (0, 2, 3))
                has = np.array([bool(x) for x in letter.to_pylist()])
                if own is None:
                    pred, score = np.full(block.n, "und", object), np.zeros(block.n)
                else:
                    prob = own.pooled(block.data, block.offsets)
                    best = prob.argmax(1)
                    pred = np.where(has, np.array(own.labels, object)[best], "und")
                    score = np.where(has, np.clip(prob[np.arange(block.n), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([ids, fold, pa.array(pred.tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    fold = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out")
    letter = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"), fold, letter)
    return rows.mapInArrow(run, SCHEMA)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs))
