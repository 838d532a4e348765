"""The online word-pair model in spans: how surprising each observation is, given all before it."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramma.sources.snapshots import checkpointed

#: Fixed values of the model.
VOCABULARY, ALPHA, BIGRAM, UNIGRAM, HISTORY, PERCENTILE, MIN_HISTORY, FALLBACK = 50_000, 0.01, 0.6, 0.4, 300, 0.2, 40, 0.05


SPAN = 1 << 13  # sequence numbers, or places, that one task has
OBSERVED = 1 << 12  # sequence numbers whose words one task has
FIRST = -(1 << 62)  # span of what was learnt before
BUCKET = 1 << 11  # observations whose words one task has, on average, of all spans
ALL, CONTEXT = np.uint64(0), np.uint64(0x5851F42D4C957F2D)  # key of all words; makes a word's hash that of the context


def running_before(rows: DataFrame, order: str, value: str) -> DataFrame:
    """`rows` with `before`: the sum of `value` of the name space's earlier rows. Sums within spans of the order, then over the spans."""
    span = F.floor(F.col(order) / SPAN)
    inner = Window.partitionBy("namespace", "span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("span", span).withColumn("inside", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    spans = inside.groupBy("namespace", "span").agg(F.sum(value).alias("v"))
    outer = Window.partitionBy("namespace").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("namespace", "span", F.coalesce(F.sum("v").over(outer), F.lit(0)).alias("ahead"))
    return inside.join(spans, ["namespace", "span"]).withColumn("before", F.col("inside") + F.col("ahead")).drop("span", "inside", "ahead")


def mixed(a: np.ndarray, b) -> np.ndarray:
    """One 64-bit hash of two."""
    z = b
    for x in (None, a):
        z = (z if x is None else z ^ x) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return z


def hashes(words: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in words), "<u8")


def _planes(x: np.ndarray) -> bytes:
    """Integers byte by byte, all first bytes first, and compressed: little is left to shuffle of small ones."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _from_planes(packed: bytes, kind: type) -> np.ndarray:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys by the steps from one to the next."""
    return _planes(np.diff(keys, prepend=ALL))


def _from_steps(packed: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(packed, np.uint64), dtype=np.uint64)


def coded(obs: DataFrame) -> DataFrame:
    """(namespace, span, seqs, sizes, codes, names): the observations (namespace, seq, span, tokens) of a span that are in one batch, their words as numbers and the 64-bit hashes of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            places = pd.DataFrame({"n": batch["namespace"].to_pandas(), "s": batch["span"].to_pandas()}).groupby(["n", "s"], sort=False).indices
            for (space, span), at in places.items():
                tokens = batch["tokens"].take(pa.array(at))
                words = pc.list_flatten(tokens).dictionary_encode()
                sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int32)
                seqs = batch["seq"].take(pa.array(at)).to_numpy().astype(np.int64)
                out.append((space, span, _planes(seqs), _planes(sizes), _planes(words.indices.to_numpy().astype(np.int32)), hashes(words.dictionary.to_pylist()).tobytes()))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = (pa.string(), pa.int64(), *[pa.binary()] * 4)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["namespace", "span", "seqs", "sizes", "codes", "names"])

    rows = obs.where("namespace is not null").select(F.col("namespace").cast("string").alias("namespace"), F.col("seq").cast("long").alias("seq"), F.col("span").cast("long").alias("span"), "tokens")
    return rows.mapInArrow(run, "namespace string, span long, seqs binary, sizes binary, codes binary, names binary")


def _words(row) -> tuple[np.ndarray, np.ndarray]:
    """Of a row of `coded`: the hash of each word in order, and the number of words of each observation."""
    return np.frombuffer(row.names, np.uint64)[_from_planes(row.codes, np.int32)], _from_planes(row.sizes, np.int32).astype(np.int64)


def _firsts(sizes: np.ndarray) -> np.ndarray:
    """Which words are the first of their observation."""
    first = np.zeros(int(sizes.sum()), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return first


def prior_counts(obs: DataFrame, counts: DataFrame | None = None, buckets: int = 8) -> DataFrame:
    """(space, before, keys, priors): for words, word pairs, contexts and all words of a span of observations (`coded`), how often they came in earlier spans, if they did.

    A key, told by 64-bit hashes, has a number a span, however often it occurs, so a hot word is never one task's; keys are dealt to `buckets`, whose tasks add up what came before. Numbers
    are shuffled packed, keys by their steps. `counts` (namespace, context, token, count) go before all spans."""
    shift = np.uint64(64 - max(1, (buckets - 1).bit_length()))

    def dealt(space: str, span: int, keys: np.ndarray, n: np.ndarray) -> list[tuple]:
        """keys ascend and differ."""
        bucket = keys >> shift
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
        return [(space, int(bucket[i]), span, _steps(keys[i:j]), _planes(n[i:j])) for i, j in zip(cuts, [*cuts[1:], len(keys)], strict=True)]

    def keys_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                words, sizes = _words(row)
                if len(words):
                    two = np.flatnonzero(~_firsts(sizes))
                    before = words[two - 1]
                    keys, n = np.unique(np.concatenate([words, mixed(before, words[two]), mixed(before, CONTEXT)]), return_counts=True)
                    rows = dealt(row.namespace, row.span, np.append(ALL, keys), np.append(len(words), n))
                    yield pd.DataFrame(rows, columns=["namespace", "bucket", "span", "keys", "n"])

    def learnt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for space, own in batch.groupby("namespace", sort=False):
                token, n = hashes(own["token"].tolist()), own["count"].to_numpy(np.int64)
                pair = (own["context"] != "").to_numpy()
                context = hashes(own["context"].tolist())[pair]
                keys = np.concatenate([token[~pair], np.full((~pair).sum(), ALL), mixed(context, token[pair]), mixed(context, CONTEXT)])
                keys, back = np.unique(keys, return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, back, np.concatenate([n[~pair], n[~pair], n[pair], n[pair]]))
                yield pd.DataFrame(dealt(space, FIRST, keys, sums), columns=["namespace", "bucket", "span", "keys", "n"])

    def running(key, frame: pd.DataFrame) -> pd.DataFrame:
        each = [_from_steps(x) for x in frame["keys"]]
        keys = np.concatenate(each)
        n = np.concatenate([_from_planes(x, np.int64) for x in frame["n"]])
        span = np.repeat(frame["span"].to_numpy(), [len(x) for x in each])
        order = np.lexsort((span, keys))
        keys, n, span = keys[order], n[order], span[order]
        fresh = np.append(True, keys[1:] != keys[:-1])
        start = np.flatnonzero(fresh | np.append(True, span[1:] != span[:-1]))
        sums = np.add.reduceat(n, start)
        keys, span, fresh = keys[start], span[start], fresh[start]
        ahead = np.cumsum(sums) - sums
        prior = ahead - ahead[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        ok = np.flatnonzero((prior > 0) & (span > FIRST))
        ok = ok[np.argsort(span[ok], kind="stable")]
        cuts = np.flatnonzero(np.append(True, span[ok][1:] != span[ok][:-1])).tolist() if len(ok) else []
        parts = [ok[i:j] for i, j in zip(cuts, [*cuts[1:], len(ok)], strict=True)] if cuts else []
        rows = [(key[0], int(span[p[0]]), _steps(keys[p]), _planes(prior[p])) for p in parts]
        return pd.DataFrame(rows, columns=["space", "before", "keys", "priors"])

    kind = "namespace string, bucket long, span long, keys binary, n binary"
    each = obs.mapInPandas(keys_of, kind)
    if counts is not None:
        old = counts.where("namespace is not null").select(F.col("namespace").cast("string").alias("namespace"), "context", "token", F.col("count").cast("long").alias("count"))
        each = each.unionByName(old.mapInPandas(learnt, kind))
    return each.groupBy("namespace", "bucket").applyInPandas(lambda key, frame: running(key, frame), "space string, before long, keys binary, priors binary")


def earlier_equals(codes: np.ndarray, obs: np.ndarray) -> np.ndarray:
    """For each place, how many places of earlier observations have its code; obs ascends."""
    order = np.lexsort((obs, codes))
    c, o = codes[order], obs[order]
    place = np.arange(len(c))
    new = np.append(True, c[1:] != c[:-1]) if len(c) else np.zeros(0, bool)
    run = np.maximum.accumulate(np.where(new, place, 0))
    sub = np.maximum.accumulate(np.where(new | np.append(True, o[1:] != o[:-1]), place, 0)) if len(c) else place
    out = np.empty(len(c), np.int64)
    out[order] = sub - run
    return out


def _span_bits(key, obs: pd.DataFrame, prior: pd.DataFrame) -> pd.DataFrame:
    """Mean bits of a word for each observation of a span, given the counts (kind, a, b, prior) before the span."""
    obs = obs.sort_values("seq", kind="stable")
    sizes = obs["tokens"].map(len).to_numpy(np.int64)
    words = [t for tokens in obs["tokens"] for t in tokens]
    codes, names = pd.factorize(np.array(words, object)) if words else (np.zeros(0, np.int64), [])
    index = {w: i for i, w in enumerate(names)}
    held = {k: g for k, g in prior.groupby("kind")}
    vocabulary = max(1, len(names))
    code = lambda column: [index[w] for w in column]

    def known(kind: str, a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
        g = held.get(kind)
        ident = [] if g is None else code(g["a"]) if b is None else [x * vocabulary + y for x, y in zip(code(g["a"]), code(g["b"]), strict=True)]
        found = dict(zip(ident, g["prior"].tolist(), strict=True)) if g is not None else {}
        unique, back = np.unique(a if b is None else a * vocabulary + b, return_inverse=True)
        return np.array([found.get(k, 0) for k in unique.tolist()], np.int64)[back] if len(a) else np.zeros(0, np.int64)

    total = int(held["t"]["prior"].iloc[0]) if "t" in held else 0
    return _scores(obs["namespace"].to_numpy(), obs["seq"].to_numpy(), codes, sizes, total, known)


def _coded_bits(key, obs: pd.DataFrame, prior: pd.DataFrame) -> pd.DataFrame:
    """`_span_bits` of rows of `coded` and `prior_counts`."""
    if not len(obs):
        return pd.DataFrame({"namespace": [], "seq": [], "n_tokens": [], "surprise": []})
    seqs = np.concatenate([_from_planes(x, np.int64) for x in obs["seqs"]])
    words, sizes = (np.concatenate(x) for x in zip(*map(_words, obs.itertuples(index=False)), strict=True))
    order = np.argsort(seqs, kind="stable")
    start, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    words = words[np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(words))]
    names, codes = np.unique(words, return_inverse=True)
    keys = np.concatenate([np.zeros(0, np.uint64), *map(_from_steps, prior["keys"])])
    priors = np.concatenate([np.zeros(0, np.int64), *(_from_planes(x, np.int64) for x in prior["priors"])])
    by = np.argsort(keys)
    keys, priors = np.append(keys[by], ~ALL), np.append(priors[by], 0)  # what is behind all keys has come never

    def found(asked: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, priors[at], 0)

    def known(kind: str, a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
        if kind == "p":
            return found(mixed(names[a], names[b]))
        return found(names if kind == "w" else mixed(names, CONTEXT))[a]

    return _scores(obs["namespace"].iloc[0], seqs[order], codes, sizes, int(found(np.array([ALL]))[0]), known)


def _scores(space, seqs: np.ndarray, codes: np.ndarray, sizes: np.ndarray, total: int, known: Callable) -> pd.DataFrame:
    """Mean bits of a word for each observation of a span, in order of seq, from numbers of its words, and how often words (w), pairs (p) and contexts (c) and all words came before."""
    at = np.repeat(np.arange(len(sizes)), sizes)
    first = _firsts(sizes)
    vocabulary = int(codes.max()) + 1 if len(codes) else 1
    c_word = known("w", codes) + earlier_equals(codes, at)
    c_all = total + (np.cumsum(sizes) - sizes)[at]
    space_size = ALPHA * VOCABULARY
    p = (c_word + ALPHA) / (c_all + space_size)
    two = np.flatnonzero(~first)
    prev, own = codes[two - 1], codes[two]
    c_pair = known("p", prev, own) + earlier_equals(prev * vocabulary + own, at[two])
    c_context = known("c", prev) + earlier_equals(prev, at[two])
    p[two] = np.where(c_context > 0, BIGRAM * ((c_pair + ALPHA) / (c_context + space_size)) + UNIGRAM * p[two], p[two])
    bits = np.bincount(at, -np.log2(p), minlength=len(sizes)) / np.maximum(1, sizes)
    return pd.DataFrame({"namespace": space, "seq": seqs, "n_tokens": sizes.astype(np.int32), "surprise": np.round(np.minimum(1.0, bits / math.log2(VOCABULARY)), 12)})


def surprise(observations: DataFrame, counts: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """(namespace, seq, surprise, predictable) of (namespace, seq, tokens), as if learnt in order of seq.

    Spans of seq are scored each by itself: counts before a span are running sums with one row a key and span (`prior_counts`), those inside it are taken in the
    span's task, in numpy. The percentile of the last scores goes by spans of places that overlap by the history's length. No task holds a whole name space, or all of a word.

    `counts` (namespace, context, token, count) and `history` (namespace, id, score) are what was learnt and scored before.
    """
    obs = observations.select("namespace", "seq", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), F.floor(F.col("seq") / OBSERVED).alias("span"))
    obs = checkpointed(coded(obs))
    prior = prior_counts(obs, counts, max(8, -(-observations.count() // BUCKET)))
    spans = obs.groupBy("namespace", "span").cogroup(prior.groupBy("space", "before"))
    scored = checkpointed(spans.applyInPandas(lambda key, one, before: _coded_bits(key, one, before), "namespace string, seq long, n_tokens int, surprise double"))
    scored = scored.withColumn("one", F.lit(1))
    placed = running_before(scored, "seq", "one").withColumnRenamed("before", "place").withColumn("own", F.lit(True))
    if history is not None:
        old = recent(history.select("namespace", "id", "score"))
        none = F.lit(None)
        old = old.select("namespace", none.cast("long").alias("seq"), none.cast("int").alias("n_tokens"), F.lit(1).alias("one"), F.col("score").alias("surprise"), (-F.col("back")).cast("long").alias("place"), F.lit(False).alias("own"))
        placed = placed.unionByName(old)
    chunk = F.floor(F.col("place") / SPAN)
    ahead = F.floor((F.col("place") + HISTORY) / SPAN)  # the next span, for rows that its first ones look back to
    each = placed.withColumn("home", F.when(F.col("own"), chunk)).withColumn("chunk", F.explode(F.array_distinct(F.array(F.greatest(chunk, F.lit(0)), ahead))))
    return each.groupBy("namespace", "chunk").applyInPandas(_judged, "namespace string, seq long, n_tokens int, surprise double, predictable boolean")


def _judged(key, frame: pd.DataFrame) -> pd.DataFrame:
    """The rows whose home is this chunk, held against the percentile of the scores before each."""
    frame = frame.sort_values("place", kind="stable")
    last = frame["surprise"].shift(1).rolling(HISTORY, min_periods=1)
    seen = np.minimum(np.arange(len(frame)), HISTORY)
    score = frame["surprise"].to_numpy()
    low = last.quantile(PERCENTILE).to_numpy()
    out = frame[["namespace", "seq", "n_tokens", "surprise"]].assign(predictable=np.where(seen < MIN_HISTORY, score < FALLBACK, score <= low))
    return out[(frame["own"] & (frame["home"] == frame["chunk"])).to_numpy(bool)].astype({"seq": "int64", "n_tokens": "int32"})


def recent(history: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The last `keep` scores of each name space, with `back`: 1 for the latest. (A limited rank: each task keeps its own best first.)"""
    last = Window.partitionBy("namespace").orderBy(F.desc("id"))
    return history.withColumn("back", F.row_number().over(last)).where(F.col("back") <= keep)


def merged_history(stored: DataFrame, scored: DataFrame, keep: int = HISTORY) -> DataFrame:
    """Bounded history (id, namespace, score) after scored observations (namespace, seq, surprise); ids go on behind the stored ones."""
    top = stored.groupBy("namespace").agg(F.max("id").alias("top"))
    new = running_before(scored.withColumn("one", F.lit(1)), "seq", "one").join(top, "namespace", "left")
    new = new.select("namespace", (F.coalesce("top", F.lit(0)) + 1 + F.col("before")).alias("id"), F.col("surprise").alias("score"))
    return recent(stored.select("namespace", "id", "score").unionByName(new), keep).select("id", "namespace", "score")


def merged_counts(stored: DataFrame, observations: DataFrame) -> DataFrame:
    """Stored counts (namespace, context, token, count) with those of new observations added; context '' is the word itself."""
    pos = observations.select("namespace", F.posexplode("tokens").alias("i", "token"), "tokens")
    both = pos.select("namespace", F.lit("").alias("context"), "token").union(pos.where("i > 0").select("namespace", F.col("tokens")[F.col("i") - 1], "token"))
    new = both.groupBy("namespace", "context", "token").agg(F.count("*").alias("count"))
    return stored.select("namespace", "context", "token", "count").union(new).groupBy("namespace", "context", "token").agg(F.sum("count").alias("count"))
