"""Suffix-array dedup of long repeated byte strings by merging Burrows-Wheeler transforms.

A byte is removed if a string of `length` bytes that covers it also starts earlier in the
corpus (smaller doc_id, or same document and earlier start), judged on the input.

1. Candidates.  Every `length`-byte window is owned by its minimiser, the `GRAM`-byte string
   in it of least hash (leftmost of equals).  Equal windows have equal minimisers, so a
   window can only repeat if its minimiser does; repeated ones are found by a shuffle of
   hashes, sent in packed arrays, each task's own repeats counted once.
2. Contexts.  For each repeated minimiser the bytes of its windows (a string of up to
   2 `length` - `GRAM` bytes) go to the minimiser's bucket.  Equal strings are one member of
   the collection, represented by their first occurrence; later ones are removed whole.
3. Transforms.  In a bucket, strings that share a minimiser with another string are cut into
   shards, and each shard's transform of the circular strings is built.  Shards are merged
   without sorting their rotations again: an interleave (which shard is next) starts
   unordered, and each pass moves it by the preceding symbols, stably, so that after a pass
   over q symbols the merged order is right for q more symbols.  Symbols are runs of four
   bytes in a dense code (fewer if the code would not fit 16 bits).  The pass that first puts a border between
   two neighbours gives their common prefix; where it is `length` or more they belong to one
   repeated interval: all windows of an interval but the first are removed.
4. The removed windows come back to their documents, and the covered bytes are cut out.

Minimisers that occur more than `HOT` times send each window as a string of its own, keyed
by the window's hash, so that a passage that a third of all documents share is spread.

Defined cases: null text is empty; texts shorter than `length` lose nothing; null doc_id
orders last; rows of equal doc_id and text are one document and give equal rows; rows of
equal doc_id and different texts are ordered by the texts' hash; an empty table gives no rows; very long texts are
searched in pieces that overlap, so nothing is cut; other columns are ignored and never clash.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramma.llm.common import U64, bounded_batches, drop_stored, mix, shuffle_parts, span_hashes, store

LENGTH, GRAM = 100, 32
HOT = 1 << 16
HOT_SHIFT = 28  # 100 TB: 2^18 strings of one minimiser meet (62 MB), and the broadcast hot ones are fewer than 2^28 / 35 (61 MB) at any size
LAST = (1 << 63) - 1
PIECE = 1 << 20  # window starts of one document handled at a time
COLLECTION = 1 << 17  # bytes whose transforms are merged together; small, since random access pays for cache misses
SHARDS = 2
BATCH = 1 << 23  # bytes of text whose hashes are packed together
GROUP = 1 << 24  # bytes of text of one group of documents


# ------------------------------------------------------------ minimisers

_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for hashes of a `GRAM` at every place; equal strings are told by their bytes, never by these."""
    size = 1 << max(16, n.bit_length())
    if size not in _POW:
        _POW.clear()
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U64))
        _POW[size] = tuple(both)
    return _POW[size]


def owners(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: first start, end of starts, minimiser's hash."""
    found = []
    last = len(data) - length + 1
    low = U64((1 << 22) - 1)
    for base in range(0, max(last, 0), PIECE):
        part = data[base : base + PIECE + length - 1]
        n = len(part)
        power, inverse = _powers(n + 1)
        run = np.empty(n + 1, U64)
        run[0] = 0
        np.cumsum(_BYTE[part] * power[:n], out=run[1:])
        h = mix((run[gram:] - run[:-gram]) * inverse[: n - gram + 1])
        key = (h & ~low) | np.arange(len(h), dtype=U64)
        width, s = length - gram + 1, 1
        while 2 * s <= width:
            key = np.minimum(key[:-s], key[s:])
            s *= 2
        if s < width:
            key = np.minimum(key[: len(key) - (width - s)], key[width - s :])
        place = (key & low).astype(np.int64)
        a = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        b = np.append(a[1:], len(place))
        found.append((a + base, b + base, h[place[a]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def windows_of(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Single windows of the runs [a, b): their starts and hashes."""
    at = np.repeat(a, b - a) + np.arange(int((b - a).sum())) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
    digests = [int.from_bytes(hashlib.blake2b(data[i : i + length].tobytes(), digest_size=8).digest(), "little") for i in at.tolist()]
    return at, np.array(digests, U64)


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of `data` one after another."""
    total = int(size.sum())
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)]


# ------------------------------------------------------------ packed arrays


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<4sQ", a.dtype.str[1:].encode().ljust(4), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    (k,) = struct.unpack_from("<I", raw)
    at, out = 4 + 12 * k, []
    for i in range(k):
        kind, n = struct.unpack_from("<4sQ", raw, 4 + 12 * i)
        kind = np.dtype("<" + kind.decode().strip())
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def _documents(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    doc = F.col(id_col).cast("long")
    return bounded_batches(docs).select(doc.alias("doc_id"), F.coalesce(doc, F.lit(LAST)).alias("o"), F.xxhash64(body).alias("t"), body.alias("body"), *more)


def spot(o: np.ndarray, t: np.ndarray, groups: int) -> np.ndarray:
    """The group of each document."""
    return (mix(o.view(U64) * U64(0x9E3779B97F4A7C15) ^ t.view(U64)) % U64(groups)).astype(np.int32)


def cuts(keys: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of equal neighbours."""
    if not len(keys):
        return []
    edge = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return list(zip(edge[:-1], edge[1:], strict=True))


def squeezed(rows: DataFrame, groups: int) -> DataFrame:
    """`rows` with compressed bodies and the group of each document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            names = [n for n in batch.schema.names if n != "body"]
            body = pa.array([press.compress(x.as_buffer()) for x in batch.column("body")], pa.binary())
            g = spot(*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("o", "t")), groups)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), body, pa.array(g, pa.int32())], [*names, "body", "g"])

    kinds = [f for f in rows.schema if f.name != "body"]
    return rows.select(*[f.name for f in kinds], "body").mapInArrow(run, T.StructType([*kinds, T.StructField("body", T.BinaryType()), T.StructField("g", T.IntegerType())]))


def by_document(o: np.ndarray, t: np.ndarray, *values: np.ndarray) -> dict:
    """Values of each document."""
    order = np.lexsort((t, o))
    o, t = o[order], t[order]
    values = [v[order] for v in values]
    edge = np.append(True, (o[1:] != o[:-1]) | (t[1:] != t[:-1])) if len(o) else np.zeros(0, bool)
    at = np.append(np.flatnonzero(edge), len(o)).tolist()
    return {(int(o[x]), int(t[x])): tuple(v[x:y] for v in values) for x, y in zip(at[:-1], at[1:], strict=True)}


# ------------------------------------------------------------ 1. repeated minimisers


def repeated(rows: DataFrame, length: int, gram: int, groups: int, hot: int) -> DataFrame:
    """(g, data): for groups of documents the numbers of the runs whose minimiser repeats; rows of
    group -1 hold minimisers that occur more than `hot` times."""
    buckets = groups

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, keys, size = [], [], 0

        def flush():
            o, t = (np.array(x, np.int64) for x in zip(*keys, strict=True))
            count = np.array([len(h) for h in held])
            h = np.concatenate(held)
            doc = np.repeat(np.arange(len(held), dtype=np.int32), count)
            nth = (np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
            order = np.argsort(h, kind="stable")
            h, doc, nth = h[order], doc[order], nth[order]
            first = np.append(True, h[1:] != h[:-1])
            times = np.diff(np.append(np.flatnonzero(first), len(h))).astype(np.int32)
            each = np.repeat(times, times)
            out: list[tuple[int, bool, bytes]] = []
            # repeats inside this batch: the answer is known; only one ask for each hash goes out
            back = np.flatnonzero(each > 1)
            goal = spot(o, t, buckets)
            back = back[np.argsort(goal[doc[back]], kind="stable")]
            for x, y in cuts(goal[doc[back]]):
                ix = back[x:y]
                d = doc[ix]
                out.append((int(goal[d[0]]), True, pack(o[d], t[d], nth[ix])))
            hf, df, nf = h[first], doc[first], nth[first]
            place = ((hf >> U64(32)) % U64(buckets)).astype(np.int32)
            order = np.argsort(place, kind="stable")
            for x, y in cuts(place[order]):
                ix = order[x:y]
                docs_here, local = np.unique(df[ix], return_inverse=True)
                out.append((int(place[ix[0]]), False, pack(o[docs_here], t[docs_here], hf[ix], local.astype(np.int32), nf[ix], times[ix])))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int32(), pa.bool_(), pa.binary()))], ["b", "known", "data"])

        for batch in batches:
            for o, t, body in zip(batch.column("o").to_pylist(), batch.column("t").to_pylist(), batch.column("body"), strict=True):
                data = np.frombuffer(body.as_buffer(), np.uint8)
                if len(data) < length:
                    continue
                held.append(owners(data, length, gram)[2])
                keys.append((o, t))
                size += len(data)
                if size >= BATCH:
                    yield flush()
                    held, keys, size = [], [], 0
        if held:
            yield flush()

    def answer(key, frame):
        import pandas as pd

        out_g, out_d = [], []
        for known in frame[frame["known"]]["data"]:
            out_g.append(int(key[0]))
            out_d.append(known)
        asks = [unpack(x) for x in frame[~frame["known"]]["data"]]
        if asks:
            h = np.concatenate([x[2] for x in asks])
            times = np.concatenate([x[5] for x in asks])
            _, inv = np.unique(h, return_inverse=True)
            total = np.bincount(inv, times).astype(np.int64)[inv]
            often = np.unique(h[total > hot])
            if len(often):
                out_g.append(-1)
                out_d.append(pack(often))
            pick = (total > 1) & (times == 1)  # those repeated in the batch already have an answer
            o, t = (np.concatenate([x[k][x[3]] for x in asks])[pick] for k in (0, 1))
            nth = np.concatenate([x[4] for x in asks])[pick]
            goal = spot(o, t, groups)
            order = np.argsort(goal, kind="stable")
            for x, y in cuts(goal[order]):
                ix = order[x:y]
                out_g.append(int(goal[ix[0]]))
                out_d.append(pack(o[ix], t[ix], nth[ix]))
        return pd.DataFrame({"g": pd.Series(out_g, dtype="int32"), "data": pd.Series(out_d, dtype="object")})

    asked = rows.select("o", "t", "body").mapInArrow(ask, "b int, known boolean, data binary")
    return asked.repartition(buckets, "b").groupBy("b").applyInPandas(answer, "g int, data binary")


# ------------------------------------------------------------ 3. transforms


def _dense(codes: np.ndarray, top: int) -> tuple[np.ndarray, int] | None:
    """Codes below `top` renumbered without gaps, if the new ones fit 16 bits."""
    seen = np.zeros(top, bool)
    seen[codes] = True
    n = int(seen.sum())
    if n > 1 << 16:
        return None
    return (np.cumsum(seen) - 1).astype(np.uint16)[codes], n


def symbols(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(width, dense code of the run of that width from each place on), widest first; strings are circular."""
    n = len(data)
    nxt = np.arange(1, n + 1)
    nxt[start + size - 1] = start
    one, n1 = _dense(data, 256)
    out = [(1, one)]
    two = _dense(one.astype(np.int64) * n1 + one[nxt], n1 * n1)
    if two:
        out.append((2, two[0]))
        if two[1] ** 2 <= 1 << 25:
            four = _dense(two[0].astype(np.int64) * two[1] + two[0][nxt[nxt]], two[1] ** 2)
            if four:
                out.append((4, four[0]))
    return out[::-1]


def before(start: np.ndarray, size: np.ndarray, q: int) -> np.ndarray:
    """For each place the one q symbols before it in its circular string."""
    n = int(size.sum())
    first = np.repeat(start, size)
    length = np.repeat(size, size)
    return (first + (np.arange(n) - first - q) % length).astype(np.int32)


def steps(table: list[tuple[int, np.ndarray]], length: int) -> list[int]:
    """Which symbol width each pass takes, `length` in all."""
    out, rest = [], length
    for q, _ in table:
        out += [q] * (rest // q)
        rest %= q
    return out


def transform(places: np.ndarray, plan: list[int], code: dict, prev: dict) -> np.ndarray:
    """Rotations at `places` (whole strings) in the order of their first symbols."""
    order = places
    for q in plan:
        moved = prev[q][order]
        order = moved[np.argsort(code[q][moved], kind="stable")]
    return order


def interleave(shards: list[np.ndarray], plan: list[int], code: dict, prev: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave of the shards' transforms, refined pass by pass: (rotation, interval, common) in merged order.

    Rotations with a common prefix keep their stretch of places in all later passes, so the pass that first puts a border at a place tells how far that rotation agrees with the
    one before it: `common` is the symbols before that pass (it may agree for some of the pass's own, see `common_prefixes`), and all of them where no pass tells the two apart."""
    total = sum(map(len, shards))
    which = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s) for s in shards])
    bwt = {q: [code[q][prev[q][s]] for s in shards] for q in set(plan)}
    block = np.zeros(total, np.int32)
    symbol = np.empty(total, np.uint16)
    common, depth = np.full(total, sum(plan), np.int32), 0
    common[:1] = 0
    apart = np.zeros(total, bool)  # places with a border
    for q in plan:
        for k, column in enumerate(bwt[q]):
            symbol[which == k] = column
        order = np.argsort(symbol, kind="stable")
        which = which[order]
        sorted_, source = symbol[order], block[order]
        border = np.empty(total, bool)
        border[0] = False
        np.not_equal(sorted_[1:], sorted_[:-1], out=border[1:])
        border[1:] |= source[1:] != source[:-1]
        common[border & ~apart] = depth
        apart, depth = border, depth + q
        block = np.cumsum(border, dtype=np.int32)
    rotation = np.empty(total, np.int64)
    for k, s in enumerate(shards):
        rotation[which == k] = s
    return rotation, block, common


def merge(shards: list[np.ndarray], plan: list[int], code: dict, prev: dict) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, interval) in merged order."""
    return interleave(shards, plan, code, prev)[:2]


def common_prefixes(data: np.ndarray, size: np.ndarray, rotation: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """How many bytes, up to `length`, each rotation of the merged order shares with the one before it: what `interleave` says, and the few bytes of one pass behind it compared."""
    start = np.cumsum(size) - size
    first, long = np.repeat(start, size), np.repeat(size, size)
    out = common.astype(np.int64)
    at = np.arange(1, len(rotation))
    while len(at := at[out[at] < length]):
        a, b = rotation[at - 1], rotation[at]
        equal = data[first[a] + (a - first[a] + out[at]) % long[a]] == data[first[b] + (b - first[b] + out[at]) % long[b]]
        at = at[equal]
        out[at] += 1
    return out


def repeated_windows(data: np.ndarray, size: np.ndarray, length: int, shards: int = SHARDS) -> np.ndarray:
    """For each place: does the window that starts there (inside its string) also start at an earlier place?"""
    start = np.cumsum(size) - size
    table = symbols(data, start, size)
    plan = steps(table, length)
    code = dict(table)
    prev = {q: before(start, size, q) for q in set(plan)}
    n = len(size)
    cut = np.unique(np.linspace(0, n, min(shards, n) + 1).astype(int))
    ends = np.append(start, len(data))
    built = [transform(np.arange(ends[a], ends[b], dtype=np.int32), plan, code, prev) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    rotation, _, common = interleave(built, plan, code, prev)
    inside = np.repeat(start + size - length, size) >= np.arange(len(data))
    place = np.where(inside[rotation], rotation, len(data))
    new = np.append(True, common[1:] < length)  # repeated intervals: stretches that share `length` bytes
    least = np.minimum.reduceat(place, np.flatnonzero(new))
    later = np.zeros(len(data) + 1, bool)
    later[place[place != least[np.cumsum(new) - 1]]] = True
    return later[:-1] & inside


# ------------------------------------------------------------ 2. contexts, buckets


def removed_windows(rows: DataFrame, found: DataFrame, length: int, gram: int, groups: int) -> DataFrame:
    """(g, data): for groups of documents the runs of removed window starts."""
    n = found.where("g >= 0").agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = max(shuffle_parts(rows.sparkSession), math.ceil(n / (256 << 10)))
    hot = [unpack(r["data"])[0] for r in found.where("g < 0").select("data").collect()]
    hot_set = rows.sparkSession.sparkContext.broadcast(np.sort(np.concatenate(hot)) if hot else np.zeros(0, U64))
    texts = squeezed(rows.where(F.octet_length("body") >= length).select("o", "t", "body"), groups)

    def contexts(key, docs, answers):
        import pyarrow as pa
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        hot = hot_set.value
        names = ["b", "late", "data"]
        kinds = (pa.int32(), pa.bool_(), pa.binary())
        table = lambda rows: pa.table([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], names)
        if not docs.num_rows or not answers.num_rows:
            return table([])
        parts = [unpack(x.as_py()) for x in answers.column("data")]
        wanted = by_document(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
        texts, found, at, seen = [], [], 0, set()
        for o, t, body in zip(docs.column("o").to_pylist(), docs.column("t").to_pylist(), docs.column("body"), strict=True):
            want = wanted.get((o, t))
            if want is None or (o, t) in seen:  # a repeated row has the same contexts
                continue
            seen.add((o, t))
            data = np.frombuffer(open_.decompress(body.as_buffer()), np.uint8)
            a, b, h = owners(data, length, gram)
            nth = np.unique(want[0])
            a, b, h = a[nth], b[nth], h[nth]
            whole = span_hashes(data, a, b + length - 1)
            spread = np.isin(h, hot) if len(hot) else np.zeros(0, bool)
            if spread.any():
                single, digest = windows_of(data, a[spread], b[spread], length)
                a, b, h, whole = (np.concatenate([x[~spread], y]) for x, y in ((a, single), (b, single + 1), (h, digest), (whole, digest)))
            texts.append(data)
            found.append((h, whole, np.full(len(a), o), np.full(len(a), t), a, b, a + at))
            at += len(data)
        if not found:
            return table([])
        text = np.concatenate(texts)
        h, whole, o, t, a, b, place = (np.concatenate(x) for x in zip(*found, strict=True))
        del texts, found
        firsts, late = split_classes(h, whole, o, t, a, text, place, b - a + length - 1)
        out: list[tuple[int, bool, bytes]] = []
        goal = spot(o[late], t[late], buckets)
        order = np.argsort(goal, kind="stable")
        for x, y in cuts(goal[order]):
            ix = late[order[x:y]]
            out.append((int(goal[order[x]]), True, pack(o[ix], t[ix], a[ix], b[ix])))
        goal = (mix(h[firsts]) % U64(buckets)).astype(np.int32)
        order = np.argsort(goal, kind="stable")
        for x, y in cuts(goal[order]):
            ix = firsts[order[x:y]]
            size = b[ix] - a[ix] + length - 1
            out.append((int(goal[order[x]]), False, pack(h[ix], whole[ix], o[ix], t[ix], a[ix], size.astype(np.int32), gathered(text, place[ix], size))))
        return table(out)

    def decide(key, frame):
        import pandas as pd

        gone = [unpack(x) for x in frame[frame["late"]]["data"]]
        parts = [unpack(x) for x in frame[~frame["late"]]["data"]]
        if parts:
            h, whole, o, t, a, size, data = (np.concatenate([p[k] for p in parts]) for k in range(7))
            size = size.astype(np.int64)
            start = np.cumsum(size) - size
            firsts, late = split_classes(h, whole, o, t, a, data, start, size)
            gone.append([o[late], t[late], a[late], a[late] + size[late] - length + 1])
            # strings that share a minimiser with another string; firsts are in the order of minimisers
            many = np.append(False, h[firsts][1:] == h[firsts][:-1]) if len(firsts) else np.zeros(0, bool)
            many |= np.append(many[1:], False)
            firsts = firsts[many]
            run, bounds = np.cumsum(size[firsts]), cuts(h[firsts])
            i = 0
            while i < len(bounds):
                x, j = bounds[i][0], i
                while j + 1 < len(bounds) and run[bounds[j + 1][1] - 1] - run[x] + size[firsts[x]] <= COLLECTION:
                    j += 1
                part = firsts[x : bounds[j][1]]
                i = j + 1
                part = part[np.lexsort((a[part], t[part], o[part]))]
                sizes = size[part]
                later = repeated_windows(gathered(data, start[part], sizes), sizes, length)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], later, [False]]).astype(np.int8)))
                lo, hi = edge[::2], edge[1::2]
                base = np.cumsum(sizes) - sizes
                own = np.searchsorted(base, lo, "right") - 1
                shift = a[part][own] - base[own]
                gone.append([o[part][own], t[part][own], shift + lo, shift + hi])
        go, gt, ga, gb = (np.concatenate(x) for x in zip(*gone, strict=True))
        goal = spot(go, gt, groups)
        order = np.argsort(goal, kind="stable")
        out = [(int(goal[order[x]]), pack(*(v[order[x:y]] for v in (go, gt, ga, gb)))) for x, y in cuts(goal[order])]
        return pd.DataFrame({"g": pd.Series([x[0] for x in out], dtype="int32"), "data": pd.Series([x[1] for x in out], dtype="object")})

    shipped = texts.groupBy("g").cogroup(found.where("g >= 0").groupBy("g")).applyInArrow(contexts, "b int, late boolean, data binary")
    return shipped.repartition(buckets, "b").groupBy("b").applyInPandas(decide, "g int, data binary")


def split_classes(h: np.ndarray, whole: np.ndarray, o: np.ndarray, t: np.ndarray, a: np.ndarray, text: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of first occurrences of strings (in order of minimisers), and of later ones; repeats of one place are neither.

    Hashes only bring equal strings side by side: a later one is equal byte by byte to the one before it."""
    order = np.lexsort((a, t, o, whole, h))
    same = lambda v: v[order[1:]] == v[order[:-1]]
    equal = np.append(False, same(h) & same(whole) & same(size)) if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(equal)
    for i in range(0, len(at), 1 << 14):
        ix = at[i : i + (1 << 14)]
        mine, other = order[ix], order[ix - 1]
        differ = gathered(text, place[mine], size[mine]) != gathered(text, place[other], size[other])
        equal[ix] = ~np.add.reduceat(differ, np.cumsum(size[mine]) - size[mine], dtype=np.int64).astype(bool)
    twice = np.append(False, equal[1:] & same(o) & same(t) & same(a)) if len(order) else equal
    return order[~equal], order[equal & ~twice]


# ------------------------------------------------------------ 4. what is left


def covered(a: np.ndarray, b: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs from runs [a, b) of window starts."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order] + length - 1)
    new = np.append(True, a[1:] > b[:-1])
    return list(zip(a[new].tolist(), b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)].tolist(), strict=True))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start,end>>, kept binary, and a struct `carried` of the named columns) of every row."""
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    rows = _documents(docs.withColumn("__carried", carried), id_col, text_col, F.col("__carried").alias("carried"))
    n_bytes = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    groups = max(shuffle_parts(docs.sparkSession), math.ceil(n_bytes / GROUP))
    found = store(repeated(rows, length, gram, groups, max(hot, n_bytes >> HOT_SHIFT)))
    runs = store(removed_windows(rows, found, length, gram, groups))
    drop_stored(found)
    long, text = T.LongType(), T.BinaryType()

    def cut(key, docs, runs):
        import pyarrow as pa
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        parts = [unpack(x.as_py()) for x in runs.column("data")] if runs.num_rows else []
        gone_in = by_document(*(np.concatenate([p[k] for p in parts]) for k in range(4))) if parts else {}
        sizes, spans, kept = [], [], []
        for o, t, body in zip(docs.column("o").to_pylist(), docs.column("t").to_pylist(), docs.column("body"), strict=True):
            raw = open_.decompress(body.as_buffer())
            own = gone_in.get((o, t))
            gone = covered(*own, length) if own else []
            sizes.append(len(raw))
            spans.append([{"start": s, "end": e} for s, e in gone])
            if gone:
                ends, begins = [0, *(e for _, e in gone)], [*(s for s, _ in gone), len(raw)]
                raw = b"".join(raw[x:y] for x, y in zip(ends, begins, strict=True))
            kept.append(raw)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([docs.column("doc_id"), docs.column("carried"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "carried", "n_bytes", "spans", "kept"])

    span = T.ArrayType(T.StructType([T.StructField("start", long), T.StructField("end", long)]))
    out = T.StructType([T.StructField("doc_id", long), rows.schema["carried"], T.StructField("n_bytes", long), T.StructField("spans", span), T.StructField("kept", text)])
    return squeezed(rows, groups).groupBy("g").cogroup(runs.groupBy("g")).applyInArrow(cut, out)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with their columns and what is left of each text; characters cut in two go."""
    others = tuple(c for c in docs.columns if c != text_col)
    got = dedup_substrings(docs, id_col, text_col, carry=others, **options)

    def text(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            body = pa.array([x.as_py().decode("utf-8", "ignore") for x in batch.column("kept")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("carried"), body], ["carried", "body"])

    schema = T.StructType([got.schema["carried"], T.StructField("body", T.StringType())])
    rows = got.select("carried", "kept").mapInArrow(text, schema)
    return rows.select(*[F.col("body").alias(c) if c == text_col else F.col("carried")[c].alias(c) for c in docs.columns])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return got.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
