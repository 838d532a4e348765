"""Byte-level BPE by the tiktoken library with a local rank file, and decoding to raw bytes.

The library takes one string at a time and builds all its ids at once.  So a long text
is cut into slices at safe boundaries: places where a match of the pre-splitting pattern ends whatever
surrounds it, so that the ids of the slices, one after another, are those of the text.  These are the start of white space, and a change
between letters, digits and other characters, but for letters after an apostrophe (which may be a contraction).
A stretch without any (one match, however long) is a slice.  A long run of white space would exhaust the library's
matcher; it is one match up to its last character (at the end of a text: all of it), and its bytes are merged as such.

Decoding joins the tokens' bytes; they need not be UTF-8 token by token.  Digests are taken
slice by slice, so memory follows the slice, not the text.  No shuffle: one pass over the table, in batches of bounded size;
a lost executor's slices are encoded again elsewhere, with the same result.

Defined cases: null text is the empty text (0 tokens, digests of nothing); null `doc_id` stays null; repeated
rows give repeated results; bytes that are not UTF-8 count as U+FFFD; an empty table gives no rows;
other columns are ignored and never clash. `decode` gives null ids no bytes, and refuses ids that the file doesn't have.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.llm.common import bounded_batches, id_and_bytes

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SLICE = 1 << 16  # characters encoded at once
WHITE = 1 << 12  # runs of white space from about so many characters on are taken out


@functools.lru_cache(maxsize=1)
def _boundary():
    """Ends where a pre-splitting match ends in any text."""
    import regex

    return regex.compile(r"\S(?=\s)|\p{L}(?=[^\s\p{L}])|\p{N}(?=[^\s\p{N}])|[^\s\p{L}\p{N}'](?=[\p{L}\p{N}])")


@functools.lru_cache(maxsize=1)
def _white():
    import regex

    return regex.compile(rf"\p{{White_Space}}{{{WHITE},}}")


def _cuts(text: str, size: int) -> Iterator[str]:
    at, n = 0, len(text)
    while n - at > size:
        found = _boundary().search(text, at + size - 1)
        end = found.end() if found else n
        yield text[at:end]
        at = end
    if at < n:
        yield text[at:]


def slices(text: str, size: int = SLICE) -> Iterator[tuple[bool, str]]:
    """A text in pieces whose encodings add up to its own; True marks a piece that is a single match."""
    at, half = 0, WHITE // 2
    # a run of WHITE characters holds a whole block of half as many
    if any(text[i : i + half].isspace() for i in range(0, len(text) - half + 1, half)):
        for run in _white().finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            yield from ((False, piece) for piece in _cuts(text[at : run.start()], size))
            yield True, text[run.start() : end]
            at = end
    yield from ((False, piece) for piece in _cuts(text[at:] if at else text, size))


class RankBpe:
    """A rank file (base64 bytes and rank by line) with its pre-splitting pattern."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def pieces(self, text: str, size: int = SLICE) -> Iterator[np.ndarray]:
        """Ids of a text (unsigned 32-bit integers), slice by slice."""
        for whole, piece in slices(text, size):
            if whole:
                yield np.array(self.encoding._core_bpe.encode_single_piece(piece.encode("utf-8")), np.uint32)
            else:
                yield self.encoding.encode_to_numpy(piece, disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *self.pieces(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        try:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        except KeyError as unknown:
            raise ValueError(f"no token has the id {unknown}") from None

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of them and of their bytes."""
        n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for piece in self.pieces(text):
            n += len(piece)
            ids.update(piece.astype("<u4", copy=False).tobytes())
            decoded.update(self.decode(piece))
        return n, ids.hexdigest(), decoded.hexdigest()


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> RankBpe:
    return RankBpe(path, pattern)


def defaults() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _mapped(rows: DataFrame, path: str | None, pattern: str | None, schema: str, arrays) -> DataFrame:
    """Each batch of (id, value) as the id and what `arrays(model, values)` makes of the values, 256 rows at a time."""
    own_path, own_pattern = defaults() if path is None or pattern is None else (path, pattern)
    path, pattern = path or own_path, pattern or own_pattern
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = tokenizer(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays(model, part.column(1))], names)

    return rows.mapInArrow(run, schema)


def _texts(values) -> Iterator[str]:
    return (v.as_buffer().to_pybytes().decode("utf-8", "replace") for v in values)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, an array of integers."""

    def arrays(model: RankBpe, values):
        import pyarrow as pa

        got = [model.encode(t) for t in _texts(values)]
        ends = np.cumsum([0, *map(len, got)], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got).astype(np.int32)))]

    return _mapped(id_and_bytes(docs, id_col, text_col), path, pattern, "doc_id long, ids array<int>", arrays)


def decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and `decoded`, the bytes of its ids (binary: they are UTF-8 only where the ids are a whole text's)."""

    def arrays(model: RankBpe, values):
        import pyarrow as pa

        return [pa.array([model.decode(np.array(v.as_py() or [], np.int64)) for v in values], pa.binary())]

    rows = bounded_batches(tokens).select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return _mapped(rows, path, pattern, "doc_id long, decoded binary", arrays)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, decode its ids, and digest both; one row per row of `docs`."""

    def arrays(model: RankBpe, values):
        import pyarrow as pa

        return [pa.array(x) for x in zip(*map(model.digest, _texts(values)), strict=True)]

    return _mapped(id_and_bytes(docs, id_col, text_col), path, pattern, SCHEMA, arrays)


def op13_tiktoken_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
