"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge can be kept from happening only by a merge of lower rank that takes its
right part first, and that one by a still lower one further right.  The longest
such chain in a merge list, in symbols, is a sufficient lookahead: once that many
symbols follow a token, later input can't change it.  The transducer, which encodes every word, keeps a
window of block + 2 lookaheads of symbols and emits the tokens that are stable (at the end of a word: all), so
memory is constant however long a word is.  A token border of the full encoding
splits it into the encodings of both sides, so restarting behind a border is exact.

Decoding turns tokens into bytes and pushes them through an incremental state
machine that holds back at most three bytes of an unfinished code point.

Words repeat, so each worker keeps the last words' finished output in a table of bounded
size.  Texts are read in slices cut at white space, and long words in blocks.  No shuffle: one pass over the table, in batches of bounded size.

Defined cases: null text is the empty text (0 tokens); null `doc_id` stays null;
repeated rows give repeated results; very long texts and words are encoded whole, slice by slice; an
empty table gives no rows; other columns are ignored and never clash.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.llm.common import bounded_batches

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CACHE_WORDS = 250_000
BLOCK = 1024  # symbols pushed at once
SLICE = 1 << 16  # characters of text looked at together
NONE = (1 << 30) - 1  # above all ranks


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeList:
    """Merges by rank, and the lookahead that suffices for them."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))
        self.step = {p: r for p, (r, _) in self.rank.items()}.get
        self.made = {r: new for r, new in self.rank.values()}
        self.lookahead = sufficient_lookahead(merges)

    def encode(self, symbols: list[int]) -> list[int]:
        """All merges: lowest rank first, leftmost first among equals."""
        return self._short(symbols) if len(symbols) <= 48 else self._long(symbols)

    def _short(self, parts: list[int]) -> list[int]:
        step, made, parts = self.step, self.made, list(parts)
        found = list(map(step, zip(parts, parts[1:], strict=False), repeat(NONE)))
        while found and (best := min(found)) != NONE:
            i = found.index(best)
            new = parts[i] = made[best]
            del parts[i + 1], found[i]
            if i:
                found[i - 1] = step((parts[i - 1], new), NONE)
            if i < len(found):
                found[i] = step((new, parts[i + 1]), NONE)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        n, rank, token = len(parts), self.rank, list(parts)
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        alive = [True] * n
        heap = [(f[0], i, f[1], a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (f := rank.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or token[i] != a or token[j] != b:
                continue
            token[i], alive[j], right[i] = new, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (f := rank.get((token[x], token[y]))):
                    heapq.heappush(heap, (f[0], x, f[1], token[x], token[y]))
        return [t for t, keep in zip(token, alive, strict=True) if keep]


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str = "</w>") -> int:
    """Upper bound, in symbols, on how far right of a token the input can decide about it."""
    width = lambda s: len(s.removesuffix(suffix)) or 1
    reach: dict[str, int] = {}  # by left part: furthest influence of the merges seen so far
    right_of: dict[str, str] = {}  # last part of a token's own merge
    most = 1
    for a, b in merges:
        chain, s = 0, b
        while s is not None:  # what may take the right end of b before this merge does
            chain = max(chain, reach.get(s, 0))
            s = right_of.get(s)
        far = width(b) + chain
        most = max(most, far)
        reach[a] = max(reach.get(a, 0), far)
        right_of.setdefault(a + b, b)
    return most + max((width(a + b) for a, b in merges), default=1)


class Transducer:
    """Push the symbols of one word in pieces; tokens come out as soon as they are stable."""

    def __init__(self, merges: MergeList, block: int = BLOCK):
        self.merges, self.block, self.pending, self.width = merges, block, [], 0

    def push(self, symbols: list[int], spans) -> list[int]:
        """Tokens that no later input can change."""
        out: list[int] = []
        self.pending += symbols
        while len(self.pending) >= self.block + 2 * self.merges.lookahead:
            window = self.pending[: self.block + 2 * self.merges.lookahead]
            at, stable = 0, len(window) - self.merges.lookahead
            for token in self.merges.encode(window):
                if at + spans[token] > stable:
                    break
                out.append(token)
                at += spans[token]
            self.pending = self.pending[at:]
        return out

    def finish(self) -> list[int]:
        """The word ends here, so all that is left is stable."""
        out, self.pending = self.merges.encode(self.pending), []
        return out


class ByteToText:
    """Incremental UTF-8: bytes in, text out; at most three bytes wait for the rest of a code point."""

    def __init__(self):
        self.held = b""

    def push(self, piece: bytes) -> str:
        data = self.held + piece
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                keep = back if need > back else 0
                break
            if lead < 0x80:
                break
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """A text in pieces of about `size` characters, cut before a blank or a line break, where no word and no composed character is cut."""
    at, n = 0, len(text)
    while at < n:
        end = min(at + size, n)
        if end < n:
            near = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
            end = near if near > at else min((p for p in (text.find(" ", end), text.find("\n", end)) if p >= 0), default=n)
        yield text[at:end]
        at = end


class WordBpe:
    """A tokenizer file with word ends (`</w>`): NFC, lower case, white space dropped."""

    #: fixed value: the word pattern of such files
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"]
        self.merges = MergeList(model["vocab"], pairs)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        self.packed_ids = {i: i.to_bytes(4, "little") for i in self.texts}
        self.bodies = {i: t.encode("utf-8") for i, t in self.texts.items()}
        self.find = regex.compile(self.PATTERN).findall
        blank = "".join(re.escape(c) for c in map(chr, range(128)) if regex.match(r"\s", c))
        self.find_ascii = re.compile(self.PATTERN.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", blank)).findall  # of normal text the same, in half the time
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").splititer
        self.machine = Transducer(self.merges)
        alphabet = byte_alphabet()
        self.inner = [model["vocab"][c] for c in alphabet]
        self.final = [model["vocab"][c + self.suffix] for c in alphabet]
        self.spans = {i: len(t.removesuffix(self.suffix)) or 1 for t, i in model["vocab"].items()}
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # each character on its own: no final sigma

    def word(self, word: str) -> Iterator[list[int]]:
        """A word's ids, as the transducer gives them."""
        machine, inner, n = self.machine, self.inner.__getitem__, len(word)
        for i in range(0, n, BLOCK):
            symbols = list(map(inner, word[i : i + BLOCK].encode("utf-8")))
            if i + BLOCK >= n:
                symbols[-1] = self.final[word[-1].encode("utf-8")[-1]]
            if out := machine.push(symbols, self.spans):
                yield out
        yield machine.finish()

    def output(self, ids: list[int]) -> tuple[bytes, bytes]:
        """Ids as 32-bit little-endian integers, and their tokens' texts as bytes."""
        return b"".join(map(self.packed_ids.__getitem__, ids)), b" ".join(map(self.bodies.__getitem__, ids))

    def packed(self, word: str) -> tuple[bytes, bytes]:
        """Output of a word of at most BLOCK characters, kept if short. Words that are met again outlast the others: half of the table is set aside when full, and given up when the next half is."""
        if (out := self.older.pop(word, None)) is None:
            out = self.output([*chain.from_iterable(self.word(word))])
        if len(word) <= 64:
            if len(self.cache) >= CACHE_WORDS // 2:
                self.older = dict(self.cache)
                self.cache.clear()
            self.cache[word] = out
        return out

    def pieces(self, text: str) -> Iterator[list[tuple[bytes, bytes]]]:
        """Output of a text, some words at a time."""
        get, packed = self.cache.get, self.packed
        for k, part in enumerate(self.cut(text)):
            if k % 2:
                yield [(self.special[part].to_bytes(4, "little"), part.encode("utf-8"))]
                continue
            for piece in slices(part):
                words = (self.find_ascii if piece.isascii() else self.find)(self.normal(piece))
                if len(piece) <= BLOCK or max(map(len, words), default=0) <= BLOCK:
                    yield [get(w) or packed(w) for w in words]
                else:
                    for w in words:
                        if len(w) <= BLOCK:
                            yield [get(w) or packed(w)]
                        else:
                            yield from ([self.output(ids)] for ids in self.word(w) if ids)

    def encode(self, text: str) -> list[int]:
        ids = b"".join(p[0] for piece in self.pieces(text) for p in piece)
        return [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]

    def decode(self, ids: list[int]) -> str:
        """Tokens' texts with blanks between them, as a file without decoder asks for."""
        machine = ByteToText()
        out = [machine.push(self.texts[i].encode("utf-8") if k == 0 else b" " + self.texts[i].encode("utf-8")) for k, i in enumerate(ids)]
        return "".join(out) + machine.finish()

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, and SHA-256 of ids and of the decoded text, piece by piece."""
        ids, decoded, n, machine, first = hashlib.sha256(), hashlib.sha256(), 0, ByteToText(), True
        for piece in self.pieces(text):
            if piece:
                a, b = zip(*piece, strict=True)
                a, b = b"".join(a), b" ".join(b)
                n += len(a) // 4
                ids.update(a)
                decoded.update(machine.push(b if first else b" " + b).encode("utf-8"))
                first = False
        decoded.update(machine.finish().encode("utf-8"))
        return n, ids.hexdigest(), decoded.hexdigest()


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))


def bpe_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text with the tokenizer file at `path` (on every executor)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = tokenizer(path)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                got = [model.digest(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x) for x in zip(*got, strict=True))], names)

    return _rows(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def bpe_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its token ids (array of int)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = tokenizer(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.encode(t.as_py()) for t in part.column(1)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
