"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths are taken in numpy over all words of a
block of documents; equal hashes of one document mark duplicated n-grams, and the
code points of the words inside them are measured, as are those of repeated lines.
Longer n-grams are looked for only where the next shorter one is repeated, since a
repeated n-gram starts with a repeated shorter one.

No shuffle: one pass over the table, memory bounded by a block of about 1 MiB (or
one document, if longer).

Defined cases: null or empty text has no words and fails the base rule; null
`doc_id` is kept as null; repeated rows give repeated result rows; other columns
are ignored and never clash; a very long text is a block of its own; an empty table gives an empty result.
Lines and n-grams are compared by 64-bit hashes of mixes keyed by place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from engramma.llm.common import U64, blocks, bounded_batches, id_and_bytes, mix, per_doc_cumulative, span_hashes

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, dup5_chars long, dup8_chars long, dup10_chars long"
)


@dataclass(frozen=True)
class Rules:
    """Percent limits. `later` n-grams are those equal to an earlier one of the same document."""

    min_words: int = 20
    repeat_window: int = 8
    max_repeat_percent: int = 30
    max_dup_line_chars_percent: int = 30
    max_later_ngram_chars_percent: tuple[tuple[int, int], ...] = ((5, 25), (8, 20), (10, 15))


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


class Rolling:
    """Rolling hash over a block's word hashes: sums of word * base**place, from which any window of any length is one difference."""

    def __init__(self, words: np.ndarray):
        power, self.back = np.full(len(words) + 1, _BASE, U64), np.full(len(words) + 1, _INVERSE, U64)
        power[0] = self.back[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(self.back, out=self.back)
        self.run = np.zeros(len(words) + 1, U64)
        np.cumsum(words * power[:-1], out=self.run[1:])

    def windows(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n words from each position in `at` on."""
        return mix((self.run[at + n] - self.run[at]) * self.back[at])


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it found twice or more; is an equal one before it."""
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        later[order[1:][same]] = True
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
    return many, later


def _covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside any of the n-word windows that start at `at`."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(block, rules: Rules) -> dict[str, np.ndarray]:
    data, offsets, n_docs = block.data, block.offsets, block.n
    starts, ends, doc = block.words()
    lead = (data & 0xC0) != 0x80
    run = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=run[1:])
    chars = run[ends] - run[starts]
    count = lambda d, w=None: np.bincount(d, w, minlength=n_docs).astype(np.int64)
    out = {"n_words": count(doc), "word_chars": count(doc, chars), "n_symbols": per_doc_cumulative(_SYMBOL[data], offsets)}

    cut = np.flatnonzero(data == 10)
    line_start = np.union1d(offsets[:-1], cut + 1)
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data)) if len(line_start) else line_start
    has_break = np.zeros(len(line_start), np.int64)
    if len(line_start):
        has_break = ((data[line_end - 1] == 10) & (line_end > line_start)).astype(np.int64)
    line_end = line_end - has_break
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    word_at = np.searchsorted(starts, line_start)
    word_to = np.searchsorted(starts, line_end)
    full = word_to > word_at
    line_doc, word_at, word_to = line_doc[full], word_at[full], word_to[full]
    keys = mix(span_hashes(data, line_start[full], line_end[full]) + mix(line_doc.astype(U64) + U64(1)))
    _, later = _repeats(keys)
    chars_run = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=chars_run[1:])
    out["n_dup_lines"] = count(line_doc[later])
    out["dup_line_chars"] = count(line_doc[later], (chars_run[word_to] - chars_run[word_at])[later])

    words = span_hashes(data, starts, ends)
    salt = mix(doc.astype(U64) + U64(1))
    at = np.arange(len(words))
    rolling = Rolling(words)
    lengths = sorted({rules.repeat_window, *(n for n, _ in rules.max_later_ngram_chars_percent)})
    for n in lengths:
        at = at[at + n <= len(words)]
        at = at[doc[at] == doc[at + n - 1]]
        many, later = _repeats(mix(rolling.windows(at, n) + salt[at]))
        if n == rules.repeat_window:
            out["n_repeat_words"] = count(doc, _covered(at[many], n, len(words)))
        out[f"dup{n}_chars"] = count(doc, chars * _covered(at[later], n, len(words)))
        at = at[many]
    n_words, word_chars = out["n_words"], out["word_chars"]
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * n_words)
    bad = 100 * out["dup_line_chars"] > rules.max_dup_line_chars_percent * word_chars
    for n, most in rules.max_later_ngram_chars_percent:
        bad |= 100 * out[f"dup{n}_chars"] > most * word_chars
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def quality_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs` with its counts and verdict; see the module's text for odd inputs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for block in blocks(batch.column(1)):
                got = measure(block, rules)
                ids = batch.column(0).slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(got[c]) for c in names[1:])], names)

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that the rules keep."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            kept = [measure(block, rules)["kept"] for block in blocks(texts)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _later(n: int) -> str:
    return f"""
  s{n} as materialized (select doc_id, i, array_to_string(list_slice(ws, i, i + {n - 1}), ' ') g from w, unnest(range(1, len(ws) - {n - 2})) t(i) where len(ws) >= {n}),
  g{n} as (select doc_id, i, k, c from s{n} join (select doc_id, g, min(i) k, count(*) c from s{n} group by 1, 2 having count(*) > 1) using (doc_id, g)),
  p{n} as (select doc_id, sum(len(ws[p])) later_chars from w join
            (select distinct doc_id, i + d p from g{n}, unnest(range(0, {n})) u(d) where i > k) using (doc_id) group by 1)"""


SQL = f"""
with w as materialized (select doc_id, coalesce(text, '') txt, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws from documents),
  l as (select doc_id, i, s, row_number() over (partition by doc_id, s order by i) k from
         (select doc_id, unnest(string_split(txt, chr(10))) s, unnest(range(len(string_split(txt, chr(10))))) i from w)
        where regexp_matches(s, '[^\\x20\\x09-\\x0D]')),
  dl as (select doc_id, count(*) n_dup_lines, sum(len(regexp_replace(s, '[\\x20\\x09-\\x0D]', '', 'g'))) dup_line_chars from l where k > 1 group by 1),
  {_later(5)}, {_later(8)}, {_later(10)},
  r8 as (select doc_id, count(*) n_repeat_words from (select distinct doc_id, i + d p from g8, unnest(range(0, 8)) u(d) where c > 1) group by 1),
  m as (select doc_id, len(ws) n_words, coalesce(list_sum(list_transform(ws, lambda x: len(x))), 0) word_chars,
          len(regexp_replace(txt, '[^#*$%&|<>]', '', 'g')) n_symbols from w),
  j as (select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, coalesce(n_dup_lines, 0)::bigint n_dup_lines,
          coalesce(n_repeat_words, 0)::bigint n_repeat_words, coalesce(dup_line_chars, 0)::bigint dup_line_chars,
          coalesce(p5.later_chars, 0)::bigint dup5_chars, coalesce(p8.later_chars, 0)::bigint dup8_chars, coalesce(p10.later_chars, 0)::bigint dup10_chars
        from m left join dl using (doc_id) left join r8 using (doc_id) left join p5 using (doc_id) left join p8 using (doc_id) left join p10 using (doc_id))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 100 * dup_line_chars > 30 * word_chars or 100 * dup5_chars > 25 * word_chars
       or 100 * dup8_chars > 20 * word_chars or 100 * dup10_chars > 15 * word_chars) kept
from j
"""
