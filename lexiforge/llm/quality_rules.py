"""Quality rules as a short-circuit cascade.

Each rule has a cost and a share of documents that it rejects. Every task measures
both on a sample, the first documents that it reads, on which it runs all rules;
from then on rules run in the order of rejections per cost, and a rule gets a block
of those documents alone that no earlier rule has rejected. So there is no second
scan, no shuffle and nothing to collect. The verdict is the conjunction of all
rules, so the order, which depends on timings, never changes it.

Defined results: a null or empty text has no words and fails the base rule; a very
long text is a block of its own; a rule's bounds are no rejection where they are
met exactly (ties); rows are judged one by one, so repeated rows and repeated ids
each give a row; other columns of the input are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import documents

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, base_failed boolean, kept boolean"
)
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True


class Block:
    """Texts with what rules ask for, made when first asked."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, scan: ts.Scan | None = None):
        self.data, self.offsets, self._scan = data, offsets, scan

    @property
    def s(self) -> ts.Scan:
        if self._scan is None:
            self._scan = ts.scan(self.data, self.offsets, ts.SPACE, lower=False)
        return self._scan

    @property
    def n_words(self) -> np.ndarray:
        return self.s.n_words

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def only(self, docs: np.ndarray) -> Block:
        """A block of some of the documents, with their words if they are known."""
        if len(docs) == len(self):
            return self
        first, last = self.offsets[:-1][docs], self.offsets[1:][docs]
        offsets = np.append(0, np.cumsum(last - first))
        data = np.concatenate([self.data[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)] or [self.data[:0]])
        if self._scan is None:
            return Block(data, offsets)
        s, number = self._scan, np.full(len(self), -1)
        number[docs] = np.arange(len(docs))
        mine = np.flatnonzero(number[s.doc] >= 0)
        doc = number[s.doc[mine]]
        shift = (offsets[:-1] - first)[doc]
        bounds = np.append(0, np.cumsum(s.n_words[docs]))
        return Block(data, offsets, ts.Scan(data, offsets, s.start[mine] + shift, s.end[mine] + shift, doc, s.hash[mine], bounds))

    def word_chars(self) -> np.ndarray:
        s = self.s
        chars = np.zeros(len(s.data) + 1, np.int64)
        np.cumsum((s.data & 0xC0) != 0x80, out=chars[1:])
        total = np.zeros(len(s.start) + 1, np.int64)
        np.cumsum(chars[s.end] - chars[s.start], out=total[1:])
        return np.diff(total[s.first])

    def symbols(self) -> np.ndarray:
        return ts.per_doc(_SYMBOL[self.data], self.offsets)

    def dup_lines(self) -> np.ndarray:
        s = self.s
        breaks = np.flatnonzero(s.data == 10)
        bounds = np.union1d(s.offsets, np.concatenate([breaks, breaks + 1]))
        start, end = bounds[:-1], bounds[1:]
        is_line = (end > start) & (np.searchsorted(s.start, end, "left") > np.searchsorted(s.start, start, "left"))
        start, end = start[is_line], end[is_line]
        doc = np.searchsorted(s.offsets, start, "right") - 1
        key = ts.mix(ts.range_hash(s.prefix, start, end) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, where = np.unique(key, return_index=True)
        return np.bincount(doc, minlength=s.n_docs) - np.bincount(doc[where], minlength=s.n_docs)

    def repeat_words(self) -> np.ndarray:
        s = self.s
        ok = ts.inside(s, WINDOW)
        key = ts.windows(s.hash, WINDOW)
        at = np.flatnonzero(ok)
        key = ts.mix(key[at] + s.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(len(s.hash), bool)
        hit = at[again]
        for j in range(WINDOW):
            covered[hit + j] = True
        return ts.per_doc(covered, s.first)


@dataclass(frozen=True)
class Rule:
    """`rejects(block)`: which of the block's documents fail."""

    name: str
    rejects: Callable[[Block], np.ndarray]


def _share(block: Block, top: np.ndarray, base: np.ndarray) -> np.ndarray:
    return ts.per_doc(top[block.data], block.offsets) / np.maximum(1, ts.per_doc(base[block.data], block.offsets))


def symbol_rule(most_per_word: float = 0.25) -> Rule:
    return Rule("symbols", lambda block: ts.per_doc(_SYMBOL[block.data], block.offsets) > most_per_word * block.n_words)


def capitals_rule(most: float = 0.5) -> Rule:
    """Capitals A-Z as a share of the bytes of letters."""
    return Rule("capitals", lambda block: _share(block, _UPPER, _LETTER) > most)


def letters_rule(least: float = 0.5) -> Rule:
    """Letters as a share of the bytes that are no white space."""
    return Rule("letters", lambda block: _share(block, _LETTER, ts.IS_SPACE_WORD) < least)


def stutter_rule(most: float = 0.2) -> Rule:
    """Words that equal the word before them."""

    def rejects(block: Block) -> np.ndarray:
        s = block.s
        again = np.zeros(len(s.hash), bool)
        again[1:] = (s.hash[1:] == s.hash[:-1]) & (s.doc[1:] == s.doc[:-1])
        return ts.per_doc(again, s.first) > most * block.n_words

    return Rule("stutter", rejects)


def word_length_rule(least: float = 2.0, most: float = 25.0) -> Rule:
    def rejects(block: Block) -> np.ndarray:
        mean = block.word_chars() / np.maximum(1, block.n_words)
        return (mean < least) | (mean > most)

    return Rule("word_length", rejects)


def base_rule() -> Rule:
    """Too few words, or too many of them in repeated windows."""
    return Rule("base", lambda block: (block.n_words < MIN_WORDS) | (100 * block.repeat_words() > MAX_REPEAT_PERCENT * block.n_words))


DEFAULT_RULES = (symbol_rule(), capitals_rule(), letters_rule(), stutter_rule(), word_length_rule())
#: Documents of a task on which it measures its rules, at least.
SAMPLE_ROWS = 256


class Cascade:
    """Rules that are measured on the first documents and then run in order."""

    def __init__(self, rules: list[Rule], sample_rows: int = SAMPLE_ROWS):
        self.rules, self.sample_rows, self.rows = list(rules), sample_rows, 0
        self.cost, self.rejected = dict.fromkeys((r.name for r in rules), 0.0), dict.fromkeys((r.name for r in rules), 0)

    def _measured(self, block: Block, alive: np.ndarray) -> np.ndarray:
        docs = np.flatnonzero(alive)
        mine, failed = block.only(docs), np.zeros(len(docs), bool)
        for rule in self.rules:
            # What a rule needs is its cost, so each begins anew with what is known of the block.
            fresh = Block(mine.data, mine.offsets, mine._scan)
            began = time.perf_counter()
            bad = rule.rejects(fresh)
            self.cost[rule.name] += time.perf_counter() - began
            self.rejected[rule.name] += int(bad.sum())
            failed |= bad
        self.rows += len(docs)
        if self.rows >= self.sample_rows:
            self.rules = ordered(self.rules, {r.name: (self.cost[r.name] / self.rows, self.rejected[r.name] / self.rows) for r in self.rules})
        kept = np.zeros(len(alive), bool)
        kept[docs[~failed]] = True
        return kept

    def keeps(self, block: Block, alive: np.ndarray) -> np.ndarray:
        """Which documents all rules accept; `alive` are those to look at."""
        if self.rows < self.sample_rows:
            return self._measured(block, alive)
        return cascade(block, self.rules, alive)


def cascade(block: Block, rules: list[Rule], alive: np.ndarray) -> np.ndarray:
    """Which documents all rules accept; each rule gets those left by the ones before."""
    kept, docs = np.zeros(len(alive), bool), np.flatnonzero(alive)
    block = block.only(docs)
    for rule in rules:
        if not len(docs):
            return kept
        good = np.flatnonzero(~rule.rejects(block))
        block, docs = block.only(good), docs[good]
    kept[docs] = True
    return kept


def ordered(rules: list[Rule], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """Most rejections per cost first; rules that weren't measured come last."""

    def gain(rule: Rule) -> float:
        cost, share = measured.get(rule.name, (0.0, 0.0))
        return share / cost if cost > 0 else -1.0

    return sorted(rules, key=lambda r: (-gain(r), measured.get(r.name, (0.0, 0.0))[0], r.name))


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base statistics and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Cascade(list(rules))
        for batch in batches:
            for i, j, data, offsets in ts.blocks(batch.column(1)):
                block = Block(data, offsets)
                repeated = block.repeat_words()
                failed = (block.n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * block.n_words)
                columns = [
                    batch.column(0).slice(i, j - i).cast(pa.int64()), block.n_words, block.word_chars(), block.symbols(), block.dup_lines(), repeated, failed, judge.keeps(block, ~failed),
                ]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=NAMES)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(",")]


def keep_quality(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, text_col: str = "text") -> DataFrame:
    """The documents that the base rule and all other rules accept, unchanged.

    Null and empty texts go, as they have no words; repeated rows stay or go
    together; columns of any name and null ids are carried along.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Cascade([base_rule(), *rules])
        for batch in batches:
            for i, j, data, offsets in ts.blocks(batch.column(at)):
                kept = judge.keeps(Block(data, offsets), np.ones(j - i, bool))
                yield batch.slice(i, j - i).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir))


#: DuckDB SQL of `op3_quality_rules`, with the defaults of all rules.
ORACLE = r"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
listed as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, string_split(t, chr(10)) as lines from docs),
words as (select r, unnest(w) as said, generate_subscripts(w, 1) as i from listed),
grams as (
  select r, i, said, lead(said, 1) over k as b, lead(said, 2) over k as c, lead(said, 3) over k as d, lead(said, 4) over k as e, lag(said) over k as before
  from words window k as (partition by r order by i)),
again as (select r, i from (select r, i, e, count(*) over (partition by r, said, b, c, d, e) as n from grams) where e is not null and n > 1),
covered as (select r, count(distinct i + j) as n_repeat from again cross join range(0, 5) as x(j) group by r),
stutters as (select r, count(*) as n_stutter from grams where said = before group by r),
line_rows as (select r, unnest(lines) as line from listed),
dups as (select r, count(*) - count(distinct line) as n_dup from line_rows where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
stats as (
  select r, doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    strlen(t) - strlen(regexp_replace(t, '[A-Z]', '', 'g')) as capitals,
    strlen(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) as letters,
    strlen(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as inked
  from listed),
joined as (
  select *, coalesce(n_dup, 0) as dup, coalesce(n_repeat, 0) as rep, coalesce(n_stutter, 0) as stut
  from stats left join dups using (r) left join covered using (r) left join stutters using (r)),
judged as (select *, n_words < 10 or 100 * rep > 20 * n_words as failed from joined)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(dup as bigint) as n_dup_lines, cast(rep as bigint) as n_repeat_words, failed as base_failed,
  not failed and not (n_symbols > 0.25::double * n_words) and not (capitals / greatest(letters, 1)::double > 0.5::double)
    and not (letters / greatest(inked, 1)::double < 0.5::double) and not (stut > 0.2::double * n_words)
    and not (word_chars / greatest(n_words, 1)::double < 2 or word_chars / greatest(n_words, 1)::double > 25) as kept
from judged
"""
