"""Substring dedup by hashing lines, cut at sentence ends.

Passages that documents share seldom fill lines, so lines are cut further, at a
blank after a full stop, ! or ?. A unit's words are lower-cased (A-Z) and joined
by one blank; a 128-bit digest of them stands for the unit. A unit of fewer than
`context` words says little, so its digest also covers the words after it, up to
`context` in all, where the text has as many. Digests are grouped over all
documents; the occurrence of lowest rank, by document and offset, stays. Others
are repeats. Of these, runs of neighbouring units with `least_words` words or more
together are removed, with their offsets in code points of the original text: a
lone sentence that two documents happen to share is none of these.

A digest may hold a large share of all repeats, so units meet their first
occurrence by `join_singles`, which gathers no digest's units in one task.

Defined results: null and empty texts have no units; a very long text is scanned
alone, as a block; of equal ranks (ties: repeated rows, or texts of one id that
share a unit at one offset) none is a repeat of the other, and repeated rows are
one occurrence; texts of one id are judged one by one; rows without id are left
out; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import documents, free_name, join_singles, written

#: Words of neighbouring repeats that go. A shared passage of 50 words has about as many between the sentences that its ends cut.
LEAST_WORDS = 20
#: Words that a digest covers at least.
CONTEXT = 8

UNIT = "h1 long, h2 long, doc_id long, text_hash long, unit int, start long, end long, n_words long"
UNIT_NAMES = [c.split()[0] for c in UNIT.split(", ")]


def units(s: ts.Scan, sentences: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bounds, in words of the block, of the units of all documents."""
    n = len(s.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lines = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum(s.data == 10, out=lines[1:])
    new = np.ones(n, bool)
    new[1:] = (s.doc[1:] != s.doc[:-1]) | (lines[s.start[1:]] > lines[s.end[:-1]])
    if sentences:
        last, gap = s.data[s.end[:-1] - 1], s.data[np.minimum(s.end[:-1], len(s.data) - 1)]
        new[1:] |= ((last == 46) | (last == 33) | (last == 63)) & (gap == 32)
    start = np.flatnonzero(new)
    return start, np.append(start[1:], n)


def digests(s: ts.Scan, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of each unit's digest."""
    pow_, inv = ts.powers(len(s.hash) + 1)
    halves = []
    for values in (s.hash, ts.mix(s.hash ^ np.uint64(0x6A09E667F3BCC909))):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * pow_[: len(values)], out=total[1:])
        halves.append(ts.mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64)).view(np.int64))
    return halves[0], halves[1]


def text_units(docs: DataFrame, context: int = CONTEXT, sentences: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit of a document, with its digest and its number in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0))
            for i, _, data, offsets in ts.blocks(batch.column(1)):
                s = ts.scan(data, offsets, ts.SPACE)
                start, end = units(s, sentences)
                doc = s.doc[start]
                h1, h2 = digests(s, start, np.minimum(np.maximum(end, start + context), s.first[doc + 1]))
                chars = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                zero = chars[offsets[doc]]
                text_hash = ts.range_hash(s.prefix, offsets[:-1], offsets[1:]).view(np.int64)[doc]
                number = (np.arange(len(start)) - np.searchsorted(start, s.first[doc])).astype(np.int32)
                columns = [h1, h2, ids[i + doc], text_hash, number, chars[s.start[start]] - zero, chars[s.end[end - 1]] - zero, end - start]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=UNIT_NAMES)

    docs = docs.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(id_col).isNotNull())
    return docs.mapInArrow(run, UNIT)


def repeated_units(docs: DataFrame, least_words: int = LEAST_WORDS, context: int = CONTEXT, sentences: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end and n_words of every unit to remove, and where its first occurrence stands."""
    found = text_units(docs, context, sentences, id_col, text_col)
    place = F.struct("doc_id", "start")
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first != last")
    firsts = written(firsts.select("h1", "h2", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"), "n"), "firsts")
    again = join_singles(found, firsts, ["h1", "h2"], ["doc_id", "start"], whole=False).where("doc_id != first_doc_id or start != first_start")
    # One row per text holds all its repeats, so repeated rows meet before the exchange.
    texts = again.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("unit", "start", "end", "n_words", "first_doc_id", "first_start")).alias("u"))
    rows = texts.select("doc_id", "text_hash", F.explode("u").alias("u")).select("doc_id", "text_hash", "u.*")
    rows = rows.withColumn("run", F.col("unit") - F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("unit")))
    rows = rows.withColumn("words", F.sum("n_words").over(Window.partitionBy("doc_id", "text_hash", "run")))
    return rows.where(F.col("words") >= least_words).select("doc_id", "start", "end", "n_words", "first_doc_id", "first_start")


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, context: int = CONTEXT, sentences: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with the spans of repeats, and the text without them.

    `removed` is an array of (start, end) in the original text, `deduplicated` the
    text; underscores follow these names where `docs` has them already. Rows
    without id and null texts stay as they are; texts of one id lose the spans of
    all of them, cut at the text's end.
    """
    removed, out = free_name(docs, "removed"), free_name(docs, "deduplicated")
    key = free_name(docs, "_removed_from")
    spans = repeated_units(docs, least_words, context, sentences, id_col, text_col)
    mine = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(removed)).withColumnRenamed("doc_id", key)
    joined = docs.join(mine, docs[id_col] == mine[key], "left").drop(key)
    at, spans_at = joined.columns.index(text_col), len(joined.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True):
                if spans and text is not None:
                    bounds = [0, *(x for r in spans for x in (r["start"], r["end"])), len(text)]
                    text = "".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return joined.mapInArrow(run, joined.withColumn(out, F.lit(None).cast("string")).schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(documents(spark, sf_dir))


ORACLE = r"""
with texts as (
  select row_number() over () as r, doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from (select distinct doc_id, text from documents where text is not null and doc_id is not null)),
parts as (select r, doc_id, w, string_split(regexp_replace(replace(text, chr(10), chr(30) || chr(10)), '([.!?]) ', '\1' || chr(30) || ' ', 'g'), chr(30)) as p from texts),
pieces as (select r, doc_id, w, unnest(p) as u, generate_subscripts(p, 1) as i from parts),
placed as (
  select r, doc_id, w, u, i, len(regexp_extract_all(u, '[^\x20\x09-\x0D]+')) as n,
    coalesce(sum(length(u)) over k, 0) as pos, coalesce(sum(len(regexp_extract_all(u, '[^\x20\x09-\x0D]+'))) over k, 0) as before
  from pieces window k as (partition by r order by i rows between unbounded preceding and 1 preceding)),
units as (
  select r, doc_id, row_number() over (partition by r order by i) as unit, cast(n as bigint) as n_words,
    cast(pos + length(u) - length(ltrim(u, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as bigint) as start,
    cast(pos + length(rtrim(u, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as bigint) as "end",
    array_to_string(list_slice(w, cast(before + 1 as bigint), cast(before + greatest(n, 8) as bigint)), ' ') as said
  from placed where n > 0),
ranked as (
  select *, first_value(doc_id) over k as first_doc_id, first_value(start) over k as first_start
  from units window k as (partition by said order by doc_id, start)),
again as (
  select *, unit - row_number() over (partition by r order by unit) as run from ranked where doc_id <> first_doc_id or start <> first_start),
runs as (select *, sum(n_words) over (partition by r, run) as words from again)
select doc_id, start, "end", n_words, first_doc_id, first_start from runs where words >= 20
"""
