"""Glossary terms: marking, applying and restoring them.

A short glossary is a fold of native expressions over its terms, longest first;
each step takes the last match's casing from the text as it is at that step. Each
step's state is bound once, so the work stays linear in the number of terms. A
long glossary goes through an Arrow function, with the same results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import NATIVE_TERMS
from ..functions import plain
from ..functions import text as tx

Entries = plain.Entries
MARKS = "array<struct<ph:string,lit:string>>"


def mark(df: DataFrame, entries: Entries, label: str, column: str, into: str) -> DataFrame:
    """Adds `<into>` (text with placeholders), `<into>_map` and `<into>_n`.

    The map is in the order of the terms and holds those that occur.
    """
    if not entries:
        return df.withColumns({into: F.col(column), f"{into}_map": F.array().cast(MARKS), f"{into}_n": F.lit(0)})
    if len(entries) > NATIVE_TERMS:
        return _mark_by_arrow(df, entries, label, column, into)
    state = _marked(F.col(column), entries, label)
    return df.withColumn("_state", state).withColumns({into: F.col("_state.text"), f"{into}_map": F.col("_state.marks"), f"{into}_n": F.col("_state.n")}).drop("_state")


def _marked(text: Column, entries: Entries, label: str) -> Column:
    """text, marks and n after all terms."""
    targets = dict(entries)
    none = F.struct(text.alias("text"), F.array().cast(MARKS).alias("marks"), F.lit(0).alias("n"))
    state = none
    for k, term in enumerate(plain.by_length(targets)):
        state = tx.let(state, _step(tx.term_pattern(term), label % k, targets[term]))
    # Most texts hold no term: one alternation tells, before the fold.
    return F.when(F.rlike(text, F.lit(tx.any_pattern(list(targets)))), state).when(text.isNotNull(), none)


def _step(pattern: str, name: str, target: str) -> Callable[[Column], Column]:
    def one(s: Column, found: Column) -> Column:
        pair = F.struct(F.lit(name).alias("ph"), tx.cased_like(F.element_at(found, -1), target).alias("lit"))
        hit = F.struct(F.regexp_replace(s["text"], pattern, tx.java_replacement(name)).alias("text"), F.concat(s["marks"], F.array(pair)).alias("marks"), (s["n"] + F.size(found)).alias("n"))
        return F.when(F.size(found) > 0, hit).otherwise(F.struct(s["text"].alias("text"), s["marks"].alias("marks"), s["n"].alias("n")))

    return lambda s: tx.let(F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0)), lambda found: one(s, found))


def _times(c: Column, needle: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def _mark_by_arrow(df: DataFrame, entries: Entries, label: str, column: str, into: str) -> DataFrame:
    at = df.columns.index(column)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType()), T.StructField(f"{into}_map", T._parse_datatype_string(MARKS)), T.StructField(f"{into}_n", T.IntegerType())])
    kind = pa.list_(pa.struct([("ph", pa.string()), ("lit", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, None, None) if t is None else plain.mark_terms(t, entries, label) for t in batch.column(at).to_pylist()]
            more = [pa.array([d[0] for d in done], pa.string()), pa.array([None if d[1] is None else [{"ph": p, "lit": t} for p, t in d[1]] for d in done], kind), pa.array([d[2] for d in done], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, into, f"{into}_map", f"{into}_n"])

    return df.mapInArrow(run, schema)


def swap(text: Column, marks: Column) -> Column:
    """Placeholders of a map replaced by their literals, one after the other."""
    return F.aggregate(marks, text, lambda t, p: F.replace(t, p["ph"], p["lit"]))


def apply(df: DataFrame, entries: Entries, column: str = "text", into: str = "applied") -> DataFrame:
    """Adds the text with all terms replaced, and `<into>_n`, the replacements."""
    if not entries:
        return df.withColumns({into: F.col(column), f"{into}_n": F.lit(0)})
    if len(entries) > NATIVE_TERMS:
        marked = mark(df, entries, plain.REPLACED, column, "_applied")
        return marked.withColumns({into: swap(F.col("_applied"), F.col("_applied_map")), f"{into}_n": F.col("_applied_n")}).drop("_applied", "_applied_map", "_applied_n")
    done = tx.let(_marked(F.col(column), entries, plain.REPLACED), lambda s: F.struct(swap(s["text"], s["marks"]).alias("text"), s["n"].alias("n")))
    return df.withColumn("_done", done).withColumns({into: F.col("_done.text"), f"{into}_n": F.col("_done.n")}).drop("_done")


def protect(df: DataFrame, entries: Entries, column: str = "text", into: str = "protected") -> DataFrame:
    """Adds the text with terms as placeholders, the map and the number of matches."""
    return mark(df, entries, plain.TERM, column, into)


def restore(df: DataFrame, entries: Entries, column: str, marks: str, into: str = "restored") -> DataFrame:
    """Adds the text with placeholders, also changed ones, as the map's literals.

    Literals are taken as they are: a backslash or a dollar sign has no meaning.
    """
    if len(entries) > NATIVE_TERMS:
        return _restore_by_arrow(df, column, marks, into)
    state = none = F.struct(F.col(column).alias("text"), F.lit(0).alias("n"))
    for k in range(len(entries)):
        state = tx.let(state, _back(plain.TERM % k, F.col(marks)))
    state = F.when(F.size(marks) > 0, state).otherwise(none)
    return df.withColumn("_back", state).withColumns({into: F.col("_back.text"), f"{into}_n": F.col("_back.n")}).drop("_back")


def finish(df: DataFrame, entries: Entries, column: str, marks: str, into: str = "final") -> DataFrame:
    """Adds a draft's final text (terms restored and applied once more, spacing normalised) and `<into>_n`.

    A null draft has a null text and no replacements.
    """
    back = restore(df, entries, column, marks, "_finish_back")
    done = apply(back, entries, "_finish_back", "_finish")
    n = F.coalesce("_finish_back_n", F.lit(0)) + F.coalesce("_finish_n", F.lit(0))
    return done.withColumns({into: tx.normalize_spacing(F.col("_finish")), f"{into}_n": n}).drop("_finish_back", "_finish_back_n", "_finish", "_finish_n")


def _back(name: str, marks: Column) -> Callable[[Column], Column]:
    pattern = tx.variant_pattern(name)
    literal = F.try_element_at(F.transform(F.filter(marks, lambda p: p["ph"] == name), lambda p: p["lit"]), F.lit(1))

    def one(s: Column, literal: Column) -> Column:
        exact = F.replace(s["text"], F.lit(name), literal)
        guarded = F.regexp_replace(literal, r"([\\$])", r"\\$1")
        changed = tx.let(F.struct(exact.alias("t"), F.regexp_count(exact, F.lit(pattern)).alias("n")), lambda e: F.struct(F.when(e["n"] > 0, F.regexp_replace(e["t"], F.lit(pattern), guarded)).otherwise(e["t"]).alias("text"), (s["n"] + _times(s["text"], name) + e["n"]).alias("n")))
        return F.when(literal.isNull(), F.struct(s["text"].alias("text"), s["n"].alias("n"))).otherwise(changed)

    return lambda s: tx.let(literal, lambda x: one(s, x))


def _restore_by_arrow(df: DataFrame, column: str, marks: str, into: str) -> DataFrame:
    at, pairs_at = df.columns.index(column), df.columns.index(marks)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType()), T.StructField(f"{into}_n", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(at).to_pylist(), batch.column(pairs_at).to_pylist(), strict=True)
            done = [(None, None) if t is None else plain.restore_terms(t, [(p["ph"], p["lit"]) for p in pairs or []]) for t, pairs in rows]
            more = [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, into, f"{into}_n"])

    return df.mapInArrow(run, schema)


def hits(segments: DataFrame, glossary: DataFrame, column: str = "text") -> DataFrame:
    """Segments in which each target occurs; `glossary` has columns source, target.

    The terms are few and stay on the driver: each is a literal test in one scan.
    """
    rows = glossary.select("source", "target").distinct().collect()
    flags = [F.struct(F.lit(r.source).alias("source"), F.lit(r.target).alias("target"), F.contains(F.col(column), F.lit(r.target)).alias("hit")) for r in rows if r.target]
    return segments.select(F.explode(F.array(*flags)).alias("g")).groupBy("g.source", "g.target").agg(F.sum(F.col("g.hit").cast("long")).alias("n_segments"))
