"""Benchmark decontamination by winnowing.

Of every window of W neighbouring K-grams the smallest hash is kept, in training
and test texts alike. Two texts that share a span of K + W - 1 words share all
K-grams of one such window and so its smallest hash: with K = 5 and W = 6 no
shared span of 10 words is missed. Fingerprints that both sides have are then
extended: each window of 10 words around them is compared.

A benchmark of at most `block_bytes` is broadcast as sorted arrays; documents are
read once and nothing is shuffled. A larger one is a table of fingerprints and one
of windows. Documents are still scanned once: bitmaps of fixed size over both let
through few other fingerprints and windows, and what passes is joined exactly.
Both ways give the same rows.

Defined results: null or empty documents have no words and aren't contaminated;
items without words or id match nothing; an item with fewer words than a window
is one window of its own length; items with the same id count as one, and items
that share a window (ties) are all met; a very long text is a block of its own;
rows are judged one by one, so repeated rows each give a row; other columns of
the input are ignored; empty tables give an empty or a clean result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import documents, free_name, written

WINDOW, GRAM = 10, 5
#: Bytes of benchmark text that are broadcast; more go through joins.
BLOCK_BYTES = 8 << 20
#: Bits of the maps of a large benchmark's fingerprints and windows.
MAP_BITS = 1 << 25


def winnow(scan: ts.Scan, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the K-grams that winnowing selects, ties included."""
    grams = ts.windows(scan.hash, gram)
    whole = ts.inside(scan, window)
    width = window - gram + 1
    m = len(whole)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = grams[:m].copy()
    for j in range(1, width):
        np.minimum(least, grams[j : j + m], out=least)
    chosen = np.zeros(len(grams), bool)
    for j in range(width):
        chosen[j : j + m] |= whole & (grams[j : j + m] == least)
    at = np.flatnonzero(chosen)
    return at, grams[at]


@dataclass
class Index:
    """Sorted arrays of a block of items."""

    fingerprints: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length -> hashes, bounds, items
    names: list[str]


def _postings(hashes: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((items, hashes))
    hashes, items = hashes[order], items[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1])
    hashes, items = hashes[new], items[new]
    keys, first = np.unique(hashes, return_index=True)
    return keys, np.append(first, len(hashes)), items


def _item_windows(s: ts.Scan, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, document, hash) of the items' windows: of the whole of short items."""
    words = s.n_words
    for n in sorted({window, *np.unique(words[(words > 0) & (words < window)]).tolist()}):
        at = np.flatnonzero(ts.inside(s, n))
        if n < window:
            at = at[words[s.doc[at]] == n]
        yield n, s.doc[at], ts.windows(s.hash, n)[at]


def build_index(items: list[tuple[str, str]], window: int = WINDOW, gram: int = GRAM) -> Index:
    names = sorted({i for i, _ in items})
    number = {name: k for k, name in enumerate(names)}
    fingerprints, found = [], {}
    ids = np.array([number[i] for i, _ in items], np.int64)
    for i, _, data, offsets in ts.blocks(pa.array([t for _, t in items], pa.large_string())):
        s = ts.scan(data, offsets, ts.ALNUM)
        fingerprints.append(winnow(s, window, gram)[1])
        for n, doc, hashes in _item_windows(s, window):
            found.setdefault(n, []).append((hashes, ids[i + doc]))
    return Index(
        np.unique(np.concatenate([*fingerprints, np.zeros(0, np.uint64)])),
        {n: _postings(*(np.concatenate(x) for x in zip(*parts, strict=True))) for n, parts in found.items() if sum(len(h) for h, _ in parts)},
        names,
    )


def _where(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index into sorted keys, or -1."""
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at, -1)


def _starts(scan: ts.Scan, chosen: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Starts of the windows that hold a chosen K-gram, in one document."""
    whole = ts.inside(scan, window)
    at = np.unique((chosen[:, None] - np.arange(window - gram + 1)[None, :]).ravel())
    at = at[(at >= 0) & (at < len(whole))]
    return at[whole[at]]


def find(scan: ts.Scan, index: Index, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, list[set[int]]]:
    """Hit flag of every word, and the items that each document meets."""
    hit = np.zeros(len(scan.hash), bool)
    met: list[set[int]] = [set() for _ in range(scan.n_docs)]
    for n, (keys, bounds, items) in index.windows.items():
        if n == window:
            at, prints = winnow(scan, window, gram)
            at = _starts(scan, at[_where(index.fingerprints, prints) >= 0] if len(index.fingerprints) else at[:0], window, gram)
        else:
            at = np.flatnonzero(ts.inside(scan, n))
        if not len(at):
            continue
        key = _where(keys, ts.windows(scan.hash, n)[at])
        at, key = at[key >= 0], key[key >= 0]
        for j in range(n):
            hit[at + j] = True
        pairs = np.unique(np.stack([scan.doc[at], key], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        for d, k in pairs.tolist():
            met[d].update(items[bounds[k] : bounds[k + 1]].tolist())
    return hit, met


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(i, t) of the items with id and text, and the bytes of their texts."""
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    return items, items.agg(F.sum(F.octet_length("t"))).first()[0] or 0


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """A map of fixed size of the hashes in column `w`."""
    bit = F.pmod(F.col("w"), F.lit(MAP_BITS))
    words = hashes.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(w, {MAP_BITS}) % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[np.array(words.column("at"), dtype=np.int64)] = np.array(words.column("bits"))
    return out


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes.view(np.int64) % (64 * len(bitmap))
    return (bitmap[bit >> 6] >> (bit & 63) & 1).astype(bool)


@dataclass
class Joined:
    """What a large benchmark and the documents have in common.

    A row of a document is known by two hashes of its id and text, so equal rows
    are one. `scanned` has each row's words and candidates, `found` (k1, k2, pos,
    n, w) the windows that are items' too.
    """

    scanned: DataFrame
    found: DataFrame
    windows: DataFrame


KEYS = ("k1", "k2")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two hashes of a row's id and text, never null."""
    i, t = F.col(id_col).cast("long"), F.col(text_col)
    return F.xxhash64(i, t), F.xxhash64(t, i, F.lit(1))


def join_fingerprints(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> Joined:
    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in ts.blocks(batch.column(1)):
                prints = np.unique(winnow(ts.scan(data, offsets, ts.ALNUM), window, gram)[1])
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64))], names=["w"])

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in ts.blocks(batch.column(1)):
                names = batch.column(0).slice(i, j - i)
                for n, doc, hashes in _item_windows(ts.scan(data, offsets, ts.ALNUM), window):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(doc)), pa.array(np.full(len(doc), n, np.int32)), pa.array(hashes.view(np.int64))], names=["item", "n", "w"])

    spark = docs.sparkSession
    windows = written(items.mapInArrow(windowed, "item string, n int, w long").distinct(), "windows")
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # at most a window's words
    shipped = spark.sparkContext.broadcast((_bitmap(items.mapInArrow(printed, "w long")), _bitmap(windows)))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints_map, windows_map = shipped.value
        for batch in batches:
            for i, j, data, offsets in ts.blocks(batch.column(1)):
                s, parts = ts.scan(data, offsets, ts.ALNUM), []
                for n in lengths:
                    if n == window:
                        at, prints = winnow(s, window, gram)
                        at = _starts(s, at[_marked(prints_map, prints)], window, gram)
                    else:
                        at = np.flatnonzero(ts.inside(s, n))
                    hashes = ts.windows(s.hash, n)[at] if len(at) else np.zeros(0, np.uint64)
                    ok = _marked(windows_map, hashes)
                    parts.append((at[ok], np.full(int(ok.sum()), n, np.int32), hashes[ok].view(np.int64)))
                at, n, w = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
                order = np.argsort(at, kind="stable")
                doc = s.doc[at[order]]
                cands = pa.StructArray.from_arrays([pa.array(at[order] - s.first[doc]), pa.array(n[order]), pa.array(w[order])], names=["pos", "n", "w"])
                bounds = pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32))
                columns = [*(batch.column(c).slice(i, j - i) for c in (0, 2, 3)), pa.array(s.n_words), pa.ListArray.from_arrays(bounds, cands)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *KEYS, "n_words", "cands"])

    k1, k2 = keyed(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), k1.alias("k1"), k2.alias("k2"))
    table = written(rows.mapInArrow(scanned, "doc_id long, k1 long, k2 long, n_words long, cands array<struct<pos:long,n:int,w:long>>"), "scanned")
    cands = table.select(*KEYS, F.explode("cands").alias("c")).select(*KEYS, "c.*").distinct()
    found = written(cands.join(windows.select("n", "w").distinct(), ["n", "w"], "left_semi"), "found")
    return Joined(table, found, windows)


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"]


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: words, hit words and the items met."""
    items, total = _items(benchmark, item_col, text_col)
    if total > block_bytes:
        return _contamination_joined(join_fingerprints(docs, items, id_col, text_col, window, gram))
    shipped = docs.sparkSession.sparkContext.broadcast(build_index([(r.i, r.t) for r in items.collect()], window, gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for batch in batches:
            for i, j, data, offsets in ts.blocks(batch.column(1)):
                s = ts.scan(data, offsets, ts.ALNUM)
                hit, met = find(s, index, window, gram)
                names = [sorted(index.names[x] for x in m) for m in met]
                hits = ts.per_doc(hit, s.first)
                columns = [
                    batch.column(0).slice(i, j - i), pa.array(s.n_words), pa.array(hits), pa.array([len(x) for x in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]), pa.array(hits > 0), pa.array(names, pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)


def _contamination_joined(joined: Joined) -> DataFrame:
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("pos", "n")), lambda x: F.sequence(x["pos"], x["pos"] + x["n"] - 1))))
    hits = joined.found.groupBy(*KEYS).agg(F.size(covered).cast("long").alias("n_hit"))
    met = joined.found.select(*KEYS, "n", "w").distinct().join(joined.windows, ["n", "w"]).select(*KEYS, "item").distinct()
    items = met.groupBy(*KEYS).agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = joined.scanned.drop("cands").join(hits, list(KEYS), "left").join(items, list(KEYS), "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any window of the benchmark, unchanged.

    Null and empty texts stay, repeated rows stay or go together, columns of any
    name and null ids are carried along, an empty benchmark leaves all.
    """
    items, total = _items(benchmark, item_col, text_col)
    if total > block_bytes:
        names = [free_name(docs, f"_{k}") for k in KEYS]
        gone = written(join_fingerprints(docs, items, id_col, text_col, window, gram).found.select(*(F.col(k).alias(n) for k, n in zip(KEYS, names, strict=True))).distinct(), "gone")
        return docs.withColumns(dict(zip(names, keyed(docs, id_col, text_col), strict=True))).join(gone, names, "left_anti").select(*docs.columns)
    at, shipped = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(build_index([(r.i, r.t) for r in items.collect()], window, gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in ts.blocks(batch.column(at)):
                s = ts.scan(data, offsets, ts.ALNUM)
                hit, _ = find(s, shipped.value, window, gram)
                yield batch.slice(i, j - i).filter(pa.array(ts.per_doc(hit, s.first) == 0))

    return docs.mapInArrow(run, docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
sized as (select item, w, least(10, len(w)) as n from (select distinct cast(item_id as varchar) as item, {_WORDS} as w from benchmark where item_id is not null) where len(w) > 0),
item_windows as (select distinct item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as said from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from sized)),
doc_windows as (
  select r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as said
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d cross join (select distinct n from sized) where len(w) >= n)),
met as (select r, i, n, item from doc_windows join item_windows using (n, said)),
hits as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from (select distinct r, i, n from met)) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as said from (select distinct r, item from met) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(said, '')) as items_sha256, n_hit is not null as contaminated
from d left join hits using (r) left join items using (r)
"""
