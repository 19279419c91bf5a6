"""MinHash near-dedup.

A document is the set of its word shingles, each a 64-bit fingerprint. Documents
with equal sets are one class, of which the least id stands for all. Of each
class 192 universal hash minima are taken: the first 96 make 24 bands of 4 rows,
all of them, 8 bits each, verify candidates. At a similarity of 0.85, bands miss
a pair with probability 2e-8, at 0.8 with 3e-6; the signature bound lies 5
standard deviations below the threshold. Every link is confirmed on full sets.

A bucket's classes aren't paired with each other. In a round all of them meet
one leader, which is linear; buckets that lie in one component are then done. In
what is left only classes of different components meet, in tiles of bounded size
that compare signatures as matrices, each pair in the first bucket that it shares.
Classes with a near partner there get their sets and are compared in the same
tiles, so no pairs are written, only links. Links go to connected components.

Defined results: documents without words have an empty set, are in a component of
their own and are kept; a very long text is a block of its own; a similarity of
exactly the threshold (a tie) is a link; rows without id are never linked and are
kept; rows with one id count as one document, and ids are taken to be unique
otherwise: of different texts with one id, one stands for all of them; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .components import connected_components
from .shared import documents, free_name, join_singles, released, scratch, written

SHINGLE, PERCENT = 3, 85
BANDS, ROWS, HASHES = 24, 4, 192
#: Classes on a side of a tile, bytes of their sets there, and pairs of a leader that go to one salt.
TILE, TILE_BYTES, SALT = 320, 16 << 20, 1000
SIGMAS = 5.0
#: Bits of the map that keeps texts nobody asks for out of the exchange.
MAP_BITS = 1 << 23

_RNG = np.random.default_rng(20_240_601)
_A = _RNG.integers(0, 2**64, HASHES, np.uint64, endpoint=False) | np.uint64(1)
_B = _RNG.integers(0, 2**64, HASHES, np.uint64, endpoint=False)


def shingles(s: ts.Scan, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all shingles in order, and each document's bounds."""
    words = s.n_words
    count = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(bounds[-1], np.uint64)
    at = np.flatnonzero(ts.inside(s, n))
    out[bounds[s.doc[at]] + at - s.first[s.doc[at]]] = ts.windows(s.hash, n)[at]
    for k in range(1, n):
        short = np.flatnonzero(words == k)
        out[bounds[short]] = ts.windows(s.hash, k)[s.first[short]] if len(short) else 0
    return out, bounds


def signatures(prints: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minima of all hash functions (columns) of each document with shingles."""
    some = np.flatnonzero(np.diff(bounds) > 0)
    out = np.full((len(bounds) - 1, HASHES), np.uint32(0xFFFFFFFF), np.uint32)
    if not len(some):
        return out
    x = (prints >> np.uint64(32)) ^ (prints & np.uint64(0xFFFFFFFF))
    starts = bounds[some]
    for k in range(HASHES):  # multiply-shift, strongly universal on 32-bit keys
        h = x * _A[k]
        h += _B[k]
        h >>= np.uint64(32)
        out[some, k] = np.minimum.reduceat(h, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band."""
    rows = signature[:, : BANDS * ROWS].astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = ts.mix(key + rows[:, :, r])
    return key.view(np.int64)


def least_agreement(percent: int, sigmas: float = SIGMAS) -> int:
    """Signature rows that must agree for a pair to be looked at further."""
    p = percent / 100
    return max(0, int(np.floor(HASHES * p - sigmas * np.sqrt(HASHES * p * (1 - p)))))


SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary"


def sign(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in ts.blocks(batch.column(1)):
                prints, bounds = shingles(ts.scan(data, offsets, ts.SPACE), shingle)
                signature = signatures(prints, bounds)
                sets = [np.unique(prints[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                digests = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
                low = signature.astype(np.uint8)
                columns = [
                    batch.column(0).slice(i, j - i), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()),
                    pa.FixedSizeListArray.from_arrays(pa.array(band_keys(signature).ravel()), BANDS).cast(pa.list_(pa.int64())), pa.array([x.tobytes() for x in low], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "bands", "signature"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, SIGNED)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc, set) of documents (doc_id, text); a set is sorted fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in ts.blocks(batch.column(1)):
                prints, bounds = shingles(ts.scan(data, offsets, ts.SPACE), shingle)
                sets = [np.unique(prints[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], names=["doc", "set"])

    return texts.mapInArrow(run, "doc long, set binary")


def _wanted_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """Sets of the wanted documents (distinct), as a table.

    A bitmap of fixed size, by hash of the id, is joined to all documents first
    (2^17 rows at most, so broadcast), and the exchange moves few other texts;
    the join that follows is exact. Only the sets are made in Python, so a task
    of the scan has one worker.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc), {MAP_BITS}) % 64 as int))")
    words = written(wanted.groupBy(F.shiftright(place("doc"), 6).alias("at")).agg(F.bit_or(bit).alias("bits")), "bitmap")
    asked = docs.join(F.broadcast(words), F.shiftright(place("doc_id"), 6) == F.col("at")).where(f"shiftright(bits, cast(pmod(xxhash64(doc_id), {MAP_BITS}) % 64 as int)) & 1 = 1").select("doc_id", "text")
    # No semi-join, which the optimizer would put before the bitmap; `wanted` is distinct. Joined by an
    # exchange also where few are wanted: their sets are then few files, not one for each task of the scan.
    return written(_sets(asked.join(wanted.hint("merge"), asked.doc_id == wanted.doc).select("doc_id", "text"), shingle), "sets")


def similar(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _paired(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Pairs (doc, leader) with the column's value of both.

    A leader may have very many partners: they are salted by their number, and
    the leader's value is repeated for each salt.
    """
    hubs = pairs.groupBy("leader").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    many = hubs.join(values.select(F.col("doc").alias("leader"), F.col(column).alias("theirs")), "leader").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    mine = pairs.join(values.select("doc", F.col(column).alias("mine")), "doc").join(hubs.withColumnRenamed("salts", "of"), "leader")
    return mine.withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("of")).cast("int")).join(many.drop("salts"), ["leader", "salt"]).select("doc", "leader", "mine", "theirs")


def _verified(pairs: DataFrame, signed: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links among candidate pairs (doc, leader): by signature, then by full sets."""
    least = least_agreement(percent)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, theirs = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((mine == theirs).sum(1) >= least))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(a, b, percent) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    pairs = written(pairs, "pairs")
    close = written(_paired(pairs, signed, "signature").mapInArrow(near, "doc long, leader long"), "close")
    wanted = close.select("doc").unionByName(close.select(F.col("leader").alias("doc"))).distinct()
    sets = _wanted_sets(docs, written(wanted, "wanted"), shingle)
    return _paired(close, sets, "set").mapInArrow(same, "doc long, leader long").select(F.col("doc").alias("u"), F.col("leader").alias("v"))


def _unsettled(buckets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows (key, doc, comp) of buckets with classes of several components."""
    if roots is None:  # read off the signatures again rather than written, 24 rows a class
        labelled = buckets.withColumn("comp", F.col("doc"))
    else:
        labelled = written(buckets.join(roots.withColumnRenamed("u", "doc"), "doc", "left").select("key", "doc", F.coalesce("root", "doc").alias("comp")), "labelled")
    some = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low != high").select("key", "n")
    return written(join_singles(labelled, written(some, "unsettled"), ["key"], ["doc"]), "buckets")


def _led(rows: DataFrame, turn: int) -> DataFrame:
    """Candidates: each class of a bucket with the bucket's leader of this turn."""
    order = F.col("doc") if turn == 0 else F.xxhash64(F.col("doc"), F.lit(turn))
    leaders = written(rows.groupBy("key").agg(F.min(F.struct(order.alias("o"), "doc", "comp")).alias("l"), F.count("*").alias("n")).select("key", "n", F.col("l.doc").alias("leader"), F.col("l.comp").alias("led")), "leaders")
    return join_singles(rows, leaders, ["key"], ["doc"]).where("comp != led").select("doc", "leader").distinct()


def _tiled(rows: DataFrame, signed: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between components of a bucket, found in tiles.

    The members of a bucket's largest component stay at home in one tile row each;
    all others go to every tile row, and also have a home. Both sides are cut, by
    classes and by the bytes of their sets, whichever makes more tiles.
    """
    weight = F.greatest(F.lit(1 / TILE), 8 * F.col("n_shingles") / TILE_BYTES)
    sizes = rows.join(signed.select("doc", weight.alias("w")), "doc").groupBy("key", "comp").agg(F.sum("w").alias("m"), F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max(F.struct("c", "comp", "m")).alias("x"), F.sum("m").alias("all"), F.sum("c").alias("n")).select("key", "n", F.col("x.comp").alias("main"), F.ceil("all").cast("int").alias("homes"), F.ceil(F.greatest(F.lit(1 / TILE), F.col("all") - F.col("x.m"))).cast("int").alias("guests"))
    rows = join_singles(rows, written(main, "mains"), ["key"], ["doc"]).join(signed.select("doc", "signature", "bands"), "doc")
    hashed = lambda n, seed: F.pmod(F.xxhash64(F.col("doc"), F.lit(seed)), n).cast("int")
    home = rows.select("key", hashed(F.col("homes"), 1).alias("x"), F.explode(F.sequence(F.lit(0), F.col("guests") - 1)).alias("y"), F.lit(True).alias("home"), "doc", "comp", "signature", "bands")
    guest = rows.where("comp != main").select("key", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("x"), hashed(F.col("guests"), 2).alias("y"), F.lit(False).alias("home"), "doc", "comp", "signature", "bands")
    least = least_agreement(percent)

    def pairs(table):
        """(guest, hosts near to it) by row; a pair belongs to the first bucket it shares."""
        home, doc, comp = (np.array(table.column(c)) for c in ("home", "doc", "comp"))
        key = table.column("key")[0].as_py()
        bits = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, HASHES)
        bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(-1, BANDS)
        hosts = np.flatnonzero(home)
        for g in np.flatnonzero(~home).tolist():
            near = hosts[comp[hosts] != comp[g]]
            near = near[(bits[near] == bits[g]).sum(1) >= least]
            if len(near):
                shared = bands[near] == bands[g]
                near = near[bands[g][shared.argmax(1)] == key]
            if len(near):
                yield g, near, doc, comp

    def meet(table):
        met = np.zeros(table.num_rows, bool)
        for g, near, _, _ in pairs(table):
            met[g] = True
            met[near] = True
        return table.filter(pa.array(met))

    def check(table):
        sets, root, found = table.column("set").to_pylist(), {}, []

        def find(c):
            while root.setdefault(c, c) != c:
                c = root[c]
            return c

        for g, near, doc, comp in pairs(table):
            for h in near.tolist():
                a, b = find(int(comp[g])), find(int(comp[h]))
                if a != b and similar(sets[g], sets[h], percent):
                    root[max(a, b)] = min(a, b)
                    found.append((int(doc[g]), int(doc[h])))
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    tile = "key long, x int, y int, home boolean, doc long, comp long, signature binary, bands array<long>"
    # Dealt by tile outright: rows that a join has dealt by key would stay so, a hot bucket in one task.
    met = written(home.unionByName(guest).repartition("key", "x", "y").groupBy("key", "x", "y").applyInArrow(meet, tile), "met")
    sets = _wanted_sets(docs, written(met.select("doc").distinct(), "wanted"), shingle)
    return met.join(sets, "doc").groupBy("key", "x", "y").applyInArrow(check, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    signed = written(sign(docs, shingle, id_col, text_col), "signed", keep=True)
    some = signed.where("digest is not null and doc_id is not null")
    classes = written(some.groupBy("digest").agg(F.min("doc_id").alias("class"), F.count("*").alias("n")), "classes", keep=True)
    reps = written(some.join(classes, [some.digest == classes.digest, some.doc_id == classes["class"]], "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("doc"), "n_shingles", "bands", "signature"), "reps", keep=True)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    links = roots = None
    with scratch():
        rows = _unsettled(reps.select(F.explode("bands").alias("key"), "doc"), None)
        for turn in range(rounds + 1):
            with scratch():
                found = _verified(_led(rows, turn), reps, texts, shingle, percent) if turn < rounds else _tiled(rows, reps, texts, shingle, percent)
                found = written(found, "links", keep=True)
            links = found if links is None else links.unionByName(found)
            roots = connected_components(links)
            if turn < rounds:
                rows = _unsettled(rows.select("key", "doc"), roots)
                if rows.isEmpty():
                    break
    released(reps)
    rooted = written(classes.join(roots.withColumnRenamed("u", "class"), "class", "left"), "rooted", keep=True)
    released(classes)
    out = join_singles(signed.select("doc_id", "n_shingles", "digest"), rooted, ["digest"], ["doc_id"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "class", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which no near-duplicate has a smaller id, unchanged."""
    name = free_name(docs, "_gone")
    gone = near_duplicates(docs, shingle, percent, id_col=id_col, text_col=text_col).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    gone = written(gone, "gone")
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


#: DuckDB SQL of `op2_near_dedup`; ids are taken to be unique.
ORACLE = r"""
with recursive d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct r, array_to_string(list_slice(w, i, i + 2), ' ') as said
  from (select r, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from d where len(w) > 0)),
sizes as (select r, count(*) as n from shingles group by r),
common as (select a.r as a, b.r as b, count(*) as n from shingles a join shingles b on a.said = b.said and a.r < b.r group by all),
pairs as (
  select x.doc_id as u, y.doc_id as v
  from common c join sizes sa on sa.r = c.a join sizes sb on sb.r = c.b join d x on x.r = c.a join d y on y.r = c.b
  where 100 * c.n >= 85 * (sa.n + sb.n - c.n) and x.doc_id is not null and y.doc_id is not null),
links as (select u, v from pairs union select v, u from pairs),
reach(u, v) as (select doc_id, doc_id from d where doc_id is not null union select reach.u, links.v from reach join links on reach.v = links.u),
roots as (select u as doc_id, min(v) as root from reach group by u)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, root as component_id, coalesce(d.doc_id = root, true) as kept
from d left join sizes using (r) left join roots on roots.doc_id = d.doc_id
"""
