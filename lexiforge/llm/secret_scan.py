"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Text that a tokenizer has seen the like of takes few tokens; a random string
takes many. A run of key characters with few characters per token under a
tiktoken vocabulary is therefore a secret, unless it is a digest of a known
length, a UUID or an identifier made of plain parts.

Defined results: null is an empty text and has no spans; a very long text is a
block of its own; spans that begin at one place (ties) stand in the order of the
kinds; overlapping spans of different kinds are all reported, but a run that a
pattern already covers isn't tested; rows are scanned one by one, so repeated rows
each give a row; other columns of the input are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import documents

ASSIGN = re.compile(rb"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX, LEAST_RANDOM = 8, 16, 32, 20
#: Characters per token; English prose has over 4, base64 and hex noise under 2.
MOST_CHARS_PER_TOKEN = 2.1
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_KEY = np.zeros(256, bool)
_KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_UUID = re.compile(rb"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_HEX_ONLY = re.compile(rb"[0-9a-f]+|[0-9A-F]+")
#: Letters are a plain part as one short word, or as words with capitals; the token test decides on longer runs.
_PLAIN_PART = re.compile(rb"[a-z]{0,12}(?:[A-Z][a-z]{2,11}){0,3}|[A-Z]{1,12}|[0-9]+|[A-Za-z]{1,12}[0-9]{1,4}|[A-Za-z]{1,4}[0-9]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def runs(flags: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of runs of set flags, cut at the offsets, of a least length."""
    n = len(flags)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = flags.copy()
    start[1:] &= ~flags[:-1] | edge[1:n]
    end = flags.copy()
    end[:-1] &= ~flags[1:] | edge[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    long = end - start >= least
    return start[long], end[long]


def is_known(run: bytes) -> bool:
    """A digest of a known length, a UUID, or an identifier of plain parts."""
    body = run.strip(b"=-_/+")
    if len(body) in DIGEST_LENGTHS and _HEX_ONLY.fullmatch(body) or _UUID.fullmatch(body):
        return True
    return all(_PLAIN_PART.fullmatch(p) for p in re.split(rb"[-_/=+]", body))


def is_random(run: bytes, path: str, most: float = MOST_CHARS_PER_TOKEN) -> bool:
    if is_known(run):
        return False
    return len(run) < most * len(encoding(path).encode_ordinary(run.decode("ascii")))


def block_spans(data: np.ndarray, offsets: np.ndarray, path: str, most: float) -> list[tuple[int, int, int, int]]:
    """(document, start, kind, end) in bytes of the block, sorted."""
    raw, found = data.tobytes(), []
    hex_start, hex_end = runs(_HEX[data], offsets, LEAST_HEX)
    doc = np.searchsorted(offsets, hex_start, "right") - 1
    found += [(d, s, 2, e) for d, s, e in zip(doc.tolist(), hex_start.tolist(), hex_end.tolist(), strict=True)]
    bounds = offsets.tolist()
    signs = np.flatnonzero((data == 61) | (data == 58))  # = and :, without which there is no assignment
    for d in np.unique(np.searchsorted(offsets, signs, "right") - 1).tolist():
        for m in ASSIGN.finditer(raw, bounds[d], bounds[d + 1]):
            if m.end(1) - m.start(1) >= LEAST_ASSIGN:
                found.append((d, m.start(), 0, m.end()))
    at = raw.find(b"AKIA")
    seen = -1
    while at >= 0:
        d = int(np.searchsorted(offsets, at, "right")) - 1
        if d != seen:
            seen = d
            for m in ACCESS.finditer(raw, bounds[d], bounds[d + 1]):
                if m.end() - m.start() >= LEAST_ACCESS:
                    found.append((d, m.start(), 1, m.end()))
        at = raw.find(b"AKIA", bounds[d + 1])
    covered = np.zeros(len(data), bool)
    for _, s, _, e in found:
        covered[s:e] = True
    for s, e in zip(*(x.tolist() for x in runs(_KEY[data] & ~covered, offsets, LEAST_RANDOM)), strict=True):
        run = raw[s:e]
        if is_random(run, path, most):
            found.append((int(np.searchsorted(offsets, s, "right")) - 1, s, 3, e))
    return sorted(found)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def scan_secrets(docs: DataFrame, vocabulary: str | None = None, most: float = MOST_CHARS_PER_TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by kind and all spans in code points.

    `vocabulary` is the path of a tiktoken file that every executor can read.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in ts.blocks(batch.column(1)):
                n = j - i
                counts = np.zeros((4, n), np.int64)
                spans: list[list[str]] = [[] for _ in range(n)]
                base: list[list[str]] = [[] for _ in range(n)]
                if found := block_spans(data, offsets, path, most):
                    chars = np.zeros(len(data) + 1, np.int64)
                    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                    for d, s, kind, e in found:
                        zero = chars[offsets[d]]
                        said = f"{KINDS[kind]}:{chars[s] - zero}:{chars[e] - zero}"
                        counts[kind, d] += 1
                        spans[d].append(said)
                        if kind < 3:
                            base[d].append(said)
                columns = [batch.column(0).slice(i, n).cast(pa.int64()), *map(pa.array, counts[:3]), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in base]), pa.array([",".join(x) for x in spans]), pa.array(counts[3])]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, SCHEMA)


def redact_secrets(docs: DataFrame, vocabulary: str | None = None, most: float = MOST_CHARS_PER_TOKEN, mark: str = "[SECRET]", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The same rows and columns, each span (overlapping ones as one) replaced.

    Where `chars_col` is a column, it is the length of the new text in the rows
    that change.
    """
    path, at, mark_ = vocabulary or default_vocabulary(), docs.columns.index(text_col), mark.encode()
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in ts.blocks(batch.column(at)):
                piece, raw, spans = batch.slice(i, j - i), data.tobytes(), {}
                for d, s, _, e in block_spans(data, offsets, path, most):
                    mine = spans.setdefault(d, [])
                    if mine and s < mine[-1][1]:
                        mine[-1][1] = max(mine[-1][1], e)
                    else:
                        mine.append([s, e])
                if spans:
                    texts = piece.column(at).to_pylist()
                    sizes = piece.column(chars_at).to_pylist() if chars_at is not None else None
                    for d, mine in spans.items():
                        out, cursor = [], offsets[d]
                        for s, e in mine:
                            out += [raw[cursor:s], mark_]
                            cursor = e
                        texts[d] = b"".join([*out, raw[cursor : offsets[d + 1]]]).decode()
                        if sizes is not None:
                            sizes[d] = len(texts[d])
                    columns = list(piece.columns)
                    columns[at] = pa.array(texts, piece.column(at).type)
                    if sizes is not None:
                        columns[chars_at] = pa.array(sizes, piece.column(chars_at).type)
                    piece = pa.RecordBatch.from_arrays(columns, schema=piece.schema)
                yield piece

    return docs.mapInArrow(run, docs.schema)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))
