"""License scans with a positional rare-token index.

Licence texts and notices are templates, word sequences. Over all documents it is
counted how many hold each word of the templates, one count a word from each task.
The index keeps, for the words of highest IDF in each template, the postings
(template, position). A file's words are looked up there; every posting proposes a
start of the template in the file, and proposals that agree are intersected by
relative position. A start holds if enough rare words agree and all mandatory key
phrases stand at their place, give or take a few inserted words, more in a long
template.

Short phrases are templates of which every word is mandatory; they are found
exactly, wherever they stand.

Defined results: a null text is empty and has no places; a very long text is a
block of its own; words of equal IDF (ties) are taken in the template's order;
repeated rows each give a row and count each; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .licenses import TEXTS
from .shared import documents


@dataclass(frozen=True)
class Template:
    """Words of a licence text; `keys` are (position, length) of mandatory phrases."""

    name: str
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]


def phrase(text: str, label: str) -> Template:
    words = tuple(text.split())
    return Template(text, label, words, ((0, len(words)),))


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def template(name: str, label: str, text: str) -> Template:
    """`[[...]]` marks the mandatory phrases of the text."""
    words: list[str] = []
    keys = []
    for k, part in enumerate(text.replace("]]", "[[").split("[[")):
        found = _WORD.findall(part.lower())
        if k % 2:
            keys.append((len(words), len(found)))
        words += found
    return Template(name, label, tuple(words), tuple(keys))


#: The phrases of the base rule and their labels.
PHRASES = (
    phrase("gnu general public license", "gpl"),
    phrase("apache license", "apache"),
    phrase("cc by", "cc-by"),
    phrase("mit license", "mit"),
)

#: Phrases, notices and texts of public licences, with labels of the method.
NOTICES = (
    phrase("gnu lesser general public license", "lgpl"),
    phrase("gnu affero general public license", "agpl"),
    phrase("mozilla public license", "mpl"),
    phrase("eclipse public license", "epl"),
    phrase("boost software license", "bsl"),
    phrase("cc0 1 0 universal", "cc0"),
    *(template(*t) for t in TEXTS),
)

RARE_WORDS = 8
LEAST_AGREEMENT = 0.6
#: Words inserted or lost before a place that are put up with, and one more for so many words of the template.
SLACK, SLACK_WORDS = 4, 64


def frequencies(docs: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> tuple[dict[str, int], int]:
    """Documents that hold each word of the templates, and all documents."""
    words = sorted({w for t in templates for w in t.words})
    keys = ts.hash_words(words)
    order = np.argsort(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, n = keys[order], np.zeros(len(words), np.int64), 0
        for batch in batches:
            for i, j, data, offsets in ts.blocks(batch.column(0)):
                s = ts.scan(data, offsets, ts.ALNUM)
                at = np.minimum(np.searchsorted(known, s.hash), len(known) - 1)
                mine = known[at] == s.hash
                pairs = np.unique(s.doc[mine] * len(words) + at[mine])
                total += np.bincount(pairs % len(words), minlength=len(words))
                n += j - i
        yield pa.RecordBatch.from_pydict({"word": np.append(order, -1), "n": np.append(total, n)})

    found = {r[0]: r[1] for r in docs.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").sum("n").collect()}
    return {w: found.get(k, 0) for k, w in enumerate(words)}, found.get(-1, 0)


class Index:
    """Postings of the rarest words of each template."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[str, int] | None = None, documents: int = 0, rare_words: int = RARE_WORDS):
        """`frequency` is how many of the documents hold a word; without it, templates are counted."""
        self.templates = templates
        if frequency is None:
            frequency, documents = Counter(w for t in templates for w in set(t.words)), len(templates)
        self.idf = {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) for t in templates for w in t.words}
        self.hashes = [ts.hash_words(list(t.words)) for t in templates]
        self.rare: list[list[int]] = []
        postings: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(templates):
            exact = t.keys == ((0, len(t.words)),)
            firsts = [i for i, w in enumerate(t.words) if t.words.index(w) == i]
            at = sorted(firsts, key=lambda i: (-self.idf[t.words[i]], i))[: 1 if exact else rare_words]
            self.rare.append(at)
            for i in at:
                postings.setdefault(int(self.hashes[k][i]), []).append((k, i))
        self.keys = np.array(sorted(postings), np.uint64)
        lists = [postings[int(x)] for x in self.keys]
        self.bounds = np.cumsum([0, *map(len, lists)])
        self.template = np.array([k for x in lists for k, _ in x], np.int64)
        self.position = np.array([i for x in lists for _, i in x], np.int64)

    def find(self, s: ts.Scan, least: float = LEAST_AGREEMENT, slack: int = SLACK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(template, document, start word in the block, share of words that agree)."""
        none = np.zeros(0, np.int64)
        if not len(self.keys) or not len(s.hash):
            return none, none, none, np.zeros(0)
        at = np.minimum(np.searchsorted(self.keys, s.hash), len(self.keys) - 1)
        word = np.flatnonzero(self.keys[at] == s.hash)
        key = at[word]
        n = self.bounds[key + 1] - self.bounds[key]
        word, posting = np.repeat(word, n), np.repeat(self.bounds[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        which, start, doc = self.template[posting], word - self.position[posting], s.doc[word]
        found = []
        for k, t in enumerate(self.templates):
            mine = which == k
            if not mine.any():
                continue
            size, rare, near = len(t.words), self.rare[k], slack + len(t.words) // SLACK_WORDS
            pairs, votes = np.unique(np.stack([doc[mine], start[mine]], 1), axis=0, return_counts=True)
            d, at = pairs[:, 0], pairs[:, 1]
            if len(rare) > 1:  # proposals a few words apart stand for inserted or lost words
                votes = self._near(d, at, votes, near)
            ok = votes >= max(1, math.ceil(least * len(rare)))
            d, at = d[ok], at[ok]
            low, high = s.first[d], s.first[d + 1]
            exact = t.keys == ((0, size),)
            for first, length in t.keys:
                held = np.zeros(len(at), bool)
                for shift in (0,) if exact else range(-near, near + 1):
                    held |= self._stands(s, k, first, length, at + shift, low, high)
                d, at, low, high = d[held], at[held], low[held], high[held]
            if not len(at):
                continue
            where = at[:, None] + np.arange(size)[None, :]
            within = (where >= low[:, None]) & (where < high[:, None])
            share = ((s.hash[np.clip(where, 0, len(s.hash) - 1)] == self.hashes[k][None, :]) & within).mean(1)
            found.append((np.full(len(at), k), d, at, share))
        if not found:
            return none, none, none, np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    @staticmethod
    def _near(doc: np.ndarray, start: np.ndarray, votes: np.ndarray, slack: int) -> np.ndarray:
        """Votes of all proposals within the slack; pairs are sorted."""
        place = doc * (1 << 40) + start
        total = np.concatenate([[0], np.cumsum(votes)])
        return total[np.searchsorted(place, place + slack, "right")] - total[np.searchsorted(place, place - slack, "left")]

    def _stands(self, s: ts.Scan, k: int, first: int, length: int, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        at = start + first
        ok = (at >= low) & (at + length <= high)
        for i in range(length):
            ok &= s.hash[np.clip(at + i, 0, len(s.hash) - 1)] == self.hashes[k][first + i]
        return ok


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def scan_licenses(docs: DataFrame, phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES, least: float = LEAST_AGREEMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: places of base phrases, labels, best agreement.

    `score` is the largest share of a found template's words that agree by
    relative position: 1 for any exact phrase, 0 where nothing was found.
    """
    templates, n_base = (*phrases, *notices), len(phrases)
    labels = np.array([t.label for t in templates], object)
    frequency, n_docs = frequencies(docs, templates, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, frequency, n_docs)
        for batch in batches:
            for i, j, data, offsets in ts.blocks(batch.column(1)):
                s, n = ts.scan(data, offsets, ts.ALNUM), j - i
                which, doc, start, share = index.find(s, least)
                base = which < n_base
                number = np.bincount(doc[base], minlength=n)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                np.minimum.at(first, doc[base], (start - s.first[doc])[base])
                np.maximum.at(last, doc[base], (start - s.first[doc])[base])
                score = np.zeros(n)
                np.maximum.at(score, doc, share)
                said: list[set[str]] = [set() for _ in range(n)]
                base_said: list[set[str]] = [set() for _ in range(n)]
                for d, k, is_base in {*zip(doc.tolist(), which.tolist(), base.tolist(), strict=True)}:
                    said[d].add(labels[k])
                    if is_base:
                        base_said[d].add(labels[k])
                none = number == 0
                columns = [
                    batch.column(0).slice(i, n).cast(pa.int64()), pa.array(s.n_words), pa.array(number), pa.array(first, mask=none), pa.array(last, mask=none),
                    pa.array([",".join(sorted(x)) for x in base_said]), pa.array([",".join(sorted(x)) for x in said]), pa.array(score),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, SCHEMA)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
