"""Translation and post-edit engines behind small protocols.

No model runtime is part of this package. Deterministic engines are here, and
adapters that load an installed runtime when a worker first needs it; any other
object with the same method will do. A failing text becomes an error of its row,
and a failing post-edit a fallback, so that neither ends a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PostEditSettings
from ..functions import plain
from ..functions import text as tx


class Translator(Protocol):
    def translate(self, text: str) -> str: ...


@dataclass(frozen=True)
class NativeEngine:
    """A translation that is a column expression; blank text stays."""

    name: str
    expression: Callable[[Column], Column]

    def draft(self, df: DataFrame, column: str, into: str) -> DataFrame:
        c = F.col(column)
        return df.withColumns({into: F.when(tx.is_blank(c), c).otherwise(self.expression(c)), f"{into}_error": F.lit(None).cast("string")})


def identity() -> NativeEngine:
    return NativeEngine("identity", lambda c: c)


def prefix(mark: str = "T:") -> NativeEngine:
    return NativeEngine("prefix", lambda c: F.concat(F.lit(mark), c))


def tag(mark: str = " [en]") -> NativeEngine:
    return NativeEngine("tag", lambda c: F.concat(c, F.lit(mark)))


def phrase_table(phrases: tuple[tuple[str, str], ...]) -> NativeEngine:
    def replaced(c: Column) -> Column:
        for source, target in sorted(phrases, key=lambda p: (-len(p[0]), p[0])):
            c = F.replace(c, F.lit(source), F.lit(target))
        return c

    return NativeEngine("phrase_table", replaced)


@dataclass(frozen=True)
class BatchEngine:
    """`load` makes a translator, once in each task."""

    name: str
    load: Callable[[], Translator]

    def draft(self, df: DataFrame, column: str, into: str) -> DataFrame:
        at, load = df.columns.index(column), self.load
        schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType()), T.StructField(f"{into}_error", T.StringType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            engine = None
            for batch in batches:
                texts, errors = [], []
                for t in batch.column(at).to_pylist():
                    try:
                        if t is not None and t.strip():
                            engine = engine or load()
                            t = engine.translate(t)
                        texts.append(t)
                        errors.append(None)
                    except Exception as problem:  # noqa: BLE001 - the row keeps its source
                        texts.append(None)
                        errors.append(str(problem))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, into, f"{into}_error"])

        return df.mapInArrow(run, schema)


class Argos:
    """Argos Translate for a pair of languages, looked up at the first text."""

    def __init__(self, source: str, target: str):
        self.source, self.target, self.pair = source, target, None

    def _load(self):
        try:
            from argostranslate import translate
        except ImportError as problem:
            raise RuntimeError("no Argos Translate on this worker: install argostranslate and a package of the language pair") from problem
        installed = {x.code: x for x in translate.get_installed_languages()}
        for code in (self.source, self.target):
            if code not in installed:
                raise RuntimeError(f"Argos Translate has no language {code} here")
        return installed[self.source].get_translation(installed[self.target])

    def translate(self, text: str) -> str:
        if not text.strip():
            return text
        self.pair = self.pair or self._load()
        return self.pair.translate(text)


def argos(source: str, target: str) -> BatchEngine:
    return BatchEngine("argos", lambda: Argos(source, target))


def _load_llama(s: PostEditSettings):
    try:
        from llama_cpp import Llama
    except ImportError as problem:
        raise RuntimeError("no llama-cpp-python on this worker") from problem
    return Llama(model_path=s.model_path, n_ctx=s.n_ctx, n_batch=s.n_batch, n_threads=s.n_threads, verbose=False)


@lru_cache(maxsize=1)
def _loaded(load: Callable, settings: PostEditSettings):
    """A worker keeps one model over its tasks."""
    return load(settings)


@dataclass(frozen=True)
class LanguageModel:
    """A post-editor that asks a local model, greedily and within a token budget.

    Without a model path, and for blank drafts, the draft is the answer.
    """

    settings: PostEditSettings
    load: Callable = _load_llama

    def __call__(self, source: str, draft: str, entries: plain.Entries, mode: str) -> str:
        s = self.settings
        if not draft.strip() or not s.model_path:
            return draft
        model = _loaded(self.load, s)
        # The sampling and the ends of an answer.
        said = model(plain.prompt(source, draft, entries, mode), max_tokens=plain.token_budget(draft, mode, s.max_tokens), temperature=max(0.0, s.temperature), top_k=1, top_p=1.0, seed=0, stop=["[/OUTPUT]", "\n\n"])
        return said["choices"][0]["text"].strip()


# Post-edit engines: (source, draft, entries, mode) -> candidate


def echo(source: str, draft: str, entries: plain.Entries, mode: str) -> str:
    return draft


def fail(source: str, draft: str, entries: plain.Entries, mode: str) -> str:
    raise RuntimeError("no language model here")


def rewrite(source: str, draft: str, entries: plain.Entries, mode: str) -> str:
    """A small change that keeps all placeholders and blocks."""
    return draft.replace(" ,", ",").replace(" .", ".")


def mangle(source: str, draft: str, entries: plain.Entries, mode: str) -> str:
    """Placeholders lose their underscores, as with some models."""
    return plain.ANY_PLACEHOLDER.sub(lambda m: m.group().strip("_").replace("_", " "), draft)


def broken_markers(source: str, draft: str, entries: plain.Entries, mode: str) -> str:
    return draft.replace("[/SEGMENT_1]", "")


POST_EDITORS: dict[str, plain.Edit] = {"echo": echo, "fail": fail, "rewrite": rewrite, "mangle": mangle, "broken_markers": broken_markers}
