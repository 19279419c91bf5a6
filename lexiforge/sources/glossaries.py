"""Glossary files: YAML or JSON objects of terms, with or without languages."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from ..functions.plain import Entries

SUFFIXES = (".json", ".yaml", ".yml")


class GlossaryError(ValueError):
    """A glossary can't be read or doesn't fit the request."""


@dataclass(frozen=True)
class Glossary:
    entries: Entries = ()
    source_language: str | None = None
    target_language: str | None = None


def _document(path: Path) -> dict:
    suffix, text = path.suffix.lower(), path.read_text(encoding="utf-8")
    if suffix not in SUFFIXES:
        raise GlossaryError(f"{path} is no glossary: its name has to end in {', '.join(SUFFIXES)}")
    if suffix == ".json":
        loaded = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as problem:
            raise GlossaryError("a YAML glossary can only be read where PyYAML is installed") from problem
        loaded = yaml.safe_load(text)
    if loaded is not None and not isinstance(loaded, dict):
        raise GlossaryError(f"{path} holds no object of terms")
    return loaded or {}


def _entries(raw: object) -> Entries:
    if not isinstance(raw, dict):
        raise GlossaryError("the entries of a glossary give each term its translation, as an object")
    kept = {}
    for source, target in ((str(s).strip(), str(t).strip()) for s, t in raw.items()):
        if not source or not target:
            raise GlossaryError(f"a term has an empty source (its translation is {target!r})" if not source else f"the term {source!r} has an empty target")
        kept[source] = target
    return tuple(kept.items())


def _language(raw: dict, key: str) -> str | None:
    value = raw.get(key)
    if value is not None and not isinstance(value, str):
        raise GlossaryError(f"{key} is a language code, not {value!r}")
    return value.lower() if value is not None else None


def load(path: str | Path | None, source: str | None = None, target: str | None = None) -> Glossary:
    """A glossary, empty without a path; its languages, if it names any, must fit."""
    if path is None:
        return Glossary()
    raw = _document(Path(path))
    if "entries" not in raw:
        return Glossary(_entries(raw))
    found = Glossary(_entries(raw["entries"]), _language(raw, "source_language"), _language(raw, "target_language"))
    for side, own, asked in (("source", found.source_language, source), ("target", found.target_language, target)):
        if own and asked and own != asked.lower():
            raise GlossaryError(f"{side} language mismatch: the glossary has {own}, the request {asked.lower()}")
    return found
