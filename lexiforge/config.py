"""Settings and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import StrEnum

LANGUAGES = ("fr", "en")
POLICIES = ("off", "auto", "safe", "smart")


class EngineMode(StrEnum):
    ARGOS = "argos"
    HYBRID = "hybrid"
    LLM = "llm"


@dataclass(frozen=True)
class PostEditSettings:
    """When and how a draft is post-edited."""

    # The defaults that results depend on.
    enabled: bool = False
    model_path: str | None = None
    n_ctx: int = 1024
    n_threads: int = 2
    n_batch: int = 64
    temperature: float = 0.0
    max_tokens: int = 256
    strict_validation: bool = True
    fallback_to_draft: bool = True
    max_expansion_ratio: float = 1.4
    policy: str = "auto"
    skip_short_characters: int = 48
    skip_high_placeholder_ratio: float = 0.12
    smart_min_chars: int = 160
    enable_chunking: bool = False
    technical_token_threshold: int = 1
    safe_placeholder_count: int = 2
    multi_sentence_threshold: int = 2
    chunk_max_placeholders: int = 1
    chunk_max_segments: int = 4
    chunk_max_chars: int = 560
    chunk_min_chars: int = 1


@dataclass(frozen=True)
class RunConfig:
    source_language: str = "fr"
    target_language: str = "en"
    engine: EngineMode = EngineMode.ARGOS
    glossary: tuple[tuple[str, str], ...] = ()
    settings: PostEditSettings = field(default_factory=PostEditSettings)


#: Terms up to which the glossary is a fold of native expressions; a longer one
#: is applied by an Arrow function with patterns that are compiled once.
NATIVE_TERMS = 24
