"""Settings of an engine: plain dataclasses, read from and written to one JSON text."""

from __future__ import annotations

import json
from collections.abc import Callable, MutableMapping
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

# Defaults that decide results.
FORMAT_PRIORITY = ("EPUB", "AZW3", "MOBI", "FB2", "DOCX", "HTML", "TXT", "PDF")
UNREADABLE_FORMATS = ("LSF", "LRF")
TOKENS_PER_CHAR = {"dense": 0.70, "arabic": 0.60, "nonlatin": 0.40, "latin": 0.20}
#: The same as whole hundredths, so that sums and halves are exact.
TOKEN_HUNDREDTHS = {tier: round(100 * n) for tier, n in TOKENS_PER_CHAR.items()}
CONTEXT_OVERHEAD_TOKENS = 64
MIN_CHUNK_CHARS = 200
MIN_EXTRACTED_CHARS = 1000
PROMPT_OVERHEAD_TOKENS = 1024
ESTIMATE_SAFETY = 1.10
MIN_TEXT_CHARS = 2000
STRUCTURED_RETRIES = 2
BAD_RESPONSE_RETRIES = 2
HTTP_ATTEMPTS = 4
MAX_RESULTS = 1000
PRIORITY_DEFAULT, PRIORITY_PER_BOOK = 0, 100
SCHEMA_VERSION = 5

#: Name, label, type and description of the attributes that are extracted by default.
DEFAULT_FIELDS = (
    ("main_character_gender", "ss_gender", "category", "Gender of the main or point-of-view character(s), 'multiple' for several protagonists."),
    ("protagonist_orientation", "ss_orientation", "tags", "Orientation of the main character(s) as shown or stated."),
    ("romance_elements", "ss_romance", "tags", "Romance plot elements and dynamics."),
    ("tropes", "ss_tropes", "tags", "Notable tropes."),
    ("themes", "ss_themes", "tags", "Major themes."),
    ("pov", "ss_pov", "category", "Narrative point of view."),
    ("content_warnings", "ss_warnings", "tags", "Content warnings for what is actually present."),
    ("blurb", "ss_blurb", "text", "A spoiler-free blurb of one to three short paragraphs."),
)


@dataclass(frozen=True)
class EmbedSettings:
    base_url: str = "http://localhost:11434"
    model: str = "nomic-embed-text"
    api_key: str = ""
    batch_size: int = 64
    concurrency: int = 4
    timeout: int = 300


@dataclass(frozen=True)
class Attribute:
    """type: text (prose), category (one value) or tags (several); language: empty, 'book' or a language's name."""

    name: str
    label: str
    type: str
    description: str
    enabled: bool = True
    language: str = ""
    title: str = ""


def default_attributes() -> tuple[Attribute, ...]:
    return tuple(Attribute(*f, language="book" if f[0] == "blurb" else "") for f in DEFAULT_FIELDS)


@dataclass(frozen=True)
class Settings:
    embed: EmbedSettings = field(default_factory=EmbedSettings)
    vector_backend: str = "sqlite"
    format_priority: tuple[str, ...] = FORMAT_PRIORITY
    target_chars: int = 1000
    overlap_chars: int = 150
    embed_context_tokens: int = 8192
    embed_token_scale: float = 1.25
    max_chunks_per_book: int = 0
    search_min_score: float = 0.2
    attr_mode: str = "sampled"
    attr_context_tokens: int = 8192
    attr_token_scale: float = 1.0
    attr_template_kwargs: str = ""
    auto_extract_attributes: bool = True
    attributes: tuple[Attribute, ...] = field(default_factory=default_attributes)

    def enabled(self) -> tuple[Attribute, ...]:
        return tuple(a for a in self.attributes if a.enabled)

    @property
    def effective_target(self) -> int:
        return min(self.target_chars, max_chunk_chars(self.embed_context_tokens, self.embed_token_scale))

    @property
    def chunk_token_cap(self) -> int:
        cap = int((self.embed_context_tokens - CONTEXT_OVERHEAD_TOKENS) / self.embed_token_scale)
        if cap <= 0:
            raise ValueError("embed_context_tokens leaves no room for a chunk")
        return cap


def max_chunk_chars(context_tokens: int, scale: float = 1.0) -> int:
    return max(MIN_CHUNK_CHARS, int((context_tokens - CONTEXT_OVERHEAD_TOKENS) / (TOKENS_PER_CHAR["latin"] * scale)))


def text_budget_chars(context_tokens: int, scale: float = 1.0) -> int:
    return max(MIN_TEXT_CHARS, int((context_tokens - PROMPT_OVERHEAD_TOKENS) / (TOKENS_PER_CHAR["latin"] * scale)))


def text_budget_tokens(context_tokens: int, prompt_tokens: int, scale: float = 1.0) -> int:
    """Whole tokens of text that fit beside a prompt of prompt_tokens."""
    return max(1, int(int((context_tokens - PROMPT_OVERHEAD_TOKENS) / (ESTIMATE_SAFETY * scale)) - prompt_tokens * scale))


def _known(kind, data: Any) -> dict[str, Any]:
    names = {f.name for f in fields(kind)}
    return {k: v for k, v in data.items() if k in names and v is not None} if isinstance(data, dict) else {}


def from_json(text: str | None) -> Settings:
    """Unknown keys are dropped, broken JSON gives defaults, default attributes that are missing are appended, the old
    backend name 'auto' means the default."""
    try:
        data = json.loads(text) if text else {}
    except ValueError:
        data = {}
    given = _known(Settings, data)
    given["embed"] = EmbedSettings(**_known(EmbedSettings, given.get("embed")))
    if given.get("vector_backend") == "auto":
        del given["vector_backend"]
    if "format_priority" in given:
        given["format_priority"] = tuple(given["format_priority"])
    defaults = {a.name: a for a in default_attributes()}
    listed = [x for x in given.pop("attributes", None) or () if isinstance(x, dict) and x.get("name")]
    if listed:
        own = [replace(defaults.get(x["name"], Attribute(x["name"], "ss_" + x["name"], "text", "")), **_known(Attribute, x)) for x in listed]
        given["attributes"] = (*own, *(a for n, a in defaults.items() if n not in {x.name for x in own}))
    return Settings(**given)


def to_json(settings: Settings) -> str:
    return json.dumps(asdict(settings))


Prefs = MutableMapping[str, str] | Callable[..., Any]
PREFS_KEY = "engine_settings"


def load(prefs: Prefs, key: str = PREFS_KEY) -> Settings:
    return from_json(prefs(key, "") if callable(prefs) else prefs.get(key, ""))


def store(prefs: Prefs, settings: Settings, key: str = PREFS_KEY) -> None:
    if callable(prefs):
        prefs(key, to_json(settings))
    else:
        prefs[key] = to_json(settings)


def template_kwargs(text: str | None) -> dict[str, Any] | None:
    """A JSON object, else None."""
    try:
        found = json.loads(text or "")
    except ValueError:
        return None
    return found if isinstance(found, dict) else None
