"""Configuration of grading: an endpoint, limits, bands, rubrics and keywords, with defaults for what is left out."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from ..functions import grading as G
from .model import Endpoint


@dataclass(frozen=True)
class Settings:
    endpoint: Endpoint | None = None
    chunk_chars: int = G.CHUNK_CHARS
    fulltext_chars: int = G.FULLTEXT_CHARS
    bands: tuple[tuple[float, str], ...] = G.BANDS
    type_keywords: tuple[tuple[str, tuple[str, ...]], ...] = G.TYPE_KEYWORDS
    rubrics: dict = field(default_factory=dict)

    @classmethod
    def of(cls, data: dict, environ: dict[str, str] | None = None) -> Settings:
        """Sections ``llm``, ``grading``, ``type_keywords`` and ``rubrics``; numbers may be texts."""
        limits, llm = data.get("grading") or {}, data.get("llm") or {}
        made: dict = {}
        for ours, theirs in (("chunk_chars", "chunk_chars"), ("fulltext_chars", "max_fulltext_chars")):
            if theirs in limits:
                made[ours] = int(limits[theirs])
        if "grade_bands" in limits:
            made["bands"] = tuple((float(b["min"]), str(b["label"])) for b in limits["grade_bands"])
        if "type_keywords" in data:
            made["type_keywords"] = tuple((k, tuple(v)) for k, v in data["type_keywords"].items())
        if llm.get("base_url") and llm.get("model"):
            made["endpoint"] = Endpoint.of(llm, environ)
        return cls(rubrics=data.get("rubrics") or {}, **made)

    @classmethod
    def load(cls, path: str | None, environ: dict[str, str] | None = None) -> Settings:
        """From a JSON file, or YAML where a YAML library is installed; a missing file gives the defaults."""
        if path is None or not Path(path).exists():
            return cls.of({}, environ)
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith(".json"):
            return cls.of(json.loads(text) or {}, environ)
        try:
            import yaml
        except ImportError:
            raise ValueError("no YAML library is installed; write the configuration as JSON") from None
        return cls.of(yaml.safe_load(text) or {}, environ)
