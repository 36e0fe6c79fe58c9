"""Ingest requests read from a JSON file inside the project."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from .api import IngestRequest, SourceInput
from .schema import AUTHORITY_LEVELS


def inside(path: str | Path, root: str | Path) -> Path:
    """The resolved path, which must lie below the root, links followed."""
    whole, top = Path(path).resolve(), Path(root).resolve()
    if not whole.is_relative_to(top):
        raise ValueError(f"{path} must lie below {top}")
    return whole


def _member(of: object, name: str, where: str, kind: type = str, optional: bool = False) -> object:
    """A member of an object with its type checked; texts are trimmed and must not be blank."""
    if not isinstance(of, Mapping):
        raise ValueError(f"{where or 'the config'} must be an object")
    value = of.get(name)
    label = f"{where}.{name}" if where else name
    if value is None and optional:
        return None
    if not isinstance(value, kind):
        raise ValueError(f"{label} must be a {'text' if kind is str else 'list' if kind is list else 'object'}")
    if kind is str and not value.strip():
        raise ValueError(f"{label} must not be blank")
    return value.strip() if kind is str else value


def _level(value: str) -> str:
    if value not in AUTHORITY_LEVELS:
        raise ValueError(f"unknown authority level {value!r}")
    return value


def load_ingest(path: str | Path, root: str | Path) -> tuple[str, IngestRequest]:
    """(actor, request) of a config file below ``root``; anything that does not fit is a ValueError that names it.

    The guideline block is needed only for a guideline that is not registered yet; it must agree with the request.
    """
    try:
        config = json.loads(inside(path, root).read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise ValueError(f"the config is not valid JSON: {e.msg}") from e
    version = _member(config, "version", "", dict)
    sources: dict[str, SourceInput] = {}
    listed = _member(config, "sources", "", list)
    if len(listed) < 2:
        raise ValueError("sources must list two files at least")
    for i, s in enumerate(listed):
        at = f"sources[{i}]"
        one = SourceInput(_member(s, "id", at), _member(s, "path", at), _member(s, "source_kind", at), _member(s, "provenance", at, dict, optional=True) or {})
        if one.id in sources:
            raise ValueError(f"{at}.id is there twice")
        sources[one.id] = one
    chosen = {}
    for role in ("jsonl_source_id", "citation_source_id"):
        name = _member(config, role, "")
        if name not in sources:
            raise ValueError(f"{role} names no source")
        chosen[role] = sources[name]
    language, level = _member(config, "language", ""), _level(_member(config, "authority_level", ""))
    guideline, title, more = _member(config, "guideline", "", dict, optional=True), "", {}
    if guideline is not None:
        own = tuple(_member(guideline, f, "guideline") for f in ("id", "language", "authority_level"))
        if own != (_member(version, "guideline_id", "version"), language, level):
            raise ValueError("the guideline block differs from the request")
        title = _member(guideline, "title", "guideline")
        more = {f: _member(guideline, f, "guideline", optional=True) for f in ("title_zh", "publisher")}
    request = IngestRequest(
        guideline_id=_member(version, "guideline_id", "version"), title=title, language=language, authority_level=level, version_id=_member(version, "id", "version"),
        version_label=_member(version, "version_label", "version"), chunks=chosen["jsonl_source_id"], citation=chosen["citation_source_id"],
        published_at=_member(version, "published_at", "version", optional=True), **more,
    )
    return _member(config, "actor", ""), request
