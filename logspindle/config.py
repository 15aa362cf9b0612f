"""Layered settings: defaults, then files in the order given, then environment variables; the last one wins."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

#: What the settings are called and looked up by.
DEFAULTS = {"bind_address": "0.0.0.0:5985"}
PREFIX = "WEF"
SEPARATOR = "__"


def merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``over`` on top of ``base``: tables are merged key by key, everything else is replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def from_environment(env: Mapping[str, str], prefix: str = PREFIX) -> dict[str, Any]:
    """``WEF__SYSLOG__UDP_PORT`` becomes ``{"syslog": {"udp_port": ...}}``; a variable that a longer one runs through is replaced by its table.
    A name with one underscore after the prefix and an empty part are left out."""
    out: dict[str, Any] = {}
    for name in sorted(env):
        head, *parts = name.split(SEPARATOR)
        if head.upper() != prefix or not parts or not all(parts):
            continue
        at = out
        for part in parts[:-1]:
            if not isinstance(at.get(part.lower()), dict):
                at[part.lower()] = {}
            at = at[part.lower()]
        at[parts[-1].lower()] = _scalar(env[name])
    return out


def _scalar(text: str) -> Any:
    """true, false, whole and decimal numbers as such; the rest stays text."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def load(files: Iterable[str | Path] = (), env: Mapping[str, str] | None = None, defaults: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """TOML files that don't exist are skipped; one that can't be read raises an error."""
    out = dict(DEFAULTS if defaults is None else defaults)
    for path in map(Path, files):
        if path.is_file():
            out = merge(out, tomllib.loads(path.read_text("utf-8")))
    return merge(out, from_environment(os.environ if env is None else env))
