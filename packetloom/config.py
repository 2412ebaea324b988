"""Settings of the engine and where its tables are kept."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


def cache_root(explicit: str | None = None, env: dict[str, str] | None = None) -> str:
    """Given, else PACKETLOOM_CACHE, else the user's cache folder. On a cluster, give a shared
    path."""
    e = os.environ if env is None else env
    if explicit or e.get("PACKETLOOM_CACHE"):
        return explicit or e["PACKETLOOM_CACHE"]
    base = e.get("XDG_CACHE_HOME") or e.get("LOCALAPPDATA") or os.path.join(e.get("HOME", "."), ".cache")
    return os.path.join(base, "packetloom")


@dataclass(frozen=True)
class Config:
    """What a Session, the registry and the tools go by."""

    #: Folder of written tables (on a cluster a shared one); None keeps them in the session only.
    tables: str | None = None
    sessions: int = 8
    sql_rows: int = 100
    sql_timeout_s: float = 30.0
    render_chars: int = 12_000
    #: Protocol paths that an overview shows.
    protocols: int = 200


def configure(settings: dict, env: dict[str, str] | None = None) -> Config:
    """A Config from plain settings: unknown names and values of another type or out of range
    are errors; `cache: true` or a path turns written tables on."""
    known = {f.name: f for f in fields(Config)} | {"cache": None}
    if wrong := sorted(set(settings) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(wrong)}. Allowed: {', '.join(known)}")
    given = dict(settings)
    cache = given.pop("cache", None)
    if cache:
        given["tables"] = cache_root(cache if isinstance(cache, str) else None, env)
    out = Config(**given)
    for name in ("sessions", "sql_rows", "render_chars", "protocols", "sql_timeout_s"):
        v = getattr(out, name)
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v <= 0 or (name != "sql_timeout_s" and not isinstance(v, int)):
            raise ValueError(f"{name} must be a positive number")
    return out
