"""Settings of a worker from text: lists, numbers, switches, time limits, certificates, passwords in addresses."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from urllib.parse import quote

ON = {"1", "true", "yes", "on"}


def listed(settings: Mapping[str, str], name: str, default: str = "") -> list[str]:
    """The parts of a comma list, trimmed, blank ones left out."""
    return [part for part in (p.strip() for p in settings.get(name, default).split(",")) if part]


def whole(settings: Mapping[str, str], name: str, default: int) -> int:
    """A whole number; absent or empty: default. Other text raises ValueError."""
    text = settings.get(name)
    return int(text) if text else default


def switch(settings: Mapping[str, object], name: str, default: bool) -> bool:
    """On for 1, true, yes, on in any case, off for other text; absent: default."""
    value = settings.get(name)
    if value is None:
        return default
    return value if isinstance(value, bool) else str(value).lower() in ON


def flush_seconds(flush_ms: int, delivery_ms: int) -> float:
    """How long a publisher may flush: its own limit, else that of a delivery; a second at least."""
    return max((flush_ms or delivery_ms) / 1000, 1.0)


def certificates(configured: str, known: Iterable[str]) -> str:
    """The configured file if it exists, else the first of the known ones that does, else the configured name or the first known one."""
    places = list(known)
    for place in ([configured] if configured else []) + places:
        if os.path.exists(place):
            return place
    return configured or (places[0] if places else "")


def password_in_address(password: str) -> str:
    """A password as it stands in an address: everything but letters, digits and _.-~ is percent-encoded."""
    return quote(password, safe="")
