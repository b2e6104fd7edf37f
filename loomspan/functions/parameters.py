"""What a caller asks for, made safe: unknown evidence types are dropped, unknown levels and numbers fall back, numbers keep to their range."""

from __future__ import annotations

from collections.abc import Iterable

from .citations import EVIDENCE_TYPES, RANK


def evidence_types(asked: Iterable[str] | None) -> tuple[str, ...]:
    """The known types among those asked for; none stands for no filter."""
    return tuple(t for t in asked or () if t in EVIDENCE_TYPES)


def sources(asked: Iterable[str] | None) -> tuple[str, ...]:
    """The distinct non-empty source ids; none stands for no filter."""
    return tuple(dict.fromkeys(s for s in asked or () if s))


def level(asked: str | None) -> str:
    return asked if asked in RANK else "low"


def whole(asked, default: int, least: int, most: int) -> int:
    """A whole number from text or a number, kept within least and most."""
    try:
        return min(most, max(least, int(asked)))
    except (TypeError, ValueError):
        return default
