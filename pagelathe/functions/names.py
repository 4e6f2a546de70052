"""Names in bylines, in plain Python; `text.normalize_authors` does the same on columns."""

from __future__ import annotations

import html
import re

from pagelathe.functions.vocab import BYLINE_CLEANUP, EMAIL, EMOJI, LONGEST_SINGLE_NAME, NAME_CLEANUP, NAME_SEPARATORS, NO_NAME_CHARACTERS

_SEPARATORS, _EMAIL = re.compile(NAME_SEPARATORS), re.compile(EMAIL)
_STEPS = [(re.compile(p), to) for p, to in ((EMOJI, ""), *NAME_CLEANUP)]
_BYLINE = [(re.compile(p), to) for p, to in BYLINE_CLEANUP]
_NO_NAME = str.maketrans("", "", NO_NAME_CHARACTERS)


def _without(text: str, steps: list[tuple[re.Pattern, str]]) -> str:
    for pattern, to in steps:
        text = " ".join(pattern.sub(to, text).split())
    return text


def split_names(told: str) -> list[str]:
    """The cleaned names that a byline or a list of authors tells; an address or e-mail tells none."""
    if told.lower().startswith("http") or _EMAIL.match(told):
        return []
    cleaned = (_without(p, _STEPS) for p in _SEPARATORS.split(html.unescape(told)))
    fair = (n for n in cleaned if n and (" " in n or "-" in n or len(n) < LONGEST_SINGLE_NAME))
    return [n if n[0].isupper() else n.title() for n in fair]


def joined(names: list[str], more: list[str]) -> list[str]:
    """`names` and those of `more` that hold none of the names before them."""
    out = list(names)
    for name in more:
        if not any(known in name for known in out):
            out.append(name)
    return out


def byline(text: str) -> str | None:
    """An author element's text without the words around the name, in title case."""
    return _without(text, _BYLINE).title() or None


def from_labels(labels: list[str], text: str) -> list[str]:
    """Names from one label a character: B begins a name, I goes on with it, anything else ends it."""
    runs: list[list[str]] = []
    inside = False
    for label, char in zip(labels, text, strict=False):
        if label == "B" or (label == "I" and not inside):
            runs.append([])
        inside = label in ("B", "I")
        if inside:
            runs[-1].append(char)
    names = ("".join(r).translate(_NO_NAME).strip() for r in runs)
    return [n for n in names if n]
