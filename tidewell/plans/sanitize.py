"""Repairs for query text that people type."""

from __future__ import annotations

import re

IGNORE, REMOVE, ESCAPE = "ignore", "remove", "escape"


def _unescaped(text: str, chars: str) -> list[int]:
    out, at = [], 0
    while at < len(text):
        if text[at] == "\\":
            at += 2
            continue
        if text[at] in chars:
            out.append(at)
        at += 1
    return out


def _apply(text: str, places: list[int], action: str) -> str:
    for i in reversed(places):
        text = text[:i] + ("\\" + text[i] if action == ESCAPE else "") + text[i + 1 :]
    return text


def _unbalanced(text: str) -> list[int]:
    quoted = _quoted(text)
    open_at, extra = [], []
    for i in _unescaped(text, "()"):
        if quoted(i):
            continue
        if text[i] == "(":
            open_at.append(i)
        elif open_at:
            open_at.pop()
        else:
            extra.append(i)
    return sorted(extra + open_at)


def _quoted(text: str):
    marks = _unescaped(text, '"')
    spans = list(zip(marks[::2], marks[1::2], strict=False))
    return lambda i: any(a < i < b for a, b in spans)


def sanitize(text: str, quotes: str = REMOVE, parentheses: str = REMOVE, colons: str = ESCAPE, exclamations: str = ESCAPE, slashes: str = ESCAPE) -> str:
    """Repeated until nothing changes: odd quotes, unbalanced parentheses, trailing colons and exclamation
    marks, and slashes are each removed, escaped or ignored."""
    while True:
        before = text
        marks = _unescaped(text, '"')
        if quotes != IGNORE and len(marks) % 2:
            text = _apply(text, marks if quotes == REMOVE else marks[-1:], quotes)
        if parentheses != IGNORE and (bad := _unbalanced(text)):
            text = _apply(text, bad, parentheses)
        quoted = _quoted(text)
        for char, action in ((":", colons), ("!", exclamations)):
            if action != IGNORE:
                text = _apply(text, [i for i in _unescaped(text, char) if not quoted(i) and re.match(r"(\s|\)|$)", text[i + 1 :] or "")], action)
                quoted = _quoted(text)
        if slashes != IGNORE:
            text = _apply(text, [i for i in _unescaped(text, "/") if not quoted(i)], slashes)
        if text == before:
            return text
