"""Query trees."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Node:
    boost: float = field(default=1.0, kw_only=True)


@dataclass(frozen=True)
class Term(Node):
    field: str | None
    text: str


@dataclass(frozen=True)
class Phrase(Node):
    field: str | None
    text: str
    slop: int = 0


@dataclass(frozen=True)
class Prefix(Node):
    field: str | None
    text: str


@dataclass(frozen=True)
class Wildcard(Node):
    field: str | None
    text: str


@dataclass(frozen=True)
class Fuzzy(Node):
    field: str | None
    text: str
    distance: float = 2


@dataclass(frozen=True)
class Regexp(Node):
    field: str | None
    text: str


@dataclass(frozen=True)
class Range(Node):
    field: str | None
    low: str | None
    high: str | None
    include_low: bool = True
    include_high: bool = True


@dataclass(frozen=True)
class MatchAll(Node):
    pass


@dataclass(frozen=True)
class MatchNone(Node):
    pass


@dataclass(frozen=True)
class Clause:
    occur: str  # must, should or not
    node: Node


@dataclass(frozen=True)
class Boolean(Node):
    clauses: tuple[Clause, ...]


@dataclass(frozen=True)
class DisMax(Node):
    """Matches like OR; scores like the best part."""

    parts: tuple[Node, ...]


LEAVES = (Term, Phrase, Prefix, Wildcard, Fuzzy, Regexp, Range)


def with_field(node: Node, name: str | None) -> Node:
    return replace(node, field=name)


def _escaped(text: str) -> str:
    return "".join("\\" + c if c in '+-!(){}[]^"~*?:\\/ ' else c for c in text)


def show(node: Node, terse: bool = True, quoted: bool = False, top: bool = True) -> str:
    """The tree as query text.  terse: no parentheses where they aren't needed; quoted: terms in quotes."""
    if isinstance(node, Boolean):
        marks = {"must": "+", "not": "-", "should": ""}
        body = " ".join(marks[c.occur] + show(c.node, terse, quoted, False) for c in node.clauses)
        text = body if terse and top and node.boost == 1 else f"({body})"
    elif isinstance(node, DisMax):
        text = "(" + " | ".join(show(p, terse, quoted, False) for p in node.parts) + ")"
    elif isinstance(node, MatchAll):
        text = "*:*"
    elif isinstance(node, MatchNone):
        text = ""
    else:
        text = f"{node.field}:" if node.field else ""
        if isinstance(node, Term):
            text += f'"{node.text}"' if quoted else _escaped(node.text)
        elif isinstance(node, Phrase):
            text += f'"{node.text}"' + (f"~{node.slop}" if node.slop else "")
        elif isinstance(node, Prefix):
            text += _escaped(node.text) + "*"
        elif isinstance(node, Wildcard):
            text += node.text
        elif isinstance(node, Fuzzy):
            text += f"{_escaped(node.text)}~{node.distance:g}"
        elif isinstance(node, Regexp):
            text += f"/{node.text}/"
        elif isinstance(node, Range):
            text += ("[" if node.include_low else "{") + f"{node.low or '*'} TO {node.high or '*'}" + ("]" if node.include_high else "}")
    return text + (f"^{node.boost:g}" if node.boost != 1 and text else "")
