"""Query trees to column expressions over rows that hold each field's tokens as an array."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ast import Boolean, DisMax, Fuzzy, MatchAll, MatchNone, Node, Phrase, Prefix, Range, Regexp, Term, Wildcard



class Compiler:
    """tokens: field name to the column with its tokens; analyze: (field, text) to the query's own tokens."""

    def __init__(self, tokens: Callable[[str], Column], analyze: Callable[[str, str], list[str]]):
        self.tokens, self.analyze = tokens, analyze

    def matches(self, node: Node) -> Column:
        if isinstance(node, Boolean):
            must = [self.matches(c.node) for c in node.clauses if c.occur == "must"]
            should = [self.matches(c.node) for c in node.clauses if c.occur == "should"]
            banned = [~self.matches(c.node) for c in node.clauses if c.occur == "not"]
            if should and not must:
                must = [reduce(Column.__or__, should)]
            return reduce(Column.__and__, must + banned)
        if isinstance(node, DisMax):
            return reduce(Column.__or__, [self.matches(p) for p in node.parts])
        if isinstance(node, MatchAll):
            return F.lit(True)
        if isinstance(node, MatchNone):
            return F.lit(False)
        return F.coalesce(self._leaf(node), F.lit(False))

    def _leaf(self, node: Node) -> Column:
        # Bound to a lambda variable, the tokens are computed once however often the test reads them.
        return F.transform(F.array(self.tokens(node.field)), lambda tokens: self._test(node, tokens))[0]

    def _test(self, node: Node, tokens: Column) -> Column:
        if isinstance(node, Term):
            words = self.analyze(node.field, node.text)
            if len(words) == 1:
                return F.array_contains(tokens, words[0])
            return self._phrase(tokens, words, 0) if words else F.lit(False)
        if isinstance(node, Phrase):
            return self._phrase(tokens, self.analyze(node.field, node.text), node.slop)
        if isinstance(node, Range):
            def inside(t: Column) -> Column:
                low = F.lit(True) if node.low is None else (t >= node.low if node.include_low else t > node.low)
                high = F.lit(True) if node.high is None else (t <= node.high if node.include_high else t < node.high)
                return low & high

            return F.exists(tokens, inside)
        return F.exists(tokens, self.token_test(node))

    def token_test(self, node: Node) -> Callable[[Column], Column]:
        """The test that a single token passes."""
        if isinstance(node, Prefix):
            start = node.text.lower()
            return lambda t: t.startswith(start)
        if isinstance(node, Wildcard):
            pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in re.sub(r"\\(.)", r"\1", node.text.lower()))
            return lambda t: t.rlike(f"^(?:{pattern})$")
        if isinstance(node, Regexp):
            return lambda t: t.rlike(f"^(?:{node.text})$")
        if isinstance(node, Fuzzy):
            word = "".join(self.analyze(node.field, node.text)) or node.text
            edits = int(node.distance) if node.distance >= 1 else max(0, int((1 - node.distance) * len(word)))
            return lambda t: F.levenshtein(t, F.lit(word), edits) >= 0
        raise TypeError(type(node).__name__)

    def _phrase(self, tokens: Column, words: list[str], slop: int) -> Column:
        if not words:
            return F.lit(False)
        if len(words) == 1:
            return F.array_contains(tokens, words[0])
        quick = reduce(Column.__and__, [F.array_contains(tokens, w) for w in dict.fromkeys(words)])
        if slop == 0:
            wanted = F.array(*map(F.lit, words))
            starts = F.sequence(F.lit(1), F.size(tokens) - len(words) + 1)
            found = F.exists(starts, lambda i: F.slice(tokens, i, F.lit(len(words))) == wanted)
            return F.when(quick & (F.size(tokens) >= len(words)), found).otherwise(False)

        # Each word's positions less its place in the phrase: all within slop of each other in a match.
        def shifted(i: int, w: str) -> Column:
            return F.filter(F.transform(tokens, lambda t, p: F.when(t == w, p - i)), lambda p: p.isNotNull())

        lists = [shifted(i, w) for i, w in enumerate(words)]
        begins = F.concat(*lists)
        found = F.exists(begins, lambda s: reduce(Column.__and__, [F.exists(x, lambda p: (p >= s) & (p <= s + slop)) for x in lists]))
        return F.when(quick, found).otherwise(False)

    def leaves(self, node: Node) -> list[Node]:
        if isinstance(node, Boolean):
            return [x for c in node.clauses if c.occur != "not" for x in self.leaves(c.node)]
        if isinstance(node, DisMax):
            return [x for p in node.parts for x in self.leaves(p)]
        return [node]

    def score(self, node: Node, weight: Callable[[Node], Column]) -> Column:
        """Sums over boolean clauses, the best over dis-max parts, times the boosts."""
        if isinstance(node, Boolean):
            parts = [self.score(c.node, weight) for c in node.clauses if c.occur != "not"]
            total = reduce(Column.__add__, parts) if parts else F.lit(1.0)
        elif isinstance(node, DisMax):
            parts = [self.score(p, weight) for p in node.parts]
            total = parts[0] if len(parts) == 1 else F.greatest(*parts)
        elif isinstance(node, MatchAll):
            total = F.lit(1.0)
        elif isinstance(node, MatchNone):
            total = F.lit(0.0)
        else:
            total = F.when(self.matches(node), weight(node)).otherwise(0.0)
        return total * float(node.boost) if node.boost != 1 else total
