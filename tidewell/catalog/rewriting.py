"""Queries of rewriting: what texts and requests become, next to results written by hand."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from tidewell.federate import Balanced
from tidewell.operators import facets
from tidewell.plans import rewrite
from tidewell.plans.ast import show
from tidewell.plans.parser import parse_raw
from tidewell.plans.sanitize import sanitize

from .common import Tables, query
from .text_sql import _q


def _by_hand(name: str, rewritten, cases: list[tuple[str, str | None]]) -> None:
    """Registers the results of a function of text, with the given ones as SQL."""
    values = ", ".join(f"({_q(a)}, {'NULL' if b is None else _q(b)})" for a, b in cases)

    @query(name, f"SELECT given, rewritten FROM (VALUES {values}) x(given, rewritten)")
    def _(t: Tables) -> DataFrame:
        return t.spark.createDataFrame([(a, rewritten(a)) for a, _ in cases], "given string, rewritten string")


_by_hand(
    "rew_sanitize",
    sanitize,
    [('a "b', "a b"), ("(a", "a"), ("a)", "a"), ("a:", r"a\:"), ("a!", r"a\!"), ("a/b", r"a\/b"), ('"a (b"', '"a (b"'), ("(a) b))", "(a) b"), (r"a\"b", r"a\"b"), ("f:x AND y", "f:x AND y"), ('(a "b) c', "(a b) c")],
)
_by_hand(
    "rew_shapes",
    lambda text: show(parse_raw(text, "or")),
    [("a b", "a b"), ("a AND b", "+a +b"), ("a AND NOT b", "+a -b"), ("+a b -c", "+a b -c"), ("f:(a b)", "f:a f:b"), ("(a OR b) AND c", "+(a b) +c"), ("a^2 b", "a^2 b"), ("f:[x TO y}", "f:[x TO y}"), ("f:ab*", "f:ab*"), ("a~1", "a~1")],
)
_by_hand("rew_phrase", rewrite.phrased, [("red fox", '(red fox) OR "red fox"~2'), ("f:red fox", "f:red fox"), ("red", "red"), ("red -fox", "red -fox"), ("a b c", '(a b c) OR "a b c"~2')])
_by_hand("rew_fuzzy", lambda text: show(rewrite.fuzzed(parse_raw(text, "or"))), [("a b~1", "a~2 b~1"), ('"a b" c', '"a b" c~2'), ("f:x -g:y", "f:x~2 -g:y~2")])
_by_hand(
    "rew_reduce",
    lambda text: rewrite.reduce_text(text, ["f:", ":gone", "g:y"]),
    [("a gone", "a"), ("a OR gone", "a"), ("+gone +b", ""), ("f:x OR h:y", "h:y"), ("h:x -g:y", "h:x"), ("f:x", ""), ("", None), ('f:"a b" OR c', "c"), ("(f:x OR a) AND b", "+a +b")],
)
_by_hand(
    "rew_map",
    lambda text: show(rewrite.mapped(parse_raw(text, "or"), {"a": ["b", "c"], "d": ["e"]}, {("g", "x"): ["y", "z"]})),
    [("a:x", "b:x c:x"), ("d:x", "e:x"), ("g:x", "g:y g:z"), ("g:w h:x", "g:w h:x"), ("d:x OR k:y", "e:x k:y")],
)
_by_hand("rew_sort_fields", lambda text: " ".join(rewrite.map_names(text.split(), {"a": ["c", "b"]})), [("a b", "c b"), ("b a", "b c"), ("x", "x")])
_by_hand("rew_facet_filters", lambda text: json.dumps(facets.value_filters(text)), [('a:b AND c:"d e"', '[["a", "b"], ["c", "d e"]]'), ("a:b OR c:d", "[]"), ("(a:b)", '[["a", "b"]]'), ("word", "[]")])
_by_hand(
    "rew_request",
    lambda text: json.dumps(rewrite.rewrite_request(json.loads(text), ("sanitize", "phrase"))),
    [('{"query": "red \\"fox", "filters": ["a:", "b"]}', '{"query": "(red fox) OR \\"red fox\\"~2", "filters": ["a\\\\:", "b"]}'), ('{"start": 1}', '{"start": 1}')],
)
_by_hand(
    "rew_prune",
    lambda text: json.dumps(rewrite.prune_request(json.loads(text), ["query", "s.*"], ["secret"])),
    [('{"query": "x", "start": 1, "secret": 2, "other": 3}', '{"query": "x", "start": 1}'), ("{}", "{}")],
)


def _guarded(text: str) -> str:
    """Calls of two searchers with so many slots each, all held, in the order they are taken; then a refusal."""
    guard, taken = Balanced([lambda r: 0, lambda r: 1], int(text)), []

    def hold(depth: int) -> None:
        if depth == 0:
            try:
                guard.search(None, 0.001)
            except TimeoutError:
                taken.append("refused")
            return
        at = guard.free.index(max(guard.free))
        guard.searchers[at] = lambda r: (taken.append(str(at)), hold(depth - 1))
        guard.search(None, 0.001)

    hold(2 * int(text))
    return ",".join(taken)


_by_hand("rew_guard", _guarded, [("1", "0,1,refused"), ("2", "0,1,0,1,refused")])
