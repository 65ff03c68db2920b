import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidewell.plans import rewrite
from tidewell.plans.ast import Boolean, Fuzzy, MatchAll, Phrase, Prefix, Range, Regexp, Term, Wildcard, show
from tidewell.plans.parser import QueryError, parse, parse_raw, split_boosts
from tidewell.plans.sanitize import IGNORE, REMOVE, sanitize
from tidewell.schema import Descriptor, Field, Group, from_xml


def test_leaves():
    assert parse_raw("a:b") == Term("a", "b")
    assert parse_raw('a:"b c"~2') == Phrase("a", "b c", 2)
    assert parse_raw("b*") == Prefix(None, "b")
    assert parse_raw("a:t?x*") == Wildcard("a", "t?x*")
    assert parse_raw("b~1") == Fuzzy(None, "b", 1)
    assert parse_raw("a:[x TO y}") == Range("a", "x", "y", True, False)
    assert parse_raw("/b.d/") == Regexp(None, "b.d")
    assert parse_raw(r"a\:b") == Term(None, "a:b")
    for text in (None, "", "*", "(*)", "*:*"):
        assert parse_raw(text) == MatchAll()


@pytest.mark.parametrize(
    "text, operator, shown",
    [
        ("a b", "and", "+a +b"),
        ("a b", "or", "a b"),
        ("a OR b", "and", "a b"),
        ("a AND b", "or", "+a +b"),
        ("a AND NOT b", "or", "+a -b"),
        ("+a b -c", "or", "+a b -c"),
        ("f:(a b)", "and", "+f:a +f:b"),
        ("(a OR b) c", "and", "+(a b) +c"),
        ("a^2 b", "or", "a^2 b"),
    ],
)
def test_shapes(text, operator, shown):
    assert show(parse_raw(text, operator)) == shown


@pytest.mark.parametrize("text", ["a AND", "OR a", "(a", "a)", "f:", '"a'])
def test_errors(text):
    with pytest.raises(QueryError):
        parse_raw(text)


def descriptor() -> Descriptor:
    fields = {"title": Field("title", query_boost=2), "text": Field("text"), "au": Field("au", aliases=(("author", None),))}
    return Descriptor(fields, {"all": Group("all", ("title", "text"))}, {"dyn_": Field("dyn_")}, ("title", "au"))


def test_expansion():
    assert show(parse("x", descriptor())) == "title:x^2 au:x"
    assert show(parse("all:x", descriptor())) == "(title:x^2 | text:x)"
    assert show(parse("author:x", descriptor())) == "au:x"
    assert show(parse("all:x boost(title^3 all^5)", descriptor())) == "(title:x^6 | text:x^5)"
    assert show(parse("title:[a TO b] boost(title^3)", descriptor())) == "title:[a TO b]"
    assert descriptor().resolve("dyn_x").name == "dyn_x" and descriptor().resolve("none") is None
    assert split_boosts("x y") == ("x y", {})


def test_descriptor_xml():
    got = from_xml(
        """<IndexDescriptor><fields><field name="base" stored="false" queryBoost="1.5"/><field name="kid" parent="base" multiValued="false"><alias name="barn" lang="da"/></field>
        <field name="x_*" parent="verbatim"/></fields><groups><group name="g"><field ref="base"/><field ref="kid"/></group></groups>
        <defaultSearchFields>g kid</defaultSearchFields><defaultLanguage>da</defaultLanguage><QueryParser defaultOperator="OR"/></IndexDescriptor>"""
    )
    kid = got.resolve("barn")
    assert (kid.name, kid.stored, kid.query_boost, kid.multi_valued) == ("kid", False, 1.5, False)
    assert got.groups["g"].fields == ("base", "kid") and got.defaults == ("g", "kid") and got.operator == "or"
    assert got.resolve("x_1").kind == "verbatim" and len(got.struct()) == 2


@pytest.mark.parametrize(
    "text, fixed",
    [('a "b', "a b"), ("(a", "a"), ("a)", "a"), ("a:", r"a\:"), ("a!", r"a\!"), ("a/b", r"a\/b"), ('"a (b"', '"a (b"'), ("(a) b))", "(a) b"), (r"a\"b", r"a\"b")],
)
def test_sanitize(text, fixed):
    assert sanitize(text) == fixed


def test_sanitize_actions():
    assert sanitize("a/b:", slashes=IGNORE, colons=REMOVE) == "a/b"


@given(st.text(alphabet='ab "():!/\\', max_size=12))
def test_sanitize_is_stable(text):
    once = sanitize(text)
    assert sanitize(once) == once


def test_rewrites():
    assert rewrite.phrased("red fox") == '(red fox) OR "red fox"~2'
    assert rewrite.phrased("f:red fox") == "f:red fox" and rewrite.phrased("red") == "red"
    assert show(rewrite.fuzzed(parse_raw("a b~1"))) == "a~2 b~1"
    assert rewrite.is_simple(parse_raw("a b")) and not rewrite.is_simple(parse_raw("a -b"))
    assert rewrite.is_all_required(parse_raw("+a +(+b +c)")) and not rewrite.is_all_required(parse_raw("+a b"))
    assert show(rewrite.mapped(parse_raw("a:x"), {"a": ["b", "c"]})) == "b:x c:x"
    assert show(rewrite.mapped(parse_raw("a:x"), None, {("a", "x"): ["y", "z"]})) == "a:y a:z"
    assert rewrite.map_names(["a", "b"], {"a": ["c", "b"]}) == ["c", "b"]


@pytest.mark.parametrize(
    "text, patterns, left",
    [("a b", [":a"], "b"), ("+a +b", [":a"], ""), ("f:x OR g:y", ["f:"], "g:y"), ("f:x -g:y", ["g:y"], "f:x"), ("f:x", ["f:x"], ""), ("", ["f:x"], None), ('f:"a b" OR c', ["f:"], "c"), ("a -b", [":a"], "")],
)
def test_reduce(text, patterns, left):
    assert rewrite.reduce_text(text, patterns) == left


def test_requests():
    request = {"query": 'red "fox', "filters": ["a:", "b"], "start": 1, "secret": 2}
    assert rewrite.rewrite_request(request)["query"] == '(red fox) OR "red fox"~2'
    assert rewrite.prune_request(request, ["query", "s.*"], ["secret"]) == {"query": 'red "fox', "start": 1}
    assert rewrite.ids_query(["a", "b", "c"], "id", 2) == 'id:"a" OR id:"b"'
    assert rewrite.ids_query(["a", "b"], "id", 1, "skip") is None
    with pytest.raises(ValueError):
        rewrite.ids_query(["a", "b"], "id", 1, "fail")
    assert isinstance(parse_raw("a b"), Boolean)
