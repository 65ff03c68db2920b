import pytest

from tidewell.catalog.registry import QUERIES
from tidewell.federate import Adjustment, Balanced, CachedSearch, Composite, Federation, Guard
from tidewell.search import Request, Searcher


@pytest.fixture(scope="module")
def both(spark):
    a = spark.createDataFrame([(1, "red fox", "en"), (2, "red hen", "en")], "id bigint, text string, lang string")
    b = spark.createDataFrame([(3, "red fox fox", "dansk"), (4, "blue", "dansk")], "id bigint, body string, lang string")
    sources = {"a": Searcher(a, "id", {"text": "text", "lang": "verbatim"}, ["text"]), "b": Searcher(b, "id", {"body": "text", "lang": "verbatim"}, ["body"])}
    return Federation(sources, {"b": Adjustment({"text": ["body"]}, tags=[("dansk", "da")], factor=100.0)})


def test_adjusted_search(both):
    rows = both.search(Request("text:red", fields=["lang"], rows=2)).orderBy("position").collect()
    assert rows[0]["id"] == 3 and rows[0]["source"] == "b" and len(rows) == 2
    assert [r["id"] for r in both.search(Request("text:red", fields=["lang"], rows=2, start=1)).orderBy("position").collect()] == [1, 2]
    with pytest.raises(KeyError):
        both.search(Request("x"), ["nowhere"])


def test_search_of_all_rows(both, spark):
    """No number of rows stands for all of them; none is the rest from a start on."""
    every = Request("text:red", fields=["lang"], rows=None)
    merged = both.search(every)
    assert [(r["position"], r["id"]) for r in merged.orderBy("position").collect()] == [(0, 3), (1, 1), (2, 2)]
    assert [r["id"] for r in both.search(Request("text:red", fields=["lang"], start=1, rows=None)).orderBy("position").collect()] == [1, 2]
    assert sorted(r["position"] for r in both.search(every, enforce={"a": 1}).collect()) == [0, 1, 2]
    groups = both.search(Request("*", group="lang", rows=None))
    assert sorted((r["lang"], r["num_found"], r["id"]) for r in groups.collect()) == [("dansk", 2, 3), ("en", 2, 1)]
    assert [r["id"] for r in both.sources["a"].search(Request("red", rows=None)).collect()] == [1, 2]
    plan = merged.select("id", "source")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Limit" not in plan


def test_federated_query_has_no_limit(spark):
    plan = QUERIES["fed_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Window" not in plan


def test_merged_facets(both):
    counts = both.facet(Request("text:red", facets="lang"))["lang"]
    assert sorted((r["term"], r["count"]) for r in counts.collect()) == [("da", 1), ("en", 2)]


def test_merged_groups_and_proposals(both):
    groups = both.search(Request("*", group="lang", rows=5))
    assert sorted((r["lang"], r["num_found"], r["id"]) for r in groups.collect()) == [("dansk", 2, 3), ("en", 2, 1)]
    assert both.did_you_mean("fix", "text").first()["term"] == "fox"


def test_cache_and_balance(both):
    now = [0.0]
    cached = CachedSearch(lambda r: both.search(r), 10, 1, lambda: now[0])
    request = Request("text:red", fields=["lang"])
    assert cached.search(request) == cached.search(request) and (cached.hits, cached.misses) == (1, 1)
    now[0] = 11
    cached.search(request)
    assert cached.misses == 2
    spread = Balanced([lambda r: "x", lambda r: "y"], 1)
    assert spread.search(request) == "x" and spread.free == [1, 1]
    spread.free = [0, 0]
    with pytest.raises(TimeoutError):
        spread.search(request, 0.01)


def test_guard_and_composite(both):
    guard = Guard(lambda r: "rows", 1, 2)
    assert guard.search(None) == "pong" and guard.search(Request("x")) == "rows" and guard.served == 1
    with pytest.raises(ValueError):
        guard.search(Request(ids=["1", "2", "3"]))
    guard.slots.acquire()
    with pytest.raises(TimeoutError):
        guard.search(Request("x"), 0.01)
    for parallel in (True, False):
        composite = Composite({name: s.search for name, s in both.sources.items()}, parallel)
        request = Request("lang:en OR lang:dansk", fields=["lang"])
        assert {name: len(rows) for name, rows in composite.search(request).items()} == {"a": 2, "b": 2}
        assert composite.later(request).result().keys() == {"a", "b"}
        composite.close()
