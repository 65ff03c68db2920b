"""Searching several sources as one: adjusted requests out, adjusted and merged rows back."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import ANALYZERS
from tidewell.operators import browse, facets, federation, postings, suggest
from tidewell.plans import rewrite
from tidewell.plans.ast import show
from tidewell.plans.parser import parse_raw
from tidewell.search import Request, Searcher


@dataclass
class Adjustment:
    """How a source differs: field and term names, facet tags, and the scale of its scores."""

    fields: dict[str, list[str]] = field(default_factory=dict)
    terms: dict[tuple[str, str], list[str]] = field(default_factory=dict)
    tags: list[tuple[str, str]] = field(default_factory=list)
    factor: float = 1.0
    add: float = 0.0
    simple_factor: float | None = None

    def request(self, request: Request) -> Request:
        if not (self.fields or self.terms):
            return request

        def changed(text: str) -> str:
            return show(rewrite.mapped(parse_raw(text, "and"), self.fields, self.terms))

        query = changed(request.query) if request.query else request.query
        sort = rewrite.map_names([request.sort], self.fields)[0] if request.sort else None
        return replace(request, query=query, filters=[changed(f) for f in request.filters], sort=sort)

    def scores(self, rows: DataFrame, query: str | None) -> DataFrame:
        simple = bool(query) and rewrite.is_simple(parse_raw(query))
        return federation.adjust_scores(rows, self.factor, self.add, self.simple_factor, simple)


class Federation:
    """Named sources under one search call.  All sources must have the key and the wanted fields."""

    def __init__(self, sources: dict[str, Searcher], adjustments: dict[str, Adjustment] | None = None, mode: str = "score", order: list[str] | None = None):
        self.sources, self.adjustments = sources, adjustments or {}
        self.mode, self.order = mode, order or list(sources)

    def search(self, request: Request, wanted: list[str] | None = None, enforce: dict[str, int] | None = None) -> DataFrame:
        """One page of merged rows.  Each source gives its rows from 0 to the page's end; rows None: all of them.

        A grouped request's groups are merged whatever the mode: counts summed, documents ranked anew.
        """
        if request.group:
            return self._grouped(request, wanted)
        chosen = federation.route_requests(self.sources, wanted)
        found = {}
        for name, searcher in chosen.items():
            adjusted = self.adjustments.get(name, Adjustment())
            own = adjusted.request(replace(request, start=0, rows=None if request.rows is None else request.start + request.rows))
            # All rows are put in order once, after they are merged.
            rows = searcher.search(own, ordered=False) if request.rows is None and isinstance(searcher, Searcher) else searcher.search(own)
            rows = rows.withColumnRenamed(searcher.key, "id")
            found[name] = adjusted.scores(rows, request.query)
        gathered = federation.gather(found, request.start, request.rows)
        merged = federation.merge(gathered, self.mode, self.order, 0 if enforce else request.start, None if enforce else request.rows)
        if enforce:
            merged = federation.enforce(merged, enforce, request.query or "").where(F.col("position") >= request.start)
            if request.rows is not None:
                merged = merged.where(F.col("position") < request.start + request.rows)
        return merged

    def _grouped(self, request: Request, wanted: list[str] | None) -> DataFrame:
        parts = []
        for name, searcher in federation.route_requests(self.sources, wanted).items():
            adjusted = self.adjustments.get(name, Adjustment())
            # All groups: one that is small here may be large in the whole.
            hits = adjusted.scores(searcher.scored(adjusted.request(request).query, adjusted.request(request).filters), request.query)
            found = hits.groupBy(request.group).agg(F.count(F.lit(1)).alias("num_found"))
            best = browse.best_of_each(hits.withColumnRenamed(searcher.key, "id"), request.group, request.group_limit, key="id")
            parts.append(best.join(found, request.group).select(request.group, "num_found", "id", "score"))
        return browse.merge_groups(parts, request.group, request.group_limit, request.rows, key="id")

    def did_you_mean(self, word: str, field: str, limit: int = 5, wanted: list[str] | None = None) -> DataFrame:
        """Proposals of all sources together, the best first."""
        parts = []
        for name, searcher in federation.route_requests(self.sources, wanted).items():
            own = self.adjustments.get(name, Adjustment()).fields.get(field, [field])[0]
            terms = postings.extract(searcher.docs, [own], ANALYZERS[searcher.fields.get(own, "default")])
            parts.append(suggest.did_you_mean(terms, word, limit).select("term", (1 / (1 + F.col("distance"))).alias("score")))
        return federation.merge_proposals(parts, limit)

    def facet(self, request: Request, wanted: list[str] | None = None) -> dict[str, DataFrame]:
        """Facets of all sources' hits, tags renamed by each source's map, whole counts summed, and then cut as asked."""
        asked = {f.name: f for f in facets.parse_request(request.facets or "")}
        parts: dict[str, list[DataFrame]] = {}
        for name, searcher in federation.route_requests(self.sources, wanted).items():
            adjusted = self.adjustments.get(name, Adjustment())
            for facet, counts in searcher.facet(adjusted.request(request), whole=True).items():
                parts.setdefault(facet, []).append(facets.map_tags(counts, adjusted.tags) if adjusted.tags else counts.select("term", "count"))
        return {facet: facets.answer(facets.summed(counts), asked[facet]) for facet, counts in parts.items()}


class RemoteSource:
    """A source that is asked over a network: fetch takes a request and gives a page's rows as dicts, with the key and a score.

    It stands in a Federation beside local searchers.  The rows of a page are as many as the request asks for (None: all).
    """

    def __init__(self, spark: SparkSession, key: str, schema: str, fetch: Callable[[Request], list[dict]], fetch_facets: Callable[[Request], dict[str, list[tuple[str, int]]]] | None = None):
        self.spark, self.key, self.schema, self.fetch, self.fetch_facets = spark, key, schema, fetch, fetch_facets

    def search(self, request: Request) -> DataFrame:
        rows = self.spark.createDataFrame([], f"{self.schema}, score double")
        names = rows.columns
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in self.fetch(request)], rows.schema)

    def facet(self, request: Request, whole: bool = False) -> dict[str, DataFrame]:
        found = self.fetch_facets(request) if self.fetch_facets else {}
        return {name: self.spark.createDataFrame(counts, "term string, count bigint") for name, counts in found.items()}


class CachedSearch:
    """Remembers rows of recent requests: at most `entries` of them, for `seconds` each."""

    def __init__(self, search: Callable[[Request], DataFrame], seconds: float = 120, entries: int = 1000, clock: Callable[[], float] = time.monotonic):
        self.inner, self.seconds, self.entries, self.clock = search, seconds, entries, clock
        self.kept: OrderedDict[str, tuple[float, list]] = OrderedDict()
        self.hits = self.misses = 0
        self.lock = threading.Lock()

    def search(self, request: Request) -> list:
        """A page's rows: they are as many as the request asks for."""
        key, now = repr(request), self.clock()
        with self.lock:
            if key in self.kept and now - self.kept[key][0] <= self.seconds:
                self.kept.move_to_end(key)
                self.hits += 1
                return self.kept[key][1]
        rows = self.inner(request).collect()
        with self.lock:
            self.misses += 1
            self.kept[key] = (now, rows)
            while len(self.kept) > self.entries:
                self.kept.popitem(last=False)
        return rows


class Guard:
    """What a search node checks of a request: pings are answered at once, ids are limited, and only so many requests run
    at a time."""

    def __init__(self, search: Callable[[Request], DataFrame], slots: int = 5, most_ids: int | None = None, clock: Callable[[], float] = time.monotonic):
        self.inner, self.most_ids, self.clock = search, most_ids, clock
        self.slots = threading.BoundedSemaphore(slots)
        self.served, self.seconds = 0, 0.0

    def search(self, request: Request | None, timeout: float | None = None):
        if request is None:
            return "pong"
        if self.most_ids is not None and len(request.ids or []) > self.most_ids:
            raise ValueError(f"{len(request.ids)} ids; at most {self.most_ids} are allowed")
        if not self.slots.acquire(timeout=timeout):
            raise TimeoutError("no free slot")
        began = self.clock()
        try:
            return self.inner(request)
        finally:
            self.served, self.seconds = self.served + 1, self.seconds + self.clock() - began
            self.slots.release()


class Composite:
    """Several searches for one request, one after another or at the same time; the rows of each page by name.

    A request in the background gives a future of the same.
    """

    def __init__(self, searches: dict[str, Callable[[Request], DataFrame]], parallel: bool = True):
        self.searches = searches
        self.pool = ThreadPoolExecutor(max(1, len(searches)) if parallel else 1)
        self.background = ThreadPoolExecutor(4)

    def search(self, request: Request) -> dict[str, list]:
        running = {name: self.pool.submit(lambda s=s: s(request).collect()) for name, s in self.searches.items()}
        return {name: f.result() for name, f in running.items()}

    def later(self, request: Request) -> Future:
        return self.background.submit(self.search, request)

    def close(self) -> None:
        self.background.shutdown()
        self.pool.shutdown()


class Balanced:
    """Spreads calls over equal searchers, to the one with the most free slots; waits if there is none."""

    def __init__(self, searchers: list[Callable[[Request], DataFrame]], slots: int = 5):
        self.searchers, self.free = searchers, [slots] * len(searchers)
        self.change = threading.Condition()

    def search(self, request: Request, timeout: float | None = None) -> DataFrame:
        with self.change:
            if not self.change.wait_for(lambda: max(self.free) > 0, timeout):
                raise TimeoutError("no free slot")
            at = self.free.index(max(self.free))
            self.free[at] -= 1
        try:
            return self.searchers[at](request)
        finally:
            with self.change:
                self.free[at] += 1
                self.change.notify()
