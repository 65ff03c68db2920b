"""Searching a table of documents: query text in, ranked rows, facets and lookups out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import ANALYZERS
from tidewell.operators import browse, facets, postings
from tidewell.plans import rewrite
from tidewell.plans.ast import Boolean, Clause, Fuzzy, MatchAll, Node, Phrase, Term
from tidewell.plans.compile import Compiler
from tidewell.plans.parser import parse
from tidewell.schema import Descriptor, Field
from tidewell.session import checkpoint


@dataclass
class Request:
    """What a client asks for.  Defaults: all documents, the first 20 rows by score; rows None: all of them."""

    query: str | None = None
    filters: list[str] = field(default_factory=list)
    start: int = 0
    rows: int | None = 20
    sort: str | None = None
    reverse: bool = False
    fields: list[str] | None = None
    fallbacks: dict[str, str] = field(default_factory=dict)
    group: str | None = None
    group_limit: int = 1
    facets: str | None = None
    ids: list[str] | None = None
    sanitize: bool = False


class Searcher:
    """Queries over a DataFrame.

    fields: column name to field type (see text.ANALYZERS).  Only the columns that a query names are
    analysed, so a scan reads no others.
    """

    def __init__(self, docs: DataFrame, key: str, fields: dict[str, str], defaults: list[str] | None = None, descriptor: Descriptor | None = None, operator: str = "and"):
        self.docs, self.key, self.fields = docs, key, fields
        self.descriptor = descriptor or Descriptor({n: Field(n, kind=k) for n, k in fields.items()}, defaults=tuple(defaults or [next(iter(fields))]), operator=operator)
        self._analysed: dict[tuple[str, str], list[str]] = {}

    def _analyzer(self, name: str):
        return ANALYZERS[self.fields.get(name, "default")]

    def tokens(self, name: str) -> Column:
        if name not in self.docs.columns:
            return F.array().cast("array<string>")
        if dict(self.docs.dtypes)[name].startswith("array"):
            return F.flatten(F.transform(name, self._analyzer(name)))
        return self._analyzer(name)(F.col(name).cast("string"))

    def _analyze(self, name: str, text: str) -> list[str]:
        """A query's words, by the same expression as the field's."""
        if (name, text) not in self._analysed:
            self._analyze_all([(name, text)])
        return self._analysed[name, text]

    def _analyze_all(self, pairs: list[tuple[str, str]]) -> None:
        """All words of a query that aren't known yet, in one job."""
        kinds = {(self.fields.get(name, "default"), text) for name, text in pairs if (name, text) not in self._analysed}
        if kinds:
            rows = self.docs.sparkSession.createDataFrame(sorted(kinds), "kind string, text string")
            by_kind = [F.when(F.col("kind") == k, ANALYZERS[k](F.col("text"))) for k in sorted({k for k, _ in kinds})]
            found = {(r["kind"], r["text"]): list(r["x"]) for r in rows.select("kind", "text", F.coalesce(*by_kind).alias("x")).collect()}
            self._analysed |= {(name, text): found[kind, text] for name, text in pairs if (kind := self.fields.get(name, "default"), text) in found}

    def _name(self, name: str) -> str:
        return f"_tokens_{name}"

    def _leaves(self, nodes: list[Node]) -> list[Node]:
        found: list[Node] = []

        def walk(n: Node) -> None:
            if isinstance(n, Boolean):
                for c in n.clauses:
                    walk(c.node)
            elif hasattr(n, "parts"):
                for p in n.parts:
                    walk(p)
            elif getattr(n, "field", None):
                found.append(n)

        for n in nodes:
            walk(n)
        return found

    def _names(self, nodes: list[Node]) -> list[str]:
        return list(dict.fromkeys(n.field for n in self._leaves(nodes)))

    def plan(self, query: str | None, filters: list[str] = ()) -> tuple[Node, list[Node], Compiler]:
        compiler = Compiler(lambda name: F.col(self._name(name)), self._analyze)
        node, others = parse(query, self.descriptor), [parse(f, self.descriptor) for f in filters]
        self._analyze_all([(n.field, n.text) for n in self._leaves([node, *others]) if isinstance(n, Term | Phrase | Fuzzy)])
        return node, others, compiler

    def _with_tokens(self, names: list[str]) -> DataFrame:
        return self.docs.withColumns({self._name(n): self.tokens(n) for n in names}) if names else self.docs

    def matches(self, query: str | None, filters: list[str] = ()) -> DataFrame:
        """The rows that match, unscored."""
        node, others, compiler = self.plan(query, filters)
        names = self._names([node, *others])
        rows = self._with_tokens(names)
        for n in (node, *others):
            if not isinstance(n, MatchAll):
                rows = rows.where(compiler.matches(n))
        return rows.drop(*map(self._name, names))

    def count(self, query: str | None, filters: list[str] = ()) -> int:
        return self.matches(query, filters).count()

    def scored(self, query: str | None, filters: list[str] = ()) -> DataFrame:
        """Matching rows with a TF-IDF score: sqrt(tf) * idf^2 / sqrt(tokens of the field) for each leaf.

        One aggregation over the documents counts, for all leaves together, how many documents match.
        """
        node, others, compiler = self.plan(query, filters)
        names = self._names([node, *others])
        rows = self._with_tokens(names)
        leaves = [n for n in dict.fromkeys(compiler.leaves(node)) if getattr(n, "field", None)]
        counts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(compiler.matches(n), 1)).alias(f"d{i}") for i, n in enumerate(leaves)]).first()
        idfs = {n: postings.idf(F.lit(float(counts[f"d{i}"])), F.lit(float(max(1, counts["n"])))) for i, n in enumerate(leaves)}

        def weight(n: Node) -> Column:
            tokens = F.col(self._name(n.field))
            words = self._analyze(n.field, n.text) if type(n).__name__ == "Term" else []
            tf = F.size(F.filter(tokens, lambda t: t == words[0])) if len(words) == 1 else F.lit(1)
            return F.sqrt(tf.cast("double")) * F.pow(idfs[n], 2) / F.sqrt(F.greatest(F.size(tokens), F.lit(1)).cast("double"))

        for n in (node, *others):
            if not isinstance(n, MatchAll):
                rows = rows.where(compiler.matches(n))
        return rows.withColumn("score", compiler.score(node, weight).cast("double")).drop(*map(self._name, names))

    def by_ids(self, ids: list, rows: DataFrame | None = None) -> DataFrame:
        """The documents of a request's ids, however many: a semi-join with them."""
        kind = self.docs.schema[self.key].dataType.simpleString()
        asked = self.docs.sparkSession.createDataFrame([(str(i),) for i in dict.fromkeys(ids)], "_id string").select(F.col("_id").try_cast(kind).alias(self.key))
        return (self.docs if rows is None else rows).join(F.broadcast(asked), self.key, "left_semi")

    def search(self, request: Request, ordered: bool = True) -> DataFrame:
        """One page of rows: the wanted fields (with fallbacks for empty ones), the score and the key.

        A request with ids asks for these documents (that pass the filters); each scores 1.  If all rows are asked
        for, the order may be left out.
        """
        query = request.query
        if request.sanitize and query:
            query = rewrite.sanitize(query)
        if request.ids:
            hits = self.by_ids(request.ids, self.matches(None, request.filters)).withColumn("score", F.lit(1.0))
        else:
            hits = self.scored(query, request.filters)
        if request.group:
            return browse.group_results(hits, request.group, request.group_limit, request.rows, key=self.key)
        order = [F.desc("score"), F.asc(self.key)] if request.sort in (None, "score") else browse.sort_order(request.sort, request.reverse, key=self.key)
        whole = request.rows is None and not request.start
        chosen = hits if whole and not ordered else browse.page(hits, order, request.start, request.rows)
        wanted = [c for c in (request.fields or self.docs.columns) if c not in (self.key, "score")]
        shown = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(request.fallbacks[c])).alias(c) if c in request.fallbacks else F.col(c) for c in wanted]
        return chosen.select(self.key, *shown, "score")

    def facet(self, request: Request, whole: bool = False) -> dict[str, DataFrame]:
        """Facets over all hits of a request; whole: all terms of each, so that counts of several sources can be summed."""
        hits = self.matches(request.query, request.filters)
        answers = {}
        for wanted in facets.parse_request(request.facets or ""):
            terms = facets.doc_terms(hits, self.key, [wanted.name])
            counts = facets.term_counts(terms)
            answers[wanted.name] = counts if whole else facets.answer(counts, wanted)
        return answers

    def lookup(self, name: str, term: str, query: str | None = None, **options) -> DataFrame:
        """A window in the sorted values of a field, of all documents or of a query's hits."""
        terms = facets.doc_terms(self.matches(query), self.key, [name])
        return browse.index_lookup(facets.term_counts(terms), term, **options)

    def more_like(self, key, name: str, limit: int = 10, **options) -> DataFrame:
        """The documents most like one; of the others, only the terms that it has are gathered."""
        own = self.docs.where(F.col(self.key) == F.lit(key)).select(F.explode(self.tokens(name)).alias("term")).distinct()
        terms = [r["term"] for r in own.collect()]  # of one document
        rows = self.docs.select(F.col(self.key).alias("doc"), self.tokens(name).alias("tokens")).where(F.size("tokens") > 0)
        found = rows.select("doc", F.filter("tokens", lambda t: t.isin(terms)).alias("tokens"))
        posts = checkpoint(found.select("doc", F.explode("tokens").alias("term")).groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf")))
        return postings.more_like(posts, key, limit, total=rows.count(), **options).withColumnRenamed("doc", self.key)

    def explain(self, query: str | None) -> str:
        from tidewell.plans.ast import show

        return show(parse(query, self.descriptor))


class SearchService:
    """The calls that clients of the search service make; each returns a DataFrame or plain values."""

    def __init__(self, searcher: Searcher, suggestions=None, records: DataFrame | None = None):
        self.searcher, self.suggestions, self.records = searcher, suggestions, records

    def simple_search(self, query: str, rows: int = 20, start: int = 0) -> DataFrame:
        return self.searcher.search(Request(query, rows=rows, start=start))

    def simple_search_sorted(self, query: str, rows: int, start: int, sort: str, reverse: bool = False) -> DataFrame:
        return self.searcher.search(Request(query, rows=rows, start=start, sort=sort, reverse=reverse))

    def filter_search_sorted(self, filter: str, query: str, rows: int, start: int, sort: str, reverse: bool = False) -> DataFrame:
        return self.searcher.search(Request(query, [filter], start, rows, sort, reverse))

    def simple_facet(self, query: str, wanted: str) -> dict[str, DataFrame]:
        return self.searcher.facet(Request(query, facets=wanted))

    def advanced_facet(self, query: str, filter: str, wanted: str) -> dict[str, DataFrame]:
        return self.searcher.facet(Request(query, [filter], facets=wanted))

    def hierarchical_facet(self, query: str, path: str, request: facets.Hierarchy = facets.Hierarchy()) -> DataFrame:
        hits = self.searcher.matches(query)
        return facets.hierarchical(hits.select(F.col(self.searcher.key).alias("doc"), F.col(path).alias("path")), request)

    def index_lookup(self, field: str, term: str, delta: int = -5, length: int = 20) -> DataFrame:
        return self.searcher.lookup(field, term, delta=delta, length=length)

    def extended_index_lookup(self, query: str, field: str, term: str, delta: int = -5, length: int = 20, min_count: int = 0) -> DataFrame:
        return self.searcher.lookup(field, term, query, delta=delta, length=length, min_count=min_count)

    def more_like_this(self, key, field: str, rows: int = 10) -> DataFrame:
        return self.searcher.more_like(key, field, rows)

    def get_suggestions(self, prefix: str, limit: int = 10) -> DataFrame:
        return self.suggestions.suggest(prefix, limit)

    def commit_query(self, query: str, hits: int) -> None:
        self.suggestions.add(query, hits)

    def delete_suggestion(self, query: str) -> None:
        self.suggestions.delete(query)

    def did_you_mean(self, word: str, field: str, limit: int = 5) -> DataFrame:
        from tidewell.operators.suggest import did_you_mean

        posts = postings.postings(self.searcher.docs, self.searcher.key, [field], self.searcher._analyzer(field))
        return did_you_mean(postings.statistics(posts), word, limit)

    def get_field(self, key, field: str) -> str | None:
        row = self.searcher.docs.where(F.col(self.searcher.key) == F.lit(key)).select(field).first()
        return None if row is None else row[0]

    def get_records(self, ids: list) -> DataFrame:
        from tidewell.operators.records import multi_get

        return multi_get(self.records, ids)

    def direct_json(self, request: dict) -> list[str]:
        """A request as plain keys and values; the page's rows as JSON."""
        known = {k: v for k, v in request.items() if k in Request.__dataclass_fields__}
        return self.searcher.search(Request(**known)).toJSON().collect()


def with_filters(node: Node, filters: list[Node]) -> Node:
    """A query and its filters as one tree."""
    return Boolean((Clause("must", node), *[Clause("must", f) for f in filters])) if filters else node
