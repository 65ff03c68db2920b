"""Searching written postings: a query reads its fields' folders and its terms' row groups, not the texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import postings
from tidewell.plans.ast import Boolean, DisMax, MatchAll, Node, Phrase, Range, Term
from tidewell.plans.compile import Compiler
from tidewell.schema import Descriptor
from tidewell.search import Searcher
from tidewell.sources import sinks


def write_index(searcher: Searcher, path: str, fields: list[str] | None = None) -> None:
    """The postings of a searcher's fields with positions, and its documents with the fields' lengths."""
    names = fields or list(searcher.fields)
    tokens = {n: searcher.tokens(n) for n in names}
    sinks.write_index(postings.placed(searcher.docs, searcher.key, tokens), f"{path}/postings")
    searcher.docs.withColumns({_length(n): F.size(c) for n, c in tokens.items()}).write.mode("overwrite").parquet(f"{path}/documents")


def _length(name: str) -> str:
    return f"_length_{name}"


class _Flags(Compiler):
    """Leaves as columns that tell whether a document has them."""

    def __init__(self, leaves: list[Node], analyze: Callable[[str, str], list[str]]):
        super().__init__(lambda name: F.lit(None), analyze)
        self.numbers = {n: i for i, n in enumerate(leaves)}

    def _leaf(self, node: Node) -> Column:
        return F.col(f"_f{self.numbers[node]}")

    def holds_without_any(self, node: Node) -> bool:
        """Whether a document without any of the leaves matches."""
        if isinstance(node, Boolean):
            must = [self.holds_without_any(c.node) for c in node.clauses if c.occur == "must"]
            should = [self.holds_without_any(c.node) for c in node.clauses if c.occur == "should"]
            banned = any(self.holds_without_any(c.node) for c in node.clauses if c.occur == "not")
            return all(must) and (bool(must) or not should or any(should)) and not banned
        if isinstance(node, DisMax):
            return any(map(self.holds_without_any, node.parts))
        return isinstance(node, MatchAll)


class IndexSearcher(Searcher):
    """A Searcher over what write_index has written; the same queries give the same rows and scores."""

    def __init__(self, spark: SparkSession, path: str, key: str, fields: dict[str, str], defaults: list[str] | None = None, descriptor: Descriptor | None = None, operator: str = "and"):
        whole = spark.read.parquet(f"{path}/documents")
        super().__init__(whole.drop(*map(_length, fields)), key, fields, defaults, descriptor, operator)
        self.whole, self.posts = whole, spark.read.parquet(f"{path}/postings")

    def _words(self, node: Node) -> list[str] | None:
        """The single terms that a leaf asks for; None if it tests terms."""
        return self._analyze(node.field, node.text) if isinstance(node, Term | Phrase) else None

    def _hits(self, leaves: list[Node], compiler: Compiler) -> DataFrame:
        """(key, _f0.., _tf0..): the documents with any leaf, which leaves they have, and how often a leaf's only word."""
        wanted, aggregates, derived = [], [], {}
        for i, node in enumerate(leaves):
            words, here = self._words(node), F.col("field") == node.field
            if words is not None and len(words) != 1:
                spots = []
                for j, word in enumerate(words):
                    wanted.append(here & (F.col("term") == word))
                    aggregates.append(F.max(F.when(wanted[-1], F.col("positions"))).alias(f"_p{i}_{j}"))
                    spots.append(_shifted(F.coalesce(f"_p{i}_{j}", F.array().cast("array<int>")), j))
                derived[f"_f{i}"] = _together(spots, getattr(node, "slop", 0)) if spots else F.lit(False)
                derived[f"_tf{i}"] = F.lit(1).cast("bigint")
                continue
            if words is not None:
                test = here & (F.col("term") == words[0])
            elif isinstance(node, Range):
                low = F.lit(True) if node.low is None else (F.col("term") >= node.low if node.include_low else F.col("term") > node.low)
                high = F.lit(True) if node.high is None else (F.col("term") <= node.high if node.include_high else F.col("term") < node.high)
                test = here & low & high
            else:
                test = here & compiler.token_test(node)(F.col("term"))
            wanted.append(test)
            aggregates += [F.max(F.coalesce(test, F.lit(False))).alias(f"_f{i}"), F.sum(F.when(test, F.col("tf")).otherwise(0)).alias(f"_n{i}")]
            derived[f"_tf{i}"] = F.col(f"_n{i}") if isinstance(node, Term) else F.lit(1).cast("bigint")
        rows = self.posts.where(F.col("field").isin(sorted({n.field for n in leaves})))
        asked = [self._words(n) for n in leaves]
        if all(w is not None for w in asked):
            rows = rows.where(F.col("term").isin(sorted({w for words in asked for w in words})))
        if not aggregates:
            aggregates = [F.lit(False).alias("_none")]
        rows = rows.where(reduce(Column.__or__, wanted, F.lit(False)))
        return rows.groupBy(F.col("doc").alias(self.key)).agg(*aggregates).withColumns(derived)

    def _found(self, query: str | None, filters: list[str]) -> tuple[DataFrame, Node, _Flags, list[Node]]:
        node, others, compiler = self.plan(query, filters)
        leaves = [n for n in dict.fromkeys(x for n in (node, *others) for x in _all_leaves(n)) if getattr(n, "field", None) in self.fields]
        flags = _Flags(leaves, self._analyze)
        # A leaf of a field that isn't indexed matches nothing.
        flags.numbers |= {n: -1 for x in (node, *others) for n in _all_leaves(x) if getattr(n, "field", None) and n not in flags.numbers}
        every = [n for n in (node, *others) if not isinstance(n, MatchAll)]
        if not leaves or all(map(flags.holds_without_any, every)):
            rows = self.whole.join(self._hits(leaves, compiler), self.key, "left") if leaves else self.whole
            rows = rows.withColumns({f"_f{i}": F.coalesce(f"_f{i}", F.lit(False)) for i in range(len(leaves))})
        else:
            rows = self.whole.join(self._hits(leaves, compiler), self.key)
        rows = rows.withColumn("_f-1", F.lit(False))
        for n in every:
            rows = rows.where(flags.matches(n))
        return rows, node, flags, leaves

    def matches(self, query: str | None, filters: list[str] = ()) -> DataFrame:
        return self._found(query, list(filters))[0].select(*self.docs.columns)

    def scored(self, query: str | None, filters: list[str] = ()) -> DataFrame:
        rows, node, flags, leaves = self._found(query, list(filters))
        scored = [n for n in dict.fromkeys(flags.leaves(node)) if n in leaves]
        numbers = [flags.numbers[n] for n in scored]
        total = self.whole.count()
        found = self._hits(leaves, flags).agg(F.count(F.lit(1)), *[F.count(F.when(F.col(f"_f{i}"), 1)).alias(f"d{i}") for i in numbers]).first() if scored else {}
        idfs = {n: postings.idf(F.lit(float(found[f"d{flags.numbers[n]}"])), F.lit(float(max(1, total)))) for n in scored}

        def weight(n: Node) -> Column:
            tf = F.coalesce(F.col(f"_tf{flags.numbers[n]}"), F.lit(0))
            return F.sqrt(tf.cast("double")) * F.pow(idfs[n], 2) / F.sqrt(F.greatest(F.col(_length(n.field)), F.lit(1)).cast("double")) if n in idfs else F.lit(0.0)

        return rows.withColumn("score", flags.score(node, weight).cast("double")).select(*self.docs.columns, "score")


def _all_leaves(node: Node) -> list[Node]:
    if isinstance(node, Boolean):
        return [x for c in node.clauses for x in _all_leaves(c.node)]
    if isinstance(node, DisMax):
        return [x for p in node.parts for x in _all_leaves(p)]
    return [node]


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _together(spots: list[Column], slop: int) -> Column:
    """Whether the words, whose places are given less their own in the phrase, stand in a row or within slop of each other."""
    if not spots:
        return F.lit(False)
    if slop == 0:
        return F.exists(spots[0], lambda p: reduce(Column.__and__, [F.array_contains(x, p) for x in spots[1:]], F.lit(True)))
    return F.exists(F.concat(*spots), lambda s: reduce(Column.__and__, [F.exists(x, lambda p: (p >= s) & (p <= s + slop)) for x in spots]))
