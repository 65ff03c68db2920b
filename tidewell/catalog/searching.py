"""Queries of the query language, scoring and term statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.text import standard
from tidewell.operators import postings
from tidewell.plans.compile import Compiler
from tidewell.plans.parser import parse
from tidewell.schema import Descriptor, Field, Group
from tidewell.search import Request, Searcher

from . import text_sql
from .common import Tables, query

DOCS_SQL = f"(SELECT doc_id, lang, source, n_chars, {text_sql.tokens('text')} AS w FROM documents)"
KINDS = {"text": "text", "lang": "verbatim", "source": "verbatim"}


def _searcher(t: Tables, operator: str = "and") -> Searcher:
    return Searcher(t.texts, "doc_id", KINDS, ["text"], operator=operator)


def _matching(name: str, text: str, where: str, operator: str = "and", filters: tuple[str, ...] = ()) -> None:
    @query(name, f"SELECT doc_id FROM {DOCS_SQL} WHERE {where}")
    def _(t: Tables):
        return _searcher(t, operator).matches(text, filters).select("doc_id")


def _any(test: str) -> str:
    return f"len(list_filter(w, lambda t: {test})) > 0"


_matching("qry_all", "*", "TRUE")
_matching("qry_term", "text:with", "list_contains(w, 'with')")
_matching("qry_default_field", "with", "list_contains(w, 'with')")
_matching("qry_bool", "(with OR que) AND -source:src3 AND NOT der", "(list_contains(w, 'with') OR list_contains(w, 'que')) AND source <> 'src3' AND NOT list_contains(w, 'der')")
_matching("qry_bool_or", "+lang:en with for", "lang = 'en'", "or")
_matching("qry_phrase", 'text:"of the"', "len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0")
_matching("qry_phrase_slop", 'text:"in the"~2', "len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'in' AND len(list_filter([i - 1, i + 1, i + 2, i + 3], lambda j: j >= 1 AND j <= len(w) AND w[j] = 'the')) > 0)) > 0")
_matching("qry_prefix", "text:thing*", _any("starts_with(t, 'thing')"))
_matching("qry_wildcard", "text:t?in*ing", _any("regexp_full_match(t, 't.in.*ing')"))
_matching("qry_range", "text:[thin TO thine}", _any("t >= 'thin' AND t < 'thine'"))
_matching("qry_range_open", "source:{src5 TO *]", "source > 'src5'")
_matching("qry_regexp", "text:/th(in|on)e?r/", _any("regexp_full_match(t, 'th(in|on)e?r')"))
_matching("qry_fuzzy", "text:whither~2", _any("levenshtein(t, 'whither') <= 2"))
_matching("qry_filters", "with", "list_contains(w, 'with') AND lang = 'en' AND source <> 'src1'", filters=("lang:en", "-source:src1"))
_matching("qry_ids", 'doc_id:"5" OR doc_id:"17"', "doc_id IN (5, 17)")
_matching("qry_unknown_field", "nothing:x OR with", "list_contains(w, 'with')")


@query("qry_search_page", f"SELECT doc_id, lang, n_chars FROM {DOCS_SQL} WHERE list_contains(w, 'with') ORDER BY doc_id DESC LIMIT 30 OFFSET 10")
def _(t: Tables):
    return _searcher(t).search(Request("with", start=10, rows=30, sort="doc_id", reverse=True, fields=["lang", "n_chars"])).select("doc_id", "lang", "n_chars")


def _part_descriptor() -> Descriptor:
    fields = {"p_name": Field("p_name", kind="text", query_boost=2.0), "p_type": Field("p_type", kind="text"), "p_brand": Field("p_brand", kind="text", aliases=(("maker", None),))}
    return Descriptor(fields, {"about": Group("about", ("p_name", "p_type"))}, defaults=("about",))


@query(
    "qry_group_dismax",
    f"""SELECT p_partkey, score FROM (SELECT p_partkey, greatest(CASE WHEN list_contains({text_sql.tokens("p_name")}, 'ring') THEN 6.0 ELSE 0.0 END, CASE WHEN list_contains({text_sql.tokens("p_type")}, 'ring') THEN 1.5 ELSE 0.0 END)::DOUBLE AS score FROM part) WHERE score > 0""",
)
def _(t: Tables):
    """Descriptor boost 2 and a query boost of 3 for one field and of 1.5 for the group's other field."""
    searcher = Searcher(t.part, "p_partkey", {"p_name": "text", "p_type": "text"}, descriptor=_part_descriptor())
    node = parse("about:ring boost(p_name^3 about^1.5)", searcher.descriptor)
    compiler = Compiler(searcher.tokens, searcher._analyze)
    rows = t.part.withColumn("score", compiler.score(node, lambda leaf: F.lit(1.0)).cast("double"))
    return rows.where(compiler.matches(node)).select("p_partkey", "score")


@query("qry_alias", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#13', 'Brand#21')")
def _(t: Tables):
    searcher = Searcher(t.part, "p_partkey", {"p_brand": "text"}, descriptor=_part_descriptor())
    return searcher.matches('maker:"brand#13" OR maker:BRAND#21').select("p_partkey")


POSTINGS_SQL = f"(SELECT term, doc_id AS doc, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM {DOCS_SQL}) GROUP BY ALL)"
TERMS = ["with", "thing", "que"]


@query(
    "scr_tfidf",
    f"""WITH p AS MATERIALIZED {POSTINGS_SQL}, n AS (SELECT count(DISTINCT doc) AS n FROM p), l AS (SELECT doc, sum(tf) AS length FROM p GROUP BY doc), d AS (SELECT term, count(*) AS df FROM p WHERE term IN ('with', 'thing', 'que') GROUP BY term)
    SELECT doc, round(sum(sqrt(tf) * pow(1 + ln(n / (df + 1.0)), 2) / sqrt(length)), 6) AS score FROM p JOIN d USING (term) JOIN l USING (doc), n GROUP BY doc""",
)
def _(t: Tables):
    tokens = t.texts.select(F.col("doc_id").alias("doc"), standard("text").alias("w"))
    lengths = tokens.select("doc", F.size("w").alias("length")).where("length > 0")
    # Only the terms that are asked for are exploded.
    wanted = tokens.select("doc", F.explode(F.filter("w", lambda w: w.isin(TERMS))).alias("term"))
    posts = wanted.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"))
    return postings.tf_idf(posts, TERMS, lengths=lengths).select("doc", F.round("score", 6).alias("score"))


@query(
    "scr_search",
    f"""WITH x AS (SELECT doc_id, len(list_filter(w, lambda t: t = 'with')) AS a, len(list_filter(w, lambda t: t = 'for')) AS b, len(w) AS n FROM {DOCS_SQL}),
    s AS (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (WHERE a > 0))::DOUBLE AS da, (count(*) FILTER (WHERE b > 0))::DOUBLE AS db FROM x)
    SELECT doc_id, round(sqrt(a::DOUBLE) * pow(1 + ln(s.n / (da + 1)), 2) / sqrt(x.n::DOUBLE) + 2 * sqrt(b::DOUBLE) * pow(1 + ln(s.n / (db + 1)), 2) / sqrt(x.n::DOUBLE), 6) AS score FROM x, s WHERE a > 0 AND b > 0""",
)
def _(t: Tables):
    return _searcher(t).scored("with AND for^2").select("doc_id", F.round("score", 6).alias("score"))


@query(
    "scr_mlt",
    f"""WITH p AS MATERIALIZED {POSTINGS_SQL}, n AS (SELECT count(DISTINCT doc)::DOUBLE AS n FROM p),
    b AS (SELECT term, df FROM (SELECT o.term, o.tf * (1 + ln(n / (df + 1))) AS w, df FROM (SELECT * FROM p WHERE doc = 12 AND length(term) >= 4) o JOIN (SELECT term, count(*) AS df FROM p GROUP BY 1) USING (term), n WHERE df >= 2) ORDER BY round(w, 9) DESC, term LIMIT 10)
    SELECT doc, round(sum(sqrt(tf) * pow(1 + ln(n / (df + 1)), 2)), 5) AS score FROM p JOIN b USING (term), n WHERE doc <> 12 GROUP BY doc ORDER BY round(sum(sqrt(tf) * pow(1 + ln(n / (df + 1)), 2)), 9) DESC, doc LIMIT 10""",
)
def _(t: Tables):
    found = _searcher(t).more_like(12, "text", 10, max_terms=10, min_length=4)
    return found.select(F.col("doc_id").alias("doc"), F.round("score", 5).alias("score"))


@query("tst_extract", f"SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM {POSTINGS_SQL} GROUP BY term HAVING count(*) >= 5")
def _(t: Tables):
    return postings.extract(t.texts, ["text"], min_df=5)


@query(
    "tst_fields_summed",
    f"SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM (SELECT term, f, p_partkey, count(*) AS tf FROM (SELECT p_partkey, 'a' AS f, unnest({text_sql.tokens('p_name')}) AS term FROM part UNION ALL SELECT p_partkey, 'b', unnest({text_sql.tokens('p_type')}) FROM part) GROUP BY ALL) GROUP BY term",
)
def _(t: Tables):
    return postings.extract(t.part, ["p_name", "p_type"])


@query("tst_postings", f"SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM {POSTINGS_SQL} WHERE starts_with(term, 'th') GROUP BY term")
def _(t: Tables):
    """The same from postings."""
    posts = postings.postings(t.texts, "doc_id", ["text"])
    return postings.statistics(posts.where(F.col("term").startswith("th")))


def _stats_sql(lang: str) -> str:
    return f"(SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM {DOCS_SQL} WHERE lang = '{lang}') GROUP BY ALL) GROUP BY term)"


@query(
    "tst_merge",
    f"""SELECT term, (coalesce(a.tf, 0) + coalesce(b.tf, 0))::BIGINT AS tf, coalesce(a.df, 0) + coalesce(b.df, 0) AS df, coalesce(a.tf, 0)::BIGINT AS tf_en, coalesce(a.df, 0) AS df_en, coalesce(b.tf, 0)::BIGINT AS tf_de, coalesce(b.df, 0) AS df_de
    FROM {_stats_sql("en")} a FULL JOIN {_stats_sql("de")} b USING (term) WHERE coalesce(a.df, 0) + coalesce(b.df, 0) >= 3""",
)
def _(t: Tables):
    dumps = {lang: postings.extract(t.texts.where(F.col("lang") == lang), ["text"]) for lang in ("en", "de")}
    return postings.merge_statistics(dumps, 3)


@query("tst_unique", f"SELECT count(DISTINCT term) AS terms FROM {POSTINGS_SQL}")
def _(t: Tables):
    terms = t.texts.select(F.lit("text").alias("field"), F.explode(F.array_distinct(standard("text"))).alias("term"))
    return postings.unique_terms(terms).agg(F.count(F.lit(1)).alias("terms"))


@query(
    "tst_boost",
    f"""WITH a AS {_stats_sql("en")}, b AS {_stats_sql("fr")}, n AS (SELECT count(*) FILTER (WHERE lang = 'en')::DOUBLE AS na, count(*) FILTER (WHERE lang = 'fr')::DOUBLE AS nb FROM documents)
    SELECT term, round(pow(1 + ln((na + nb) / (coalesce(a.df, 0) + coalesce(b.df, 0) + 1.0)), 2) / pow(1 + ln(na / (coalesce(a.df, 1) + 1.0)), 2), 6) AS boost FROM a FULL JOIN b USING (term), n""",
)
def _(t: Tables):
    counts = {r["lang"]: r["count"] for r in t.documents.groupBy("lang").count().collect()}
    targets = {lang: (postings.extract(t.texts.where(F.col("lang") == lang), ["text"]), counts.get(lang, 0)) for lang in ("en", "fr")}
    return postings.term_boosts(targets, "en").select("term", F.round("boost", 6).alias("boost"))


@query("qry_count", f"SELECT count(*) AS hits FROM {DOCS_SQL} WHERE list_contains(w, 'with')")
def _(t: Tables):
    return _searcher(t).matches("with").agg(F.count(F.lit(1)).alias("hits"))


@query("qry_fallback", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'none' ELSE lang END AS lang FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def _(t: Tables):
    """Empty values and missing ones fall back."""
    docs = t.texts.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 2, F.col("lang")))
    searcher = Searcher(docs, "doc_id", KINDS, ["text"])
    found = searcher.search(Request("*", rows=25, sort="n_chars", reverse=True, fields=["lang"], fallbacks={"lang": "none"}))
    return found.select("doc_id", "lang")
