"""Queries of facets, browsing, paging and grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import browse, facets

from . import text_sql
from .common import Tables, query

WORDS_SQL = "(SELECT p_partkey AS doc, unnest(string_split(lower(p_name), ' ')) AS term FROM part)"


def _words(t: Tables):
    return t.part.select(F.col("p_partkey").alias("doc"), F.explode(F.split(F.lower("p_name"), " ")).alias("term"))


@query("fct_count", "SELECT p_brand AS term, count(DISTINCT p_partkey) AS count, (row_number() OVER (ORDER BY count(DISTINCT p_partkey) DESC, p_brand))::INTEGER AS rank FROM part GROUP BY 1 ORDER BY count DESC, term LIMIT 15")
def _(t: Tables):
    return facets.top_by_count(facets.term_counts(facets.doc_terms(t.part, "p_partkey", ["p_brand"])), 15)


@query(
    "fct_index_prefix",
    f"""SELECT term, count, (n - o)::INTEGER AS position FROM (SELECT term, count(DISTINCT doc) AS count, row_number() OVER (ORDER BY term) AS n FROM {WORDS_SQL} GROUP BY 1),
    (SELECT count(DISTINCT term) + 1 AS o FROM {WORDS_SQL} WHERE term < 'g') WHERE n - o BETWEEN -3 AND 6""",
)
def _(t: Tables):
    return facets.by_term_order(facets.term_counts(_words(t)), 10, -3, "g")


@query(
    "fct_index_reverse",
    f"""SELECT term, count, (row_number() OVER (ORDER BY term DESC) - 1)::INTEGER AS position FROM (SELECT term, count(DISTINCT doc) AS count FROM {WORDS_SQL} GROUP BY 1) WHERE count >= 3 AND term <= 'm' ORDER BY term DESC LIMIT 8""",
)
def _(t: Tables):
    return facets.by_term_order(facets.term_counts(_words(t)), 8, 0, "m", min_count=3, reverse=True)


@query(
    "fct_locale_order",
    f"SELECT term, count, (row_number() OVER (ORDER BY term COLLATE da, term) - 1)::INTEGER AS position FROM (SELECT term, count(DISTINCT doc) AS count FROM {WORDS_SQL} GROUP BY 1) ORDER BY position LIMIT 12",
)
def _(t: Tables):
    return facets.by_term_order(facets.term_counts(_words(t)), 12, locale="da")


FIELDS_SQL = "(SELECT p_partkey AS doc, unnest([p_brand, p_type]) AS term FROM part)"


@query("fct_group", f"SELECT term, count(DISTINCT doc) AS count FROM {FIELDS_SQL} GROUP BY 1")
def _(t: Tables):
    return facets.term_counts(facets.doc_terms(t.part, "p_partkey", ["p_brand", "p_type"]))


@query("fct_group_per_field", "SELECT term, count(*) AS count FROM (SELECT doc_id, unnest([lang, source, lang]) AS term FROM documents) GROUP BY 1")
def _(t: Tables):
    docs = t.documents.withColumn("again", F.col("lang"))
    return facets.term_counts(facets.doc_terms(docs, "doc_id", ["lang", "source", "again"]), distinct_docs=False)


@query("fct_totals", f"SELECT sum(c)::BIGINT AS total_references, count(*) FILTER (WHERE c >= 5) AS valid_tags, count(*) AS potential_tags FROM (SELECT count(DISTINCT doc) AS c FROM {WORDS_SQL} GROUP BY term)")
def _(t: Tables):
    return facets.totals(facets.term_counts(_words(t)), 5)


@query("fct_after_query", "SELECT source AS term, count(*) AS count, (row_number() OVER (ORDER BY count(*) DESC, source))::INTEGER AS rank FROM documents WHERE lang = 'en' AND list_contains(" + text_sql.tokens("text") + ", 'the') GROUP BY 1 ORDER BY count DESC, term LIMIT 15")
def _(t: Tables):
    from tidewell.search import Searcher

    searcher = Searcher(t.texts, "doc_id", {"text": "text", "lang": "verbatim", "source": "verbatim"}, defaults=["text"])
    hits = searcher.matches("text:the AND lang:en")
    return facets.top_by_count(facets.term_counts(facets.after_query(facets.doc_terms(t.documents, "doc_id", ["source"]), hits, "doc_id")), 15)


@query(
    "fct_range_num",
    "SELECT (r * 50000.0)::DOUBLE AS bucket_start, count(o_orderkey) AS count FROM range(12) x(r) LEFT JOIN orders ON o_totalprice >= r * 50000 AND o_totalprice < (r + 1) * 50000 GROUP BY r",
)
def _(t: Tables):
    return facets.number_ranges(t.orders, "o_totalprice", 0.0, 600000.0, 50000.0)


@query(
    "fct_range_date",
    """SELECT (m::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE 'UTC' AS bucket_start, count(o_orderkey) AS count FROM generate_series(TIMESTAMP '1993-01-01', TIMESTAMP '1996-12-01', INTERVAL 1 MONTH) g(m)
    LEFT JOIN orders ON o_orderdate >= m AND o_orderdate < m + INTERVAL 1 MONTH GROUP BY m""",
)
def _(t: Tables):
    ranges = facets.date_ranges(t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), "o_orderdate", "1993-01-01", "1997-01-01", "month")
    return ranges.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


@query(
    "fct_range_merge",
    "SELECT key, count(*) AS count FROM (SELECT (floor(l_quantity / 10) * 10)::BIGINT::VARCHAR AS key FROM lineitem) GROUP BY 1",
)
def _(t: Tables):
    key = (F.floor(F.col("l_quantity") / 10) * 10).cast("bigint").alias("key")
    parts = [t.lineitem.where(f"l_linenumber % 2 = {i}").groupBy(key).agg(F.count(F.lit(1)).alias("count")) for i in (0, 1)]
    return facets.merge_ranges(parts)


TREE_SQL = """d AS (SELECT c_custkey AS doc, r_name AS a, n_name AS b, c_mktsegment AS c FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
l3 AS (SELECT 3 AS level, a || '/' || b || '/' || c AS path, a || '/' || b AS parent, count(*) AS own, count(*) AS total FROM d GROUP BY ALL HAVING count(*) >= {m}),
l2 AS (SELECT 2 AS level, x.path, x.parent, 0::BIGINT AS own, coalesce(sum(l3.total), 0) AS total FROM (SELECT DISTINCT a || '/' || b AS path, a AS parent FROM d) x LEFT JOIN l3 ON l3.parent = x.path GROUP BY ALL HAVING coalesce(sum(l3.total), 0) >= 1),
l1 AS (SELECT 1 AS level, x.path, '' AS parent, 0::BIGINT AS own, coalesce(sum(l2.total), 0) AS total FROM (SELECT DISTINCT a AS path FROM d) x LEFT JOIN l2 ON l2.parent = x.path GROUP BY ALL HAVING coalesce(sum(l2.total), 0) >= 1),
u AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"""


def _paths(t: Tables):
    joined = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.select(F.col("c_custkey").alias("doc"), F.concat_ws("/", "r_name", "n_name", "c_mktsegment").alias("path"))


@query("fct_hierarchical", f"WITH {TREE_SQL.format(m=1)} SELECT level, path, parent, own, total::BIGINT AS total, (row_number() OVER (PARTITION BY parent ORDER BY total DESC, path))::INTEGER AS rank FROM u")
def _(t: Tables):
    return facets.hierarchical(_paths(t))


@query(
    "fct_hierarchical_limits",
    f"""WITH {TREE_SQL.format(m=3)}, r AS (SELECT *, (row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN level = 1 THEN 0 ELSE -total END, path))::INTEGER AS rank FROM u),
    a AS (SELECT * FROM r WHERE level = 1), b AS (SELECT * FROM r WHERE level = 2 AND rank <= 4), c AS (SELECT * FROM r WHERE level = 3 AND parent IN (SELECT path FROM b))
    SELECT level, path, parent, own, total::BIGINT AS total, rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""",
)
def _(t: Tables):
    special = {1: facets.Level(order="base"), 2: facets.Level(max_tags=4), 3: facets.Level(min_count=3)}
    return facets.hierarchical(_paths(t), facets.Hierarchy(special=special))


@query(
    "fct_url_paths",
    """WITH p AS (SELECT page_id, split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) AS path FROM pages), h AS (SELECT DISTINCT page_id, string_split(path, '/') AS x FROM p)
    SELECT level, path, count(*)::BIGINT AS total FROM (SELECT page_id, unnest(range(1, least(len(x), 5) + 1)) AS level, x FROM h), LATERAL (SELECT array_to_string(x[1:level], '/') AS path) GROUP BY ALL""",
)
def _(t: Tables):
    path = F.regexp_extract("url", r"^\w+://([^?#]*)", 1)
    every = facets.Hierarchy(default=facets.Level(max_tags=-1))
    return facets.hierarchical(t.pages.select(F.col("page_id").alias("doc"), path.alias("path")), every).select(F.col("level").cast("bigint").alias("level"), "path", "total")


@query("fct_merge", "SELECT p_type AS term, count(*) AS count, 1 AS reliability FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def _(t: Tables):
    small, large = (facets.term_counts(facets.doc_terms(t.part.where(w), "p_partkey", ["p_type"])) for w in ("p_size <= 25", "p_size > 25"))
    return facets.merge([small.withColumn("reliability", F.lit(facets.PRECISE)), large.withColumn("reliability", F.lit(facets.LESS))])


RENAMES = "en;de - germanic, fr;es - romance, en - english"


def _renames(how: str):
    sql = f"""SELECT coalesce(m.b, lang) AS term, {how}(n)::BIGINT AS count FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
    LEFT JOIN (VALUES ('en', 'germanic'), ('de', 'germanic'), ('fr', 'romance'), ('es', 'romance'), ('en', 'english')) m(a, b) ON m.a = lang GROUP BY 1"""

    @query(f"fct_tagmap_{how}", sql)
    def _(t: Tables):
        return facets.map_tags(facets.term_counts(facets.doc_terms(t.documents, "doc_id", ["lang"])), facets.parse_map(RENAMES), how)


for _how in ("sum", "min", "max"):
    _renames(_how)


@query("fct_request", "SELECT p_brand AS term, count(*) AS count FROM part GROUP BY 1 ORDER BY 2, 1 LIMIT 5")
def _(t: Tables):
    request = facets.parse_request("Title (ALPHA), Brand (5 POPULARITY_ASC)")[1]
    return facets.answer(facets.term_counts(facets.doc_terms(t.part, "p_partkey", ["p_brand"])), request)


@query(
    "grp_results",
    """WITH g AS (SELECT source, count(*) AS num_found, row_number() OVER (ORDER BY max(n_chars) DESC, arg_min(doc_id, (-n_chars, doc_id)), source) AS group_rank FROM documents GROUP BY 1),
    d AS (SELECT source, doc_id, n_chars AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
    SELECT source, num_found, group_rank::INTEGER AS group_rank, rank::INTEGER AS rank, doc_id, score FROM g JOIN d USING (source) WHERE group_rank <= 10 AND rank <= 3""",
)
def _(t: Tables):
    return browse.group_results(t.documents.select("source", "doc_id", F.col("n_chars").alias("score")), "source", 3, 10)


@query("grp_merge", "SELECT source, count(*) AS num_found FROM documents GROUP BY 1")
def _(t: Tables):
    hits = t.documents.select("source", "doc_id", F.col("n_chars").alias("score"))
    parts = [browse.group_results(hits.where(f"doc_id % 2 = {i}"), "source", 2, 100) for i in (0, 1)]
    return browse.merge_groups(parts, "source", 1, 100).select("source", "num_found")


@query("grp_headers", "SELECT count(*)::BIGINT AS hit_count, max(o_totalprice) AS max_records, max(n)::BIGINT AS search_time FROM orders, (SELECT max(c) AS n FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderstatus))")
def _(t: Tables):
    headers = t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("hit_count"), F.max("o_totalprice").alias("max_records"), F.count(F.lit(1)).alias("search_time"))
    return browse.merge_documents([headers.drop("o_orderstatus")])


LOOKUP_SQL = """WITH c AS (SELECT lower(term) AS term, count(*) AS count FROM (SELECT unnest(string_split(p_name, ' ')) AS term FROM part {where}) GROUP BY 1),
o AS (SELECT count(*) AS o FROM c WHERE term < 'green') SELECT n - 1 AS position, term, count FROM (SELECT *, row_number() OVER (ORDER BY term) AS n FROM c), o
WHERE n - 1 >= greatest(o - 5, 0) AND n - 1 < greatest(o - 5, 0) + 12"""


@query("brw_lookup", LOOKUP_SQL.format(where=""))
def _(t: Tables):
    counts = _words(t).groupBy("term").agg(F.count(F.lit(1)).alias("count"))
    return browse.index_lookup(counts, "Green", -5, 12)


@query("brw_lookup_merge", LOOKUP_SQL.format(where=""))
def _(t: Tables):
    parts = [_words(t).where(f"doc % 2 = {i}").groupBy("term").agg(F.count(F.lit(1)).alias("count")) for i in (0, 1)]
    return browse.merge_lookups(parts, "green", -5, 12)


@query("srt_page", "SELECT c_custkey, v FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) ORDER BY v ASC NULLS LAST, c_custkey LIMIT 20 OFFSET 100")
def _(t: Tables):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_acctbal")).alias("v"))
    return browse.page(rows, browse.sort_order("v", score="", key="c_custkey"), 100, 20)


@query("srt_locale", "SELECT p_partkey, p_name FROM part ORDER BY p_name COLLATE da, p_partkey LIMIT 30")
def _(t: Tables):
    return browse.page(t.part.select("p_partkey", "p_name"), browse.sort_order("p_name", locale="da", score="", key="p_partkey"), 0, 30)


@query("srt_score_window", "SELECT doc_id, n_chars FROM documents WHERE n_chars >= 1000 AND n_chars < 3000 ORDER BY n_chars DESC, doc_id LIMIT 40")
def _(t: Tables):
    return browse.score_window(t.documents.select("doc_id", "n_chars"), 1000, 3000, 40, "n_chars")
