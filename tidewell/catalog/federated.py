"""Queries of federation, suggestions, spelling, highlighting and page layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import federation, layout, suggest

from .common import Tables, query

NAMES = ["src1", "src0", "src2"]
RANKED_SQL = "(SELECT doc_id AS id, source, n_chars AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents WHERE source IN ('src0', 'src1', 'src2'))"
PLACE = "CASE source WHEN 'src1' THEN 1 WHEN 'src0' THEN 2 ELSE 3 END"


def _gathered(t: Tables, start: int, rows: int):
    docs = t.documents.select(F.col("doc_id").alias("id"), "source", F.col("n_chars").alias("score"))
    return federation.gather({n: docs.where(F.col("source") == n).drop("source") for n in ("src0", "src1", "src2")}, start, rows)


def _merged(name: str, mode: str, order: str) -> None:
    sql = f"SELECT id, (row_number() OVER (ORDER BY {order}) - 1)::INTEGER AS position FROM {RANKED_SQL} WHERE rn <= 20"

    @query(name, sql)
    def _(t: Tables):
        return federation.merge(_gathered(t, 0, 20), mode, NAMES).select("id", "position")


_merged("fed_standard", "standard", "score DESC, source, id")
_merged("fed_score", "score", "score DESC, source, id")
_merged("fed_concat", "concatenate", f"{PLACE}, score DESC, id")
_merged("fed_interleave", "interleave", f"rn, {PLACE}, id")


@query("fed_page", f"SELECT id, (row_number() OVER (ORDER BY score DESC, source, id) + 9)::INTEGER AS position FROM (SELECT * FROM {RANKED_SQL} ORDER BY score DESC, source, id LIMIT 10 OFFSET 10)")
def _(t: Tables):
    return federation.merge(_gathered(t, 10, 10), "score", start=10, size=10).select("id", "position")


@query("fed_adjust", "SELECT doc_id, n_chars * 1.5 + 10 AS score FROM (SELECT doc_id, n_chars::DOUBLE AS n_chars FROM documents)")
def _(t: Tables):
    return federation.adjust_scores(t.documents.select("doc_id", F.col("n_chars").cast("double").alias("score")), 1.5, 10.0)


@query("fed_facets", "SELECT field, term, count, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY count DESC, term) AS rank FROM (SELECT 'type' AS field, p_type AS term, count(*) AS count FROM part GROUP BY 2 UNION ALL SELECT 'brand', p_brand, count(*) FROM part GROUP BY 2)) WHERE rank <= 4")
def _(t: Tables):
    def counts(where: str):
        rows = t.part.where(where)
        types = rows.groupBy(F.lit("type").alias("field"), F.col("p_type").alias("term")).agg(F.count(F.lit(1)).alias("count"))
        return types.unionByName(rows.groupBy(F.lit("brand").alias("field"), F.col("p_brand").alias("term")).agg(F.count(F.lit(1)).alias("count")))

    return federation.merge_facets([counts("p_size <= 20"), counts("p_size > 20")], limit=4)


@query("fed_highlights", "SELECT page_id AS id, 'url' AS field, 'a|b' AS fragments FROM pages")
def _(t: Tables):
    one = t.pages.select(F.col("page_id").alias("id"), F.lit("url").alias("field"), F.array(F.lit("b")).alias("fragments"))
    two = one.withColumn("fragments", F.array(F.lit("a"), F.lit("b")))
    return federation.merge_highlights([one, two]).select("id", "field", F.array_join("fragments", "|").alias("fragments"))


LOG_SQL = "(SELECT event_type || ' ' || (user_id % 20) AS query, CASE WHEN event_id % 37 = 0 THEN 0 ELSE event_id % 100 + 1 END AS hits, ts, event_id FROM events)"


def _log(t: Tables):
    return t.events.select(F.concat_ws(" ", "event_type", F.col("user_id") % 20).alias("query"), F.when(F.col("event_id") % 37 == 0, 0).otherwise(F.col("event_id") % 100 + 1).alias("hits"), "ts", "event_id")


FOLD_SQL = f"""(WITH l AS {LOG_SQL}, d AS (SELECT query, max((ts, event_id)) FILTER (WHERE hits = 0) AS del FROM l GROUP BY query)
SELECT query, arg_max(hits, (ts, event_id)) AS hits, count(*) AS count FROM l JOIN d USING (query) WHERE del IS NULL OR (ts, event_id) > del GROUP BY query)"""


@query("sug_fold", f"SELECT query, hits, count FROM {FOLD_SQL}")
def _(t: Tables):
    return suggest.fold(_log(t), ["ts", "event_id"]).select("query", "hits", "count")


@query("sug_prefix", f"SELECT query, hits, count FROM {FOLD_SQL} WHERE starts_with(query, 'p') ORDER BY count DESC, query LIMIT 10")
def _(t: Tables):
    return suggest.suggest(suggest.fold(_log(t), ["ts", "event_id"]), "P").select("query", "hits", "count")


@query("sug_update", f"SELECT query, hits, count FROM {FOLD_SQL}")
def _(t: Tables):
    log = _log(t)
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    store = suggest.fold(log.where(F.col("ts") < middle), ["ts", "event_id"])
    return suggest.update(store, log.where(F.col("ts") >= middle), ["ts", "event_id"]).select("query", "hits", "count")


@query("sug_delete", f"SELECT query, count FROM {FOLD_SQL} WHERE query NOT IN ('click 3', 'view 4')")
def _(t: Tables):
    return suggest.delete(suggest.fold(_log(t), ["ts", "event_id"]), ["Click 3", "VIEW  4"]).select("query", "count")


@query("sug_merge", f"SELECT query, sum(hits)::BIGINT AS hits, max(count) AS count FROM (SELECT query, hits, count FROM {FOLD_SQL} UNION ALL SELECT query, 1, 3 FROM {FOLD_SQL} WHERE count > 5) GROUP BY query ORDER BY count DESC, query LIMIT 10")
def _(t: Tables):
    store = suggest.fold(_log(t), ["ts", "event_id"])
    other = store.where("count > 5").withColumns({"hits": F.lit(1).cast("bigint"), "count": F.lit(3).cast("bigint")})
    return federation.merge_suggestions([store, other])


@query("sug_recent", "SELECT event_type AS query, count(*) AS count FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t: Tables):
    latest = t.events.agg(F.max("ts")).first()[0]
    return suggest.recent(t.events.withColumn("query", F.col("event_type")), F.lit(latest).cast("timestamp_ntz"), 5 * 86400)


@query("dym_candidates", "SELECT term, levenshtein(term, 'widgte')::INTEGER AS distance, count(*) AS df FROM (SELECT unnest(string_split(p_name, ' ')) AS term FROM part) WHERE levenshtein(term, 'widgte') <= 3 GROUP BY 1 ORDER BY 2, 3 DESC, 1 LIMIT 5")
def _(t: Tables):
    terms = t.part.select(F.explode(F.split("p_name", " ")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return suggest.did_you_mean(terms, "widgte", most=3)


@query("hlt_words", "SELECT p_partkey, regexp_replace(p_name, '\\b(ring|bolt)\\b', '<em>\\1</em>', 'g') AS marked FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", suggest.highlight(F.col("p_name"), ["ring", "bolt"]).alias("marked"))


@query("ocr_regex_stats", "SELECT match, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(text), 'th[a-z]ng')) AS match FROM documents) GROUP BY 1")
def _(t: Tables):
    return layout.match_counts(t.documents, "text", "th[a-z]ng")


@query("ocr_regex_template", "SELECT match, count(*) AS count FROM (SELECT regexp_replace(unnest(regexp_extract_all(lower(text), '([a-z])hing')), '([a-z])hing', '\\1?') AS match FROM documents) GROUP BY 1")
def _(t: Tables):
    return layout.match_counts(t.documents, "text", "([a-z])hing", "$1?")


LINES_SQL = "(SELECT DISTINCT doc_id AS f, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 60)"


def _lines(t: Tables):
    return t.documents.select(F.col("doc_id").alias("file"), F.explode(F.split("text", "\n")).alias("text"))


@query("ocr_duplicate_blocks", f"SELECT a.f AS a, b.f AS b, count(*) AS shared FROM {LINES_SQL} a JOIN {LINES_SQL} b ON a.line = b.line AND a.f < b.f GROUP BY ALL HAVING count(*) >= 2")
def _(t: Tables):
    return layout.shared_blocks(_lines(t), "2@60")


@query(
    "ocr_duplicate_percent",
    f"""WITH n AS (SELECT f, count(*) AS n FROM {LINES_SQL} GROUP BY f) SELECT a, b, shared FROM (SELECT a.f AS a, b.f AS b, count(*) AS shared FROM {LINES_SQL} a JOIN {LINES_SQL} b ON a.line = b.line AND a.f < b.f GROUP BY ALL)
    JOIN n x ON x.f = a JOIN n y ON y.f = b WHERE shared >= greatest(1, greatest(x.n, y.n) * 0.5)""",
)
def _(t: Tables):
    return layout.shared_blocks(_lines(t), "50%@60")


@query(
    "ocr_duplicate_groups",
    f"""WITH p AS (SELECT a.f AS a, b.f AS b FROM {LINES_SQL} a JOIN {LINES_SQL} b ON a.line = b.line AND a.f < b.f GROUP BY ALL HAVING count(*) >= 2), m AS (SELECT a AS g, b AS f FROM p UNION SELECT a, a FROM p)
    SELECT g AS "group", f AS file FROM m WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT g FROM m) e WHERE e.g < m.g AND NOT EXISTS (SELECT 1 FROM m x WHERE x.g = m.g AND NOT EXISTS (SELECT 1 FROM m y WHERE y.g = e.g AND y.f = x.f)))""",
)
def _(t: Tables):
    return layout.star_groups(layout.shared_blocks(_lines(t), "2@60"))


@query("ocr_boxes", "SELECT p_partkey AS id, 'ring' AS term, 0.25::DOUBLE AS hpos, 0.5::DOUBLE AS vpos, 0.1::DOUBLE AS width, 0.05::DOUBLE AS height FROM part WHERE p_name LIKE '% ring'")
def _(t: Tables):
    def string(content, x: int):
        return F.struct(content.alias("content"), F.lit(x).alias("hpos"), F.lit(100).alias("vpos"), F.lit(40).alias("width"), F.lit(10).alias("height"))

    parts = F.split("p_name", " ")
    line = F.struct(F.array(string(parts[0], 10), string(F.concat(parts[1], F.lit(".")), 100)).alias("strings"))
    page = F.struct(F.lit(400).alias("width"), F.lit(200).alias("height"), F.array(F.struct(F.array(line).alias("lines"))).alias("blocks"))
    return layout.boxes(t.part.select(F.col("p_partkey").alias("id"), page.alias("page")), ["Ring"])
