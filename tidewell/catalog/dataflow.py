"""Queries of scalar functions, analyzers, filters and shapers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import scalar, text
from tidewell.operators import filters

from . import text_sql
from .common import Tables, query

DATE_SQL = "strftime(o_orderdate, '%Y-%m-%d')"


def _cut(c, n):
    return F.substring(c, 1, n)


@query(
    "fn_solr_date",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:00Z') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00Z')
    WHEN 3 THEN strftime(o_orderdate, '%Y-%m-01T00:00:00Z') WHEN 4 THEN strftime(o_orderdate, '%Y-01-01T00:00:00Z') ELSE '' END AS solr_date FROM orders""",
)
def _(t: Tables):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    length = F.element_at(F.array(*map(F.lit, (19, 16, 10, 7, 4, 0))), (F.col("o_orderkey") % 6).cast("int") + 1)
    return t.orders.select("o_orderkey", scalar.iso_date_time(F.substr(stamp, F.lit(1), length)).alias("solr_date"))


@query(
    "fn_date_expand",
    """SELECT o_orderkey, strftime(d, '%Y-%m-%d') || ' ' || strftime(d, '%d/%m-%Y') || ' ' || strftime(d, '%m/%d-%Y') || ' ' || strftime(d, '%d/%m/%Y') || ' ' || strftime(d, '%Y%m%d') || ' ' || strftime(d, '%d/%m') || ' ' || strftime(d, '%m/%d') || ' ' || strftime(d, '%m-%d') ||
    CASE WHEN month(d) < 10 OR day(d) < 10 THEN ' ' || day(d) || '/' || month(d) || ' ' || month(d) || '/' || day(d) || ' ' || month(d) || '-' || day(d) ELSE '' END || ' ' || lower(monthname(d)) AS expanded FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)""",
)
def _(t: Tables):
    return t.orders.select("o_orderkey", scalar.expand_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("expanded"))


@query(
    "fn_time_expand",
    "SELECT event_id, strftime(ts, '%H:%M %H.%M %H%M %H:%M:%S %H.%M.%S %H%M%S') AS expanded, strftime(ts, '%H:%M %H.%M %H%M %H:%M:%H %H.%M.%H %H%M%H') AS compat, strftime(ts, '%m %d') AS month_day FROM events",
)
def _(t: Tables):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.events.select("event_id", scalar.expand_time(stamp).alias("expanded"), scalar.expand_time(stamp, True).alias("compat"), scalar.divide(stamp, 1, 2).alias("month_day"))


@query(
    "fn_year_range",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (SELECT string_agg(y::VARCHAR, ' ' ORDER BY y) FROM range(year(o_orderdate) // 10 * 10, year(o_orderdate) // 10 * 10 + 10) r(y)) WHEN 1 THEN year(o_orderdate)::VARCHAR ELSE 'around ' || year(o_orderdate) END AS years FROM orders""",
)
def _(t: Tables):
    year = F.year("o_orderdate").cast("string")
    given = F.when(F.col("o_orderkey") % 3 == 0, F.concat(_cut(year, 3), F.lit("?"))).when(F.col("o_orderkey") % 3 == 1, year).otherwise(F.concat(F.lit("around "), year))
    return t.orders.select("o_orderkey", scalar.year_range(given).alias("years"))


@query(
    "fn_isbn",
    """WITH x AS (SELECT p_partkey, '978' || lpad(p_partkey::VARCHAR, 9, '0') AS b FROM part)
    SELECT p_partkey, b || ((10 - list_sum(list_transform(range(1, 13), lambda i: b[i]::BIGINT * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10)::BIGINT AS isbn, 'abc' AS other FROM x""",
)
def _(t: Tables):
    nine = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    hyphened = F.concat(_cut(nine, 1), F.lit("-"), F.substring(nine, 2, 8), F.lit("-X"))
    return t.part.select("p_partkey", scalar.isbn13(hyphened).alias("isbn"), scalar.isbn13(F.lit("abc")).alias("other"))


@query("fn_md5", "SELECT p_partkey, regexp_replace(md5(p_name || p_partkey), '^0+', '') AS digest FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", scalar.md5_short(F.concat("p_name", "p_partkey")).alias("digest"))


@query("fn_normalize", "SELECT doc_id, md5(trim(translate(text, '-,.()[]', ''))) AS digest FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.md5(scalar.normalize("text").cast("binary")).alias("digest"))


@query("fn_url_escape", "SELECT page_id, replace(replace(replace(replace(replace(replace(url, ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D'), '&', '%26'), '#', '%23') AS escaped FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", scalar.open_url_escape("url").alias("escaped"))


@query("fn_lookup", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'cheap' WHEN 'SMALL' THEN 'little' ELSE '' END AS genre FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", scalar.lookup("p_type", {"ECONOMY": "cheap", "SMALL": "little"}).alias("genre"))


@query("txt_tokens", f"SELECT doc_id, len(w)::BIGINT AS tokens, len(list_distinct(w))::BIGINT AS terms FROM (SELECT doc_id, {text_sql.tokens('text')} AS w FROM documents)")
def _(t: Tables):
    words = t.texts.select("doc_id", text.standard("text").alias("w"))
    return words.select("doc_id", F.size("w").cast("bigint").alias("tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("terms"))


@query("txt_transliterate", f"SELECT doc_id, md5({text_sql.fold('text')}) AS folded FROM documents")
def _(t: Tables):
    return t.texts.select("doc_id", F.md5(text.fold("text").cast("binary")).alias("folded"))


@query("txt_freetext", f"SELECT doc_id, len(w)::BIGINT AS tokens, md5(array_to_string(w, ' ')) AS words FROM (SELECT doc_id, {text_sql.free_text('text')} AS w FROM documents)")
def _(t: Tables):
    words = t.texts.select("doc_id", text.free_text("text").alias("w"))
    return words.select("doc_id", F.size("w").cast("bigint").alias("tokens"), F.md5(F.array_join("w", " ").cast("binary")).alias("words"))


# What each class of rules makes of a text, by hand: (text, full chain, standard).
SAMPLES = (
    ("Über Ål!", "yber aal", "über ål"),
    ("ä æ ö ø čř α ΘΦ", "æ æ ø ø cr a thph", "ä æ ö ø čř α θφ"),
    ("a:b x*y c*-algebra", "ab x*y cstaralgebra", "ab x*y c* algebra"),
    (".Net vs C* Algebra? C++/C#", "dotnet vs cstaralgebra cplusplus csharp", "net vs c* algebra c c#"),
    ("Foo-%4g 123/>erW'd;_=foo", "foo %4g 123 erw d foo", "foo %4g 123 erw d foo"),
    ("1½ km² “quoted” (no)", "11 2 km 2 quoted no", "11 2 km 2 quoted no"),
    ("Straße Œuvre þing ™", "strasse oeuvre thing tm", "straße œuvre þing ™"),
    ("a\u00a0b\u2028c\u3000d e\u0301", "a b c d e", "a b c d e"),
)


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(text_sql._q, r)) + ")" for r in rows) + ")"


@query("txt_rules", f"SELECT given, full_chain, standard FROM {_values(SAMPLES)} x(given, full_chain, standard)")
def _(t: Tables):
    given = t.spark.createDataFrame([(r[0],) for r in SAMPLES], "given string")
    return given.select("given", F.array_join(text.folded("given"), " ").alias("full_chain"), F.array_join(text.standard("given"), " ").alias("standard"))


@query("txt_sortkey", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS sortkey FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", text.symbols_removed("p_name").alias("sortkey"))


@query("txt_keyword", f"SELECT p_partkey, array_to_string({text_sql.tokens(chr(39) + 'A ' + chr(39) + ' || p_name')}, ' ') AS keyword, translate(p_brand, '-_:/', '') AS number FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", text.keyword(F.concat(F.lit("A_"), "p_name"))[0].alias("keyword"), text.number("p_brand")[0].alias("number"))


@query("txt_lowercase", "SELECT doc_id, len(list_filter(string_split(lower(text), ' '), lambda t: t <> ''))::BIGINT AS tokens FROM documents")
def _(t: Tables):
    return t.texts.select("doc_id", F.size(text.lower_case("text")).cast("bigint").alias("tokens"))


@query("flt_regex", "SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(licensed|rights) ')")
def _(t: Tables):
    return filters.by_regex(t.documents, "text", ["licensed ", "rights "]).select("doc_id")


@query(
    "flt_regex_amount",
    "SELECT doc_id FROM documents WHERE regexp_matches(text, 'ing')::INT + regexp_matches(text, '[0-9]{4}')::INT + regexp_matches(text, 'License')::INT + regexp_full_match(lang, 'e.')::INT > 2",
)
def _(t: Tables):
    return filters.by_amount(t.documents, {"text": ["ing", "[0-9]{4}", "License"], "lang": ["e."]}, "more", 2).select("doc_id")


@query("flt_size", "SELECT doc_id FROM documents WHERE octet_length(encode(text)) BETWEEN 1000 AND 5000")
def _(t: Tables):
    return filters.by_size(t.documents, "text", 1000, 5000).select("doc_id")


@query("flt_dedup_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
def _(t: Tables):
    rows = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return filters.first_of_each(rows, ["digest"], ["doc_id"]).select("doc_id")


FRACTION = "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS p FROM orders) WHERE p = 1 OR floor(p * 0.3) > floor((p - 1) * 0.3)"


@query("flt_fraction", FRACTION)
def _(t: Tables):
    return filters.fraction(t.orders.select("o_orderkey", "o_orderdate"), 0.3, ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@query("flt_counted", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 200 OFFSET 99")
def _(t: Tables):
    return filters.counted(t.orders.select("o_orderkey"), ["o_orderkey"], 100, 200)


@query("flt_mux", "SELECT CASE WHEN lang = 'de' THEN 'german' WHEN source = 'src1' THEN 'first' ELSE 'rest' END AS branch, count(*) AS n FROM documents GROUP BY 1")
def _(t: Tables):
    routed = filters.route(t.documents, [("german", F.col("lang") == "de"), ("first", F.col("source") == "src1")], "rest")
    return routed.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


@query("flt_mux_steps", "SELECT doc_id, CASE WHEN lang = 'de' THEN upper(source) ELSE source || '!' END AS source FROM documents WHERE lang IN ('de', 'fr')")
def _(t: Tables):
    docs = t.documents.select("doc_id", "lang", "source")
    out = filters.mux(docs, [("d", F.col("lang") == "de", lambda r: r.withColumn("source", F.upper("source"))), ("f", F.col("lang") == "fr", lambda r: r.withColumn("source", F.concat("source", F.lit("!"))))])
    return out.select("doc_id", "source")


@query("flt_tee", "SELECT p || doc_id AS id, b AS base FROM documents, (VALUES ('new1'), ('new2')) x(b), (VALUES ('a:'), ('b:')) y(p)")
def _(t: Tables):
    return filters.tee(t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("base")), ["new1", "new2"], ["a:", "b:"])


@query("flt_discard_mark", "SELECT doc_id, coalesce(n_chars < 500, false) AS discarded FROM documents")
def _(t: Tables):
    return filters.discard(t.documents.select("doc_id", "n_chars"), F.col("n_chars") < 500, "mark").select("doc_id", "discarded")


@query(
    "shp_record",
    """SELECT 'page:' || page_id AS id, regexp_extract(url, '^\\w+://([^/]+)/(\\w+)/', 1) AS base, regexp_extract(url, '^\\w+://([^/]+)/(\\w+)/', 2) || '@' || regexp_extract(url, '^\\w+://([^/]+)/(\\w+)/', 1) AS content
    FROM pages WHERE regexp_matches(url, '^\\w+://([^/]+)/(\\w+)/')""",
)
def _(t: Tables):
    rows = t.pages.select(F.col("page_id").cast("string").alias("id"), F.lit("web").alias("base"), F.col("url").alias("content"))
    host = r"^\w+://([^/]+)/(\w+)/"
    return filters.shape(rows, [("id", "id", "^(.*)$", "page:$1"), ("content", "base", host, "$1"), ("content", "content", host, "$2@$1")], "all")


@query("shp_replace", "SELECT doc_id, md5(replace(replace(replace(regexp_replace(text, '[0-9]+', '#', 'g'), 'thing', chr(57344)), 'th', 'ð'), chr(57344), 'res')) AS digest FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.md5(filters.replaced(F.col("text"), [("[0-9]+", "#")], {"th": "ð", "thing": "res"}).cast("binary")).alias("digest"))


@query("shp_sanitise", "SELECT doc_id, md5(regexp_replace(text || chr(7) || 'x' || chr(9), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '?', 'g')) AS digest FROM documents")
def _(t: Tables):
    dirty = F.concat("text", F.lit("\x07x\t"))
    return t.documents.select("doc_id", F.md5(filters.sanitised(dirty).cast("binary")).alias("digest"))


@query("shp_snippet", "SELECT page_id, substr(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 11, 200) AS snippet FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", filters.snippet(F.col("html"), 10, 200).alias("snippet"))


@query(
    "shp_document",
    """SELECT doc, field, value, boost FROM (SELECT p_partkey AS doc, unnest(['p_name', 'p_type', 'freetext']) AS field, unnest([trim(p_name), trim(p_type), trim(p_name)]) AS value, unnest([2.0 * (1 + p_size % 2), 1.0 * (1 + p_size % 2), 1.0 * (1 + p_size % 2)])::DOUBLE AS boost FROM part) WHERE value <> ''""",
)
def _(t: Tables):
    docs = t.part.withColumn("weight", (1 + F.col("p_size") % 2).cast("double"))
    return filters.document_fields(docs, "p_partkey", {"p_name": 2.0, "p_type": 1.0}, "weight", ["p_name"])


@query("shp_reduce_xml", "SELECT page_id, least(len(regexp_extract_all(html, '<li>')), 2)::BIGINT AS kept FROM pages")
def _(t: Tables):
    cut = filters.capped_elements(F.col("html"), "li", 2)
    return t.pages.select("page_id", F.size(F.regexp_extract_all(cut, F.lit("<li>"), F.lit(0))).cast("bigint").alias("kept"))


@query("shp_field_map", "SELECT p_partkey, p_name AS title, p_brand || '+' || p_type AS tags FROM part")
def _(t: Tables):
    xml = F.concat(F.lit("<r><t>"), "p_name", F.lit("</t><g>"), "p_brand", F.lit("</g><g>"), "p_type", F.lit("</g></r>"))
    found = t.part.select("p_partkey", *filters.field_map(xml, {"title": "/r/t", "tags[]": "/r/g/text()"}))
    return found.select("p_partkey", "title", F.array_join("tags", "+").alias("tags"))


@query("shp_enrich", "SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 3")
def _(t: Tables):
    nations = t.nation.withColumnRenamed("n_regionkey", "r_regionkey")
    return filters.enriched(nations, t.region.where("r_regionkey < 3"), "r_regionkey", ["r_name"]).select("n_nationkey", "r_name")


@query("shp_script", "SELECT doc_id, n_chars * 2 AS n_chars FROM documents WHERE doc_id % 3 <> 0")
def _(t: Tables):
    def script(batches):
        for pdf in batches:
            kept = pdf[pdf["doc_id"] % 3 != 0]
            yield kept.assign(n_chars=kept["n_chars"] * 2)

    return filters.scripted(t.documents.select("doc_id", "n_chars"), script)
