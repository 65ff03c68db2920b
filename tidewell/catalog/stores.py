"""Queries of files, archives, sinks, row functions and searches over a written index."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from tidewell import session
from tidewell.federate import Federation, RemoteSource
from tidewell.functions import scalar
from tidewell.index import IndexSearcher, write_index
from tidewell.operators import browse, facets, federation, filters, postings, records, suggest
from tidewell.plans import rewrite
from tidewell.search import Request, Searcher
from tidewell.sources import files, marc, sinks
from tidewell.streaming import incremental

from . import text_sql
from .common import RECORDS_SQL, Tables, query
from .federated import FOLD_SQL, RANKED_SQL, _gathered, _log
from .searching import DOCS_SQL, KINDS, _searcher


def _place(t: Tables) -> str:
    return f"{session.shared_folder(t.spark)}/work_{uuid.uuid4().hex}"


# Files and archives.
@query("src_files", "SELECT p_size AS size, sum(octet_length(encode(p_name)) + 1)::BIGINT AS bytes FROM part GROUP BY 1")
def _(t: Tables):
    place = _place(t)
    t.part.select("p_size", "p_name").write.partitionBy("p_size").text(place)
    found = files.read_files(t.spark, place, "*.txt")
    return found.groupBy(F.regexp_extract("path", r"p_size=(\d+)", 1).cast("int").alias("size")).agg(F.sum("length").alias("bytes"))


@query("src_watch", "SELECT count(*) AS lines, sum(octet_length(encode(p_name)) + 1)::BIGINT AS bytes FROM part")
def _(t: Tables):
    place = _place(t)
    t.part.select("p_name").repartition(3).write.text(place)
    seen = incremental.drain(files.watch_files(t.spark, place, "*.txt"), _place(t))
    lines = F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1
    return seen.agg(F.sum(lines).alias("lines"), F.sum("length").alias("bytes"))


def _zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row as an archive in an archive with a second file and a broken one."""
    for pdf in batches:
        rows = []
        for key, name in zip(pdf["k"], pdf["name"], strict=True):
            inner, outer = io.BytesIO(), io.BytesIO()
            with zipfile.ZipFile(inner, "w") as z:
                z.writestr("deep/name.txt", name)
            with zipfile.ZipFile(outer, "w") as z:
                z.writestr("in.zip", inner.getvalue())
                z.writestr("other.xml", "<a/>")
                z.writestr("broken.gz", b"\x1f\x8bno")
            rows.append((f"f{key}.zip", outer.getvalue()))
        yield pd.DataFrame(rows, columns=["path", "content"])


@query(
    "src_archives",
    "SELECT 'f' || p_partkey || '.zip' AS origin, 'f' || p_partkey || '.zip!/in.zip!/deep/name.txt' AS name, p_name AS text, FALSE AS broken FROM part UNION ALL SELECT 'f' || p_partkey || '.zip', 'f' || p_partkey || '.zip!/broken.gz', NULL, TRUE FROM part",
)
def _(t: Tables):
    packed = session.spread(t.part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))).mapInPandas(_zipped, "path string, content binary")
    found = files.read_archives(packed, "*.txt")
    return found.select("origin", "name", F.decode("content", "UTF-8").alias("text"), F.col("error").isNotNull().alias("broken"))


@query("src_pulled", "SELECT DISTINCT url FROM pages")
def _(t: Tables):
    listing = t.pages.agg(F.array_join(F.array_sort(F.collect_set("url")), "\r\n").alias("content"))
    return t.spark.createDataFrame([(u,) for u in files.pulled(listing, most=10**6)], "url string")


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        raw = [
            marc.encode_record([{"tag": "001", "ind1": "", "ind2": "", "subfields": [{"code": "", "value": str(k)}]}, {"tag": "245", "ind1": "0", "ind2": "0", "subfields": [{"code": "a", "value": n}, {"code": "c", "value": "é"}]}])
            for k, n in zip(pdf["p_partkey"], pdf["p_name"], strict=True)
        ]
        yield pd.DataFrame({"path": ["x"], "content": [b"".join(raw) + b"broken\x1d"]})


@query("src_marc_binary", "SELECT p_partkey::VARCHAR AS id, p_name AS title FROM part")
def _(t: Tables):
    found = marc.read_binary(t.part.select("p_partkey", "p_name").mapInPandas(_encoded, "path string, content binary"))
    return found.select(marc.first("fields", "001", "").alias("id"), marc.first("fields", "245", "a").alias("title"))


@query("src_aleph", "SELECT lpad(p_partkey::VARCHAR, 9, '0') AS number, p_partkey::VARCHAR AS id, p_name AS title, 2::BIGINT AS fields FROM part")
def _(t: Tables):
    number = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    lines = F.concat(number, F.lit(" 001   L "), F.col("p_partkey").cast("string"), F.lit("\n"), number, F.lit(" 24500 L $$a"), "p_name", F.lit("$$cx\nnoise\n"))
    found = marc.read_aleph(t.part.select(lines.alias("value")))
    return found.select("number", marc.first("fields", "001", "").alias("id"), marc.first("fields", "245", "a").alias("title"), F.size("fields").cast("bigint").alias("fields"))


@query(
    "shp_marc",
    """SELECT p_partkey, '<record><controlfield tag="001">' || p_partkey || '</controlfield><datafield tag="100" ind1=" " ind2=" "><subfield code="a">a &amp; b</subfield></datafield><datafield tag="245" ind1="0" ind2="0"><subfield code="a">'
    || upper(p_name) || '</subfield><subfield code="c">x</subfield></datafield></record>' AS xml FROM part""",
)
def _(t: Tables):
    text = F.concat(F.lit("245 00 *a"), "p_name", F.lit("*cx\n900 00 *agone"))
    parsed = marc.read_lines(t.part.select(F.concat(F.lit("001 00 *a"), F.col("p_partkey").cast("string"), F.lit("\n"), text).alias("value")))
    bare = parsed.withColumn("id", marc.first("fields", "001", "a"))
    control = F.array(F.struct(F.lit("001").alias("tag"), F.lit("").alias("ind1"), F.lit("").alias("ind2"), F.array(F.struct(F.lit("").alias("code"), F.col("id").alias("value"))).alias("subfields")))
    kept = F.concat(control, marc.without("fields", "900", "001"))
    made = marc.changed(marc.added(kept, "100", {"a": F.lit("a & b")}), "245", "a", F.upper)
    return bare.select(F.col("id").cast("bigint").alias("p_partkey"), marc.as_xml(made).alias("xml"))


# Row functions and flow.
def _picky(row: dict) -> dict | None:
    if row["doc_id"] % 7 == 0:
        raise ValueError("seven")
    return None if row["doc_id"] % 5 == 0 else {"doc_id": row["doc_id"], "size": len(row["text"])}


@query("flt_row_errors", "SELECT doc_id, length(text)::BIGINT AS size FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0")
def _(t: Tables):
    return filters.each(t.documents.select("doc_id", "text"), _picky, "doc_id bigint, size bigint")


@query("flt_row_errors_marked", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'ValueError: seven' END AS error FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 <> 0")
def _(t: Tables):
    return filters.each(t.documents.select("doc_id", "text"), _picky, "doc_id bigint, size bigint", errors="mark").select("doc_id", "error")


def _copies(row: dict) -> list[dict]:
    return [{"doc_id": row["doc_id"], "copy": i} for i in range(row["doc_id"] % 3)]


@query("flt_several", "SELECT doc_id, unnest(range(doc_id % 3)) AS copy FROM documents")
def _(t: Tables):
    return filters.each(t.documents.select("doc_id"), _copies, "doc_id bigint, copy bigint")


@query("shp_add_fields", "SELECT doc_id AS doc, 'lang' AS field, lang AS value FROM documents WHERE lang <> '' UNION ALL SELECT doc_id, 'number', 'no ' || regexp_extract(source, 'src([0-9]+)', 1) FROM documents WHERE regexp_matches(source, 'src[0-9]+')")
def _(t: Tables):
    stored = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("base"), "lang")
    fields = filters.document_fields(stored, "id", {"lang": 1.0})
    return filters.add_fields(fields, stored, [("base", "number", r"src(\d+)", "no $1"), ("base", "none", "nowhere", "$0")]).select("doc", "field", "value")


@query("flt_plugged", "SELECT doc_id, upper(lang) AS lang FROM documents WHERE n_chars > 500")
def _(t: Tables):
    name = f"longer_{uuid.uuid4().hex}"
    filters.plug(name)(lambda df, most: df.where(F.col("n_chars") > most))
    filters.plug(f"{name}_upper")(lambda df: df.withColumn("lang", F.upper("lang")))
    return filters.plugged(t.documents, [(name, {"most": 500}), f"{name}_upper"]).select("doc_id", "lang")


@query("flt_batches", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM documents")
def _(t: Tables):
    return filters.batched(t.documents.select("doc_id"), ["doc_id"], 64)


@query("shp_stream", "SELECT doc_id, md5(text) AS digest, octet_length(encode(text))::BIGINT AS bytes FROM documents")
def _(t: Tables):
    streams = filters.content_to_stream(t.documents.select("doc_id", F.col("text").alias("content"))).withColumn("bytes", F.octet_length("stream").cast("bigint"))
    return filters.stream_to_content(streams).select("doc_id", F.md5(F.col("content").cast("binary")).alias("digest"), "bytes")


@query("shp_replace_overlap", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '1cd' WHEN 1 THEN '2x1' WHEN 2 THEN 'a' || chr(57344) || '+1' ELSE '' END AS text FROM documents")
def _(t: Tables):
    """One pass from the left: what is replaced isn't looked at again."""
    given = F.element_at(F.array(F.lit("abcd"), F.lit("bcdxab"), F.lit("a.ab"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.documents.select("doc_id", filters.replaced(given, strings={"ab": "1", "bcd": "2", ".": "+", "": "never"}).alias("text"))


@query("fn_cdata", "SELECT p_partkey, 'x&' || p_name || '<![CDATA[' || p_name || '&amp;y]]>&' AS kept FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", scalar.keep_entities(F.concat(F.lit("x&"), "p_name", F.lit("<![CDATA["), "p_name", F.lit("&y]]>&"))).alias("kept"))


# Sinks.
@query("snk_records", f"SELECT base, count(*) AS records FROM {RECORDS_SQL} GROUP BY base")
def _(t: Tables):
    place = _place(t)
    sinks.write_records(t.records, place)
    return t.spark.read.parquet(place).groupBy(F.col("base").cast("string").alias("base")).agg(F.count(F.lit(1)).alias("records"))


@query("snk_clear_base", f"SELECT id, base, deleted OR (base = 'src1' AND id % 2 = 0) AS deleted FROM {RECORDS_SQL}")
def _(t: Tables):
    place, stored = _place(t), t.records
    sinks.clear_then_write(stored.where("base = 'src1' AND id % 2 = 1"), stored, "src1", place)
    return t.spark.read.parquet(place).select("id", F.col("base").cast("string").alias("base"), "deleted")


@query("snk_dump", f"SELECT id, content FROM {RECORDS_SQL} WHERE base IN ('src1', 'src2') AND id::VARCHAR LIKE '%3'")
def _(t: Tables):
    place = _place(t)
    sinks.dump(t.records, place, "src[12]$", "3$")
    return t.spark.read.schema("id bigint, content string").json(place)


@query("snk_validated", f"SELECT count(*) AS records FROM {RECORDS_SQL}")
def _(t: Tables):
    return sinks.validated(t.records).agg(F.count(F.lit(1)).alias("records"))


@query("snk_xml", "SELECT p_partkey, p_name AS name, p_size AS size FROM part")
def _(t: Tables):
    xml = t.part.select(sinks.as_xml(F.struct("p_partkey", "p_name", "p_size"), "part").alias("x"))
    return xml.select(*[F.xpath_string("x", F.lit(f"/part/{c}")).cast(k).alias(a) for c, k, a in (("p_partkey", "bigint", "p_partkey"), ("p_name", "string", "name"), ("p_size", "int", "size"))])


@query("snk_batches", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def _(t: Tables):
    """A stream merged into a table, a version for each batch."""
    source, place = _place(t), _place(t)
    t.events.select("user_id", "event_id").repartition(3, "event_id").write.parquet(source)
    stream = incremental.read_table_stream(t.spark, source, "user_id bigint, event_id bigint", files_per_trigger=1)
    written = sinks.write_batches(stream, f"{place}/table", f"{place}/progress", lambda stored, batch: records.upsert(batch.where("false") if stored is None else stored, batch if stored is None else batch.unionByName(stored), "event_id", "user_id"))
    written.awaitTermination()
    return t.spark.read.parquet(f"{place}/table/v{written.lastProgress['batchId']}")


@query("sug_export", f"SELECT query, hits, count FROM {FOLD_SQL}")
def _(t: Tables):
    place = _place(t)
    suggest.export_text(suggest.fold(_log(t), ["ts", "event_id"]), place)
    return suggest.import_text(t.spark, place).select("query", "hits", "count")


TEXT_STATS = f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(w) AS term FROM {DOCS_SQL}) GROUP BY term"


@query("tst_persist", f"SELECT term, tf, df FROM ({TEXT_STATS}) WHERE term >= 'm' AND term < 'n'")
def _(t: Tables):
    place = _place(t)
    postings.write_statistics(postings.extract(t.texts, ["text"]), place)
    return t.spark.read.parquet(place).where("term >= 'm' AND term < 'n'")


# The same searches over a written index.
def _indexed(t: Tables) -> IndexSearcher:
    place = _place(t)
    write_index(_searcher(t), place, ["text", "lang", "source"])
    return IndexSearcher(t.spark, place, "doc_id", KINDS, ["text"])


def _over_index(name: str, text: str, where: str, filters_: tuple[str, ...] = ()) -> None:
    @query(name, f"SELECT doc_id FROM {DOCS_SQL} WHERE {where}")
    def _(t: Tables):
        return _indexed(t).matches(text, filters_).select("doc_id")


_over_index("idx_bool", "(with OR que) AND -source:src3 AND NOT der", "(list_contains(w, 'with') OR list_contains(w, 'que')) AND source <> 'src3' AND NOT list_contains(w, 'der')")
_over_index("idx_phrase", 'text:"of the"', "len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0")
_over_index("idx_slop", 'text:"in the"~2', "len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'in' AND len(list_filter([i - 1, i + 1, i + 2, i + 3], lambda j: j >= 1 AND j <= len(w) AND w[j] = 'the')) > 0)) > 0")
_over_index("idx_prefix", "text:thing* OR text:/th(in|on)e?r/ OR text:[thin TO thine}", "len(list_filter(w, lambda t: starts_with(t, 'thing') OR regexp_full_match(t, 'th(in|on)e?r') OR (t >= 'thin' AND t < 'thine'))) > 0")
_over_index("idx_negative", "-text:with", "NOT list_contains(w, 'with')")
_over_index("idx_filters", "with", "list_contains(w, 'with') AND lang = 'en' AND source <> 'src1'", ("lang:en", "-source:src1"))


@query(
    "idx_search",
    f"""WITH x AS (SELECT doc_id, len(list_filter(w, lambda t: t = 'with')) AS a, len(list_filter(w, lambda t: t = 'for')) AS b, len(w) AS n FROM {DOCS_SQL}),
    s AS (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (WHERE a > 0))::DOUBLE AS da, (count(*) FILTER (WHERE b > 0))::DOUBLE AS db FROM x)
    SELECT doc_id, round(sqrt(a::DOUBLE) * pow(1 + ln(s.n / (da + 1)), 2) / sqrt(x.n::DOUBLE) + 2 * sqrt(b::DOUBLE) * pow(1 + ln(s.n / (db + 1)), 2) / sqrt(x.n::DOUBLE), 6) AS score FROM x, s WHERE a > 0 AND b > 0""",
)
def _(t: Tables):
    return _indexed(t).scored("with AND for^2").select("doc_id", F.round("score", 6).alias("score"))


def _word_scores(where: str, word: str) -> str:
    return f"""(WITH x AS (SELECT doc_id, source, len(list_filter(w, lambda t: t = '{word}'))::DOUBLE AS a, len(w)::DOUBLE AS n FROM {DOCS_SQL} WHERE {where}), s AS (SELECT count(*)::DOUBLE AS total, (count(*) FILTER (WHERE a > 0))::DOUBLE AS d FROM x)
    SELECT doc_id, source, round(sqrt(a) * pow(1 + ln(total / (d + 1)), 2) / sqrt(n), 6) AS score FROM x, s WHERE a > 0)"""


@query("scr_page", f"SELECT doc_id, score FROM {_word_scores('TRUE', 'with')} ORDER BY score DESC, doc_id LIMIT 20 OFFSET 5")
def _(t: Tables):
    """Rounded scores order the page, so that two engines agree on ties."""
    hits = _searcher(t).scored("with").withColumn("score", F.round("score", 6))
    return browse.page(hits, [F.desc("score"), F.asc("doc_id")], 5, 20).select("doc_id", "score")


@query("scr_top", f"SELECT count(*) AS rows, round(sum(score), 3) AS total FROM (SELECT score FROM {_word_scores('TRUE', 'with')} ORDER BY score DESC, doc_id LIMIT 20)")
def _(t: Tables):
    top = _searcher(t).search(Request("with", rows=20, fields=["lang"]))
    return top.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.round("score", 6)), 3).alias("total"))


@query("qry_ids_many", "SELECT doc_id FROM documents WHERE doc_id < 5000 AND lang = 'en'")
def _(t: Tables):
    return _searcher(t).search(Request(ids=[str(i) for i in range(5000)], rows=5000, filters=["lang:en"], fields=["lang"])).select("doc_id")


@query("grp_results_text_key", "WITH d AS (SELECT 'd' || doc_id AS id, source, n_chars AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, 'd' || doc_id) AS rank, count(*) OVER (PARTITION BY source) AS num_found FROM documents), g AS (SELECT source, row_number() OVER (ORDER BY score DESC, id, source) AS group_rank FROM d WHERE rank = 1) SELECT source, num_found, group_rank::INTEGER AS group_rank, rank::INTEGER AS rank, id, score FROM d JOIN g USING (source) WHERE rank <= 2 AND group_rank <= 7")
def _(t: Tables):
    docs = t.documents.select("source", F.concat(F.lit("d"), "doc_id").alias("id"), F.col("n_chars").alias("score"))
    return browse.group_results(docs, "source", 2, 7, key="id")


# Federation.
def _federation(t: Tables, mode: str = "score") -> Federation:
    def part(where: str) -> Searcher:
        return Searcher(t.texts.where(where), "doc_id", KINDS, ["text"])

    return Federation({"en": part("lang = 'en'"), "rest": part("lang <> 'en'")}, mode=mode)


@query("fed_facet_whole", "SELECT source AS term, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(t: Tables):
    """Sources give whole counts, so a tag that leads in neither may lead in both together."""
    return _federation(t).facet(Request("*", facets="source (3)"))["source"]


@query(
    "fed_search",
    f"SELECT doc_id AS id, source FROM (SELECT doc_id, 'en' AS source, score FROM {_word_scores(chr(108) + 'ang = ' + chr(39) + 'en' + chr(39), 'with')} UNION ALL SELECT doc_id, 'rest', score FROM {_word_scores('lang <> ' + chr(39) + 'en' + chr(39), 'with')})",
)
def _(t: Tables):
    return _federation(t).search(Request("with", rows=None, fields=["lang"])).select("id", "source")


@query("fed_groups", "SELECT lang, count(*) AS num_found FROM documents GROUP BY 1")
def _(t: Tables):
    return _federation(t).search(Request("*", rows=10, group="lang")).select("lang", "num_found")


@query("fed_remote", "SELECT doc_id AS id, 'near' AS source FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 'far' FROM documents WHERE lang = 'en' AND doc_id < 50")
def _(t: Tables):
    """A source that answers over a function stands beside a local one."""
    far = [{"doc_id": r["doc_id"], "lang": "en", "score": 1.0} for r in t.documents.where("lang = 'en' AND doc_id < 50").select("doc_id").collect()]
    remote = RemoteSource(t.spark, "doc_id", "doc_id bigint, lang string", lambda request: far[: request.start + request.rows])
    near = Searcher(t.texts.where("lang = 'de'"), "doc_id", KINDS, ["text"])
    return Federation({"near": near, "far": remote}).search(Request("*", rows=100_000, fields=["lang"])).select("id", "source")


@query("snk_remote", "SELECT count(*) AS sent FROM part")
def _(t: Tables):
    """Each batch goes to a file of its own in the shared folder, as to another system."""
    place = _place(t)
    t.spark.range(1).write.parquet(f"{place}/made")  # makes the folder

    def send(rows: list[dict]) -> None:
        import json
        import os

        folder = place.removeprefix("file:")
        with open(os.path.join(folder, f"{rows[0]['p_partkey']}.json"), "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)

    told = sinks.send_documents(t.part.select("p_partkey", "p_name"), send, 64).agg(F.sum("sent").alias("told")).first()["told"]
    arrived = t.spark.read.schema("p_partkey bigint, p_name string").json(f"{place}/*.json")
    return arrived.where(F.lit(told) > 0).agg(F.count(F.lit(1)).alias("sent"))


def _near(column: str) -> str:
    return f"SELECT term, 1.0 / (1 + levenshtein(term, 'widgte')) AS score FROM (SELECT DISTINCT unnest({text_sql.tokens(column)}) AS term FROM part) WHERE levenshtein(term, 'widgte') <= 3"


@query("fed_did_you_mean", f"SELECT term, score::DOUBLE AS score FROM ({_near('p_name')} UNION ALL {_near('p_type')}) ORDER BY score DESC, term LIMIT 6")
def _(t: Tables):
    def part(column: str):
        found = suggest.did_you_mean(postings.extract(t.part, [column]), "widgte", 1000, 3)
        return found.select("term", (1 / (1 + F.col("distance"))).alias("score"))

    return federation.merge_proposals([part("p_name"), part("p_type")], 6)


@query("dym_query", "SELECT 'widget zzzzzzzz' AS query, 2::BIGINT AS distance WHERE EXISTS (SELECT 1 FROM part WHERE p_name LIKE '% widget')")
def _(t: Tables):
    """Each unknown word is replaced by its best proposal; one without any stays."""
    terms = t.spark.createDataFrame([("widget", 10), ("gadget", 20), ("wedge", 3)], "term string, df bigint")
    return suggest.proposed_query(terms, "Widgte zzzzzzzz").select("query", F.col("distance").cast("bigint").alias("distance"))


ENFORCED = "('0x' || substr(md5(md5('some query') || ':' || id), 1, 8))::BIGINT % 10 + 0.5"
ENFORCE_SQL = f"""WITH m AS (SELECT id, source, row_number() OVER (ORDER BY score DESC, source, id) - 1 AS p FROM {RANKED_SQL} WHERE rn <= 60),
w AS (SELECT *, count(*) FILTER (WHERE p < 15) OVER (PARTITION BY source) AS inside, row_number() OVER (PARTITION BY source, p >= 15 ORDER BY p) AS n FROM m)
SELECT id, source, (row_number() OVER (ORDER BY CASE WHEN p >= 15 AND source = 'src2' AND n <= 5 - inside THEN {ENFORCED} ELSE p END, p) - 1)::INTEGER AS position FROM w"""


@query("fed_enforce", ENFORCE_SQL)
def _(t: Tables):
    merged = federation.merge(_gathered(t, 0, 60), "score")
    return federation.enforce(merged, {"src2": 5}, "some query", 15).select("id", "source", "position")


@query("rew_ids", "SELECT doc_id FROM documents WHERE doc_id IN (3, 17)")
def _(t: Tables):
    return Searcher(t.documents, "doc_id", {"doc_id": "verbatim"}, ["doc_id"]).matches(rewrite.ids_query(["3", "17"], "doc_id")).select("doc_id")


@query("fct_summed", "SELECT term, sum(count)::BIGINT AS count FROM (SELECT p_brand AS term, count(*) AS count FROM part WHERE p_size <= 20 GROUP BY 1 UNION ALL SELECT p_brand, count(*) FROM part WHERE p_size > 20 GROUP BY 1) GROUP BY 1")
def _(t: Tables):
    return facets.summed([t.part.where(w).groupBy(F.col("p_brand").alias("term")).agg(F.count(F.lit(1)).alias("count")) for w in ("p_size <= 20", "p_size > 20")])
