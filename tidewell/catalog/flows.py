"""Queries of sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell import session
from tidewell.operators import suggest
from tidewell.sources import files, marc
from tidewell.streaming import incremental

from .common import Tables, query
from .federated import FOLD_SQL, _log


@query("src_generated", "SELECT 'rec' || id AS id, 100::BIGINT AS rows FROM range(100) r(id)")
def _(t: Tables):
    rows = files.generated(t.spark, 100, {"id": "rec$n", "text": "$words(5) $pick(a|b)"})
    return rows.where(F.col("text").rlike(r"^(w\d+ ){5}[ab]$")).select("id", F.lit(rows.count()).cast("bigint").alias("rows"))


@query("src_html", "SELECT page_id, regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 's') AS title, regexp_extract(html, '<html[^>]*lang=\"?(\\w+)', 1) AS language FROM pages")
def _(t: Tables):
    return files.extract_html(t.pages).select("page_id", "title", "language")


@query("src_split_xml", "SELECT 'p:' || p_partkey AS id, 'parts' AS base FROM part")
def _(t: Tables):
    rows = t.part.groupBy((F.col("p_partkey") % 7).alias("g")).agg(F.concat(F.lit("<all xmlns=\"urn:x\">"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<part><n>"), "p_partkey", F.lit("</n></part>")))), ""), F.lit("</all>")).alias("xml"))
    return files.split_xml(rows, "xml", "part", "/part/n", "parts", "p:").select("id", "base")


@query("src_marc_lines", "SELECT 'm:' || p_partkey AS id, p_partkey % 5 = 0 AS deleted, p_type AS type, 'm:' || (p_partkey + 2) || ',m:' || (p_partkey + 1) AS children FROM part")
def _(t: Tables):
    text = F.concat(F.lit("001 00 *a"), "p_partkey", F.lit("\n004 00 *r"), F.when(F.col("p_partkey") % 5 == 0, "d").otherwise("n"), F.lit("*a"), "p_type", F.lit("\n015 00 *a"), F.col("p_partkey") + 1, F.lit("*v2\n015 00 *a"), F.col("p_partkey") + 2)
    found = marc.records(marc.read_lines(t.part.select(text.alias("value"))), "marc", prefix="m:")
    return found.select("id", "deleted", "type", F.array_join("child_ids", ",").alias("children"))


@query("src_marc_xml", "SELECT p_partkey, p_name AS title FROM part")
def _(t: Tables):
    xml = F.concat(F.lit('<record><datafield tag="245" ind1="0" ind2="0"><subfield code="a">'), "p_name", F.lit('</subfield><subfield code="c">x</subfield></datafield></record>'))
    return t.part.select("p_partkey", marc.first(marc.xml_fields(xml), "245", "a").alias("title"))


@query("str_read_since", "SELECT count(*) AS rows, max(event_id) AS seen FROM events WHERE event_id > 400")
def _(t: Tables):
    mark = t.spark.createDataFrame([(400,)], "seen bigint")
    rows, after = incremental.records_since(t.events, mark, "event_id")
    return rows.agg(F.count(F.lit(1)).alias("rows")).crossJoin(after)


def _event_stream(t: Tables):
    batch = t.events
    return incremental.read_table_stream(t.spark, f"{t.sf_dir}/events*.parquet", batch.schema)


def _place(t: Tables) -> str:
    """A new folder in the shared place."""
    return f"{session.shared_folder(t.spark)}/work_{uuid.uuid4().hex}"


@query("str_dedup_state", "SELECT DISTINCT user_id, event_type FROM events")
def _(t: Tables):
    stream = incremental.drop_repeats(_event_stream(t).select("user_id", "event_type"), ["user_id", "event_type"])
    return incremental.drain(stream, _place(t))


@query("str_suggest_state", f"SELECT query, hits, count FROM {FOLD_SQL}")
def _(t: Tables):
    log = _event_stream(t).select(F.concat_ws(" ", "event_type", F.col("user_id") % 20).alias("query"), F.when(F.col("event_id") % 37 == 0, 0).otherwise(F.col("event_id") % 100 + 1).alias("hits"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    updates = incremental.drain(incremental.suggestion_stream(log), _place(t), "update", ("normalized",))
    return updates.where(~F.col("deleted")).select("query", "hits", "count")


def _in_parts(t: Tables) -> str:
    """The events in several files, one after another in time."""
    place = _place(t)
    days = [None, "2024-01-08", "2024-01-15", "2024-01-22", None]
    for start, stop in zip(days[:-1], days[1:], strict=True):
        rows = t.events
        rows = rows if start is None else rows.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        rows = rows if stop is None else rows.where(F.col("ts") < F.lit(stop).cast("timestamp_ntz"))
        rows.coalesce(1).write.mode("append").parquet(place)
    return place


def _suggestions_of_parts(t: Tables):
    stream = incremental.read_table_stream(t.spark, _in_parts(t), t.events.schema, files_per_trigger=1)
    log = stream.select(F.concat_ws(" ", "event_type", F.col("user_id") % 20).alias("query"), F.when(F.col("event_id") % 37 == 0, 0).otherwise(F.col("event_id") % 100 + 1).alias("hits"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    updates = incremental.drain(incremental.suggestion_stream(log), _place(t), "update", ("normalized",))
    return updates.where(~F.col("deleted")).select("query", "hits", "count")


@query("str_suggest_batches", f"SELECT query, hits, count FROM {FOLD_SQL}")
def _(t: Tables):
    return _suggestions_of_parts(t)


@query("str_reader_steps", "SELECT count(*) AS rows, max(event_id) AS last, 3::BIGINT AS steps FROM events")
def _(t: Tables):
    """A reader that stops after a step and another that goes on from its mark."""
    progress, size = _place(t), -(-t.events.count() // 3)
    rows, steps = [], []
    for total in (size, None):
        reader = incremental.RecordReader(lambda: t.events.select("event_id", "ts"), progress, time="ts", key="event_id")
        reader.run(lambda part: (rows.append(part), steps.append(1)), most=size, total=total)
    whole = rows[0].union(rows[1]).union(rows[2]) if len(rows) == 3 else rows[0]
    return whole.agg(F.count_distinct("event_id").alias("rows"), F.max("event_id").alias("last")).withColumn("steps", F.lit(len(steps)).cast("bigint"))


@query("str_changed_bases", "SELECT event_type AS base FROM events GROUP BY 1 HAVING max(event_id) > 990")
def _(t: Tables):
    seen = {r["base"]: 990 for r in t.events.select(F.col("event_type").alias("base")).distinct().collect()}
    found = incremental.changed_bases(t.events.select(F.col("event_type").alias("base"), F.col("event_id").alias("mtime")), seen)
    return t.spark.createDataFrame([(b,) for b in found], "base string")


@query("str_window_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS count FROM events GROUP BY ALL")
def _(t: Tables):
    stream = _event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = incremental.drain(incremental.windowed_counts(stream, "ts", "1 day", "1 day", "event_type"), _place(t), "complete")
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "count")


@query("sug_batch_equals_stream", f"SELECT count(*) AS queries FROM {FOLD_SQL}")
def _(t: Tables):
    batch = suggest.fold(_log(t), ["ts", "event_id"]).select("query", "hits", "count")
    return batch.join(_suggestions_of_parts(t), ["query", "hits", "count"]).agg(F.count(F.lit(1)).alias("queries"))
