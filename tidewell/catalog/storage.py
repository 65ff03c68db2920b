"""Queries of the record store and of relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import scalar
from tidewell.operators import graph, records
from tidewell.search import Searcher

from .common import RECORDS_SQL, Tables, query

ASKED = [42, 7, 999, 7000000, 3, 150]


@query("rec_modified_since", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' AND event_type = 'click'")
def _(t: Tables):
    return records.modified_since(t.events, F.lit("2024-01-10").cast("timestamp_ntz"), "click", "ts", "event_id", "event_type", ["event_id", "ts"])


@query("rec_multi_get", f"SELECT p.pos::INTEGER AS pos, doc_id, lang FROM (SELECT unnest({ASKED}) AS id, unnest(range({len(ASKED)})) AS pos) p JOIN documents ON doc_id = p.id")
def _(t: Tables):
    return records.multi_get(t.documents.select("doc_id", "lang"), ASKED, "doc_id").select("pos", "doc_id", "lang").orderBy("pos")


@query("rec_point_get", "SELECT doc_id, lang, source FROM documents WHERE doc_id = 42")
def _(t: Tables):
    return records.get(t.documents.select("doc_id", "lang", "source"), 42, "doc_id")


@query("rec_live_only", f"SELECT id, base FROM {RECORDS_SQL} WHERE NOT deleted AND indexable")
def _(t: Tables):
    return records.visible(t.records, False, True, strict=True).select("id", "base")


@query("rec_deleted_quirk", f"SELECT id, base, indexable FROM {RECORDS_SQL} WHERE NOT deleted")
def _(t: Tables):
    return records.visible(t.records, False, True).select("id", "base", "indexable")


@query(
    "rec_base_stats",
    f"""SELECT base, count(*) FILTER (WHERE deleted AND indexable) AS deleted_indexable, count(*) FILTER (WHERE deleted AND NOT indexable) AS deleted_hidden,
    count(*) FILTER (WHERE NOT deleted AND indexable) AS live, count(*) FILTER (WHERE NOT deleted AND NOT indexable) AS present_hidden,
    count(*) FILTER (WHERE deleted) AS deleted, count(*) FILTER (WHERE indexable) AS indexable, count(*) AS total FROM {RECORDS_SQL} GROUP BY base""",
)
def _(t: Tables):
    return records.base_statistics(t.records)


@query(
    "rec_holdings",
    f"""SELECT '__holdings__' AS id, '__private__' AS base, '[' || string_agg('{{"base":"' || base || '","live":' || live || ',"deleted":' || deleted || ',"indexable":' || indexable || ',"total":' || total || '}}', ',' ORDER BY base) || ']' AS content
    FROM (SELECT base, count(*) FILTER (WHERE NOT deleted AND indexable) AS live, count(*) FILTER (WHERE deleted) AS deleted, count(*) FILTER (WHERE indexable) AS indexable, count(*) AS total FROM {RECORDS_SQL} GROUP BY base)""",
)
def _(t: Tables):
    return records.holdings(t.records)


@query("rec_last_mtime", "SELECT event_type, max(ts) AS last_modified FROM events GROUP BY event_type")
def _(t: Tables):
    return t.events.groupBy("event_type").agg(F.max("ts").alias("last_modified"))


@query("rec_last_mtime_unknown_base", f"SELECT coalesce(max(mtime), 0)::BIGINT AS last_modified FROM {RECORDS_SQL} WHERE base = 'nowhere'")
def _(t: Tables):
    return records.last_modified(t.records, "nowhere")


@query(
    "rec_upsert",
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_id % 2) DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
)
def _(t: Tables):
    rows = t.events.select("user_id", "event_id", "event_type")
    stored = records.upsert(rows.where("false"), rows.where("event_id % 2 = 0"), "event_id", "user_id")
    return records.upsert(stored, rows.where("event_id % 2 = 1"), "event_id", "user_id")


@query(
    "rec_try_update",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'x' END AS a, CASE WHEN p_partkey % 3 = 1 THEN 'x' END AS b, CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 2 END::BIGINT AS mtime FROM part""",
)
def _(t: Tables):
    """Of three in a row, one comes in with its value in another column, one anew with nulls for values, one as it is stored."""
    kind = F.col("id") % 3
    rows = t.part.select(F.col("p_partkey").alias("id"))

    def version(mtime: int, first: int, second: int):
        return rows.select("id", F.when(kind == first, "x").alias("a"), F.when(kind == second, "x").alias("b"), F.lit(mtime).cast("bigint").alias("mtime"))

    return records.upsert(version(1, 1, 0), version(2, 0, 1), "mtime", try_update=True)


@query(
    "rec_get_tree",
    "SELECT 'n' || n_nationkey AS id, 0 AS depth FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'r' || n_regionkey, -1 FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'c' || c_custkey, 1 FROM customer WHERE c_nationkey = 3 "
    "UNION ALL SELECT 'o' || o_orderkey, 2 FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3",
)
def _(t: Tables):
    edges = _places(t)
    stored = edges.select(F.col("child").alias("id")).union(edges.select("parent")).distinct()
    return records.get_tree(stored, edges, "n3").select("id", "depth")


@query("rec_search_storage", "SELECT doc_id, lang FROM documents WHERE doc_id % 9 = 1 AND doc_id < 900")
def _(t: Tables):
    searcher = Searcher(t.documents.select("doc_id", "lang"), "doc_id", {"lang": "verbatim"})
    return records.SearchStorage(searcher).multi_get(list(range(1, 900, 9)))


@query("rec_clear_base", f"SELECT base, count(*) FILTER (WHERE NOT deleted AND base <> 'src3') AS live FROM {RECORDS_SQL} GROUP BY base")
def _(t: Tables):
    return records.clear_base(t.records, "src3").groupBy("base").agg(F.count(F.when(~F.col("deleted"), 1)).alias("live"))


@query(
    "rec_fulldump_diff",
    """SELECT coalesce(a.doc_id, b.doc_id) AS id, CASE WHEN a.doc_id IS NULL THEN 'insert' WHEN b.doc_id IS NULL THEN 'delete' WHEN a.text <> b.text THEN 'update' ELSE 'keep' END AS action
    FROM (SELECT doc_id, text FROM documents WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 3 <> 0) b ON a.doc_id = b.doc_id""",
)
def _(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    changed = F.when(F.col("id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return records.dump_difference(docs.where("id % 5 <> 0"), docs.where("id % 3 <> 0").withColumn("content", changed))


@query(
    "rec_fulldump_sync",
    f"SELECT id, deleted OR (base = 'src1' AND id % 3 = 0) AS deleted, indexable AND NOT (NOT deleted AND base = 'src1' AND id % 3 = 0) AS indexable FROM {RECORDS_SQL}",
)
def _(t: Tables):
    stored = t.records
    return records.sync_dump(stored, stored.where("id % 3 <> 0").select("id"), "src1", max_deletes=10**9, hide=True).select("id", "deleted", "indexable")


@query("rec_fulldump_guard", f"SELECT count(*) FILTER (WHERE deleted) AS deleted FROM {RECORDS_SQL}")
def _(t: Tables):
    stored = t.records
    return records.sync_dump(stored, stored.where("id % 3 <> 0").select("id"), "src1", max_deletes=1).agg(F.count(F.when(F.col("deleted"), 1)).alias("deleted"))


@query(
    "rec_aggregate_storage",
    f"""SELECT id, CASE WHEN id < 100 THEN 'old' WHEN base IN ('src0', 'src1') THEN 'hot' END AS storage FROM {RECORDS_SQL}""",
)
def _(t: Tables):
    stored = t.records
    whole = records.aggregate([stored.where("id % 2 = 0"), stored.where("id % 2 = 1")])
    return records.route(whole, [("old", F.col("id") < 100), ("hot", F.col("base").isin("src0", "src1"))]).select("id", "storage")


@query("rec_batch_job", f"SELECT 'x' || id AS id, base FROM {RECORDS_SQL} WHERE base = 'src2' AND mtime > 50 AND mtime < 800")
def _(t: Tables):
    return records.run_batch(t.records.withColumn("id", F.col("id").cast("string")), records.job_prefix("x"), "src2", 50, 800).select("id", "base")


@query("rec_page_keyset", "SELECT event_id, ts FROM events WHERE (ts, event_id) > (SELECT (ts, event_id) FROM events WHERE event_id = 100) ORDER BY ts, event_id LIMIT 50")
def _(t: Tables):
    last = t.events.where("event_id = 100").first()
    return records.page_after(t.events.select("event_id", "ts"), (last["ts"], last["event_id"]), 50, "ts", "event_id")


@query("rec_stamp", "SELECT event_id, (1700000000000::BIGINT << 20) + row_number() OVER (ORDER BY event_id) - 1 AS mtime FROM events")
def _(t: Tables):
    return records.stamp(t.events.select("event_id"), 1_700_000_000_000, "event_id", range_size=500)


@query("fn_stamp_parts", "SELECT event_id, event_id * 1000 AS ms, event_id % 7 AS salt, ((event_id * 1000) << 20) AS floor FROM events")
def _(t: Tables):
    stamped = t.events.select("event_id", scalar.salted_time(F.col("event_id") * 1000, F.col("event_id") % 7).alias("s"))
    return stamped.select("event_id", scalar.stamp_ms("s").alias("ms"), scalar.stamp_salt("s").alias("salt"), scalar.stamp_floor("s").alias("floor"))


def _edges(t: Tables):
    return t.lineitem.select(F.col("l_orderkey").alias("parent"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("child")).distinct()


EDGES_SQL = "(SELECT DISTINCT l_orderkey AS parent, l_orderkey * 10 + l_linenumber AS child FROM lineitem)"


@query("rel_children", f"SELECT e.parent, e.child AS id, l.l_quantity FROM {EDGES_SQL} e JOIN (SELECT l_orderkey * 10 + l_linenumber AS id, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1) l ON l.id = e.child JOIN orders ON o_orderkey = e.parent WHERE o_orderstatus = 'F'")
def _(t: Tables):
    items = t.lineitem.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.max("l_quantity").alias("l_quantity"))
    return graph.children_of(items, _edges(t), t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))


@query("rel_parents", f"SELECT e.child, o_orderkey AS id, o_orderstatus FROM {EDGES_SQL} e JOIN orders ON o_orderkey = e.parent")
def _(t: Tables):
    orders = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return graph.parents_of(orders, _edges(t), _edges(t).select(F.col("child").alias("id")))


@query("rel_related_ids", "SELECT o_custkey AS id, o_orderkey + 1000000000 AS related FROM orders UNION SELECT o_orderkey + 1000000000, o_custkey FROM orders")
def _(t: Tables):
    return graph.related_ids(t.orders.select(F.col("o_custkey").alias("parent"), (F.col("o_orderkey") + 1_000_000_000).alias("child")))


PLACES_SQL = """(SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL
SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


def _places(t: Tables):
    def ids(letter: str, column: str):
        return F.concat(F.lit(letter), F.col(column))

    a = t.nation.select(ids("r", "n_regionkey").alias("parent"), ids("n", "n_nationkey").alias("child"))
    b = t.customer.select(ids("n", "c_nationkey").alias("parent"), ids("c", "c_custkey").alias("child"))
    return a.union(b).union(t.orders.select(ids("c", "o_custkey").alias("parent"), ids("o", "o_orderkey").alias("child")))


@query(
    "rel_left_or_join",
    """SELECT n.id, n.n_name, p.x AS parents, c.x AS children FROM (SELECT 'n' || n_nationkey AS id, n_name FROM nation) n
    LEFT JOIN (SELECT 'n' || n_nationkey AS id, string_agg(DISTINCT 'r' || n_regionkey, ',' ORDER BY 'r' || n_regionkey) AS x FROM nation GROUP BY 1) p USING (id)
    LEFT JOIN (SELECT 'n' || s_nationkey AS id, string_agg(DISTINCT 's' || s_suppkey, ',' ORDER BY 's' || s_suppkey) AS x FROM supplier GROUP BY 1) c USING (id)""",
)
def _(t: Tables):
    nations = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), "n_name")
    up = t.nation.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    down = t.supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.concat(F.lit("s"), "s_suppkey").alias("child"))
    found = graph.with_relatives(nations, up.union(down))
    return found.select("id", "n_name", F.array_join("parent_ids", ",").alias("parents"), F.array_join("child_ids", ",").alias("children"))


@query("rel_require_children", "SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def _(t: Tables):
    orders = t.orders.select(F.col("o_orderkey").alias("id"))
    edges = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").cast("bigint").alias("child"))
    return graph.by_relatives(orders, edges, "child", "require")


@query("rel_disallow_children", "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(t: Tables):
    large = t.orders.where("o_totalprice > 300000")
    return graph.by_relatives(t.customer.select(F.col("c_custkey").alias("id")), large.select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child")), "child", "disallow")


@query(
    "rel_require_all_stored",
    "SELECT doc_id AS id FROM documents WHERE doc_id + 2 IN (SELECT doc_id FROM documents) AND doc_id * 2 IN (SELECT doc_id FROM documents)",
)
def _(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("id"))
    edges = docs.select(F.col("id").alias("parent"), F.explode(F.array(F.col("id") + 2, F.col("id") * 2)).alias("child"))
    return graph.by_relatives(docs, edges, "child", "require", "all")


CHAIN_SQL = "(SELECT conv_id * 1000 + turn AS parent, conv_id * 1000 + turn + 1 AS child FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1))"


def _chain(t: Tables):
    at = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("parent"), (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("child"))
    return at.join(at.select(F.col("parent").alias("child")), "child", "left_semi").select("parent", "child")


@query(
    "rel_expand_depth3",
    f"""WITH RECURSIVE x AS (SELECT conv_id * 1000 + turn AS root, conv_id * 1000 + turn AS node, 0 AS depth FROM conversations WHERE turn = 0
    UNION ALL SELECT root, child, depth + 1 FROM x JOIN {CHAIN_SQL} e ON e.parent = x.node WHERE depth < 3) SELECT root, node, depth FROM x""",
)
def _(t: Tables):
    roots = t.conversations.where("turn = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return graph.expand(roots, _chain(t), 3)


@query(
    "rel_expand_cycles",
    """WITH RECURSIVE e AS (SELECT doc_id AS parent, doc_id - doc_id % 3 + (doc_id + 1) % 3 AS child FROM documents),
    x AS (SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT root, child FROM x JOIN e ON e.parent = x.node) SELECT root, node FROM x""",
)
def _(t: Tables):
    edges = t.documents.select(F.col("doc_id").alias("parent"), (F.col("doc_id") - F.col("doc_id") % 3 + (F.col("doc_id") + 1) % 3).alias("child"))
    return graph.expand(t.documents.select(F.col("doc_id").alias("id")), edges, -1).select("root", "node")


@query(
    "rel_touch_ancestors",
    f"""WITH RECURSIVE e AS MATERIALIZED {PLACES_SQL}, x AS (SELECT 'o' || o_orderkey AS id FROM orders WHERE o_totalprice > 400000 UNION SELECT e.parent FROM x JOIN e ON e.child = x.id) SELECT id FROM x""",
)
def _(t: Tables):
    changed = t.orders.where("o_totalprice > 400000").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    return graph.touched(changed, _places(t), limit=3)


@query("rel_top_ancestor", "SELECT 'o' || o_orderkey AS root, 'r' || n_regionkey AS top FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def _(t: Tables):
    roots = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    return graph.top_ancestor(roots, _places(t))


@query("rel_top_ancestor_deep", "SELECT doc_id AS root, doc_id - doc_id % 20 AS top FROM documents")
def _(t: Tables):
    """Chains of twenty."""
    docs = t.documents.select(F.col("doc_id").alias("id"))
    return graph.top_ancestor(docs, docs.where("id % 20 <> 0").select((F.col("id") - 1).alias("parent"), F.col("id").alias("child")))


@query("rel_clear_child_edges", f"SELECT parent, child FROM {EDGES_SQL} WHERE parent % 10 <> 0")
def _(t: Tables):
    return graph.clear_relations(_edges(t), t.orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("id")), "child")


@query(
    "rel_graph_filter",
    "SELECT o_orderkey AS id FROM orders JOIN (SELECT l_orderkey, bool_and(l_returnflag = 'N') AS ok FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE ok AND o_totalprice > 1000",
)
def _(t: Tables):
    items = t.lineitem.groupBy((F.lit(1_000_000_000_000) + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.every(F.col("l_returnflag") == "N").alias("ok"))
    orders = t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    edges = t.lineitem.select(F.col("l_orderkey").alias("parent"), (F.lit(1_000_000_000_000) + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("child")).distinct()
    whole = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 1000).alias("ok")).union(items.select("id", "ok"))
    return graph.graph_filter(whole, edges, F.col("ok"), depth=1).where("id < 1000000000000").select("id")


@query(
    "rel_resolve",
    """SELECT a.item_id AS origin, string_agg(b.doc_id::VARCHAR, ',' ORDER BY b.doc_id) AS hits FROM benchmark a LEFT JOIN
    (SELECT doc_id, lower(split_part(text, ' ', 1)) AS term, row_number() OVER (PARTITION BY lower(split_part(text, ' ', 1)) ORDER BY doc_id) AS n FROM documents) b
    ON b.term = lower(split_part(a.text, ' ', 1)) AND b.n <= 5 GROUP BY 1""",
)
def _(t: Tables):
    first = F.lower(F.split_part(F.col("text"), F.lit(" "), F.lit(1)))
    found = graph.resolve(t.benchmark, t.documents, "item_id", "doc_id", first, first, 5)
    return found.select("origin", F.array_join(F.col("hits").cast("array<string>"), ",").alias("hits"))


@query(
    "rel_merge_volumes",
    """SELECT o_orderkey AS id, concat_ws('|', o_orderstatus, string_agg(flag, '|' ORDER BY child)) AS content FROM orders LEFT JOIN
    (SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS child, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2) ON l_orderkey = o_orderkey GROUP BY 1, o_orderstatus""",
)
def _(t: Tables):
    items = t.lineitem.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.max("l_returnflag").alias("content"))
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("content"))
    return graph.merge_volumes(orders, items, _edges(t), joiner="|").select("id", "content")
