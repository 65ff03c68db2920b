import gzip
import io
import time
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.catalog.registry import QUERIES
from tidewell.functions import scalar
from tidewell.index import IndexSearcher, write_index
from tidewell.operators import browse, facets, federation, filters, graph, layout, records, suggest
from tidewell.search import Request, Searcher, SearchService
from tidewell.sources import files, marc, sinks
from tidewell.streaming.incremental import RecordReader


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, wanted",
    [("2010-03-04 05:06:07", "2010-03-04T05:06:07Z"), ("2010-03-04", "2010-03-04T00:00:00Z"), ("in 2010", "2010-01-01T00:00:00Z"), ("2010-03", "2010-03-01T00:00:00Z"), ("no", "")],
)
def test_iso_date_time(spark, given, wanted):
    assert one(spark, scalar.iso_date_time(F.lit(given))) == wanted


@pytest.mark.parametrize("a, b, wanted", [("199?", None, " ".join(map(str, range(1990, 2000)))), ("1999", None, "1999"), ("1998", "2001", "1998 1999 2000 2001"), ("1???", None, "1???"), ("about 1900", None, "about 1900"), ("x", "y", "x-y")])
def test_year_range(spark, a, b, wanted):
    assert one(spark, scalar.year_range(F.lit(a), F.lit(b) if b else None)) == wanted


def test_scalars(spark):
    assert one(spark, scalar.isbn13(F.lit("0-306-40615-2"))) == "9780306406157"
    assert one(spark, scalar.isbn13(F.lit("978-0-306-40615-7"))) == "9780306406157"
    assert one(spark, scalar.normalize(F.lit(" a-b,(c).[d] "))) == "abcd"
    assert one(spark, scalar.keep_entities(F.lit("a&b <![CDATA[c&d]]> e&f"))) == "a&b <![CDATA[c&amp;d]]> e&f"
    assert one(spark, scalar.expand_date_time(F.lit("2010-11-12T13:14:15Z"))).endswith("13:14:15 13.14.15 131415")
    scalar.register(spark)
    assert spark.sql("SELECT tw_isbn13('0306406152') AS a, tw_normalize('a-b') AS b, tw_iso_date_time('1999') AS c").first() == ("9780306406157", "ab", "1999-01-01T00:00:00Z")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_upsert_try_update(spark):
    schema = "id string, v string, mtime bigint"
    old = spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], schema)
    new = spark.createDataFrame([("a", "1", 10), ("b", "3", 11), ("b", "4", 12), ("c", "5", 13)], schema)
    assert rows(records.upsert(old, new, "mtime"), "id", "v", "mtime") == [("a", "1", 10), ("b", "4", 12), ("c", "5", 13)]
    assert rows(records.upsert(old, new, "mtime", try_update=True), "id", "v", "mtime") == [("a", "1", 1), ("b", "4", 12), ("c", "5", 13)]


def test_private_ids(spark):
    table = spark.createDataFrame([("__x__",)], "id string")
    with pytest.raises(PermissionError):
        records.get(table, "__x__")
    assert records.get(table, "__x__", allow_private=True).count() == 1


@pytest.mark.parametrize("edges", [[("a", "a")], [("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a")]])
def test_cycles_end(spark, edges):
    table = spark.createDataFrame(edges, "parent string, child string")
    roots = spark.createDataFrame([("a",)], "id string")
    found = graph.expand(roots, table, -1)
    assert found.count() == len({x for e in edges for x in e})
    again = graph.expand(roots, table, 10)
    assert rows(again, "root", "node") == rows(found, "root", "node")


def test_clear_relations_compat(spark):
    edges = spark.createDataFrame([("p", "x"), ("x", "c")], "parent string, child string")
    ids = spark.createDataFrame([("x",)], "id string")
    assert rows(graph.clear_relations(edges, ids, "child"), "parent", "child") == [("p", "x")]
    assert rows(graph.clear_relations(edges, ids, "child", compat=True), "parent", "child") == []
    assert rows(graph.clear_relations(edges, ids, "parent"), "parent", "child") == [("x", "c")]


def test_hierarchy_totals_are_own_plus_valid_children(spark):
    paths = spark.createDataFrame([(1, "a"), (2, "a/b"), (3, "a/b"), (4, "a/c"), (5, "d/e/f")], "doc int, path string")
    got = {r["path"]: (r["own"], r["total"]) for r in facets.hierarchical(paths).collect()}
    assert got == {"a": (1, 4), "a/b": (2, 2), "a/c": (1, 1), "d": (0, 1), "d/e": (0, 1), "d/e/f": (1, 1)}
    strict = facets.hierarchical(paths, facets.Hierarchy(default=facets.Level(min_count=1)))
    assert sorted(r["path"] for r in strict.collect()) == ["a", "a/b", "a/c"]


def test_hierarchy_of_all_tags(spark):
    """A parent of more children than the default limit keeps them all where all are asked for, as the URL paths' query does."""
    many = facets.MAX_TAGS + 3
    paths = spark.range(many).select(F.col("id").alias("doc"), F.concat(F.lit("a/"), "id").alias("path"))
    got = facets.hierarchical(paths, facets.Hierarchy(default=facets.Level(max_tags=-1)))
    assert rows(got.groupBy("level").agg(F.count("*").alias("n"), F.max("rank").alias("last")), "level", "n", "last") == [(1, 1, 1), (2, many, many)]
    assert facets.hierarchical(paths).count() == 1 + facets.MAX_TAGS


def test_url_paths_of_a_large_host(spark, tmp_path):
    many = facets.MAX_TAGS + 3
    spark.range(many).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.example/"), "id", F.lit("?q")).alias("url")).write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["fct_url_paths"](spark, str(tmp_path))
    assert rows(got.groupBy("level").agg(F.sum("total").alias("n"), F.count("*").alias("tags")), "level", "n", "tags") == [(1, many, 1), (2, many, many)]


def test_facet_merge_is_associative(spark):
    def part(*pairs):
        return spark.createDataFrame(list(pairs), "term string, count bigint")

    a, b, c = part(("x", 1), ("y", 2)), part(("x", 3)), part(("z", 1), ("y", 1))
    left = facets.merge([facets.merge([a, b]), c])
    right = facets.merge([a, facets.merge([b, c])])
    assert rows(left, "term", "count") == rows(right, "term", "count") == [("x", 4), ("y", 3), ("z", 1)]


def test_facet_requests():
    assert facets.parse_request("A, B (7), C (ALPHA_DESC)")[1].limit == 7
    with pytest.raises(ValueError):
        facets.parse_request("A (NOPE)")
    assert facets.value_filters('a:b AND c:"d e"') == [("a", "b"), ("c", "d e")] and facets.value_filters("a:b OR c:d") == []


def test_pages_join_to_the_whole(spark):
    table = spark.range(50).withColumn("v", F.col("id") % 7)
    order = [F.asc("v"), F.asc("id")]
    whole = [r["id"] for r in table.orderBy(*order).collect()]
    assert [r["id"] for p in browse.pages(table, order, 5, 30, 8) for r in p.collect()] == whole[5:35]


def test_lookup_at_the_ends(spark):
    counts = spark.createDataFrame([("b", 1), ("d", 2), ("f", 3)], "term string, count bigint")
    assert [r["term"] for r in browse.index_lookup(counts, "a", -2, 2).collect()] == ["b", "d"]
    assert [r["term"] for r in browse.index_lookup(counts, "z", -2, 2).collect()] == ["d", "f"]
    assert [r["position"] for r in browse.index_lookup(counts, "E", -1, 2).collect()] == [1, 2]


def test_enforce_moves_rows_up(spark):
    table = spark.createDataFrame([(i, "a" if i < 30 else "b", float(100 - i)) for i in range(40)], "id bigint, source string, score double")
    merged = federation.merge(table, "score")
    top = federation.enforce(merged, {"b": 3}, "q", 20).where("position < 20")
    assert top.where("source = 'b'").count() == 3
    assert federation.enforce(merged, {"a": 3}, "q", 20).where("position < 20 AND source = 'a'").count() == 20


def test_suggestions(spark):
    store = suggest.SuggestStore(spark.createDataFrame([], "normalized string, query string, hits bigint, count bigint"))
    for query, hits in (("Foo Bar", 3), ("foo baz", 2), ("foo bar", 5), ("gone", 1), ("gone", 0)):
        store.add(query, hits)
    assert rows(store.suggest("FOO"), "query", "hits", "count") == [("foo bar", 5, 2), ("foo baz", 2, 1)]
    assert store.suggest("f", least=2).count() == 0
    store.add("foo baz", 4, count=9)
    store.delete("FOO BAR")
    assert rows(store.suggest("f"), "query", "hits", "count") == [("foo baz", 4, 9)]


def test_replacing_is_linear(spark):
    """Many places in one text, each looked up once."""
    places = 30_000
    given = spark.createDataFrame([("th7thing" * (places // 2),), ("",), (None,)], "text string").select(filters.replaced(F.col("text"), [("[0-9]+", "#")], {"th": "ð", "thing": "res"}))
    began = time.monotonic()
    assert [r[0] for r in given.collect()] == ["ð#res" * (places // 2), "", None]
    assert time.monotonic() - began < 60


def test_requirements():
    assert layout.parse_requirement("3@100") == (3, False, 100) and layout.parse_requirement("50%@20") == (50, True, 20)
    with pytest.raises(ValueError):
        layout.parse_requirement("x")


def test_service(spark):
    docs = spark.createDataFrame([(1, "red fox", "en"), (2, "red red hen", "en"), (3, "blue fox", "da"), (4, None, "da")], "id bigint, text string, lang string")
    service = SearchService(Searcher(docs, "id", {"text": "text", "lang": "verbatim"}, ["text"]))
    assert [r["id"] for r in service.simple_search("red").collect()] == [2, 1]
    assert [r["id"] for r in service.filter_search_sorted("lang:en", "*", 10, 0, "text").collect()] == [1, 2]
    assert rows(service.simple_facet("fox", "lang")["lang"], "term", "count") == [("da", 1), ("en", 1)]
    assert [r["term"] for r in service.index_lookup("lang", "e", -1, 2).collect()] == ["da", "en"]
    assert [r["id"] for r in service.more_like_this(1, "text").collect()] == [2, 3]
    assert service.did_you_mean("fix", "text").first()["term"] == "fox"
    assert service.get_field(3, "lang") == "da" and len(service.direct_json({"query": "fox"})) == 2
    grouped = service.searcher.search(Request("red OR fox", group="lang"))
    assert rows(grouped, "lang", "num_found") == [("da", 1), ("en", 2)]


def test_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/x.xml", "<a/>")
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("y.txt", "y")
    (tmp_path / "z.xml.gz").write_bytes(gzip.compress(b"<z/>"))
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    data = b"deep"
    for _ in range(12):
        data = gzip.compress(data)
    (tmp_path / ("deep.xml" + ".gz" * 12)).write_bytes(data)
    found = files.read_archives(files.read_files(spark, str(tmp_path)), "*.xml").collect()
    assert sorted(bytes(r["content"]) for r in found if r["error"] is None) == [b"<a/>", b"<z/>", b"deep"]
    broken = [r for r in found if r["error"]]
    assert len(broken) == 1 and broken[0]["name"].endswith("bad.zip") and broken[0]["content"] is None


def test_archives_come_in_frames(monkeypatch):
    """Few frames for many small files, and none of much more than the bound of bytes; no row is lost at their ends."""

    class Given:
        def __init__(self, *batches):
            self.batches = [pd.DataFrame(rows, columns=["path", "content"]) for rows in batches]

        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            return list(run(iter(self.batches)))

    small = [(f"{i}.txt", b"%d" % i) for i in range(4500)]
    frames = files.read_archives(Given(small[:3000], [], small[3000:]))
    assert [len(f) for f in frames] == [2000, 2000, 500]
    assert [(p, c) for f in frames for p, c in zip(f["origin"], f["content"], strict=True)] == small
    monkeypatch.setattr(files, "FRAME_BYTES", 10)
    large = files.read_archives(Given([("a", b"x" * 6), ("b", b"x" * 30), ("c.gz", b"no"), ("d", b"x")]))
    assert [list(f["name"]) for f in large] == [["a", "b"], ["c.gz", "d"]] and large[1]["error"].notna().tolist() == [True, False]
    assert files.read_archives(Given([])) == []


def test_listings(spark):
    listing = spark.createDataFrame([("a\r\nb\n\n c ",)], "content string")
    assert files.pulled(listing) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        files.pulled(listing, most=2)


def test_row_functions(spark):
    table = spark.createDataFrame([(1, "a", 1.5), (2, None, None), (3, "c", 3.5)], "id bigint, v string, w double")

    def upper(row):
        return row | {"v": row["v"].upper()}

    assert rows(filters.each(table, upper), "id", "v", "w") == [(1, "A", 1.5), (3, "C", 3.5)]
    marked = {r["id"]: r["error"] for r in filters.each(table, upper, errors="mark").collect()}
    assert marked[1] is None and marked[2].startswith("AttributeError")

    def stop(row):
        raise filters.Fatal("enough")

    with pytest.raises(Exception, match="enough"):
        filters.each(table, stop).collect()
    with pytest.raises(KeyError):
        filters.plugged(table, ["nowhere"])


def test_parts_of_records(spark):
    table = spark.createDataFrame([("a", "x1", {"k": "v"}, ["p", "q"])], "id string, content string, meta map<string,string>, parent_ids array<string>")
    assert one_row(table.select(filters.part("meta.k").alias("a"), filters.part("parentid").alias("b"), filters.part("xmlfull", 1).alias("c"))) == ("v", "p,q", "x")
    shaped = filters.shape(table, [("id", "meta.new", "(.)", "<$1>"), ("meta.k", "content", "v", "$0!")], require="all")
    assert one_row(shaped.select("content", F.col("meta")["new"], F.col("meta")["k"])) == ("v!", "<a>", "v")
    with pytest.raises(ValueError):
        sinks.validated(table)


def one_row(df):
    return tuple(df.collect()[0])


def test_spread(spark, tmp_path):
    from tidewell.session import spread

    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "one"))
    small = spark.read.parquet(str(tmp_path / "one"))
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(small).count() == 10
    spark.range(10).repartition(8).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert spread(many) is many


def test_batches_of_bytes(spark):
    table = spark.createDataFrame([(i, "x" * 10) for i in range(10)], "id bigint, content string")
    got = [r["batch"] for r in filters.batched(table, ["id"], 6, 25).orderBy("id").collect()]
    assert [(b["rows"], b["part"]) for b in got] == [(0, 0)] * 3 + [(0, 1)] * 2 + [(0, 2)] + [(1, 0)] * 3 + [(1, 1)]


def test_upsert_nulls(spark):
    schema = "id string, a string, b string, mtime bigint"
    old = spark.createDataFrame([("k", "x", None, 1), ("l", None, None, 1)], schema)
    new = spark.createDataFrame([("k", None, "x", 2), ("l", None, None, 2)], schema)
    assert sorted(map(tuple, records.upsert(old, new, "mtime", try_update=True).collect())) == [("k", None, "x", 2), ("l", None, None, 1)]


def test_top_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    roots = spark.createDataFrame([("a",), ("y",), ("z",)], "id string")
    assert rows(graph.top_ancestor(roots, edges), "root", "top") == [("a", "b"), ("y", "x"), ("z", "z")]
    assert rows(graph.top_ancestor(roots, edges, 1), "root", "top") == [("a", "c"), ("y", "x"), ("z", "z")]


def test_search_storage(spark):
    docs = spark.createDataFrame([(f"r{i}", "x") for i in range(120)], "id string, v string")
    storage = records.SearchStorage(Searcher(docs, "id", {"v": "verbatim"}))
    assert storage.multi_get([f"r{i}" for i in range(60, 200)]).count() == 60 and storage.get("r5").count() == 1
    with pytest.raises(NotImplementedError):
        storage.flush([])
    with pytest.raises(PermissionError):
        storage.get("__private__")


def test_reader_limits(spark, tmp_path):
    table = spark.createDataFrame([(i, "a" if i % 2 else "b", i // 3) for i in range(20)], "id bigint, base string, mtime bigint")
    seen = []
    reader = RecordReader(lambda: table, str(tmp_path / "mark"), base="a")
    assert reader.run(lambda part: seen.extend(r["id"] for r in part.collect()), most=4, total=7) == 7
    again = RecordReader(lambda: table, str(tmp_path / "mark"), base="a")
    assert again.run(lambda part: seen.extend(r["id"] for r in part.collect())) == 3 and sorted(seen) == list(range(1, 20, 2))
    assert RecordReader(lambda: table, str(tmp_path / "mark"), base="a", from_scratch=True).next().count() == 10
    assert again.run(lambda part: None, seconds=0.5, follow=True, pause=0.1) == 0


def test_index_of_several_values(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["red fox", "blue hen"], "en"), (2, ["fox red"], None), (3, None, "da")], "id bigint, text array<string>, lang string")
    searcher = Searcher(docs, "id", {"text": "text", "lang": "verbatim"}, ["text"])
    write_index(searcher, str(tmp_path / "i"))
    index = IndexSearcher(spark, str(tmp_path / "i"), "id", searcher.fields, ["text"])
    for text in ("red", '"red fox"', "red -lang:en", "nowhere:x OR hen", "-lang:da", "*", "lang:en OR lang:da", "re* AND fo?", "nothing"):
        assert rows(index.matches(text), "id") == rows(searcher.matches(text), "id"), text
        a, b = ([(r["id"], round(r["score"], 9)) for r in s.scored(text).orderBy("id").collect()] for s in (index, searcher))
        assert a == b, text


def test_marc_round_trip(spark, tmp_path):
    fields = [{"tag": "001", "ind1": "", "ind2": "", "subfields": [{"code": "", "value": "id1"}]}, {"tag": "245", "ind1": "1", "ind2": "0", "subfields": [{"code": "a", "value": "Blåbær"}, {"code": "c", "value": "x"}]}]
    (tmp_path / "m.mrc").write_bytes(marc.encode_record(fields) * 2 + b"broken\x1d")
    found = marc.read_binary(files.read_files(spark, str(tmp_path)))
    assert found.count() == 2 and found.select(marc.first("fields", "245", "a").alias("x")).first()["x"] == "Blåbær"
    assert "Blåbær" in marc.to_xml(fields) and marc.parse_lines("245 00 *aA@*B*cD")[0]["subfields"][0]["value"] == "A*B"


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([("1", "a", False, 1), ("2", "b", False, 2)], "id string, base string, deleted boolean, mtime bigint")
    sinks.write_records(table, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("base = 'a'").count() == 1
    sinks.clear_then_write(table.where("id = '2'").withColumn("id", F.lit("3")), table, "b", str(tmp_path / "u"))
    assert rows(spark.read.parquet(str(tmp_path / "u")).where("deleted"), "id") == [("2",)]
    pages = files.generated_pages(spark, 3, lines=4, words=5)
    again = files.generated_pages(spark, 3, lines=4, words=5)
    assert rows(pages.select("id", F.to_json("page").alias("p")), "id", "p") == rows(again.select("id", F.to_json("page").alias("p")), "id", "p")
    page = pages.where("id = 1").first()["page"]
    assert (page["width"], page["height"], len(page["blocks"][0]["lines"]), len(page["blocks"][0]["lines"][0]["strings"])) == (500, 120, 4, 5)
    assert all(s["content"].startswith("w") and s["vpos"] == 30 * y for y, line in enumerate(page["blocks"][0]["lines"]) for s in line["strings"])
