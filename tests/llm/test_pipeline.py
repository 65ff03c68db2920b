"""Each stage of the pipeline against a plain computation on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm_operators import near_copies, plain_components, plain_contamination, texts
from tidewell.llm import line_dedup, ngram_join

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    extra = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "12 34", "en", "src0", 5)], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_duplicates", "decontaminate", "pack"]

    known = stages["language_id"](spark, docs.unionByName(extra), SF)
    assert known.columns == columns and sorted(texts(known)) == sorted(texts(docs))

    cleaned = stages["line_dedup"](spark, known, SF)
    lines = {}
    for r in known.collect():
        for line in r["text"].split("\n"):
            lines.setdefault(line.strip(" \t\r"), set()).add(r["source"])
    wanted = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if not (key := x.strip(" \t\r")) or len(lines[key]) < line_dedup.MIN_SITES) for r in known.collect()}
    assert cleaned.columns == columns and texts(cleaned) == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in cleaned.collect())

    single = stages["near_duplicates"](spark, cleaned, SF)
    left = {doc for doc, _, least in plain_components(sorted(wanted.items())) if doc == least}
    assert single.columns == columns and set(texts(single)) == left

    clean = stages["decontaminate"](spark, single, SF)
    judged = {doc: plain_contamination(wanted[doc], items) for doc in left}
    assert clean.columns == columns and set(texts(clean)) == {d for d, (n, h, _) in judged.items() if not (h and 20 * h >= n)}

    packed = stages["pack"](spark, clean, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(texts(clean))


def test_run(spark):
    """The stages in a row give what they give one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    whole = corpus_pipeline.run(spark, SF)
    names = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(names).collect())) == sorted(map(tuple, docs.select(names).collect())) and whole.count() > 0


EXTRA = {"score": 777.0, "lang_pred": "mine", "n_lines": 778, "n_removed": 1, "n_words": 2, "n_hit": 3, "n_items": 4, "items_sha256": "s", "contaminated": True, "c": 5, "root": 6, "_th": 7, "least": 8, "_kept": 9, "__ta": 10}


def test_stages_keep_other_columns(spark):
    """Columns of any name come through all but the last stage, with repeated rows and nulls."""
    rows = [(1, "A text of some words that stays as it is.", "en", "s1", 41), (1, "A text of some words that stays as it is.", "en", "s1", 41), (2, None, None, None, None), (None, "Another text with other words in it.", "en", None, 36), (4, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.select("*", *[F.lit(v).alias(k) for k, v in EXTRA.items()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [*"doc_id text lang source n_chars".split(), *EXTRA], name
        for r in docs.collect():
            assert all(r[k] == v for k, v in EXTRA.items()), name
    assert sorted((r["doc_id"] or 0 for r in docs.collect())) == [0, 1]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 2


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_language_id_without_labels(spark):
    """Rows with letters stay where no row has a language to learn from."""
    rows = [(1, "Words in a row.", None), (2, "12 34", None), (3, None, None), (4, "äöü", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(texts(dict(corpus_pipeline.STAGES)["language_id"](spark, docs, SF))) == [1, 4]


def test_near_duplicates_rule(spark):
    """Texts that are alike by five words and 0.8, but not by four words and 0.85, lose the second copy."""
    words = [f"w{i}" for i in range(50)]
    # One word of 50 replaced: 41 of 51 shingles of five words are common (0.804), 43 of 51 of four (0.843).
    rows = [(1, " ".join(words)), (2, " ".join([*words[:25], "other", *words[26:]])), (3, " ".join(f"v{i}" for i in range(50)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(texts(dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF))) == [1, 3]
    assert sorted(texts(ngram_join.one_of_each(docs))) == [1, 2, 3]


@pytest.mark.parametrize("seed", [4, 5])
def test_near_duplicates_by_brute_force(spark, seed):
    rows = near_copies(seed)
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    left = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF)
    assert sorted(texts(left)) == sorted({rows[r][0] for r in root})
