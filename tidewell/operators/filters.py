"""Filters and transforms over rows: each takes and returns a DataFrame, for df.transform(...)."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def sequence(*steps: Step) -> Step:
    """Steps in order, as one."""
    return lambda df: reduce(lambda rows, step: step(rows), steps, df)


class Fatal(Exception):
    """Raised by a row function to stop the whole run; any other exception concerns its row alone."""


def each(df: DataFrame, function: Callable[[dict], dict | list[dict] | None], schema=None, errors: str = "drop", mark: str = "error") -> DataFrame:
    """Rows through a function of one row as a dict; it gives the new row, several new ones, or None to drop it.

    A row at which it raises is dropped, or kept as it came with the message in a column (`mark`); Fatal ends the run.
    """
    from pyspark.sql import types as T

    target = T._parse_datatype_string(schema) if isinstance(schema, str) else (schema or df.schema)
    keep = errors == "mark"
    shown = T.StructType([*target.fields, T.StructField(mark, T.StringType())]) if keep else target
    names = target.fieldNames()

    def run(rows):
        for row in rows:
            given = row.asDict(recursive=False)
            try:
                made = function(dict(given))
            except Fatal:
                raise
            except Exception as problem:  # any failure of a user's function concerns its row
                if keep:
                    yield (*[given.get(n) for n in names], f"{type(problem).__name__}: {problem}")
                continue
            for new in made if isinstance(made, list) else [made] if made is not None else []:
                yield (*[new.get(n) for n in names], None) if keep else tuple(new.get(n) for n in names)

    def batches(parts):
        import pandas as pd
        from pyspark.sql import Row

        for part in parts:
            rows = (Row(**{k: None if _is_missing(v) else v for k, v in r.items()}) for r in part.to_dict("records"))
            yield pd.DataFrame(list(run(rows)), columns=shown.fieldNames(), dtype=object)

    return df.mapInPandas(batches, shown)


def _is_missing(value) -> bool:
    return value is None or (isinstance(value, float) and value != value)


#: Row functions and parsers by name, for configurations that name them.
PLUGGED: dict[str, Callable] = {}


def plug(name: str) -> Callable:
    """Registers a step (a function of a DataFrame) under a name."""

    def register(function: Callable) -> Callable:
        if name in PLUGGED:
            raise ValueError(f"{name} is taken")
        PLUGGED[name] = function
        return function

    return register


def plugged(df: DataFrame, steps: list[str | tuple[str, dict]]) -> DataFrame:
    """The named steps in order, each with its options."""
    for step in steps:
        name, options = (step, {}) if isinstance(step, str) else step
        if name not in PLUGGED:
            raise KeyError(f"no step is called {name}")
        df = PLUGGED[name](df, **options)
    return df


def batched(df: DataFrame, order: list[str], most_rows: int, most_bytes: int | None = None, size: str = "content", batch: str = "batch") -> DataFrame:
    """Rows with the number of their batch in the order: of at most so many rows, and of about so many bytes.

    Bytes are counted over the rows before, so a batch may exceed them by its last row.
    """
    placed = _numbered(df, order).withColumn(batch, F.floor((F.col("_p") - 1) / most_rows))
    if most_bytes is None:
        return placed.drop("_p")
    bytes_ = F.coalesce(F.octet_length(F.col(size).cast("binary")), F.lit(0)).cast("bigint")
    before = F.sum(bytes_).over(Window.partitionBy(batch).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    part = F.floor(F.coalesce(before, F.lit(0)) / most_bytes)
    return placed.withColumn("_part", part).withColumn(batch, F.struct(F.col(batch).alias("rows"), F.col("_part").alias("part"))).drop("_p", "_part")


def content_to_stream(df: DataFrame, content: str = "content", stream: str = "stream", charset: str = "UTF-8") -> DataFrame:
    """A record's text as the bytes that a parser reads; the text goes."""
    return df.withColumn(stream, F.encode(F.col(content).cast("string"), charset)).drop(content)


def stream_to_content(df: DataFrame, stream: str = "stream", content: str = "content", charset: str = "UTF-8") -> DataFrame:
    return df.withColumn(content, F.decode(stream, charset)).drop(stream)


def discard(df: DataFrame, condition: Column, how: str = "drop", mark: str = "discarded") -> DataFrame:
    """Rows for which the condition holds are dropped, or marked in a column.  An unknown condition keeps."""
    bad = F.coalesce(condition, F.lit(False))
    return df.withColumn(mark, bad) if how == "mark" else df.where(~bad)


def by_regex(df: DataFrame, column: str, patterns: list[str], include: bool = False) -> DataFrame:
    """Drops the rows that any pattern is found in; with include, keeps only these."""
    hit = reduce(Column.__or__, [F.coalesce(F.col(column).cast("string").rlike(p), F.lit(False)) for p in patterns])
    return df.where(hit if include else ~hit)


def matching_amount(patterns: dict[str, list[str]], full: bool = False, dot_all: bool = False) -> Column:
    """How many of the patterns, given by column, match."""
    flags = "(?s)" if dot_all else ""

    def test(column: str, p: str) -> Column:
        pattern = f"{flags}^(?:{p})$" if full else flags + p
        return F.coalesce(F.col(column).cast("string").rlike(pattern), F.lit(False)).cast("int")

    return reduce(Column.__add__, [test(c, p) for c, ps in patterns.items() for p in ps])


def by_amount(df: DataFrame, patterns: dict[str, list[str]], compare: str = "more", amount: int = 0, full: bool = False, dot_all: bool = False) -> DataFrame:
    """Rows for which less, equal or more patterns than amount match; more than 0 unless told otherwise."""
    n = matching_amount(patterns, full, dot_all)
    return df.where({"less": n < amount, "equal": n == amount, "more": n > amount}[compare])


#: Rows that one task ranks (about), and the most ranges.
RANGE_ROWS, MOST_RANGES = 1 << 20, 4096


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with `_p`, their 1-based place in the order, without sorting all of them in one task.

    Rows are dealt into ranges of the first order column (by quantiles), as many as their number asks for, ranked
    in each, and the counts of the ranges before are added.
    """
    first = order[0]
    ranges = min(MOST_RANGES, max(8, -(-df.count() // RANGE_ROWS)))
    bounds = df.select(F.percentile_approx(first, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]))).first()[0] or []
    edges = sorted(set(bounds))
    place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda b: b < F.col(first))) if edges else F.lit(0)
    ranged = df.withColumn("_r", F.coalesce(place, F.lit(0)))
    counts = ranged.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_r", (F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).alias("_before"))
    ranked = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_r").orderBy(*order)))
    return ranked.join(F.broadcast(before), "_r").withColumn("_p", F.col("_before") + F.col("_i")).drop("_r", "_before", "_i")


def counted(df: DataFrame, order: list[str], least: int = 0, most: int | None = None) -> DataFrame:
    """Rows from place `least` on, `most` of them at most."""
    first = max(least, 1)
    rows = _numbered(df, order).where(F.col("_p") >= first)
    return (rows if most is None else rows.where(F.col("_p") < first + most)).drop("_p")


def fraction(df: DataFrame, share: float, order: list[str]) -> DataFrame:
    """An even share: the first row, and each row at which the floor of place * share steps up."""
    p = F.col("_p")
    return _numbered(df, order).where((p == 1) | (F.floor(p * share) > F.floor((p - 1) * share))).drop("_p")


def by_size(df: DataFrame, column: str, least: int | None = None, most: int | None = None) -> DataFrame:
    size = F.octet_length(F.col(column))
    if least is not None:
        df = df.where(size >= least)
    return df if most is None else df.where(size <= most)


def first_of_each(df: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """The first row of each key: a minimum by key, whose partial step runs before the shuffle."""
    named = [k.alias(f"_k{i}") if isinstance(k, Column) else F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    rest = F.struct(*[c for c in df.columns])
    best = df.select(*named, F.struct(*order).alias("_o"), rest.alias("_row")).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min_by("_row", "_o").alias("_row"))
    return best.select("_row.*")


def route(df: DataFrame, rules: list[tuple[str, Column]], fallback: str | None = None, allow_unmatched: bool = False, column: str = "branch") -> DataFrame:
    """Names the branch of each row: that of the first rule that holds, else the fallback.  Unmatched rows go,
    unless allowed (null branch)."""
    chosen = reduce(lambda rest, rule: F.when(F.coalesce(rule[1], F.lit(False)), F.lit(rule[0])).otherwise(rest), reversed(rules), F.lit(fallback).cast("string"))
    routed = df.withColumn(column, chosen)
    return routed if fallback or allow_unmatched else routed.where(F.col(column).isNotNull())


def mux(df: DataFrame, branches: list[tuple[str, Column, Step]], fallback: Step | None = None) -> DataFrame:
    """Each branch's rows through its own step, together again."""
    routed = route(df, [(n, c) for n, c, _ in branches], "" if fallback else None)
    parts = [step(routed.where(F.col("branch") == name).drop("branch")) for name, _, step in branches]
    if fallback:
        parts.append(fallback(routed.where(F.col("branch") == "").drop("branch")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def tee(df: DataFrame, bases: list[str], prefixes: list[str], key: str = "id", base: str = "base") -> DataFrame:
    """A copy of each row for each base and id prefix."""
    copies = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(p).alias("p")) for b in bases for p in prefixes])
    exploded = df.withColumn("_copy", F.explode(copies))
    return exploded.withColumns({key: F.concat(F.col("_copy.p"), F.col(key).cast("string")), base: F.col("_copy.b")}).drop("_copy")


def scripted(df: DataFrame, function, schema=None) -> DataFrame:
    """A user's function over batches: an iterator of pandas frames to another, which may drop rows."""
    return df.mapInPandas(function, schema or df.schema)


# Addressing of a record's parts: id, base, content, meta.KEY and the like.
def part(name: str, limit: int | None = None) -> Column:
    if name.startswith("meta."):
        value = F.col("meta")[name[5:]]
    elif name in ("parentid", "childid"):
        value = F.array_join(F.col(name[:-2] + "_ids"), ",")
    else:
        value = F.col({"xmlfull": "content"}.get(name, name)).cast("string")
    return value if limit is None else F.substring(value, 1, limit)


def set_part(df: DataFrame, name: str, value: Column) -> DataFrame:
    if name.startswith("meta."):
        single = F.create_map(F.lit(name[5:]), value)
        rest = F.map_filter("meta", lambda k, v: k != name[5:])
        return df.withColumn("meta", F.map_concat(rest, single))
    return df.withColumn({"xmlfull": "content"}.get(name, name), value)


def templated(source: Column, pattern: str, template: str) -> Column:
    """The template with $1... and $0 filled from the pattern's first match; null without a match."""
    pieces = [F.regexp_extract(source, pattern, int(x[1:])) if re.fullmatch(r"\$\d+", x) else F.lit(x) for x in re.split(r"(\$\d+)", template) if x]
    made = F.concat(*pieces) if pieces else F.lit("")
    return F.when(source.rlike(pattern), made)


def shape(df: DataFrame, rules: list[tuple[str, str, str, str]], require: str = "none", hash_ids_above: int | None = None, key: str = "id") -> DataFrame:
    """Rewrites parts by (source, destination, pattern, template); a rule without a match leaves its part.

    require: rows must have all, at least one, or none (no requirement) of the rules match.  hash_ids_above:
    longer ids become their MD5.
    """
    values = [templated(part(source), pattern, template) for source, _, pattern, template in rules]
    hit = [v.isNotNull() for v in values]
    rows = df.withColumns({f"_v{i}": v for i, v in enumerate(values)})
    if require != "none":
        rows = rows.withColumn("_hit", reduce(Column.__and__ if require == "all" else Column.__or__, hit)).where("_hit").drop("_hit")
    for i, (_, destination, _, _) in enumerate(rules):
        rows = set_part(rows, destination, F.coalesce(F.col(f"_v{i}"), part(destination)))
    rows = rows.drop(*[f"_v{i}" for i in range(len(rules))])
    if hash_ids_above is not None:
        rows = rows.withColumn(key, F.when(F.char_length(key) > hash_ids_above, F.md5(F.col(key).cast("binary"))).otherwise(F.col(key)))
    return rows


def replaced(text: Column, patterns: list[tuple[str, str]] = (), strings: dict[str, str] | None = None) -> Column:
    """Patterns first, in order; then all strings in one pass from the left, the longest match winning."""
    for pattern, replacement in patterns:
        text = F.regexp_replace(text, pattern, replacement)
    strings = {old: new for old, new in (strings or {}).items() if old}
    if not strings:
        return text
    either = "|".join(re.escape(old) for old in sorted(strings, key=len, reverse=True))
    table = F.create_map(*[F.lit(x) for pair in strings.items() for x in pair])
    found = F.regexp_extract_all(text, F.lit(either), F.lit(0))
    between = F.split(text, either, -1)
    # Zipped: what a lambda names besides its arguments is computed again for each piece.
    return F.array_join(F.zip_with(between, found, lambda piece, old: F.concat(piece, F.coalesce(table[old], F.lit("")))), "")


def sanitised(text: Column, replacement: str = "?") -> Column:
    """Control characters below 0x20 (but tab, line feed and return) and DEL, replaced or dropped."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", replacement.replace("\\", "\\\\").replace("$", "\\$"))


def snippet(markup: Column, skip: int = 0, most: int = 200) -> Column:
    """Text without tags on one line with single blanks, from a place and of a length."""
    bare = F.regexp_replace(markup, r"<[^>]*>", " ")
    return F.substring(F.trim(F.regexp_replace(bare, r"\s+", " ")), skip + 1, most)


def document_fields(docs: DataFrame, key: str, fields: dict[str, float], boost: str | None = None, free_text: list[str] | None = None) -> DataFrame:
    """(doc, field, value, boost): an index document's fields.

    Values that are blank after trimming are left out; the document's boost multiplies the field's; fields that
    belong to free text are repeated in `freetext`.
    """
    kinds = dict(docs.dtypes)
    weight = F.coalesce(F.col(boost), F.lit(1.0)) if boost else F.lit(1.0)

    def values(name: str, shown: str, factor: float) -> Column:
        listed = F.col(name).cast("array<string>") if kinds[name].startswith("array") else F.array(F.col(name).cast("string"))
        return F.transform(listed, lambda v: F.struct(F.lit(shown).alias("field"), F.trim(v).alias("value"), (weight * factor).cast("double").alias("boost")))

    lists = [values(n, n, b) for n, b in fields.items()] + [values(n, "freetext", 1.0) for n in free_text or []]
    return docs.select(F.col(key).alias("doc"), F.explode(F.concat(*lists)).alias("x")).select("doc", "x.*").where(F.col("value") != "")


def add_fields(fields: DataFrame, records: DataFrame, rules: list[tuple[str, str, str, str]], key: str = "id", boost: float = 1.0) -> DataFrame:
    """An index's fields (doc, field, value, boost) with more, made of the records' parts.

    rules: (part, field, pattern, template); a rule adds nothing where its pattern isn't found or the value is blank.
    """
    made = F.array(*[F.struct(F.lit(field).alias("field"), F.trim(templated(part(source), pattern, template)).alias("value")) for source, field, pattern, template in rules])
    new = records.select(F.col(key).alias("doc"), F.explode(made).alias("x")).select("doc", "x.*", F.lit(boost).alias("boost"))
    return fields.unionByName(new.where(F.col("value") != ""))


def capped_elements(xml: Column, tag: str, most: int) -> Column:
    """At most so many elements of a tag (without nested ones of the same name) left in a document."""
    element = rf"(?s)<{tag}(?:\s[^>]*)?(?:/>|>.*?</{tag}>)"
    found = F.regexp_extract_all(xml, F.lit(element), F.lit(0))
    kept, rest = F.slice(found, 1, most), F.split(xml, element, -1)
    return F.array_join(F.transform(rest, lambda r, i: F.concat(r, F.coalesce(F.try_element_at(kept, i + 1), F.lit("")))), "")


def field_map(xml: Column, paths: dict[str, str]) -> list[Column]:
    """Columns from XPath expressions: what a stylesheet that extracts fields does.  A name with [] is multi-valued."""
    return [(F.xpath(xml, F.lit(p)) if name.endswith("[]") else F.xpath_string(xml, F.lit(p))).alias(name.removesuffix("[]")) for name, p in paths.items()]


def enriched(df: DataFrame, lookup: DataFrame, on: str, columns: list[str], require: bool = False) -> DataFrame:
    """Columns looked up by a key; require: rows without an entry go."""
    return df.join(lookup.select(on, *columns), on, "inner" if require else "left")
