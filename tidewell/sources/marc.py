"""Library records: binary exchange format, line format, and records from their fields.

A record is a list of fields (tag, ind1, ind2, subfields of (code, value)); control fields have one subfield
with an empty code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUBFIELDS = "array<struct<code:string,value:string>>"
FIELDS = f"array<struct<tag:string,ind1:string,ind2:string,subfields:{SUBFIELDS}>>"
# Fixed values of the exchange format.
RECORD_END, FIELD_END, SUBFIELD = b"\x1d", b"\x1e", b"\x1f"


def decode_record(raw: bytes, charset: str = "utf-8") -> list[dict] | None:
    """Fields of one binary record; None if its directory doesn't hold.

    The leader tells where the data begin; the directory has twelve characters a field: tag, length, start.
    """
    try:
        base = int(raw[12:17])
        directory = raw[24 : base - 1]
        fields = []
        for i in range(0, len(directory) - 11, 12):
            tag, length, start = directory[i : i + 3].decode("ascii"), int(directory[i + 3 : i + 7]), int(directory[i + 7 : i + 12])
            data = raw[base + start : base + start + length].rstrip(FIELD_END)
            if tag < "010":
                fields.append({"tag": tag, "ind1": "", "ind2": "", "subfields": [{"code": "", "value": data.decode(charset)}]})
                continue
            head, *subs = data.split(SUBFIELD)
            marks = (head.decode(charset) + "  ")[:2]
            parts = [{"code": s[:1].decode("ascii"), "value": s[1:].decode(charset)} for s in subs if s]
            fields.append({"tag": tag, "ind1": marks[0], "ind2": marks[1], "subfields": parts})
        return fields
    except (ValueError, UnicodeDecodeError, LookupError):
        return None


def encode_record(fields: list[dict], charset: str = "utf-8") -> bytes:
    directory, data = b"", b""
    for f in fields:
        if f["tag"] < "010":
            body = f["subfields"][0]["value"].encode(charset)
        else:
            body = (f["ind1"] + f["ind2"]).encode(charset) + b"".join(SUBFIELD + s["code"].encode() + s["value"].encode(charset) for s in f["subfields"])
        body += FIELD_END
        directory += f"{f['tag']}{len(body):04d}{len(data):05d}".encode()
        data += body
    base = 24 + len(directory) + 1
    total = base + len(data) + 1
    return f"{total:05d}nam a22{base:05d} a 4500".encode() + directory + FIELD_END + data + RECORD_END


def read_binary(files: DataFrame, charset: str = "utf-8") -> DataFrame:
    """(origin, number, fields) of the records in binary files; unreadable ones are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                for i, raw in enumerate(r for r in bytes(content).split(RECORD_END) if r.strip()):
                    if (fields := decode_record(raw.lstrip(b"\r\n"), charset)) is not None:
                        rows.append((path, i, fields))
                yield pd.DataFrame(rows, columns=["origin", "number", "fields"])

    return files.select("path", "content").mapInPandas(run, f"origin string, number bigint, fields {FIELDS}")


_LINE = re.compile(r"^(\w{3}) ?(\S{2})? ?(\*.*)$")


def parse_lines(text: str) -> list[dict]:
    """Fields of a record in line format: `245 00 *aTitle*cAuthor`, one field to a line; @ escapes a star."""
    fields = []
    for line in text.split("\n"):
        if not (m := _LINE.match(line.strip())):
            continue
        parts = re.findall(r"\*(\w)((?:@\*|@@|[^*])*)", m[3])
        marks = (m[2] or "  ").ljust(2)
        fields.append({"tag": m[1], "ind1": marks[0], "ind2": marks[1], "subfields": [{"code": c, "value": re.sub(r"@([@*])", r"\1", v).strip()} for c, v in parts]})
    return fields


def read_lines(texts: DataFrame, text: str = "value", record_end: str = r"\n\s*\n|\n\$\s*\n?") -> DataFrame:
    """(fields) of the records in line-format texts, which blank lines or a $ line separate."""
    records = texts.select(F.explode(F.split(F.col(text), record_end)).alias("r")).where(F.trim("r") != "")

    @F.pandas_udf(FIELDS)
    def parse(values: pd.Series) -> pd.Series:
        return values.map(parse_lines)

    return records.select(parse("r").alias("fields"))


def read_aleph(texts: DataFrame, text: str = "value") -> DataFrame:
    """(number, fields) of the records in sequential dumps: `000000001 24500 L $$aTitle$$cName`, one field to a line.

    A record's lines are those of its number, in their order within a text.
    """
    line = r"^(\d{9}) (\w{3})(.)(.) (\S) (.*)$"
    lines = texts.select(F.posexplode(F.split(F.col(text).cast("string"), r"\r?\n")).alias("at", "line")).where(F.col("line").rlike(line))

    def group(i: int) -> Column:
        return F.regexp_extract("line", line, i)

    tagged = F.transform(F.filter(F.split(group(6), r"\$\$"), lambda s: s != ""), lambda s: F.struct(F.substring(s, 1, 1).alias("code"), F.substr(s, F.lit(2)).alias("value")))
    # Control fields have no marks: their text is one subfield without a code.
    plain = F.array(F.struct(F.lit("").alias("code"), group(6).alias("value")))
    fields = F.struct(group(2).alias("tag"), group(3).alias("ind1"), group(4).alias("ind2"), F.when(F.instr(group(6), "$$") > 0, tagged).otherwise(plain).alias("subfields"))
    rows = lines.select(group(1).alias("number"), F.struct("at", fields.alias("field")).alias("x"))
    return rows.groupBy("number").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["field"]).alias("fields"))


def without(fields: Column | str, *tags: str) -> Column:
    """The record without the fields of some tags."""
    return F.filter(F.col(fields) if isinstance(fields, str) else fields, lambda f: ~f["tag"].isin(*tags))


def added(fields: Column | str, tag: str, subfields_: dict[str, Column], ind1: str = " ", ind2: str = " ") -> Column:
    """The record with one more field, placed by its tag after those of the same."""
    given = F.col(fields) if isinstance(fields, str) else fields
    parts = F.array(*[F.struct(F.lit(c).alias("code"), v.cast("string").alias("value")) for c, v in subfields_.items()])
    new = F.struct(F.lit(tag).alias("tag"), F.lit(ind1).alias("ind1"), F.lit(ind2).alias("ind2"), parts.alias("subfields"))
    return F.concat(F.filter(given, lambda f: f["tag"] <= tag), F.array(new), F.filter(given, lambda f: f["tag"] > tag))


def changed(fields: Column | str, tag: str, code: str, change) -> Column:
    """The record with a subfield's values changed by a function of columns."""
    given = F.col(fields) if isinstance(fields, str) else fields

    def part(s: Column) -> Column:
        return F.struct(s["code"].alias("code"), F.when(s["code"] == code, change(s["value"])).otherwise(s["value"]).alias("value"))

    return F.transform(given, lambda f: F.struct(f["tag"].alias("tag"), f["ind1"].alias("ind1"), f["ind2"].alias("ind2"), F.when(f["tag"] == tag, F.transform(f["subfields"], part)).otherwise(f["subfields"]).alias("subfields")))


def as_xml(fields: Column | str) -> Column:
    """A record as XML text, in expressions alone; see to_xml."""

    def safe(c: Column, quoted: bool = False) -> Column:
        for old, new in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;")] if quoted else [])]:
            c = F.replace(c, F.lit(old), F.lit(new))
        return c

    def field(f: Column) -> Column:
        subs = F.array_join(F.transform(f["subfields"], lambda s: F.concat(F.lit('<subfield code="'), safe(s["code"], True), F.lit('">'), safe(s["value"]), F.lit("</subfield>"))), "")
        data = F.concat(F.lit('<datafield tag="'), f["tag"], F.lit('" ind1="'), safe(f["ind1"], True), F.lit('" ind2="'), safe(f["ind2"], True), F.lit('">'), subs, F.lit("</datafield>"))
        control = F.concat(F.lit('<controlfield tag="'), f["tag"], F.lit('">'), safe(f["subfields"][0]["value"]), F.lit("</controlfield>"))
        return F.when((f["tag"] < "010") & (F.size(f["subfields"]) > 0) & (F.try_element_at(f["subfields"], F.lit(1))["code"] == ""), control).otherwise(data)

    given = F.col(fields) if isinstance(fields, str) else fields
    return F.concat(F.lit("<record>"), F.array_join(F.transform(given, field), ""), F.lit("</record>"))


def subfields(fields: Column | str, tag: str, code: str) -> Column:
    """All values of a subfield, in order."""
    chosen = F.filter(F.col(fields) if isinstance(fields, str) else fields, lambda f: f["tag"] == tag)
    inner = F.flatten(F.transform(chosen, lambda f: F.filter(f["subfields"], lambda s: s["code"] == code)))
    return F.transform(inner, lambda s: s["value"])


def first(fields: Column | str, tag: str, code: str) -> Column:
    return F.try_element_at(subfields(fields, tag, code), F.lit(1))


def records(rows: DataFrame, base: str, fields: str = "fields", prefix: str = "") -> DataFrame:
    """(id, base, deleted, type, parent_ids, child_ids) by the national conventions.

    The id is 001*a, else 994*z; 004*r is d for deleted; 004*a the type; 014*a parents; 015*a children, those
    without a 015*v first and then by it.
    """
    children = F.filter(fields, lambda f: f["tag"] == "015")

    def value(f: Column, code: str) -> Column:
        return F.try_element_at(F.filter(f["subfields"], lambda s: s["code"] == code), F.lit(1))["value"]

    keyed = F.transform(children, lambda f, i: F.struct(value(f, "v").isNotNull().alias("has"), value(f, "v").alias("v"), i.alias("i"), value(f, "a").alias("a")))
    ordered = F.filter(F.transform(F.array_sort(keyed), lambda x: x["a"]), lambda a: a.isNotNull())
    named = F.coalesce(first(fields, "001", "a"), first(fields, "994", "z"))
    with_prefix = lambda ids: F.transform(ids, lambda x: F.concat(F.lit(prefix), x))
    return rows.select(
        F.concat(F.lit(prefix), named).alias("id"),
        F.lit(base).alias("base"),
        F.coalesce(first(fields, "004", "r") == "d", F.lit(False)).alias("deleted"),
        first(fields, "004", "a").alias("type"),
        with_prefix(subfields(fields, "014", "a")).alias("parent_ids"),
        with_prefix(ordered).alias("child_ids"),
    ).where(F.col("id").isNotNull())


def to_xml(fields: list[dict]) -> str:
    out = ["<record>"]
    for f in fields:
        if f["tag"] < "010" and f["subfields"] and not f["subfields"][0]["code"]:
            out.append(f"<controlfield tag={quoteattr(f['tag'])}>{escape(f['subfields'][0]['value'])}</controlfield>")
            continue
        subs = "".join(f"<subfield code={quoteattr(s['code'])}>{escape(s['value'])}</subfield>" for s in f["subfields"])
        out.append(f"<datafield tag={quoteattr(f['tag'])} ind1={quoteattr(f['ind1'])} ind2={quoteattr(f['ind2'])}>{subs}</datafield>")
    return "".join(out) + "</record>"


def xml_fields(xml: Column) -> Column:
    """Fields of records in XML, by Spark's own parser."""
    schema = "datafield array<struct<_tag:string,_ind1:string,_ind2:string,subfield array<struct<_code:string,_VALUE:string>>>>".replace("subfield array", "subfield:array")
    parsed = F.from_xml(xml, schema)
    return F.transform(parsed["datafield"], lambda d: F.struct(d["_tag"].alias("tag"), d["_ind1"].alias("ind1"), d["_ind2"].alias("ind2"), F.transform(d["subfield"], lambda s: F.struct(s["_code"].alias("code"), s["_VALUE"].alias("value"))).alias("subfields")))
