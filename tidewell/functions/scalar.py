"""Scalar functions for dates, years, identifiers and escapes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_date_time(c: Column | str) -> Column:
    """The first date in a text, most precise form first, as yyyy-MM-ddTHH:mm:ssZ; "" if there is none.

    Missing months and days are 01, missing times 00.
    """
    x = _c(c)
    day, minute = r"(\d{4})-(\d{2})-(\d{2})", r"[T ](\d{2}):(\d{2})"
    forms = [(day + minute + r":(\d{2})", 6), (day + minute, 5), (day, 3), (r"(\d{4})-(\d{2})", 2), (r"(\d{4})", 1)]
    filler = ["", "01", "01", "00", "00", "00"]
    out = F.lit("")
    for pattern, groups in reversed(forms):
        part = [F.regexp_extract(x, pattern, i + 1) if i < groups else F.lit(filler[i]) for i in range(6)]
        made = F.concat(part[0], F.lit("-"), part[1], F.lit("-"), part[2], F.lit("T"), part[3], F.lit(":"), part[4], F.lit(":"), part[5], F.lit("Z"))
        out = F.when(x.rlike(pattern), made).otherwise(out)
    return F.coalesce(out, F.lit(""))


# Month names.
MONTHS = {
    "en": ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"),
    "da": ("januar", "februar", "marts", "april", "maj", "juni", "juli", "august", "september", "oktober", "november", "december"),
}


def expand_date(c: Column | str, locale: str = "en") -> Column:
    """Searchable variants of an ISO date, separated by blanks; "" unless the text starts with a date."""
    x = _c(c)
    y, m, d = (F.regexp_extract(x, r"^(\d{4})-(\d{2})-(\d{2})", i) for i in (1, 2, 3))
    m1, d1 = (F.regexp_replace(p, "^0", "") for p in (m, d))
    name = F.element_at(F.array(*map(F.lit, MONTHS[locale])), F.greatest(m1.try_cast("int"), F.lit(1)))
    short = F.when((m1 != m) | (d1 != d), F.concat_ws(" ", F.concat_ws("/", d1, m1), F.concat_ws("/", m1, d1), F.concat_ws("-", m1, d1)))
    all_forms = F.concat_ws(
        " ",
        F.concat_ws("-", y, m, d),
        F.concat(d, F.lit("/"), m, F.lit("-"), y),
        F.concat(m, F.lit("/"), d, F.lit("-"), y),
        F.concat_ws("/", d, m, y),
        F.concat(y, m, d),
        F.concat_ws("/", d, m),
        F.concat_ws("/", m, d),
        F.concat_ws("-", m, d),
        short,
        name,
    )
    return F.when(x.rlike(r"^\d{4}-(0[1-9]|1[0-2])-\d{2}"), all_forms).otherwise("")


def expand_time(c: Column | str, compat: bool = False) -> Column:
    """h:m, h.m, hm and the same with seconds.  compat: the seconds repeat the hour, as older indexes have it."""
    x = _c(c)
    h, m, s = (F.regexp_extract(x, r"(\d{2}):(\d{2}):(\d{2})", i) for i in (1, 2, 3))
    s = h if compat else s
    forms = [F.concat_ws(sep, *parts) for parts in ((h, m), (h, m, s)) for sep in (":", ".", "")]
    return F.when(x.rlike(r"\d{2}:\d{2}:\d{2}"), F.concat_ws(" ", *forms)).otherwise("")


def expand_date_time(c: Column | str, locale: str = "en", compat: bool = False) -> Column:
    return F.trim(F.concat_ws(" ", expand_date(c, locale), expand_time(c, compat)))


def divide(c: Column | str, start: int, end: int) -> Column:
    """Parts start to end (year is 0, second is 5) of an ISO time, joined by blanks."""
    parts = F.filter(F.split(_c(c), "[-T:Z ]"), lambda p: p != "")
    return F.array_join(F.slice(parts, start + 1, end - start + 1), " ")


def year_range(first: Column | str, last: Column | str | None = None) -> Column:
    """Years between two that may have unknown digits (`?`), joined by blanks.

    Texts longer than four characters or that aren't years, and years of three unknown digits, come back
    unchanged (two different ones joined by `-`).
    """
    a = _c(first)
    b = a if last is None else _c(last)
    fallback = F.when(a == b, a).otherwise(F.concat_ws("-", a, b))
    lows, highs = ([F.regexp_replace(x, r"\?", digit).try_cast("int") for x in (a, b)] for digit in ("0", "9"))
    low, high = F.least(*lows, *highs), F.greatest(*lows, *highs)
    usable = a.rlike(r"^[0-9?]{1,4}$") & b.rlike(r"^[0-9?]{1,4}$") & ~((a == b) & a.rlike(r"(\?.*){3}"))
    return F.when(usable, F.array_join(F.sequence(low, high).cast("array<string>"), " ")).otherwise(fallback)


def isbn13(c: Column | str) -> Column:
    """Hyphens removed, ten digits turned into thirteen with a new check digit; other texts unchanged."""
    x = _c(c)
    bare = F.replace(x, F.lit("-"), F.lit(""))
    body = F.concat(F.lit("978"), F.substring(bare, 1, 9))
    total = sum((F.substring(body, i + 1, 1).try_cast("int") * (3 if i % 2 else 1) for i in range(12)), F.lit(0))
    ten = F.concat(body, ((10 - total % 10) % 10).cast("string"))
    return F.when(bare.rlike(r"^\d{13}$"), bare).when(bare.rlike(r"^\d{9}[\dXx]$"), ten).otherwise(x)


def normalize(c: Column | str) -> Column:
    return F.trim(F.translate(_c(c), "-,.()[]", ""))


def md5_short(c: Column | str) -> Column:
    """MD5 in hex without leading zeros."""
    return F.regexp_replace(F.md5(_c(c).cast("binary")), "^0+(?=.)", "")


def open_url_escape(c: Column | str) -> Column:
    """Percent-encoded, with blanks as %20."""
    return F.replace(F.url_encode(_c(c)), F.lit("+"), F.lit("%20"))


def lookup(c: Column | str, names: dict[str, str], default: str = "") -> Column:
    mapped = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(mapped[_c(c)], F.lit(default))


def keep_entities(c: Column | str) -> Column:
    """Ampersands escaped inside CDATA sections, which would lose them when unwrapped."""
    x = _c(c)
    escape = r"&(?=(?:(?!<!\[CDATA\[)[\s\S])*?\]\]>)"
    return F.regexp_replace(x, escape, "&amp;")


SALT_BITS = 20


def salted_time(ms: Column | str, salt: Column | str | int = 0) -> Column:
    """A unique stamp: milliseconds above SALT_BITS bits of a counter, ordered by time and then counter."""
    salt = F.lit(salt) if isinstance(salt, int) else _c(salt)
    return F.shiftleft(_c(ms).cast("bigint"), SALT_BITS) + salt.cast("bigint")


def stamp_ms(stamp: Column | str) -> Column:
    return F.shiftright(_c(stamp), SALT_BITS)


def stamp_salt(stamp: Column | str) -> Column:
    return _c(stamp).bitwiseAND((1 << SALT_BITS) - 1)


def stamp_floor(stamp: Column | str) -> Column:
    """The least stamp of the same millisecond: where a cursor starts."""
    return F.shiftleft(stamp_ms(stamp), SALT_BITS)


# Fixed names of the functions for SQL text.
SQL_FUNCTIONS = {
    "tw_iso_date_time": iso_date_time,
    "tw_expand_date": expand_date,
    "tw_expand_time": expand_time,
    "tw_isbn13": isbn13,
    "tw_normalize": normalize,
    "tw_md5_short": md5_short,
    "tw_year_range": year_range,
}


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL text: temporary SQL functions, which the optimizer inlines."""
    for name, fn in SQL_FUNCTIONS.items():
        frame = spark.sql("SELECT '' AS x").select(fn("x").alias("y"))
        body = frame._jdf.queryExecution().analyzed().expressions().head().sql().removesuffix(" AS y")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")
