"""Secret scans: a keyword automaton finds hits, anchored expressions run only there, checksums decide.

Kinds, in the order used for ties: the base kinds assign, access and hex, and then tokens that carry a
checksum of their own (a prefix, 30 characters, and the CRC-32 of those 30 in base 62): github, npm.
Keyword-led kinds are looked for only at hits of the automaton; hex has no keyword, its runs of 16 and
more digits are found by one scan.

Edge cases: null and empty texts have no spans; very long texts are scanned whole; offsets are code
points, end exclusive; repeated rows each get their result; result columns replace columns of the same name; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_text

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
# Keywords and token prefixes, lower-cased for the automaton.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CHECKED_PREFIXES = {"github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
CHECKED = re.compile(rb"(gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
DIGITS62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(value: int, width: int) -> bytes:
    out = bytearray()
    for _ in range(width):
        value, digit = divmod(value, 62)
        out.append(DIGITS62[digit])
    return bytes(out[::-1])


def checksum_holds(body: bytes, check: bytes) -> bool:
    return base62(zlib.crc32(body), 6) == check


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), *CHECKED_PREFIXES.items()):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def scan(text: str | None, keywords) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points, by start and then kind."""
    raw = (text or "").encode()
    spans: list[tuple[int, int, str]] = [(m.start(), m.end(), "hex") for m in HEX.finditer(raw)]
    done = dict.fromkeys(KINDS, 0)  # each kind's matches don't overlap
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in keywords.iter(raw.lower().decode("latin-1")))
    for start, kind in hits:
        if start < done[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(raw, start):
                done[kind] = m.end()
                if len(m[2]) >= 12:
                    spans.append((start, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(raw, start):
                done[kind] = m.end()
                if m.end() - start >= 18:
                    spans.append((start, m.end(), kind))
        elif (m := CHECKED.match(raw, start)) and checksum_holds(m[2], m[3]):
            done[kind] = m.end()
            spans.append((start, m.end(), kind))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    if spans and len(raw) != len(text):
        points = sorted({p for s in spans for p in s[:2]})
        at, code, where = 0, 0, {}
        for p in points:
            code += len(raw[at:p].decode())
            at, where[p] = p, code
        spans = [(where[a], where[b], kind) for a, b, kind in spans]
    return spans


def spelled(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256 and spans to the kept columns."""

    def make():
        keywords = automaton()

        def fn(texts: list) -> list:
            out: list[list] = [[], [], [], [], []]
            for t in texts:
                spans = scan(t, keywords)
                base = [s for s in spans if s[2] in BASE_KINDS]
                for i, kind in enumerate(BASE_KINDS):
                    out[i].append(sum(s[2] == kind for s in base))
                out[3].append(sha256(spelled(base).encode()).hexdigest())
                out[4].append(spelled(spans))
            return out

        return fn

    return map_text(docs, text, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", make, keep)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir), keep=["doc_id"])


def _oracle() -> str:
    def either_case(word: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    words = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
    patterns = {
        "assign": (rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, "length(body) >= 12"),
        "access": (r"AKIA([A-Z0-9]+)", 1, "length(body) >= 14"),
        "hex": (r"([0-9a-f]{16,})", 1, "TRUE"),
        "github": (r"gh[pousr]_([A-Za-z0-9]{36,})", 1, "length(body) = 36"),
        "npm": (r"npm_([A-Za-z0-9]{36,})", 1, "length(body) = 36"),
    }
    # CRC-32 of the first thirty characters, bit by bit, and its six digits.
    bit = "lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, 31), lambda i: ascii(substr(body, i::INTEGER, 1))::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)::BIGINT[]), {bit})))"
    digits = f"list_aggregate(list_transform([5, 4, 3, 2, 1, 0], lambda i: substr('{DIGITS62.decode()}', (crc // pow(62, i)::BIGINT % 62 + 1)::INTEGER, 1)), 'string_agg', '')"
    parts = " UNION ALL ".join(
        f"SELECT r, {k} AS k, '{kind}' AS kind, string_split_regex(t, {quoted(p)}) AS gaps, regexp_extract_all(t, {quoted(p)}) AS found, regexp_extract_all(t, {quoted(p)}, {group}) AS bodies FROM d"
        for k, (kind, (p, group, _)) in enumerate(patterns.items())
    )
    holds = " OR ".join(f"(kind = '{kind}' AND {test})" for kind, (_, _, test) in patterns.items())
    base = "kind IN ('assign', 'access', 'hex')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({parts}),
e AS (SELECT r, k, kind, unnest(range(1, len(found) + 1)) AS i, gaps, found, bodies FROM m),
s AS (SELECT r, k, kind, bodies[i] AS body, length(found[i]) AS size,
      list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start FROM e),
h AS MATERIALIZED (SELECT r, k, kind, body, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span, start FROM s WHERE {holds}),
c AS (SELECT *, CASE WHEN k > 2 THEN ({crc})::BIGINT END AS crc FROM h),
o AS (SELECT * FROM c WHERE k <= 2 OR substr(body, 31) = {digits}),
g AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
      coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (WHERE {base}), '') AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM o GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)"""


ORACLE_OP8 = _oracle()
