"""Chat formatting by quotation linking.

A message's lines are parsed by nested quote level (the number of leading `>` marks).  Runs of lines of
one level form passages.  Passages are normalised (marks and punctuation dropped, lower case, single
spaces) and hashed.  A quoted passage is hashed whole, by paragraph, and by groups of 1, 2, 4, ... of its
consecutive lines or sentences; each piece is joined, within its conversation, to the latest earlier message
that has it as its own text: the whole, a run, or any consecutive lines or sentences of it.  The longest piece
with an original links the quote, so one trimmed or edited in part links by what is left.  A message's parent is the author of its
outermost quote that can be linked.  Following parents gives the thread's root and the reply depth.
Ordering a conversation by `reply_order` (root_turn, then turn, as digits) puts every reply after what it answers;
`write_conversations` writes it so.  Texts come out without quotes.

Messages are parsed once and written.  Those of conversations with quotes hash their groups of the lengths that
pieces there have, not all groups.  Only originals whose hash some quote has take part in the join.  For each
(conversation, hash) the earlier message is found by ordered windows over stretches of SPAN turns and over the
stretches, so repeated texts make no pairs and a hot hash is split.  Threads are
resolved by pointer doubling over the linked messages alone.

Edge cases: a null text counts as empty; a null conversation or turn links to nothing; messages of equal
conversation and turn (repeated rows) get the same links; passages without letters or digits have no hash;
part of a sentence that is no line of its original links to nothing; very long texts are parsed whole, and result
columns replace columns of the same name;
a message without a link is its own root at depth 0; an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import md5

import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, join_hot, map_text, table

#: Turns of a stretch in which one task looks for originals of one hash.
SPAN = 4096
_MARKS = regex.compile(r"^(?:[ \t]{0,3}>)+[ \t]?")
_INTRO = regex.compile(r"^(?:On\b.{0,200}\bwrote|.{1,80}\bwrote):\s*$")
_DROP = regex.compile(r"[^\p{L}\p{N}]+")
_BREAK = regex.compile(r"\n[ \t\r]*\n")
_STOP = regex.compile(r"(?<=[.!?…][\"'”’)\]]*)\s+|(?<=[。！？])")


def level_of(line: str) -> tuple[int, str]:
    m = _MARKS.match(line)
    return (m[0].count(">"), line[m.end() :]) if m else (0, line)


def passages(text: str) -> list[tuple[int, str]]:
    """(level, text) of the runs of lines with one quote level; level 0 is the author's own.

    An introduction such as `Ann wrote:` right before a quote belongs to the quote and is left out.
    """
    if ">" not in text:
        return [(0, text)] if text.strip() else []
    runs: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        level, body = level_of(line)
        if not runs or runs[-1][0] != level:
            if runs and level > runs[-1][0] and runs[-1][1] and _INTRO.match(runs[-1][1][-1]):
                runs[-1][1].pop()
            runs.append((level, []))
        runs[-1][1].append(body)
    return [(level, "\n".join(lines)) for level, lines in runs if any(x.strip() for x in lines)]


def normal(passage: str) -> str:
    return _DROP.sub(" ", passage.lower()).strip()


def normal_hash(plain: str) -> int:
    """64 bits; hashes meet within a conversation only."""
    return int.from_bytes(md5(plain.encode()).digest()[:8], "little", signed=True)


def paragraphs(passage: str) -> list[str]:
    return _BREAK.split(passage)


def units(passage: str) -> tuple[list[str], list[str]]:
    """The normalised lines, and the normalised sentences, which may go over line ends but not over paragraphs."""
    lines = [normal(x) for x in passage.split("\n")]
    sentences = [normal(x) for p in paragraphs(passage) for x in _STOP.split(p)]
    return [x for x in lines if x], [x for x in sentences if x]


def pieces_of(passage: str) -> dict[str, set[int]]:
    """The pieces of a quoted passage and the numbers of units that each may have in an original."""
    out: dict[str, set[int]] = {}
    for part in [passage, *paragraphs(passage)]:
        if plain := normal(part):
            out.setdefault(plain, set()).update(len(x) for x in units(part))
    for kind in units(passage):
        size = 1
        while size <= len(kind):
            for i in range(len(kind) - size + 1):
                out.setdefault(" ".join(kind[i : i + size]), set()).add(size)
            size *= 2
    return out


def own_hashes(body: str, runs: list[str], sizes: list[int]) -> set[int]:
    """Hashes of the author's own text, its runs and paragraphs, and all groups of `sizes` lines or sentences."""
    plain = {normal(p) for p in [body, *runs, *paragraphs(body)]}
    for kind in units(body):
        plain.update(" ".join(kind[i : i + size]) for size in sizes for i in range(len(kind) - size + 1))
    return {normal_hash(p) for p in plain if p}


def quotes_of(found: list[tuple[int, str]]) -> list[dict]:
    """The pieces h of each quote q of a message, with the numbers of units that they may have in an original."""
    rows: dict[tuple, dict] = {}
    for level, p in found:
        if level and (plain := normal(p)):
            q = normal_hash(plain)
            for piece, sizes in pieces_of(p).items():
                h = normal_hash(piece)
                known = rows.setdefault((level, q, h), {"level": level, "q": q, "h": h, "chars": len(piece), "sizes": []})
                known["sizes"] = sorted(sizes.union(known["sizes"]))
    return list(rows.values())


PARSED = "body string, n_levels bigint, n_quoted bigint, __runs array<string>, __quotes array<struct<level: bigint, q: bigint, h: bigint, chars: bigint, sizes: array<bigint>>>"


def parsed(messages: DataFrame, conversation: str, turn: str, text: str, keep: list[str]) -> DataFrame:
    """The kept columns, __c and __t (conversation and turn), body (the text without quotes), n_levels, n_quoted, the
    author's own runs of lines where there are several, and the quotes' pieces."""

    def make():
        def fn(texts: list) -> list:
            out: list[list] = [[], [], [], [], []]
            for t in texts:
                found = passages(t or "")
                own = [p for level, p in found if level == 0]
                row = ("\n".join(own).strip(), max((level for level, _ in found), default=0), len(found) - len(own), own if len(own) > 1 else [], quotes_of(found))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return fn

    body = F.col(f"`{text}`").cast("string").alias("__text")
    source = messages.select(*[f"`{c}`" for c in keep], F.col(f"`{conversation}`").alias("__c"), F.col(f"`{turn}`").alias("__t"), body)
    return checkpoint(map_text(source, "__text", PARSED, make, [*keep, "__c", "__t"]))


def originals(known: DataFrame, sizes: DataFrame) -> DataFrame:
    """(__c, __t, h): own hashes of the messages of conversations with quotes; sizes: (__c, sizes)."""

    def make():
        return lambda texts, runs, wanted: [[sorted(own_hashes(t or "", r, w)) for t, r, w in zip(texts, runs, wanted, strict=True)]]

    rows = join_hot(known.select("__c", "__t", "body", "__runs"), sizes, ["__c"])
    return map_text(rows, "body", "own array<bigint>", make, ["__c", "__t"], ["__runs", "sizes"]).select("__c", "__t", F.explode("own").alias("h"))


def links(messages: DataFrame) -> DataFrame:
    """(__c, __t, level, parent): for each quote of parsed messages, the latest earlier one with its longest piece that has one."""
    known = messages.where(F.col("__c").isNotNull() & F.col("__t").isNotNull())
    pieces = known.select("__c", "__t", F.explode("__quotes").alias("x")).select("__c", "__t", "x.*")
    sizes = checkpoint(pieces.select("__c", F.explode("sizes").alias("size")).groupBy("__c").agg(F.collect_set("size").alias("sizes")))
    quotes = checkpoint(pieces.drop("sizes").distinct())
    own = originals(known, sizes).join(quotes.select("__c", "h").distinct(), ["__c", "h"], "left_semi").distinct()
    stretch = F.floor(F.col("__t") / SPAN)
    both = checkpoint(quotes.unionByName(own.withColumn("level", F.lit(0).cast("bigint")), allowMissingColumns=True).withColumn("at", stretch))
    before = Window.partitionBy("__c", "h").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    stretches = both.groupBy("__c", "h", "at").agg(F.max(F.when(F.col("level") == 0, F.col("__t"))).alias("last")).withColumn("last", F.max("last").over(before))
    earlier = Window.partitionBy("__c", "h", "at").orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
    linked = both.withColumn("near", F.max(F.when(F.col("level") == 0, F.col("__t"))).over(earlier)).join(stretches, ["__c", "h", "at"])
    found = linked.withColumn("parent", F.coalesce("near", "last")).where((F.col("level") > 0) & F.col("parent").isNotNull())
    longest = found.groupBy("__c", "__t", "level", "q").agg(F.max(F.struct("chars", "parent")).alias("x"))
    return longest.select("__c", "__t", "level", F.col("x.parent").alias("parent"))


def threads(found: DataFrame) -> DataFrame:
    """(__c, __t, parent, root, depth) for messages that have a parent, by pointer doubling."""
    parents = found.groupBy("__c", "__t").agg(F.min_by("parent", F.struct("level", -F.col("parent"))).alias("parent"))
    state = checkpoint(parents.select("__c", "__t", "parent", F.col("parent").alias("root"), F.lit(1).cast("bigint").alias("depth")))
    while True:
        up = state.select("__c", F.col("__t").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        moved = join_hot(state, up, ["__c", "root"], "left")
        if moved.where(F.col("_root").isNotNull()).isEmpty():
            return state
        state = checkpoint(moved.select("__c", "__t", "parent", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))


def link_quotes(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with body, n_levels, n_quoted, n_linked, parent_turn, root_turn, depth and reply_order."""
    made = {"body", "n_levels", "n_quoted", "n_linked", "parent_turn", "root_turn", "depth", "reply_order"}
    carried = [c for c in (messages.columns if keep is None else keep) if c not in made]
    pieces = parsed(messages, conversation, turn, text, carried)
    found = checkpoint(links(pieces))
    resolved = threads(found).join(found.groupBy("__c", "__t").agg(F.count(F.lit(1)).alias("n_linked")), ["__c", "__t"])
    resolved = checkpoint(resolved.select("__c", "__t", F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"), "depth", "n_linked"))
    joined = join_hot(pieces.drop("__runs", "__quotes"), resolved, ["__c", "__t"], "left")
    zero, root = F.lit(0).cast("bigint"), F.coalesce("root_turn", "__t")
    order = F.format_string("%019d.%019d", root.cast("bigint"), F.col("__t").cast("bigint"))
    added = {"root_turn": root, "depth": F.coalesce("depth", zero), "n_linked": F.coalesce("n_linked", zero), "reply_order": F.when(F.col("__t").isNotNull(), order)}
    return joined.withColumns(added).drop("__c", "__t")


def write_conversations(linked: DataFrame, path: str, conversation: str = "conv_id") -> None:
    """Conversations one after another, each in reply order; a long one may go over several files."""
    linked.repartitionByRange(conversation, "reply_order").sortWithinPartitions(conversation, "reply_order").write.parquet(path)


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_quotes(table(spark, sf_dir, "conversations"), keep=["conv_id", "turn", "role"])
    return linked.select("conv_id", "turn", "role", "parent_turn", "root_turn", "depth", "n_levels", "n_quoted", "n_linked", "reply_order", "body")
