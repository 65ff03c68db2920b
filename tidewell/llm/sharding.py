"""Sharding by a hierarchical weighted hash tree, in DataFrame expressions only.

A tree has regions, racks and shards; each shard has a weight, and a rack or region the sum of those below.
For a key, a node draws -ln(u)/weight with u from a hash of key and node: an exponential time with the weight as
its rate.  A key goes to the region of the least time, there to the rack of the least time, and there to
the shard of the least time.  These are 11 draws a key in the standard tree of 40 shards.

A draw depends on its own node only.  So if weights change in one rack, keys move between that rack's region and
others only as the region's weight moved, within the region only to or from that rack, and not at all among
the other racks or regions.  From SHARDS shards on, one more opens a region of its own, whose draw alone decides: it
takes rows into itself, and no other row moves.

Edge cases: a null key hashes like the empty string; a null text has size 16 and checksum 0; very long texts count
by their bytes and aren't shuffled; nodes without weight get nothing; repeated rows get slots of their own;
other columns of the input, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Shards of a rack and racks of a region in the standard tree.
RACK, REGION = 5, 4
#: Each shard's rows are numbered in so many independent ranges of the key hash (16 to the power of DIGITS).
DIGITS = 2


#: Shards of the tree before shards are added one by one.
SHARDS = 40

Tree = list[tuple[int, list[tuple[int, list[tuple[int, float]]]]]]


def standard_tree(shards: int = SHARDS, weights: dict[int, float] | None = None) -> Tree:
    """Regions of REGION racks of RACK shards, filled in order up to SHARDS; then a region for each further shard."""

    def leaves(first: int, stop: int) -> list[tuple[int, float]]:
        return [(s, float((weights or {}).get(s, 1.0))) for s in range(first, stop)]

    tree, first = [], min(shards, SHARDS)
    for region in range(-(-first // (RACK * REGION))):
        starts = [region * RACK * REGION + rack * RACK for rack in range(REGION)]
        tree.append((region, [(rack, leaves(s, min(s + RACK, first))) for rack, s in enumerate(starts) if s < first]))
    return tree + [(len(tree) + i, [(0, leaves(s, s + 1))]) for i, s in enumerate(range(first, shards))]


def _draw(key: Column, node: Column, weight: Column) -> Column:
    digest = F.md5(F.concat_ws(":", key, node))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(16**12))
    return -F.log(u) / weight


def _weighed(tree: Tree) -> list[tuple[float, str, int, list]]:
    """(weight, name, number, racks) of each region, of its racks alike, and of their shards, without those of weight 0."""
    regions = []
    for region, racks in tree:
        below = []
        for rack, leaves in racks:
            shards = [(w, f"s{s}", s) for s, w in leaves if w > 0]
            if shards:
                below.append((sum(w for w, *_ in shards), f"r{region}k{rack}", rack, shards))
        if below:
            regions.append((sum(w for w, *_ in below), f"r{region}", region, below))
    if not regions:
        raise ValueError("a tree needs a shard with a weight")
    return regions


def _literal(nodes: list) -> Column:
    """Nodes as an array of structs, inner ones with theirs."""
    fields = [[F.lit(float(n[0])).alias("weight"), F.lit(n[1]).alias("name"), F.lit(n[2]).alias("number")] for n in nodes]
    return F.array(*[F.struct(*f, *([_literal(n[3]).alias("below")] if len(n) > 3 else [])) for f, n in zip(fields, nodes, strict=True)])


def _least(key: Column, nodes: Column, below: bool = True) -> Column:
    """The node that draws the least time: a minimum of structs goes by the first field."""
    return F.array_min(F.transform(nodes, lambda n: F.struct(_draw(key, n["name"], n["weight"]).alias("t"), n["number"].alias("number"), *([n["below"].alias("below")] if below else []))))


def place(rows: DataFrame, key: str, tree: Tree) -> DataFrame:
    """Adds region, rack, shard and the region's time _t for a string key: one level after another."""
    found = rows.withColumn("_region", _least(F.col(key), _literal(_weighed(tree))))
    found = found.withColumn("_rack", _least(F.col(key), F.col("_region.below")))
    found = found.withColumn("_shard", _least(F.col(key), F.col("_rack.below"), below=False))
    # Not nullable: else a join adds a filter that draws again.
    at = {name: F.coalesce(F.col(f"_{name}.number"), F.lit(0)) for name in ("region", "rack", "shard")}
    return found.withColumns(at | {"_t": F.col("_region.t")}).drop("_region", "_rack", "_shard")


def grown(key: Column, time: Column, shard: Column, new: int, region: int, weight: float = 1.0) -> Column:
    """Where a placed key goes when the tree has one more shard, in a region of its own: there if that draws less than
    the key's region did, else it stays, for no other draw changes."""
    return F.when(_draw(key, F.lit(f"r{region}"), F.lit(weight)) < time, F.lit(new)).otherwise(shard)


def number_within(df: DataFrame, shard: str, bucket: str, order: list[str], slot: str) -> DataFrame:
    """Gapless numbers from 0 within each shard, by (bucket, order).

    No task gets a whole shard: rows are ranked within (shard, bucket), and the counts of the buckets
    before (16**DIGITS rows a shard, whatever the input) are added.
    """
    counts = df.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(shard, bucket, F.coalesce(F.sum("_n").over(Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(shard, bucket).orderBy(*order))
    return df.withColumn("_rank", rank).join(F.broadcast(before), [shard, bucket]).withColumn(slot, F.col("_before") + F.col("_rank") - 1).drop("_rank", "_before")


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40) -> DataFrame:
    """One row per row of docs: key, size, text_crc32, law, region, rack, shard, slot, grown_shard."""
    as_key = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("_id"),
        (F.octet_length(body).cast("bigint") + 16).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        as_key.alias("_key"),
        F.md5(as_key).alias("_hash"),
    )
    tree = standard_tree(shards)
    placed = place(rows.withColumn("_bucket", F.substring("_hash", 1, DIGITS)), "_key", tree)
    placed = placed.withColumn("grown_shard", grown(F.col("_key"), F.col("_t"), F.col("shard"), shards, len(tree)))
    numbered = number_within(placed.drop("_t", "_key"), "shard", "_bucket", ["_hash", "_id", "text_crc32", "size"], "slot")
    return numbered.select(F.col("_id").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", "slot", "grown_shard")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    per_region, regions = RACK * REGION, str(SHARDS // (RACK * REGION))
    first = f"region * {per_region} + rack * {RACK}"

    def draw(name: str, weight: str) -> str:
        return f"-ln((('0x' || substr(md5(k || ':' || {name}), 1, 12))::BIGINT + 0.5) / {float(16**12):.1f}) / {weight}"

    def level(of: str, names: str, weight: str, numbers: str) -> str:
        return f"(SELECT {of}({'n, ' if of == 'arg_min' else ''}{draw(names, weight)}) FROM range({numbers}) x(n))"

    def crc_nibble(value: int) -> int:
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        return value

    nibbles = "[" + ",".join(str(crc_nibble(i)) for i in range(16)) + "]::BIGINT[]"
    # A byte is taken as its two nibbles, the lower one first.
    step = f"lambda c, x: xor(c >> 4, ({nibbles})[(xor(c, x) & 15) + 1])"
    crc = (
        "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(2 * octet_length(encode(t))), "
        "lambda i: ('0x' || substr(hex(encode(t)), (CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END)::INTEGER, 1))::BIGINT))::BIGINT[], "
        f"{step}))"
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, octet_length(encode(t))::BIGINT + 16 AS size, ({crc})::BIGINT AS text_crc32, k, md5(k) AS h,
        {level("arg_min", "'r' || n", f"{per_region}.0", regions)} AS region, {level("min", "'r' || n", f"{per_region}.0", regions)} AS time FROM d),
q AS (SELECT *, {level("arg_min", "'r' || region || 'k' || n", f"{RACK}.0", str(REGION))} AS rack FROM r),
p AS (SELECT *, ({first} + {level("arg_min", f"'s' || ({first} + n)", "1.0", str(RACK))})::INTEGER AS shard FROM q)
SELECT doc_id, size, text_crc32, 'key' AS law, region::INTEGER AS region, rack::INTEGER AS rack, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, text_crc32, size) - 1)::BIGINT AS slot,
       (CASE WHEN {draw(f"'r{regions}'", "1.0")} < time THEN {SHARDS} ELSE shard END)::INTEGER AS grown_shard
FROM p"""


ORACLE_OP7 = _oracle()
