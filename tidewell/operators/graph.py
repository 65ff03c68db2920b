"""Relations between records: an edge table of (parent, child) and what is computed over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import checkpoint


#: Expansions to this depth are one plan; deeper ones write each level.
PLANNED_DEPTH = 3


def children_of(records: DataFrame, edges: DataFrame, parents: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(parent, child's columns), ordered by parent and child id."""
    chosen = edges if parents is None else edges.join(parents.select(F.col(key).alias("parent")), "parent", "left_semi")
    return chosen.join(records, F.col("child") == F.col(key)).drop("child").orderBy("parent", key)


def parents_of(records: DataFrame, edges: DataFrame, children: DataFrame | None = None, key: str = "id") -> DataFrame:
    chosen = edges if children is None else edges.join(children.select(F.col(key).alias("child")), "child", "left_semi")
    return chosen.join(records, F.col("parent") == F.col(key)).drop("parent").orderBy("child", key)


def with_relatives(records: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """records with ordered arrays parent_ids and child_ids (null if there are none).

    Two equi-joins on aggregated edges take the place of one join on `id = parent OR id = child`.
    """
    below = edges.groupBy(F.col("parent").alias("_p")).agg(F.array_sort(F.collect_set("child")).alias("child_ids"))
    above = edges.groupBy(F.col("child").alias("_c")).agg(F.array_sort(F.collect_set("parent")).alias("parent_ids"))
    return records.join(below, F.col(key) == F.col("_p"), "left").join(above, F.col(key) == F.col("_c"), "left").drop("_p", "_c")


def related_ids(edges: DataFrame) -> DataFrame:
    """Each id with each of its relatives, either way, once."""
    down = edges.select(F.col("parent").alias("id"), F.col("child").alias("related"))
    up = edges.select(F.col("child").alias("id"), F.col("parent").alias("related"))
    return down.union(up).distinct()


def expand(roots: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(root, node, depth): each root (column id) with its descendants; depth -1 is without limit.

    A level's nodes join with the edges; a node seen before for the root isn't visited again, so cycles
    end.  Each level is one equi-join, and edges keep their partitioning by parent over all of them.
    """
    level = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct()
    seen, reached = level, 0
    step = edges.select(F.col("parent").alias("node"), F.col("child").alias("next")).distinct()
    while depth < 0 or reached < depth:
        reached += 1
        found = level.join(step, "node").select("root", F.col("next").alias("node"), F.lit(reached).alias("depth")).distinct()
        level = found.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        if not 0 <= depth <= PLANNED_DEPTH:
            # A plan of many levels grows with the square and more; written levels keep it flat.
            level = checkpoint(level)
            if level.isEmpty():
                break
        seen = seen.union(level)
    return seen


def ascend(roots: DataFrame, edges: DataFrame, height: int = -1) -> DataFrame:
    """(root, node, depth): each root with its ancestors."""
    return expand(roots, edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")), height)


def top_ancestor(roots: DataFrame, edges: DataFrame, height: int = -1) -> DataFrame:
    """(root, top): climbs by the least parent of each level, until there is none or it repeats; height -1 is without limit.

    Each level is written, and only rows that still move go on.
    """
    first = edges.groupBy("child").agg(F.min("parent").alias("up"))
    if height < 0 or height > PLANNED_DEPTH:
        first = checkpoint(first)
    at = roots.select(F.col("id").alias("root"), F.col("id").alias("top"), F.array("id").alias("_path"))
    done: list[DataFrame] = []
    level = 0
    while level != height:
        level += 1
        step = at.join(first, F.col("top") == F.col("child"), "left")
        move = F.col("up").isNotNull() & ~F.array_contains("_path", F.coalesce("up", "top"))
        step = step.select("root", F.when(move, F.col("up")).otherwise(F.col("top")).alias("top"), F.when(move, F.array_append("_path", F.col("up"))).otherwise(F.col("_path")).alias("_path"), move.alias("_moved"))
        if 0 <= height <= PLANNED_DEPTH:
            at = step.drop("_moved")
            continue
        step = checkpoint(step)
        done.append(step.where("NOT _moved").select("root", "top"))
        at = step.where("_moved").drop("_moved")
        if at.isEmpty():
            break
        if len(done) == 16:
            done = [checkpoint(reduce(DataFrame.union, done))]
    return reduce(DataFrame.union, [*done, at.select("root", "top")])


def touched(changed: DataFrame, edges: DataFrame, ancestors: bool = True, descendants: bool = False, limit: int = -1) -> DataFrame:
    """Ids whose time changes along with the changed ids (column id), themselves included."""
    ids = changed.select("id").distinct()
    if ancestors:
        ids = ids.union(ascend(changed, edges, limit).select(F.col("node").alias("id")))
    if descendants:
        ids = ids.union(expand(changed, edges, limit).select(F.col("node").alias("id")))
    return ids.distinct()


def touch(records: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    hit = ids.select(F.col("id").alias("_hit")).distinct()
    joined = records.join(hit, F.col("id") == F.col("_hit"), "left")
    return joined.withColumn("mtime", F.when(F.col("_hit").isNotNull(), now).otherwise(F.col("mtime"))).select(records.columns)


def clear_relations(edges: DataFrame, ids: DataFrame, which: str = "none", compat: bool = False) -> DataFrame:
    """Edges without those of the ids: parent, child, all or none.

    compat: `child` also clears the edges to parents, as stored data of older versions has it.
    """
    if which not in ("none", "parent", "child", "all"):
        raise ValueError(which)
    gone = ids.select(F.col("id").alias("_id")).distinct()
    if which in ("child", "all"):
        edges = edges.join(gone, F.col("parent") == F.col("_id"), "left_anti")
    if which in ("parent", "all") or (which == "child" and compat):
        edges = edges.join(gone, F.col("child") == F.col("_id"), "left_anti")
    return edges


def update_relations(edges: DataFrame, updated: DataFrame, new_edges: DataFrame, clear: str = "none", compat: bool = False) -> DataFrame:
    return clear_relations(edges, updated, clear, compat).union(new_edges.select("parent", "child")).distinct()


def mark_relations(records: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("parent").alias("_e")).union(edges.select(F.col("child"))).distinct()
    return records.drop("has_relations").join(ends, F.col("id") == F.col("_e"), "left").withColumn("has_relations", F.col("_e").isNotNull()).drop("_e")


def by_relatives(records: DataFrame, edges: DataFrame, side: str, rule: str, existence: str = "id") -> DataFrame:
    """Keeps rows by whether they have relatives on a side (parent or child).

    rule: ignore, disallow or require.  existence: `id` asks for an edge, `object` for a stored relative,
    `any` for an edge of which some relative is stored, `all` for edges of which all are stored.
    """
    if rule == "ignore":
        return records
    own, other = ("child", "parent") if side == "parent" else ("parent", "child")
    linked = edges.select(F.col(own).alias("_own"), F.col(other).alias("_other")).distinct()
    if existence != "id":
        stored = records.select(F.col("id").alias("_other"), F.lit(True).alias("_there"))
        linked = linked.join(stored, "_other", "left")
        if existence == "all":
            linked = linked.groupBy("_own").agg(F.count("_there").alias("n"), F.count(F.lit(1)).alias("m")).where("n = m")
        else:
            linked = linked.where("_there")
    kind = {"require": "left_semi", "disallow": "left_anti"}[rule]
    return records.join(linked.select("_own").distinct(), F.col("id") == F.col("_own"), kind)


def graph_filter(records: DataFrame, edges: DataFrame, passes: Column, parents: bool = False, children: bool = True, success: str = "all", depth: int = -1) -> DataFrame:
    """Rows whose family passes a test: origin (the row itself), all, one (any) or none (no requirement)."""
    if success == "none":
        return records
    tested = records.withColumn("_ok", F.coalesce(passes, F.lit(False)))
    if success == "origin":
        return tested.where("_ok").drop("_ok")
    ids = records.select("id")
    family = ids.select(F.col("id").alias("root"), F.col("id").alias("node"))
    if children:
        family = family.union(expand(ids, edges, depth).select("root", "node"))
    if parents:
        family = family.union(ascend(ids, edges, depth).select("root", "node"))
    judged = family.distinct().join(tested.select(F.col("id").alias("node"), "_ok"), "node").groupBy("root").agg((F.every("_ok") if success == "all" else F.some("_ok")).alias("_pass"))
    return records.join(judged.where("_pass").select(F.col("root").alias("id")), "id", "left_semi")


def resolve(origins: DataFrame, targets: DataFrame, origin_key: str, target_key: str, origin_term: Column, target_term: Column, max_hits: int = 10, keep_unmatched: bool = True) -> DataFrame:
    """(origin, hits): the least max_hits target ids whose normalised term equals the origin's."""
    a = origins.select(F.col(origin_key).alias("origin"), origin_term.alias("_term"))
    b = targets.select(F.col(target_key).alias("_hit"), target_term.alias("_term")).distinct()
    best = b.withColumn("_n", F.row_number().over(Window.partitionBy("_term").orderBy("_hit"))).where(F.col("_n") <= max_hits)
    listed = best.groupBy("_term").agg(F.array_sort(F.collect_list("_hit")).alias("hits"))
    return a.join(listed, "_term", "left" if keep_unmatched else "inner").select("origin", "hits")


def merge_volumes(parents: DataFrame, children: DataFrame, edges: DataFrame, content: str = "content", order: str = "id", joiner: str = "\n") -> DataFrame:
    """Parents with their children's contents appended in order."""
    below = edges.join(children.select(F.col("id").alias("child"), F.col(order).alias("_o"), F.col(content).alias("_x")), "child")
    listed = below.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("_o", "child", "_x"))).alias("_list"))
    joined = parents.join(listed, F.col("id") == F.col("parent"), "left")
    volumes = F.transform(F.coalesce("_list", F.array().cast(listed.schema["_list"].dataType)), lambda v: v["_x"])
    return joined.withColumn(content, F.concat_ws(joiner, F.col(content), volumes)).drop("parent", "_list")
