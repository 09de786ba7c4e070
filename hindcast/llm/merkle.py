"""Merkle manifest of a table of events, with proofs found by pointer jumping.

Each event is a leaf. An application's leaves, in the order of their ids, are
hashed in runs of ``FANOUT`` level by level to the application's subroot, and
the subroots likewise to the root. A leaf's proof is the siblings in its run
and in the run of each of its ancestors.

Every run knows the siblings of one step, towards the run above it. Runs then
jump: a self-join on the pointer appends the segment of the run pointed at and
takes over its pointer, so the distance doubles, and after the logarithm of
the height every run holds its whole path. Leaves take their run's path last:
there are ``FANOUT`` times fewer runs, so no shuffle moves a path for each
leaf. Leaves are numbered by ranges of (application, id), so no task holds an
application, however large. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from hindcast.llm.stored import Workspace

FANOUT = 16
FIELDS = ["event_id", "app", "window", "text_len", "text"]
TOP = "^"  # names the tree of subroots; an application's tree begins with "=", that of no application is empty
BROADCAST_RUNS = 4096  # of some kilobytes each

STEP = "array<struct<left: string, right: string>>"
MANIFEST = f"event_id long, leaf string, subroot string, root string, proof {STEP}"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (lower-case hex) of the fields: each ``-`` if null, else its
    UTF-8 length in bytes, a colon and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda below, step: F.sha2(F.concat(step["left"], below, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All sibling digests of a proof, level by level, left to right, as one string."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def _step(children: Column, k: Column) -> Column:
    """The siblings of child ``k`` (from 0) in its run."""
    digests = F.transform(children, lambda child: child["digest"])
    return F.struct(F.array_join(F.slice(digests, 1, k), "").alias("left"),
                    F.array_join(F.slice(digests, k + 2, F.lit(FANOUT)), "").alias("right"))


def _numbered(rows: DataFrame, order: list[str], work: Workspace, name: str) -> DataFrame:
    """``rows`` with ``pos``, their place (from 0) in their ``tree``, and ``total``, the tree's number of rows.

    Rows are cut into ranges of (tree, order). A tree's rows lie together in
    each range, so a place is the row's distance from the first of them plus
    their numbers in the ranges before, one small row for each.
    """
    along = ["tree", *order]
    placed = work.saved(rows.repartitionByRange(*along).sortWithinPartitions(*along).withColumns(
        {"range": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), name)
    whole = Window.partitionBy("tree")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (placed.groupBy("tree", "range").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("n"))
              .select("tree", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("lo")).alias("shift"),
                      F.sum("n").over(whole).alias("total")))
    return (placed.join(ranges, ["tree", "range"]).withColumn("pos", F.col("at") + F.col("shift"))
            .drop("range", "at", "shift"))


def _tree(nodes: DataFrame, work: Workspace, name: str) -> list[DataFrame]:
    """The runs of each level from 1 on: ``tree, idx, children, digest, level``
    and ``total``, the number of runs of that level in the tree.

    ``nodes`` has ``tree, pos, total`` and ``child``, a struct with ``digest``.
    A tree of one node only has that node's digest.
    """
    levels: list[DataFrame] = []
    while True:
        runs = (nodes.groupBy("tree", F.expr(f"pos div {FANOUT}").alias("idx"))
                .agg(F.any_value("total").alias("n"),
                     F.transform(F.array_sort(F.collect_list(F.struct("pos", "child"))),
                                 lambda x: x["child"]).alias("children")))
        joint = F.sha2(F.array_join(F.transform("children", lambda child: child["digest"]), ""), 256)
        levels.append(work.saved(runs.select(
            "tree", "idx", "children", (F.col("n") == 1).alias("lone"),
            F.when(F.col("n") == 1, F.col("children")[0]["digest"]).otherwise(joint).alias("digest"),
            F.ceil(F.col("n") / FANOUT).alias("total")), f"{name}-{len(levels) + 1}"))
        more = levels[-1].filter("total > 1")
        if more.isEmpty():
            return levels
        nodes = more.select("tree", F.col("idx").alias("pos"), "total", F.struct("digest").alias("child"))


def _key(tree: Column, level: Column, idx: Column) -> Column:
    return F.struct(tree.alias("tree"), level.cast("int").alias("level"), idx.cast("long").alias("idx"))


def _upward(runs: DataFrame, level: int, child_key) -> DataFrame:
    """(key, to, path): each child run points at the run it lies in."""
    steps = runs.select("tree", "idx", "lone", "children", F.posexplode("children").alias("k", "child"))
    path = F.when(F.col("lone"), F.array().cast(STEP)).otherwise(F.array(_step(F.col("children"), F.col("k"))))
    return steps.select(child_key(F.col("child"), F.col("k")).alias("key"),
                        _key(F.col("tree"), F.lit(level), F.col("idx")).alias("to"), path.alias("path"))


def _jumped(links: DataFrame, work: Workspace) -> DataFrame:
    """(key, path) with every path up to the root: pointers double until none is left."""
    step = 0
    links = work.saved(links, "path-0")
    while True:
        open_ = links.filter(F.col("to").isNotNull())
        targets = open_.select("to").distinct()
        count = targets.count()
        if count == 0:
            return links.select("key", "path")
        above = links.select(F.col("key").alias("to"), F.col("to").alias("next"), F.col("path").alias("more"))
        if count <= BROADCAST_RUNS:  # every run below points at one of few: that join would be hot
            above = F.broadcast(above.join(F.broadcast(targets), "to", "left_semi"))
        step += 1
        links = work.saved(
            open_.join(above, "to").select("key", F.col("next").alias("to"), F.concat("path", "more").alias("path"))
            .unionByName(links.filter(F.col("to").isNull())), f"path-{step}")


def manifest(activity: DataFrame, fields: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The leaf of every event, its application's subroot, the root and the leaf's proof.

    ``activity`` needs ``event_id``, ``app`` and the hashed ``fields`` (by
    default ``FIELDS``); columns named in ``keep`` are carried along and must
    be of types that can be ordered; others are not read. Returns ``event_id,
    leaf, subroot, root`` (lower-case hex), ``proof`` (for each level from the
    leaf to the root the digests ``left`` and ``right`` of the node in its
    run, joined; empty where a run has no others) and the kept columns, one
    row per input row. A null ``app`` is a group of its own and comes first; a
    null ``event_id`` comes first in its group; rows that repeat an id stand
    in the order of their leaves, equal rows beside each other with proofs of
    their own. A lone leaf is its application's subroot and has no step
    there. An empty text is not a null one. An empty table gives no rows.
    """
    fields, keep = fields or FIELDS, keep or []
    taken = {"event_id", "leaf", "subroot", "root", "proof"} & set(keep)
    if taken:
        raise ValueError(f"these names are the manifest's own: {sorted(taken)}")
    spark = activity.sparkSession
    work = Workspace(spark, "manifest")
    tree = F.coalesce(F.concat(F.lit("="), F.col("app").cast("string")), F.lit(""))
    kept = F.struct(F.lit(0).alias("_"), *keep)
    leaves = work.saved(activity.select(tree.alias("tree"), F.col("event_id").cast("long").alias("event_id"),
                                        leaf_digest(*map(F.col, fields)).alias("digest"), kept.alias("kept")), "leaves")
    if leaves.isEmpty():
        return leaves.select("event_id", *(F.col("digest").alias(n) for n in ("leaf", "subroot", "root")),
                             F.array().cast(STEP).alias("proof"), *(F.col(f"kept.{c}").alias(c) for c in keep))
    placed = _numbered(leaves, ["event_id", "digest"], work, "ranges")
    below = _tree(placed.select("tree", "pos", "total", F.struct("digest", "event_id", "kept").alias("child")),
                  work, "runs")
    tops = reduce(DataFrame.unionByName, [
        runs.filter("total = 1").select("tree", "digest", F.lit(k + 1).alias("height")) for k, runs in enumerate(below)])
    subroots = work.saved(tops, "subroots")
    ordered = _numbered(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "digest", "height"),
                        ["of"], work, "subroot-ranges")
    above = _tree(ordered.select("tree", "pos", "total", F.struct("digest", "of", "height").alias("child")), work, "top")
    root = above[-1].first()["digest"]

    links = [_upward(above[0], 1, lambda child, k: _key(child["of"], child["height"], F.lit(0)))]
    for trees in (below, above):
        links += [_upward(runs, k + 2, lambda child, at, level=k + 1: _key(
            F.col("tree"), F.lit(level), F.col("idx") * FANOUT + at)) for k, runs in enumerate(trees[1:])]
    crown = spark.range(1).select(_key(F.lit(TOP), F.lit(len(above)), F.lit(0)).alias("key"),
                                  _key(F.lit(TOP), F.lit(0), F.lit(0)).alias("to"), F.array().cast(STEP).alias("path"))
    crown = crown.withColumn("to", F.when(F.lit(False), F.col("to")))
    paths = _jumped(reduce(DataFrame.unionByName, [*links, crown]), work)

    runs = (below[0].withColumn("key", _key(F.col("tree"), F.lit(1), F.col("idx"))).join(paths, "key")
            .join(subroots.select("tree", F.col("digest").alias("subroot")), "tree")
            .select("subroot", "path", "lone", "children", F.posexplode("children").alias("k", "child")))
    own = F.when(F.col("lone"), F.array().cast(STEP)).otherwise(F.array(_step(F.col("children"), F.col("k"))))
    return runs.select(F.col("child.event_id").alias("event_id"), F.col("child.digest").alias("leaf"), "subroot",
                       F.lit(root).alias("root"), F.concat(own, F.col("path")).alias("proof"),
                       *(F.col(f"child.kept.{c}").alias(c) for c in keep))
