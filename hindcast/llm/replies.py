"""Reply trees of transcript turns, formatted as conversations.

Turns answer turns, so a thread is a tree and every leaf ends one branch from
the root. Branches are walked by self-joins that double their reach each
round, so a thread of n turns takes log n rounds; each round also adds up the
confidence on the way. The best branches of a thread are formatted: every turn
between marks that cannot occur inside a text, since the texts are escaped.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hindcast.llm.stored import Workspace

OPEN, CLOSE, END = "<turn ", ">", "</turn>\n"
# What stands for the escape sign and for the signs that marks are made of; the escape sign is undone last.
ESCAPES = [("\\", "\\b"), ("<", "\\l"), (">", "\\g")]


def escaped(text: Column) -> Column:
    for plain, sign in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(sign))
    return text


def unescaped(text: Column) -> Column:
    for plain, sign in reversed(ESCAPES):
        text = F.replace(text, F.lit(sign), F.lit(plain))
    return text


def _jumps(nodes: DataFrame, work: Workspace) -> tuple[list[DataFrame], DataFrame]:
    """Tables (thread, turn_no, up): the ancestor 1, 2, 4, ... steps up; and every
    turn's depth and summed confidence. Turns that lead into a circle have none."""
    step = work.saved(nodes.select("thread", "turn_no", F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps"),
                                   F.col("confidence").alias("total")), "jump-0")
    levels, ends = [], None
    largest = nodes.groupBy("thread").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    while True:
        # Threads whose turns have all reached their root are done; the others go on.
        on = work.saved(step.filter("up is not null").select("thread").distinct(), f"on-{len(levels)}")
        done = step.join(on, "thread", "left_anti")
        ends = done if ends is None else ends.unionByName(done)
        step = step.join(on, "thread", "left_semi")
        if (1 << len(levels)) > largest or on.isEmpty():
            return levels, ends.unionByName(step.filter("up is null")).select("thread", "turn_no", "steps", "total")
        levels.append(step)
        above = step.select("thread", F.col("turn_no").alias("up"), F.col("up").alias("next"),
                            F.col("steps").alias("more"), F.col("total").alias("higher"))
        moved = step.filter("up is not null").join(above, ["thread", "up"]).select(
            "thread", "turn_no", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"),
            (F.col("total") + F.col("higher")).alias("total"))
        step = work.saved(moved.unionByName(step.filter("up is null").select(*moved.columns)), f"jump-{len(levels)}")


def format_reply_trees(turns: DataFrame, best: int = 1, learned: str = "internal") -> DataFrame:
    """The ``best`` branches of every thread's reply tree as formatted conversations.

    ``turns`` needs ``thread, turn_no, reply_to`` (a turn of the same thread;
    null, missing or the turn itself: a root), ``origin, text`` and
    ``confidence``; other columns are not read. A branch scores the mean
    confidence of its turns; ties go to the longer branch, then to the smaller
    last turn. Returns ``thread, branch`` (from 1), ``leaf, score, n_turns,
    formatted`` and ``loss``: the (start, stop) code points in ``formatted`` of
    the escaped texts whose origin is ``learned``.

    Null origin and text are empty, null confidence is 0. Rows whose thread or
    turn is null are left out; of rows that repeat a turn the first by origin
    and text stays; turns that reply in a circle are on no branch; an empty
    table gives no rows. A conversation is one row, as long as its branch.
    """
    work = Workspace(turns.sparkSession, "replies")
    own = F.struct(F.coalesce("origin", F.lit("")).alias("origin"), F.coalesce("text", F.lit("")).alias("text"),
                   F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"),
                   F.col("reply_to").cast("long").alias("reply_to"))
    rows = (turns.filter("thread is not null and turn_no is not null")
            .groupBy(F.col("thread").cast("long").alias("thread"), F.col("turn_no").cast("long").alias("turn_no"))
            .agg(F.min(own).alias("own")).select("thread", "turn_no", "own.*"))
    rows = work.saved(rows, "turns")
    known = rows.select("thread", F.col("turn_no").alias("parent"))
    nodes = work.saved(rows.filter("reply_to <> turn_no").select("thread", F.col("reply_to").alias("parent"), "turn_no")
                       .join(known, ["thread", "parent"], "left_semi")
                       .join(rows.select("thread", "turn_no", "confidence"), ["thread", "turn_no"], "right"), "nodes")
    levels, ends = _jumps(nodes, work)
    parents = nodes.filter("parent is not null").select("thread", F.col("parent").alias("turn_no")).distinct()
    rank = Window.partitionBy("thread").orderBy(F.desc("score"), F.desc("steps"), "turn_no")
    chosen = (ends.join(parents, ["thread", "turn_no"], "left_anti").withColumn("score", F.col("total") / F.col("steps"))
              .withColumn("branch", F.row_number().over(rank)).filter(F.col("branch") <= best)
              .select("thread", "branch", F.col("turn_no").alias("leaf"), "score", "turn_no"))
    path = work.saved(chosen, "path-0")
    for n, level in enumerate(levels):  # all ancestors that are less than 2, 4, 8, ... steps up
        up = path.join(level.filter("up is not null").select("thread", "turn_no", "up"), ["thread", "turn_no"]).select(
            "thread", "branch", "leaf", "score", F.col("up").alias("turn_no"))
        path = work.saved(path.unionByName(up), f"path-{n + 1}")
    body = escaped(F.col("text"))
    spoken = (path.join(ends.select("thread", "turn_no", "steps"), ["thread", "turn_no"])
              .join(rows.select("thread", "turn_no", "origin", "text"), ["thread", "turn_no"])
              .select("thread", "branch", "leaf", "score", "steps", (F.col("origin") == learned).alias("learned"),
                      F.length(body).alias("size"),
                      F.concat(F.lit(OPEN), escaped(F.col("origin")), F.lit(CLOSE), body, F.lit(END)).alias("piece")))
    so_far = Window.partitionBy("thread", "branch").orderBy("steps").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.length("piece")).over(so_far) - len(END)
    return (spoken.withColumn("stop", stop).groupBy("thread", "branch", "leaf", "score")
            .agg(F.array_sort(F.collect_list(F.struct("steps", "piece", "learned", (F.col("stop") - F.col("size")).alias(
                "start"), "stop"))).alias("parts"))
            .select("thread", "branch", "leaf", "score", F.size("parts").cast("long").alias("n_turns"),
                    F.array_join("parts.piece", "").alias("formatted"),
                    F.transform(F.filter("parts", lambda p: p["learned"]),
                                lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"))).alias("loss")))


def read_turns(formatted: Column) -> Column:
    """The (origin, text) of each turn of a formatted conversation."""
    def turn(piece: Column) -> Column:
        at = F.instr(piece, CLOSE)
        return F.struct(unescaped(F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("origin"),
                        unescaped(F.substring(piece, at + 1, F.length(piece))).alias("text"))
    pieces = F.split(formatted, END)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
