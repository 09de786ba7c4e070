"""Fuzzy line dedup: MinHash over character shingles, verified, joined by union-find.

DataFrame functions only. Equal lines are folded first. A line's shingles are
hashed once; a hash's low bits choose one of ``BANDS * ROWS`` bins and each
bin keeps its smallest hash (one-permutation MinHash). Of long lines only the
hashes below a mark that halves as the length doubles enter the bins, which
changes no bin's smallest hash unless the bin would have held almost nothing.
Lines that agree in a whole band are candidates. A line's weight is the number of
lines that its bands hold; the heaviest line of a band, its head, is the one that
most others are like. Lines are compared by exact Jaccard similarity in four
rounds, of which each leaves out pairs that the links found before have already joined:

1. every line with the head in which most of its bands agree,
2. every line with the heads of all its bands,
3. every line with the ``HUBS`` next lines by weight of each of its bands,
4. lines of one band that still lie in different components with each other.

After the second round a band matters only if its lines other than the head lie in
different components. For these, parities of the shingle sets rule out most unlike
pairs before their texts are read.
So a band of n copies costs n comparisons, and no verified link between
different components is lost. Texts meet for a comparison; their shingles are
made, used and gone within the task and never written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hindcast.llm.components import connected
from hindcast.llm.stored import Workspace

SHINGLE, PERCENT = 8, 80
BANDS, ROWS = 10, 4
HUBS = 4
KEPT_HASHES = 3 * BANDS * ROWS
WORDS = 32  # of 64 bits
BROADCAST_IDS = 1 << 20  # of 8 bytes


def normal_lines(activity: DataFrame) -> DataFrame:
    """(event_id, line_no from 0, normal) of every text; null is one empty line. Lines are compared without case and
    outer blanks; ``normal`` is made below the explode, once a line whatever reads it."""
    def normal(line: Column) -> Column:
        return F.lower(F.trim(F.replace(F.replace(line, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))))

    return activity.select(F.col("event_id").cast("long").alias("event_id"), F.posexplode(
        F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), normal)).alias("line_no", "normal"))


def _with_id(normal: DataFrame) -> DataFrame:
    """The lines with an ``id`` of 16 bytes; a blank line has one of its own."""
    return normal.withColumn("id", F.unhex(F.md5(F.when(F.length("normal") > 0, F.col("normal")).otherwise(
        F.concat_ws("/", F.lit(" "), "event_id", "line_no")))))


def _short() -> Column:
    return F.xxhash64("normal").alias("short")


def shingled(texts: DataFrame, text: Column, *keys: Column | str) -> DataFrame:
    """(keys, h): a row for every shingle of ``text``; one shorter than a shingle is
    one as a whole. UTF-16 gives every character a fixed width. The keys and the
    encoded text are made once for a text, below the explode."""
    wide = texts.select(*keys, F.encode(text, "UTF-16BE").alias("wide"))
    names = [c for c in wide.columns if c != "wide"]
    last = F.greatest((F.octet_length("wide") / 2).cast("int") - SHINGLE, F.lit(0))
    return (wide.select(*names, "wide", F.explode(F.sequence(F.lit(0), last)).alias("i"))
            .select(*names, F.xxhash64(F.substring(F.col("wide"), 2 * F.col("i") + 1, F.lit(2 * SHINGLE))).alias("h")))


def bands(lines: DataFrame) -> DataFrame:
    """(short, bucket) of the distinct lines ``lines`` (short, normal), which are partitioned by ``short``.
    Of two different lines that had the same short id one would not be compared, so never wrongly linked."""
    # Long lines keep a half, a quarter, ... of the 48-bit values; the low bits choose the bin.
    times = f"octet_length(encode(normal, 'UTF-16BE')) / {2 * KEPT_HASHES}"
    mark = F.expr(f"shiftright(281474976710656L, cast(greatest(floor(log2({times})), 0) as int))").alias("mark")
    hashes = shingled(lines, F.col("normal"), "short", mark)
    binned = (hashes.select("short", "mark", F.shiftrightunsigned("h", 16).alias("v"),
                            F.expr(f"cast((h & 65535) % {BANDS * ROWS} as int)").alias("bin"))
              .filter("v < mark")
              .select("short", "v", F.expr(f"cast(bin div {ROWS} as int)").alias("band"), (F.col("bin") % ROWS).alias("row")))
    least = [F.min(F.when(F.col("row") == r, F.col("v"))).alias(f"m{r}") for r in range(ROWS)]
    names = [f"m{r}" for r in range(ROWS)]
    return binned.groupBy("short", "band").agg(*least).select(
        "short", F.xxhash64("band", *(F.coalesce(n, F.lit(-1)) for n in names)).alias("bucket"))


def shingle_list(text: Column) -> Column:
    """The hashes of ``shingled``, with repeats, as an array. The encoded text is a lambda's variable, as a column of
    bytes would be copied for every shingle."""
    def hashes(wide: Column) -> Column:
        last = F.greatest(F.octet_length(wide) - 2 * SHINGLE, F.lit(0))
        return F.transform(F.sequence(F.lit(1), last + 1, F.lit(2)),
                           lambda at: F.xxhash64(F.substring(wide, at, F.lit(2 * SHINGLE))))

    return F.transform(F.array(F.encode(text, "UTF-16BE")), hashes)[0]


def with_parities(texts: DataFrame) -> DataFrame:
    """(short, size, parities) of the table ``texts`` (short, normal): ``size`` is the number of different shingles;
    of the ``WORDS`` words of ``parities`` every shingle turns over one bit."""
    # An outer explode, as Spark makes the array of a plain one a second time to filter by its size; none is empty.
    hashes = texts.repartition("short").select("short", F.explode_outer(F.array_distinct(shingle_list(F.col("normal")))).alias("h")).select(
        "short", F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"),
        F.expr(f"cast(shiftrightunsigned(h, 32) % {WORDS} as int)").alias("word"))
    parts = hashes.groupBy("short", "word").agg(F.bit_xor("bit").alias("bits"), F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    return parts.groupBy("short").agg(F.sum("n").alias("size"), F.array(*(
        F.coalesce(F.max(F.when(F.col("word") == w, F.col("bits"))), zero) for w in range(WORDS))).alias("parities"))


def _side(df: DataFrame, x: str, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(f"{x}_{c}") for c in df.columns if c not in keys))


def may_be_alike() -> Column:
    """False only where lines ``a`` and ``b`` cannot have the share in common. Shared shingles turn over the same bits,
    so the bits that differ are at most the shingles that one alone has; these are, at the share p of the
    union, at most (1 - p) / (1 + p) of both sizes."""
    differ = F.zip_with("a_parities", "b_parities", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.reduce(differ, F.lit(0), lambda so_far, n: so_far + n)
    both = F.col("a_size") + F.col("b_size")
    return ((F.least("a_size", "b_size") * 100 >= F.greatest("a_size", "b_size") * PERCENT)
            & (apart * (100 + PERCENT) <= both * (100 - PERCENT)))


def similar(pairs: DataFrame, texts: DataFrame, work: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose shingle sets have the share of their union in common.

    Both texts meet in one row, rows are dealt out by pair, and the shingles of a
    pair are arrays made and compared in that row."""
    left = work.saved(pairs, f"{name}-pairs")
    asked = left.select(F.explode(F.array("a", "b")).alias("short")).distinct()
    if 2 * left.count() <= BROADCAST_IDS >> 4:
        texts = texts.join(F.broadcast(asked), "short", "left_semi")
    sides = [texts.select(F.col("short").alias(x), F.col("normal").alias(f"text_{x}")) for x in ("a", "b")]
    met = left.join(sides[0], "a").join(sides[1], "b").repartition("a", "b")
    # Above the explode, the arrays are columns and so made once.
    lists = met.select("a", "b", F.explode(F.array(F.struct(
        shingle_list(F.col("text_a")).alias("a"), shingle_list(F.col("text_b")).alias("b")))).alias("of"))
    both, either = F.array_intersect("of.a", "of.b"), F.array_union("of.a", "of.b")
    return work.saved(lists.filter(F.size(both) * 100 >= F.size(either) * PERCENT).select("a", "b"), name)


def _pairs(df: DataFrame, one: str, other: str) -> DataFrame:
    """(a, b) with a > b, each pair once, of the two columns."""
    return df.select(F.greatest(one, other).alias("a"), F.least(one, other).alias("b")).distinct()


def with_heads(members: DataFrame) -> DataFrame:
    """``members`` (bucket, short, n), n lines to a bucket, with each line's ``place`` in its bucket, the heaviest first,
    and the bucket's ``head``, which has place 1. A line's weight is the sum of its n."""
    heaviest = Window.partitionBy("bucket").orderBy(F.desc("weight"), F.desc("short"))
    return (members.withColumn("weight", F.sum("n").over(Window.partitionBy("short")))
            .select("bucket", "short", "n", F.row_number().over(heaviest).alias("place"),
                    F.first("short").over(heaviest).alias("head")))


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with their ``root``, of buckets that hold more than one."""
    labelled = members.join(roots, "short", "left").withColumn("root", F.coalesce("root", "short"))
    still = (labelled.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
             .filter("r0 <> r1").select("bucket"))
    return labelled.join(still, "bucket", "left_semi")


def hub_pairs(opened: DataFrame) -> DataFrame:
    """(a, b): lines of ``opened`` (bucket, short, place, root, size, parities) with the ``HUBS`` lines next to the head
    of their bucket, in other components, less those that their parities rule out."""
    hubs = opened.filter(F.col("place") <= HUBS + 1)
    return _pairs(_side(opened, "a", "bucket").join(_side(hubs, "b", "bucket"), "bucket")
                  .filter("a_short <> b_short and a_root <> b_root").filter(may_be_alike()), "a_short", "b_short")


def open_pairs(opened: DataFrame) -> DataFrame:
    """(a, b): lines of one bucket of ``opened`` in different components, less those that their parities rule out."""
    return (_side(opened, "a", "bucket").join(_side(opened, "b", "bucket"), "bucket")
            .filter("a_short > b_short and a_root <> b_root").filter(may_be_alike())
            .select(F.col("a_short").alias("a"), F.col("b_short").alias("b")).distinct())


def _joined(roots: DataFrame, links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """``roots`` (short, root) after more ``links`` (a, b): only the components that these join are worked on."""
    a, b = (roots.select(F.col("short").alias(x), F.col("root").alias(f"r{x}")) for x in ("a", "b"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    above = connected(between, work, name)
    moved = (roots.join(above.select(F.col("id").alias("root"), F.col("root").alias("above")), "root", "left")
             .select("short", F.coalesce("above", "root").alias("root")))
    new = above.select(F.col("id").alias("short"), "root").join(roots.select("short"), "short", "left_anti")
    return work.saved(moved.unionByName(new), f"{name}-joined")


def rooted_lines(normal: DataFrame, work: Workspace) -> DataFrame:
    """(event_id, line_no, root) of the lines ``normal``: the id of a line of the same component."""
    filled = normal.filter(F.length("normal") > 0).select(_short(), "normal")
    # Dealt out first, so that equal lines are folded once; folding before the shuffle would save little of it.
    distinct = filled.repartition("short").distinct()
    # A bucket holds different lines only, as copies are folded; its sort spills.
    bucket = Window.partitionBy("bucket")
    counted = work.saved(bands(distinct).withColumn("n", F.count(F.lit(1)).over(bucket)).filter("n > 1"), "counted")
    members = work.saved(with_heads(counted), "members")
    shorts = work.saved(members.select("short").distinct(), "shorts")
    # Few lines have candidates; their ids are broadcast only while they are at most BROADCAST_IDS.
    wanted = shorts.withColumnRenamed("short", "wanted")
    wanted = F.broadcast(wanted) if shorts.count() <= BROADCAST_IDS else wanted
    # One more reading of the texts gives every line's id, and the text of those that have candidates.
    lines = work.saved(_with_id(normal).join(wanted, F.xxhash64("normal") == F.col("wanted"), "left").select(
        "event_id", "line_no", "id", F.col("wanted").isNotNull().alias("near"),
        F.when(F.col("wanted").isNotNull(), F.col("normal")).alias("normal")), "lines")
    texts = work.saved(lines.filter(F.length("normal") > 0).select(_short(), "normal")
                       .groupBy("short").agg(F.any_value("normal").alias("normal")), "texts")

    to_heads = work.saved(members.filter("place > 1").groupBy("short", "head").agg(F.count(F.lit(1)).alias("n")), "heads")
    best = _pairs(to_heads.groupBy("short").agg(F.max(F.struct("n", "head")).alias("best"))
                  .select("short", F.col("best.head").alias("head")), "short", "head")
    roots = connected(similar(best, texts, work, "first"), work, "first-roots").withColumnRenamed("id", "short")
    heads = roots.select(F.col("short").alias("head"), F.col("root").alias("head_root"))
    others = _pairs(to_heads.join(roots, "short", "left").join(heads, "head", "left")
                    .filter(F.coalesce("root", "short") != F.coalesce("head_root", "head")), "short", "head")
    roots = _joined(roots, similar(others.join(best, ["a", "b"], "left_anti"), texts, work, "second"), work, "star-roots")
    # All lines have met their heads: a bucket is done when its other lines lie in one component.
    apart = work.saved(_apart(members.filter("n > 2 and place > 1").select("bucket", "short", "place"), roots), "apart")
    bounds = work.saved(with_parities(texts.join(apart.select("short").distinct(), "short", "left_semi")), "parities")
    opened = work.saved(apart.join(bounds, "short"), "open")
    met = _pairs(to_heads, "short", "head")
    hubs = work.saved(hub_pairs(opened).join(met, ["a", "b"], "left_anti"), "hubs")
    roots = _joined(roots, similar(hubs, texts, work, "third"), work, "hub-roots")
    rest = (open_pairs(_apart(opened.drop("root", "place"), roots))
            .join(met, ["a", "b"], "left_anti").join(hubs, ["a", "b"], "left_anti"))
    roots = _joined(roots, similar(rest, texts, work, "rest"), work, "roots")
    ids = texts.select("short", F.unhex(F.md5("normal")).alias("id"))
    named = (roots.join(ids, "short").select("id", F.col("root").alias("short"))
             .join(ids.withColumnRenamed("id", "root_id"), "short").select("id", F.col("root_id").alias("root")))
    alone = lines.filter("not near").select("event_id", "line_no", F.col("id").alias("root"))
    return work.saved(lines.filter("near").select("event_id", "line_no", "id").join(named, "id", "left")
                      .select("event_id", "line_no", F.coalesce("root", "id").alias("root")).unionByName(alone), "rooted")


def line_components(activity: DataFrame) -> DataFrame:
    """The component of every line of every event's text, and which line of it stays.

    ``activity`` needs ``event_id`` and ``text``; other columns are not read.
    Lines end at line feeds. Two lines link when their sets of
    ``SHINGLE``-character shingles, without case and outer blanks, have
    ``PERCENT`` of their union in common; a line shorter than a shingle is one
    shingle. Returns ``event_id, line_no`` (from 0), ``first_event_id,
    first_line_no`` (the first line of the component by event and line number)
    and ``kept`` (true for that line only), one row per line. Blank lines, and
    so null and empty texts, are components of their own and kept. Rows with a
    null ``event_id`` come first in that order; rows that repeat an id share
    line numbers, so equal lines of theirs are all kept or all dropped; an
    empty table gives no rows.
    """
    work = Workspace(activity.sparkSession, "lines")
    rooted = rooted_lines(normal_lines(activity), work)
    own = F.struct("event_id", "line_no")
    firsts = (rooted.groupBy("root")
              .agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", "first"))
    placed = rooted.join(firsts, "root", "left").select("event_id", "line_no", F.coalesce("first", own).alias("first"))
    return placed.select(
        "event_id", "line_no", F.col("first.event_id").alias("first_event_id"),
        F.col("first.line_no").alias("first_line_no"), own.eqNullSafe(F.col("first")).alias("kept"))


def dedup_lines(activity: DataFrame) -> DataFrame:
    """``activity`` with the lines that are not kept taken out of ``text``; all
    columns stay. An event whose lines all go is left out; one whose text was
    blank, empty or null before stays as it was."""
    event, gone, text = (_free(name, activity) for name in ("event", "gone", "text"))
    dropped = (line_components(activity).filter("not kept").groupBy(F.col("event_id").alias(event))
               .agg(F.collect_set("line_no").alias(gone)))
    left = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(gone, i))
    return (activity.join(dropped, F.col("event_id").eqNullSafe(F.col(event)), "left")
            .withColumn(text, F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
            .filter(F.col(gone).isNull() | (F.length(F.trim(text)) > 0))
            .withColumn("text", F.col(text)).drop(event, gone, text))


def _free(name: str, df: DataFrame) -> str:
    """``name`` with as many underscores before it as make it none of the columns of ``df``."""
    held = {c.lower() for c in df.columns}
    while name in held:
        name = f"_{name}"
    return name
