"""Secrets in event text, with weak parts linked by what stands around them.

Three base kinds are found by their form alone. Three weak kinds (a login
name, a bare token, an endpoint) say nothing by themselves: one is reported
only where parts of both other roles of a credential (identifier, secret,
endpoint) lie within ``SCOPE`` characters of it in the same text. All of it is
DataFrame functions: a pattern's matches and the text between them give the
places by running sums, and the scopes are an interval join over bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hindcast.llm.stored import Workspace

SCOPE = 200

# Kind, pattern, least length and role. The first three patterns.
# A run of hex digits is matched from 32 digits on, which finds the same runs.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
     8, "secret"),
    ("access", r"AKIA[A-Z0-9]+", 16, "identifier"),
    ("hex", r"[0-9a-f]{32,}", 32, "secret"),
    ("login", r"""(?i)\b(user|username|login|account|client_id|access_key_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]+""",
     6, "identifier"),
    ("bare", r"\b(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}", 20, "secret"),
    ("endpoint", r"""(?i)\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+""", 10, "endpoint"),
]
BASE = [k[0] for k in KINDS[:3]]


def _lengths(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.length(t))


def _matches(kind: str, pattern: str, least: int) -> Column:
    """Per match of a row's text: the length of the text before it and its own, and whether it counts."""
    text = F.col("text")
    found = F.col(f"found_{kind}")
    before = F.slice(_lengths(F.split(text, pattern)), F.lit(1), F.size(found))
    counts = F.transform(found, lambda m: F.length(F.regexp_extract(m, pattern, 2) if kind == "assign" else m) >= least)
    return F.arrays_zip(before.alias("gap"), _lengths(found).alias("size"), counts.alias("counts"))


def _spans(rows: DataFrame, kinds: list[tuple]) -> DataFrame:
    """(event_id, print, kind, start, stop) of the matches that count."""
    parts = None
    for kind, pattern, least, _ in kinds:
        some = rows.filter(F.size(f"found_{kind}") > 0)
        listed = F.struct(F.lit(kind).alias("kind"), _matches(kind, pattern, least).alias("matches"))
        part = some.select("event_id", "print", listed.alias("k")).select(
            "event_id", "print", F.col("k.kind").alias("kind"), F.posexplode("k.matches").alias("at", "m"))
        parts = part if parts is None else parts.unionByName(part)
    one = (parts.select("event_id", "print", "kind", "at", F.col("m.gap").alias("gap"), F.col("m.size").alias("size"),
                        F.col("m.counts").alias("counts")).distinct())
    so_far = Window.partitionBy("event_id", "print", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return (one.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(so_far))
            .filter("counts").select("event_id", "print", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop"))


def linked_weak(parts: DataFrame, scope: int) -> DataFrame:
    """The weak parts that have parts of both other roles within ``scope``."""
    role = F.create_map(*(F.lit(x) for kind, _, _, r in KINDS for x in (kind, r)))
    roles = parts.withColumn("role", role[F.col("kind")])

    def binned(df: DataFrame, reach: int) -> DataFrame:
        lo, hi = (F.floor((F.col(c) + F.lit(d)) / F.lit(scope)) for c, d in (("start", -reach), ("stop", reach)))
        return df.withColumn("bin", F.explode(F.sequence(lo, hi)))

    weak = binned(roles.filter(~F.col("kind").isin(BASE)), 0)
    around = binned(roles, scope).select("event_id", "print", "bin", F.col("role").alias("other"),
                                         F.col("start").alias("from"), F.col("stop").alias("to"))
    near = ((F.col("from") <= F.col("stop") + scope) & (F.col("to") >= F.col("start") - scope)
            & (F.col("other") != F.col("role")))
    return (weak.join(around, ["event_id", "print", "bin"]).filter(near)
            .groupBy("event_id", "print", "kind", "start", "stop")
            .agg(F.count_distinct("other").alias("others")).filter("others = 2").drop("others"))


def find_secrets(activity: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Secrets in every event's whole text.

    ``activity`` needs ``event_id`` and ``text``; other columns are not read.
    Returns one row per input row: ``event_id``, the counts ``n_assign,
    n_access, n_hex``, and ``spans``, an array of (start, kind_no, stop, kind)
    in code points, by start and then kind, base kinds and linked weak ones.
    Matches of one kind never overlap, the leftmost wins, and a match that is
    too short is passed over; kinds may overlap. Null and empty texts have no
    spans; a null ``event_id`` is kept; repeated rows have the same result
    each; an empty table gives no rows.
    """
    work = Workspace(activity.sparkSession, "secrets")
    rows = activity.select(F.col("event_id").cast("long").alias("event_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("print", F.xxhash64("text"))

    def with_found(df: DataFrame, kinds: list[tuple]) -> DataFrame:
        return df.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"found_{k}")
                                for k, p, _, _ in kinds))

    base_rows = with_found(keyed, KINDS[:3])
    base = _spans(base_rows.filter(" or ".join(f"size(found_{k}) > 0" for k in BASE)), KINDS[:3])
    # A weak part needs an endpoint in its text, which few texts have: the other weak patterns run on those only.
    weak_rows = with_found(with_found(keyed.filter(F.contains("text", F.lit("://"))), KINDS[5:])
                           .filter("size(found_endpoint) > 0"), KINDS[3:5])
    weak = _spans(weak_rows, KINDS[3:])
    base = work.saved(base, "base")
    # The bare form also fits keys that a base kind has: those are parts already.
    base_ends = base.select("event_id", "print", F.col("start").alias("from"), F.col("stop").alias("to"))
    binned = lambda df, a, b: df.withColumn("bin", F.explode(F.sequence(
        F.floor(F.col(a) / scope), F.floor((F.col(b) - 1) / scope))))
    inside = (binned(weak.filter("kind = 'bare'"), "start", "stop")
              .join(binned(base_ends, "from", "to"), ["event_id", "print", "bin"])
              .filter("from < stop and to > start").select("event_id", "print", "kind", "start", "stop").distinct())
    weak = work.saved(weak.join(inside.withColumn("known", F.lit(True)),
                                ["event_id", "print", "kind", "start", "stop"], "left")
                      .filter("known is null").drop("known"), "weak")
    spans = base.unionByName(linked_weak(base.unionByName(weak), scope))
    number = F.create_map(*(F.lit(x) for n, k in enumerate(KINDS) for x in (k[0], n)))
    listed = (spans.groupBy("event_id", "print").agg(
        *(F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in BASE),
        F.array_sort(F.collect_list(F.struct("start", number[F.col("kind")].alias("kind_no"), "stop", "kind")))
        .alias("spans")))
    same = ((F.col("l.event_id").eqNullSafe(F.col("r.event_id"))) & (F.col("l.print") == F.col("r.print")))
    none = F.array().cast("array<struct<start:bigint,kind_no:int,stop:bigint,kind:string>>")
    return (keyed.select("event_id", "print").alias("l").join(listed.alias("r"), same, "left")
            .select("l.event_id", *(F.coalesce(f"r.n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE),
                    F.coalesce(F.col("r.spans"), none).alias("spans")))


def span_text(spans: Column) -> Column:
    """``kind:start:stop`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
