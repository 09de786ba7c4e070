"""Storage density: what to re-encode, whether a replacement is safe, which
rows to repoint, and repair of what an interrupted run left behind.

Encoding itself happens elsewhere and hands over a manifest
``replacements(old_path, new_path, new_bytes, medium, src_sample, dst_sample,
src_width, src_height, dst_width, dst_height, channels)``.
"""

from __future__ import annotations

import posixpath
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from hindcast.functions.signal import psnr
from hindcast.functions.timeparse import instant, parse_instant
from hindcast.operators.retention import EVENT, orphans

# Original extension -> compressed extension, per medium.
SCREEN_FORMATS = {"jpg": "heic", "jpeg": "heic"}
AUDIO_FORMATS = {"wav": "flac"}
DEFAULT_AGE = "48h"
MIN_PSNR = 30.0
HISTOGRAM_BINS = 16
HISTOGRAM_TOLERANCE = 0.05
# Counters of one pass.
STATUSES = ["already_done", "skipped", "missing_files", "encode_failed", "verify_failed",
            "flush_failed", "raced", "conflicted"]


class OutsideRoot(ValueError):
    """Indexed media lies outside the data directory."""


def extension(path: Column) -> Column:
    """What follows the last dot, lower-cased."""
    return F.lower(F.substring_index(path, ".", -1))


def _with_extension(path: Column, new: Column) -> Column:
    return F.concat(F.substr(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, ".", -1))), new)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    found = None
    for old, new in table.items():
        found = F.when(key == old, new) if found is None else found.when(key == old, new)
    return found


def target_path(path: Column) -> Column:
    """The compressed name of an original; null for other files."""
    return _with_extension(path, _lookup(extension(path), {**SCREEN_FORMATS, **AUDIO_FORMATS}))


def sibling_paths(path: Column) -> Column:
    """Names the same media may have in the other format."""
    swaps: dict[str, list[str]] = {}
    for old, new in {**SCREEN_FORMATS, **AUDIO_FORMATS}.items():
        swaps.setdefault(old, []).append(new)
        swaps.setdefault(new, []).append(old)
    found = None
    for ext, others in swaps.items():
        names = F.array(*[_with_extension(path, F.lit(o)) for o in others])
        found = (F.when(extension(path) == ext, names) if found is None
                 else found.when(extension(path) == ext, names))
    return found


def _medium(kind: Column) -> Column:
    return F.when(kind == "screen", "screens").otherwise("audio")


def claims(activity: DataFrame) -> DataFrame:
    """``name``: every file name an event will hold after compression and how
    many events hold it; only names held twice or more. A hot name shrinks
    map-side."""
    name = F.coalesce(target_path(F.col("media_path")), F.col("media_path"))
    return (activity.filter(F.col("media_path").isNotNull())
            .groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("holders"))
            .filter(F.col("holders") > 1))


def conflicts(activity: DataFrame) -> DataFrame:
    """Events whose compression would take another event's media along: two
    events naming one file, or a compressed name already held."""
    originals = activity.withColumn("target", target_path(F.col("media_path"))).filter(F.col("target").isNotNull())
    taken = claims(activity).select(F.col("name").alias("target"))
    return originals.join(taken, "target", "left_semi").select(*activity.columns, "target")


def plan_compress(activity: DataFrame, media: DataFrame, *, older_than: str | datetime = DEFAULT_AGE,
                  screens: bool = True, audio: bool = True, now: datetime | None = None) -> DataFrame:
    """One row per event with media: pass, target and status.

    Statuses: ``skipped`` (too recent, medium not chosen, or a format no pass
    handles), ``already_done``, ``conflicted``, ``missing_files``,
    ``candidate``.
    """
    cutoff = parse_instant(older_than, now)
    chosen = [m for m, on in (("screens", screens), ("audio", audio)) if on]
    rows = (activity.filter(F.col("media_path").isNotNull())
            .select("event_id", "device", "day", "ts", "kind", "media_path",
                    _medium(F.col("kind")).alias("pass"), target_path(F.col("media_path")).alias("target")))
    taken = claims(activity).select(F.col("name").alias("target"), F.lit(True).alias("_taken"))
    files = media.select(F.col("path").alias("media_path"), F.col("length").alias("bytes"))
    done = extension(F.col("media_path")).isin(sorted({*SCREEN_FORMATS.values(), *AUDIO_FORMATS.values()}))
    early = (F.when((F.col("ts") >= instant(activity, "ts", cutoff)) | ~F.col("pass").isin(chosen), "skipped")
             .when(done, "already_done").when(F.col("target").isNull(), "skipped"))
    rows = rows.withColumn("early", early)
    # Rows without a target are most of the table after the first run; only those still open are joined on it.
    open_rows = rows.filter(F.col("early").isNull()).join(taken, "target", "left")
    status = (F.when(F.col("early").isNotNull(), F.col("early"))
              .when(F.col("_taken"), "conflicted")
              .when(F.col("bytes").isNull(), "missing_files")
              .otherwise("candidate"))
    return (open_rows.unionByName(rows.filter(F.col("early").isNotNull()), allowMissingColumns=True)
            .join(files, "media_path", "left").withColumn("status", status)
            .select("event_id", "device", "day", "ts", "pass", "media_path", "target", "bytes", "status"))


def dry_run_report(plan: DataFrame) -> DataFrame:
    """Files a run would replace and their present bytes. No ratio: that needs the encode."""
    return (plan.filter(F.col("status") == "candidate").groupBy("pass")
            .agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")))


def clean_path(path: Column) -> Column:
    """``path`` without ``.`` and ``..`` steps, for comparison only."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(
        s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)))
    plain = ~(F.contains(path, F.lit("/.")) | F.contains(path, F.lit("//")))
    return F.when(plain, path).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def outside_root(activity: DataFrame, root: str) -> DataFrame:
    """One row: how many events name media outside ``root``'s media
    directories, and one example."""
    base = posixpath.normpath(root)
    inside = F.lit(False)
    for directory in ("screenshots", "audio"):
        inside = inside | F.startswith(clean_path(F.col("media_path")), F.lit(f"{base}/{directory}/"))
    return (activity.filter(F.col("media_path").isNotNull() & ~inside)
            .agg(F.count(F.lit(1)).alias("outside"), F.min("media_path").alias("example")))


def guard_root(activity: DataFrame, root: str) -> None:
    """Refuse the whole run if any event names media outside ``root``."""
    found = outside_root(activity, root).first()
    if found["outside"]:
        raise OutsideRoot(f"{found['outside']} events name media outside {root} (for example "
                          f"{found['example']}); nothing was changed")


def verify_audio(manifest: DataFrame) -> DataFrame:
    """``verified``: sample for sample equal."""
    same = F.col("src_sample") == F.col("dst_sample")
    return manifest.withColumn("verified", F.coalesce(same, F.lit(False)))


def histogram_distance(manifest: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``hist_l1``: L1 distance between colour histograms, the largest over the
    channels; null without samples. Samples interleave their channels. Array
    functions only: a frame stays in its row, and no batch of frames is copied."""
    channels = F.greatest(F.coalesce("channels", F.lit(1)), F.lit(1))

    def binned(samples: str, channel: Column) -> Column:
        own = F.filter(samples, lambda v, i: i % channels == channel)
        return F.transform(own, lambda v: F.least(F.greatest(F.floor(v * bins / 256), F.lit(0)), F.lit(bins - 1)))

    def share(values: Column, k: Column) -> Column:
        return F.size(F.filter(values, lambda v: v == k)) / F.greatest(F.size(values), F.lit(1))

    def distance(pair: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0.0),
                           lambda acc, k: acc + F.abs(share(pair["a"], k) - share(pair["b"], k)))

    # The pair is a lambda variable, so that its bins are made once and not for every count.
    each = F.transform(F.sequence(F.lit(0), channels - 1), lambda c: F.struct(
        binned("src_sample", c).alias("a"), binned("dst_sample", c).alias("b")))
    some = (F.size("src_sample") > 0) & (F.size("dst_sample") > 0)
    return manifest.withColumn("hist_l1", F.when(some, F.array_max(F.transform(each, distance))))


def verify_images(manifest: DataFrame, min_psnr: float = MIN_PSNR,
                  hist_tolerance: float = HISTOGRAM_TOLERANCE) -> DataFrame:
    """Three independent checks, all of which must hold: equal dimensions, PSNR
    and colour histogram."""
    checked = histogram_distance(manifest).withColumns({
        "psnr": psnr(F.col("src_sample"), F.col("dst_sample")),
        "same_size": (F.col("src_width") == F.col("dst_width")) & (F.col("src_height") == F.col("dst_height")),
    })
    ok = F.col("same_size") & (F.col("psnr") >= min_psnr) & (F.col("hist_l1") <= hist_tolerance)
    return checked.withColumn("verified", F.coalesce(ok, F.lit(False)))


def verify(manifest: DataFrame, min_psnr: float = MIN_PSNR) -> DataFrame:
    """(old_path, new_path, new_bytes, medium, verified) for both media."""
    keep = ["old_path", "new_path", "new_bytes", "medium", "verified"]
    images = verify_images(manifest.filter(F.col("medium") == "screens"), min_psnr)
    audio = verify_audio(manifest.filter(F.col("medium") == "audio"))
    return images.select(*keep).unionByName(audio.select(*keep))


def settle(plan: DataFrame, current: DataFrame, verified: DataFrame) -> DataFrame:
    """The plan with its final status per row.

    A candidate whose row no longer names the planned file is ``raced``; one
    without a manifest entry ``encode_failed``; one with a failed check
    ``verify_failed``; the rest are ``replaced`` and carry ``new_path`` and
    ``new_bytes``. Originals of all but the last stay untouched.
    """
    now_named = current.select(*EVENT, F.col("media_path").alias("_now"))
    made = verified.select(F.col("old_path").alias("media_path"), "new_path", "new_bytes", "verified")
    wanted = F.col("status") == "candidate"
    status = (F.when(~wanted, F.col("status"))
              .when(F.coalesce(F.col("_now") != F.col("media_path"), F.lit(True)), "raced")
              .when(F.col("verified").isNull(), "encode_failed")
              .when(~F.col("verified"), "verify_failed")
              .otherwise("replaced"))
    done = F.col("status") == "replaced"
    return (plan.join(now_named, EVENT, "left").join(made, "media_path", "left")
            .withColumn("status", status)
            .withColumns({"new_path": F.when(done, F.col("new_path")),
                          "new_bytes": F.when(done, F.col("new_bytes"))})
            .drop("_now", "verified"))


def flushed(settled: DataFrame, inventory: DataFrame) -> DataFrame:
    """``settled`` with ``flush_failed`` where the replacement is not on disk."""
    there = inventory.select(F.col("path").alias("new_path"), F.lit(True).alias("_there")).distinct()
    lost = (F.col("status") == "replaced") & F.col("_there").isNull()
    joined = settled.join(there, "new_path", "left")
    return joined.withColumns({
        "status": F.when(lost, "flush_failed").otherwise(F.col("status")),
        "new_path": F.when(~lost, F.col("new_path")),
        "new_bytes": F.when(~lost, F.col("new_bytes"))}).select(*settled.columns)


def repoint(activity: DataFrame, settled: DataFrame) -> DataFrame:
    """Events with replaced media named by their new path and size."""
    made = (settled.filter(F.col("status") == "replaced")
            .select(*EVENT, F.col("media_path").alias("_old"), F.col("new_path").alias("_path"),
                    F.col("new_bytes").alias("_bytes")))
    ours = F.col("_old") == F.col("media_path")
    return (activity.join(made, EVENT, "left")
            .withColumns({"media_bytes": F.when(ours, F.col("_bytes")).otherwise(F.col("media_bytes")),
                          "media_path": F.when(ours, F.col("_path")).otherwise(F.col("media_path"))})
            .select(*activity.columns))


def reconcile(activity: DataFrame, media: DataFrame) -> DataFrame:
    """Repairs after an interrupted run: (action, device, event_id, path, sibling, bytes).

    Only an unreferenced file whose other-format sibling is named by a row is
    touched. ``remove``: the row's own file is there, so ``path`` is left over.
    ``adopt``: the row's file is gone and ``path`` is what survives.
    """
    named = activity.filter(F.col("media_path").isNotNull())
    loose = orphans(media, named).select("path", "length")
    present = media.select(F.col("path").alias("media_path"), F.lit(True).alias("_present"))
    stray = (named.select(*EVENT, "media_path",
                          F.explode(sibling_paths(F.col("media_path"))).alias("path"))
             .join(loose, "path")
             .join(present, "media_path", "left"))
    action = F.when(F.col("_present"), "remove").otherwise("adopt")
    return stray.select(action.alias("action"), *EVENT, "path", F.col("media_path").alias("sibling"),
                        F.col("length").alias("bytes"))


def leftovers(repairs: DataFrame) -> DataFrame:
    """Files to remove, each once."""
    return (repairs.filter(F.col("action") == "remove")
            .groupBy("path").agg(F.max("bytes").alias("bytes")))


def adopt(activity: DataFrame, repairs: DataFrame) -> DataFrame:
    """Events whose original is gone, repointed to the surviving file."""
    kept = (repairs.filter(F.col("action") == "adopt")
            .groupBy(*EVENT).agg(F.max_by(F.struct("path", "bytes"), "path").alias("_kept")))
    return (activity.join(kept, EVENT, "left")
            .withColumns({"media_path": F.coalesce(F.col("_kept.path"), F.col("media_path")),
                          "media_bytes": F.coalesce(F.col("_kept.bytes"), F.col("media_bytes"))})
            .select(*activity.columns))


def compress_report(settled: DataFrame) -> DataFrame:
    """Counters per pass, in one aggregation."""
    replaced = F.col("status") == "replaced"
    return settled.groupBy("pass").agg(
        F.count_if(replaced).alias("files"),
        F.coalesce(F.sum(F.when(replaced, F.col("bytes"))), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum(F.when(replaced, F.col("new_bytes"))), F.lit(0)).alias("bytes_after"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def reconcile_report(repairs: DataFrame) -> DataFrame:
    """One row: leftover files and bytes removed, events recovered."""
    gone = leftovers(repairs).agg(F.count(F.lit(1)).alias("removed_files"),
                                  F.coalesce(F.sum("bytes"), F.lit(0)).alias("removed_bytes"))
    recovered = repairs.filter(F.col("action") == "adopt").agg(F.count_distinct(*EVENT)).scalar()
    return gone.withColumn("recovered_events", recovered)


def savings(settled: DataFrame) -> DataFrame:
    """Bytes before and after, and their ratio, per medium."""
    done = settled.filter(F.col("status") == "replaced")
    return (done.groupBy("pass")
            .agg(F.sum("bytes").alias("bytes_before"), F.sum("new_bytes").alias("bytes_after"))
            .withColumn("ratio", F.round(F.when(
                F.col("bytes_after") > 0, F.col("bytes_before") / F.col("bytes_after")), 6)))


def rebase_paths(activity: DataFrame, old_root: str, new_root: str) -> DataFrame:
    """Media paths of a copied index moved from one root to another, prefix only."""
    old, new = posixpath.normpath(old_root), posixpath.normpath(new_root)
    inside = F.startswith("media_path", F.lit(old + "/"))
    return activity.withColumn("media_path", F.when(
        inside, F.concat(F.lit(new), F.substr("media_path", F.lit(len(old) + 1))))
        .otherwise(F.col("media_path")))
