import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from hindcast.functions.text import search_terms
from hindcast.operators import transcript as T
from hindcast.plans import queries as Q, views as V

SHAPE = ("device string, chunk_ts timestamp, track string, seg_no int, start_ms long, end_ms long, text string")


def segments(spark, *rows):
    from datetime import datetime
    at = datetime(2024, 1, 1, 10)
    return spark.createDataFrame([("d", at, *r) for r in rows], SHAPE)


def noisy(spark, change):
    """Timed chunks whose microphone also holds a changed copy of each system segment."""
    base = (V.segments(spark, SMALL).filter(F.col("start_ms").isNotNull())
            .select("device", "chunk_ts", "track", "seg_no", "start_ms", "end_ms", "text"))
    system = base.filter("track = 'system'")
    copies = system.withColumns({"track": F.lit("mic"), "text": change(search_terms("text")), "seg_no": F.col("seg_no") + 100})
    return system.unionByName(copies)


@pytest.mark.parametrize("name,change,least", [
    ("verbatim", lambda w: F.array_join(w, " "), 1.0),
    ("every fifth word lost", lambda w: F.array_join(F.filter(w, lambda x, i: i % 5 != 4), " "), 1.0),
    ("every fourth word misheard", lambda w: F.array_join(F.transform(w, lambda x, i: F.when(
        i % 8 == 3, F.concat(x, F.lit("zzq"))).otherwise(x)), " "), 0.9),
])
def test_bleed_is_found_through_noise(spark, name, change, least):
    found = T.mic_coverage(noisy(spark, change)).filter("terms > 10")
    caught = found.agg(F.avg((F.col("coverage") >= T.BLEED_SHARE).cast("double"))).first()[0]
    assert caught >= least


def test_a_speaker_quoting_half_is_kept(spark):
    said = "one two three four five six seven eight nine ten"
    rows = segments(spark, ("system", 0, 0, 5000, said),
                    ("mic", 1, 1000, 6000, "one two three four five but i would rather disagree here"))
    kept = T.drop_bleed(rows).filter("track = 'mic'").first()
    assert kept["covered"] == 5 and kept["terms"] == 11


@pytest.mark.parametrize("shift,bleeds", [(5249, True), (5251, False), (-5250, True), (-5251, False)])
def test_overlap_tolerance(spark, shift, bleeds):
    rows = segments(spark, ("system", 0, 100_000, 105_000, "alpha beta"),
                    ("mic", 0, 100_000 + shift, 105_000 + shift, "alpha beta"))
    assert (T.drop_bleed(rows).filter("track = 'mic'").count() == 0) == bleeds


def test_overlap_reaches_across_time_slices(spark):
    rows = segments(spark, ("system", 0, 1_000, 200_000, "alpha beta"), ("system", 1, 100_000, 101_000, "alpha"),
                    ("mic", 2, 190_000, 195_000, "alpha beta"))
    assert T.drop_bleed(rows).filter("track = 'mic'").isEmpty()


def test_turn_pages_make_the_whole(spark):
    turns = T.turns_of(V.segments(spark, SMALL), V.envelopes(spark, SMALL)).cache()
    whole = [(r["ts"], r["device"], r["turn_no"]) for r in turns.orderBy("ts", "device", "turn_no").collect()]
    got, resume = [], None
    while True:
        page = T.page_turns(turns, max_turns=200, resume=resume)
        got += [(r["ts"], r["device"], r["turn_no"]) for r in page.rows.collect()]
        resume = page.info().first()["resume_from"]
        if resume is None:
            break
    assert got == whole
    tail = T.page_turns(turns, max_turns=30, latest=True).rows.collect()
    assert [(r["ts"], r["device"], r["turn_no"]) for r in tail] == whole[-30:]


def test_a_range_reads_the_same_turns_as_the_whole(spark):
    segs, env = V.segments(spark, SMALL), V.envelopes(spark, SMALL)
    since, until = "2024-01-02T03:00:00Z", "2024-01-02T20:00:00Z"
    part = T.get_transcript(segs, env, since=since, until=until, max_turns=1000).rows
    whole = T.page_turns(T.turns_of(segs, env), since=since, until=until, max_turns=1000).rows
    assert part.collect() == whole.collect() and part.count() > 20


def test_turns_keep_every_segment(spark):
    labelled = T.label_origin(V.segments(spark, SMALL), V.envelopes(spark, SMALL))
    assert T.build_turns(labelled, 20_000).agg(F.sum("segments")).first()[0] == labelled.count()


def test_the_clock_breaks_no_turn(spark):
    rows = segments(spark, *(("system", i, i * 4_000, i * 4_000 + 3_900, f"word{i}") for i in range(200)))
    turn = T.build_turns(T.label_origin(rows), 2_000).collect()
    assert len(turn) == 1 and turn[0]["segments"] == 200
    assert turn[0]["text"].split() == [f"word{i}" for i in range(200)]


def test_turns_at_one_time_are_told_apart(spark):
    rows = segments(spark, ("system", None, None, None, "a"), ("mic", None, None, None, "b c"), ("mic", 3, 0, 10, "d e"))
    turns = T.build_turns(T.label_origin(rows)).collect()
    assert sorted(t["turn_no"] for t in turns) == list(range(1, len(turns) + 1)) and len(turns) == 3


def test_words_decide_where_only_some_overlap(spark):
    def timed(track, *words):
        return (track, 0, 0, 20_000, " ".join(w for w, _ in words),
                [(w, at, at + 500, 1.0) for w, at in words])
    from datetime import datetime
    shape = SHAPE + ", words array<struct<w string, start_ms long, end_ms long, conf double>>"
    rows = spark.createDataFrame([("d", datetime(2024, 1, 1), *timed("system", ("one", 0), ("two", 1000), ("three", 2000))),
                                  ("d", datetime(2024, 1, 1), *timed("mic", ("one", 100), ("two", 1100), ("three", 15_000)))],
                                 shape)
    seen = T.mic_coverage(rows).first()
    assert (seen["terms"], seen["covered"]) == (3, 2)
    assert T.mic_coverage(rows.drop("words")).first()["covered"] == 3


def test_every_conversation_row_is_a_segment(spark):
    rows = V.table(spark, SMALL, "conversations")
    assert V.segments(spark, SMALL).select("device", "chunk_ts", "text").distinct().count() == (
        rows.withColumns(V._chunk_of("conv_id")).select("device", "chunk_ts", "text").distinct().count())


def test_a_turn_of_nine_hours_is_whole(spark, folder):
    """Read up to an instant in it, and stored by a backfill of its first day."""
    from datetime import date, datetime, timedelta

    from hindcast import schema
    from hindcast.sources.maintain import backfill_turns
    from hindcast.sources.tables import read_turns

    begin, rows = datetime(2024, 1, 1, 20), []
    for k in range(9 * 6):
        for seg in range(60):
            rows.append(("long", begin + timedelta(minutes=10 * k), "mic", seg, seg * 10_000, seg * 10_000 + 9_000,
                         f"w{k}x{seg}", None))
    rows.append(("long", begin + timedelta(hours=10), "mic", 0, 0, 5_000, "later", None))
    rows += [("short", begin + timedelta(minutes=m), "mic", 0, 0, 5_000, f"s{m}", None) for m in (0, 230, 250, 600)]
    segments = spark.createDataFrame(rows, schema.SEGMENTS)
    shown = ["device", "ts", "text", "segments"]
    whole = {tuple(r) for r in T.turns_of(segments).select(*shown).collect()}
    assert max(r[3] for r in whole) == 9 * 360
    until = datetime(2024, 1, 2)
    page = T.get_transcript(segments, until=until, max_text_chars=1 << 20, fields=shown)
    assert {tuple(r)[:4] for r in page.rows.collect()} == {r for r in whole if r[1] < until}
    assert T.reach(segments, None, until, T.TURN_GAP_MS) < timedelta(hours=20)
    backfill_turns(spark, segments, None, folder + "/turns", date(2024, 1, 1), date(2024, 1, 1))
    stored = read_turns(spark, folder + "/turns").select("device", "ts", "text")
    assert {tuple(r) for r in stored.collect()} == {r[:3] for r in whole if r[1] < until}


def test_a_text_is_not_split_anew_for_each_of_its_words(spark):
    """No array of words is made inside a lambda of its own making, as a filter inferred from an explode would do."""
    plan = Q.QUERIES["words"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(filter(split" not in plan


def test_words_of_odd_segments(spark):
    rows = segments(spark, ("mic", 1, 0, 5, "a b"), ("mic", 2, 0, 5, ""), ("mic", 3, 0, 5, None)).withColumn(
        "words", F.expr("case seg_no when 1 then array(named_struct('w', 'a', 'start_ms', 0L), null) when 2 then "
                        "array_remove(array(named_struct('w', 'a', 'start_ms', 0L)), named_struct('w', 'a', 'start_ms', 0L)) end"))
    got = T.words(rows).select("seg_no", "word_no", "w").orderBy("word_no").collect()
    assert [tuple(r) for r in got] == [(1, 0, "a"), (1, 1, None)]
