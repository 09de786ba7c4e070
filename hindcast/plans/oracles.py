"""DuckDB SQL for the registered queries, on the same Parquet tables.

``VIEWS`` restates the derivations of ``views.py``; ``ORACLES`` the queries.
"""

from __future__ import annotations

from hindcast.plans import queries as q

TERMS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
PRINT = "md5(trim(regexp_replace(lower(coalesce(text, '')), '[ \\t\\n\\r\\f]+', ' ', 'g')))"
TOLD = "kind = 'screen' AND length(trim(text)) > 0"  # without text nothing says what a frame showed
RANGE = "ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-20 16:30:00'"
CHUNK = "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({0} * 10 AS INTEGER))"
IN_TERMS = ", ".join(f"'{t}'" for t in q.TERMS)


def swapped(path: str) -> str:
    return (f"CASE WHEN {path} LIKE '%.jpg' THEN replace({path}, '.jpg', '.heic') "
            f"WHEN {path} LIKE '%.wav' THEN replace({path}, '.wav', '.flac') END")


VIEWS = {
    "events1": f"""
        SELECT event_id, CAST(user_id AS VARCHAR) AS device, ts, CAST(ts AS DATE) AS day,
          CASE WHEN event_id % 4 <> 0 THEN 'screen' ELSE 'audio' END AS kind,
          CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 8 = 0 THEN 'system' ELSE 'mic' END END AS track,
          CASE WHEN event_id % 4 <> 0 THEN 'd' || (event_id % 3) END AS display_id,
          event_type AS app,
          CASE WHEN event_id % 4 <> 0 THEN '/data/screenshots/' || event_id || '.jpg'
               ELSE '/data/audio/' || event_id || '.wav' END AS media_path,
          CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000 AS media_bytes
        FROM events""",
    "activity": """
        SELECT e.*, CASE WHEN event_id % 10 = 0 THEN upper(app) ELSE d.source END AS "window",
          CASE WHEN event_id % 17 <> 0 THEN d.text END AS text
        FROM events1 e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)""",
    "docs": 'SELECT doc_id AS event_id, source AS app, lang AS "window", text FROM documents',
    "docterms": f"SELECT event_id, {TERMS} AS terms FROM docs",
    "postings": """
        SELECT term, event_id, count(*) AS tf, max(dl) AS dl
        FROM (SELECT event_id, unnest(terms) AS term, len(terms) AS dl FROM docterms)
        GROUP BY term, event_id""",
    "turns0": f"""
        SELECT conv_id, 'm' || (conv_id % 4) AS device, {CHUNK.format('conv_id')} AS chunk_ts, role, text,
          CAST(turn AS INTEGER) AS turn, turn * 10000 AS start0 FROM conversations""",
    "segments": """
        SELECT device, chunk_ts, track, CASE WHEN conv_id % 5 <> 2 THEN turn END AS seg_no,
          CASE WHEN conv_id % 5 NOT IN (1, 2) THEN s END AS start_ms,
          CASE WHEN conv_id % 5 NOT IN (1, 2) THEN s + 5000 END AS end_ms, text
        FROM (
          SELECT *, 'system' AS track, start0 AS s FROM turns0 WHERE role <> 'user' AND conv_id % 7 <> 3
          UNION ALL SELECT *, 'mic', start0 FROM turns0 WHERE role = 'user'
            OR (conv_id % 7 = 3 AND NOT (role = 'assistant' AND conv_id % 3 = 0))
          UNION ALL SELECT *, 'mic', start0 + 40 FROM turns0 WHERE role = 'assistant' AND conv_id % 3 = 0)""",
    "envelopes": f"""
        SELECT 'm' || (vec_id % 4) AS device, {CHUNK.format('vec_id')} AS chunk_ts, 'system' AS track,
          1250 AS step_ms,
          list_transform(embedding, lambda x: CASE WHEN vec_id % 10 = 0 THEN 0.0::DOUBLE ELSE abs(x::DOUBLE) END) AS rms
        FROM embeddings""",
    "media": f"""
        SELECT path, length FROM (
          SELECT event_id, CASE WHEN event_id % 20 IN (3, 8) THEN {swapped('media_path')} ELSE media_path END AS path,
            media_bytes AS length FROM events1 WHERE event_id % 20 NOT IN (7, 16)
          UNION ALL SELECT event_id, {swapped('media_path')}, media_bytes // 2 FROM events1
            WHERE event_id % 20 IN (5, 12, 7, 16)) WHERE event_id % 50 <> 0
        UNION ALL SELECT '/data/screenshots/x' || event_id || '.jpg', 500 FROM events1 WHERE event_id % 100 = 1""",
    "stored": f"""
        SELECT * REPLACE (CASE WHEN event_id % 20 IN (3, 8) THEN {swapped('media_path')}
          WHEN event_id % 200 = 14 THEN '/data/screenshots/' || (event_id - 1) || '.jpg'
          ELSE media_path END AS media_path) FROM events1""",
    "scaled": """
        SELECT vec_id, label, list_transform(embedding, lambda x:
          CAST(floor(greatest(0.0, least(255.0, 128 + 300 * x::DOUBLE))) AS INTEGER)) AS src FROM embeddings""",
    "manifest": f"""
        SELECT *, {swapped('old_path')} AS new_path FROM (
          SELECT vec_id, label, CASE WHEN vec_id % 4 = 0 THEN 'audio' ELSE 'screens' END AS medium,
            CASE WHEN vec_id % 4 = 0 THEN '/data/audio/' || vec_id || '.wav'
                 ELSE '/data/screenshots/' || vec_id || '.jpg' END AS old_path,
            300 AS new_bytes, src,
            CASE WHEN label < 5 THEN src
                 WHEN label < 8 THEN list_transform(src, lambda x, i: x + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END)
                 WHEN label = 8 THEN list_transform(src, lambda x: CAST(floor(x / 64) * 64 AS INTEGER))
                 ELSE list_reverse(src) END AS dst,
            vec_id % 25 <> 1 AS same_size
          FROM scaled)""",
    "dwells": """
        SELECT *, CASE WHEN lead(ts) OVER w IS NULL THEN 0
          ELSE least(epoch_us(lead(ts) OVER w) - epoch_us(ts), 300000000) END AS us
        FROM {source} WINDOW w AS (PARTITION BY device ORDER BY ts, event_id)""",
    "folded": f"""
        SELECT * FROM (
          SELECT *, count(*) OVER g AS similar_count, min(ts) OVER g AS first_ts, max(ts) OVER g AS last_ts,
            row_number() OVER (g ORDER BY ts DESC, event_id DESC) AS place
          FROM (SELECT *, CASE WHEN {TOLD} THEN {PRINT} ELSE 'e' || event_id END AS print FROM activity)
          WINDOW g AS (PARTITION BY device, kind, app, "window", print)) WHERE place = 1""",
}

SHOWN = ('event_id, ts, device, kind, app, "window", similar_count, first_ts, last_ts, '
         "substring(text, 1, 600) AS text, length(text) AS text_len, coalesce(length(text) > 600, false) AS truncated")


KEPT, ONCE = "MATERIALIZED ", ("shingles", "edges")  # read by a recursion, which would run them again each round


def sql(body: str, *views: str, **named: str) -> str:
    parts = [f"{v} AS ({VIEWS[v]})" for v in views] + [f"{n} AS {KEPT if n in ONCE else ''}({t})" for n, t in named.items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def hit(term: str) -> str:
    return f"instr(' ' || regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', ' ', 'g') || ' ', ' {term} ')"


def cut(terms: list[str], cap: int = 600) -> str:
    hits = f"coalesce(list_min(list_filter([{', '.join(hit(t) for t in terms)}], lambda p: p > 0)), 0)"
    return f"substring(text, greatest(1, least({hits} - {cap // 2}, length(text) - {cap} + 1)), {cap})"


def scores(source: str) -> str:
    """BM25 of the rows of ``source`` (event_id, terms), statistics over all of them."""
    return f"""
        SELECT event_id, sum(h) AS matched, round(sum(s), 6) AS score FROM (
          SELECT event_id, CASE WHEN tf > 0 THEN 1 ELSE 0 END AS h,
            ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl)) AS s
          FROM (SELECT *, sum(CASE WHEN tf > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY term) AS df,
                  count(*) OVER (PARTITION BY term) AS n, avg(dl) OVER (PARTITION BY term) AS avg_dl
                FROM (SELECT event_id, term, len(terms) AS dl, len(list_filter(terms, lambda x: x = term)) AS tf
                      FROM (SELECT * FROM {source} WHERE len(terms) > 0),
                           (SELECT unnest([{IN_TERMS}]) AS term)))
          WHERE tf > 0) GROUP BY event_id"""


ORACLES: dict[str, str] = {
    # ingest and sources
    "event_scan": sql(f"SELECT * FROM events1 WHERE {RANGE}", "events1"),
    "storage_stats": sql("""SELECT kind, count(*) AS events, CAST(sum(media_bytes) AS BIGINT) AS media_bytes,
        min(ts) AS first_ts, max(ts) AS last_ts FROM events1 GROUP BY ROLLUP (kind)""", "events1"),
    "media_store_stats": sql("""SELECT store, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM
        (SELECT string_split(path, '/')[-2] AS store, length FROM media) GROUP BY ROLLUP (store)""",
                             "events1", "media"),
    "clean_titles": sql("""SELECT event_id, app, CASE WHEN lower(trim("window")) = lower(trim(app)) THEN NULL
        ELSE "window" END AS "window" FROM activity""", "events1", "activity"),
    "clean_text": sql("""SELECT event_id, "window", CASE WHEN event_id % 3 = 0 THEN NULL
        WHEN lower(trim(text)) = lower(trim("window")) THEN NULL ELSE text END AS text FROM activity""",
                      "events1", "activity"),
    "upsert_new_events": sql("SELECT * FROM events1 WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'", "events1"),
    "select_displays": sql("""SELECT event_id, device, ts, display_id FROM (
          SELECT *, bool_or(coalesce(display_id IN ('view', 'click'), false))
              OVER (PARTITION BY device, date_trunc('hour', ts)) AS hit
          FROM (SELECT * REPLACE (CASE WHEN kind = 'screen' THEN app END AS display_id) FROM events1))
        WHERE display_id IS NULL OR NOT hit OR display_id IN ('view', 'click')""", "events1"),
    "select_sources": sql("SELECT event_id, kind, track FROM events1 WHERE kind = 'audio' AND track = 'mic'", "events1"),
    "mark_silent": sql("SELECT device, chunk_ts, track, list_max(rms) <= 0 AS silent FROM envelopes", "envelopes"),
    "drop_silent": sql("""SELECT device, chunk_ts, track, seg_no, start_ms, text FROM segments s WHERE NOT EXISTS (
        SELECT 1 FROM envelopes e WHERE e.device = s.device AND e.chunk_ts = s.chunk_ts AND e.track = s.track
        AND list_max(e.rms) <= 0)""", "turns0", "segments", "envelopes"),
    # filters and projections
    "filter_kind": sql("""SELECT event_id, kind, app, "window" FROM activity WHERE kind = 'audio'""", "events1", "activity"),
    "filter_app": sql("""SELECT event_id, kind, app, "window" FROM activity WHERE lower(app) = 'view'""", "events1", "activity"),
    "search_window_sub": sql("""SELECT event_id, kind, app, "window" FROM activity
        WHERE contains(lower("window"), 'rc1')""", "events1", "activity"),
    "search_time_range": sql(f'SELECT event_id, ts, app, "window" FROM activity WHERE {RANGE}', "events1", "activity"),
    "search_since_duration": sql("SELECT event_id, ts, app FROM activity WHERE ts >= TIMESTAMP '2024-01-29 11:30:00'",
                                 "events1", "activity"),
    "search_require_text": sql('SELECT event_id, app, "window" FROM activity WHERE length(trim(text)) > 0',
                               "events1", "activity"),
    "get_event": sql('SELECT event_id, ts, app, "window", media_path, text FROM activity WHERE event_id = 77',
                     "events1", "activity"),
    "get_events_bulk": sql("""SELECT event_id, ts, app, "window", text FROM activity
        WHERE event_id IN (SELECT doc_id FROM labels)""", "events1", "activity"),
    "cap_text": sql("""SELECT event_id, substring(text, 1, 600) AS text, length(text) AS text_len,
        coalesce(length(text) > 600, false) AS truncated FROM activity""", "events1", "activity"),
    "search_excerpt": sql(f"""SELECT event_id, {cut(q.TERMS)} AS text, length(text) AS text_len,
        length(text) > 600 AS truncated FROM docs""", "docs"),
    # search
    "terms_df": sql("SELECT term, CAST(sum(tf) AS BIGINT) AS uses FROM postings GROUP BY term", "docs", "docterms", "postings"),
    "postings_build": sql("SELECT * FROM postings", "docs", "docterms", "postings"),
    "postings_update": sql("""SELECT p.* FROM postings p JOIN docs d USING (event_id) WHERE d.app <> 'src3'""",
                           "docs", "docterms", "postings"),
    "corpus_stats": sql("""SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS total_dl FROM docterms
        WHERE len(terms) > 0""", "docs", "docterms"),
    "search_all": sql(f"""SELECT event_id, count(*) AS matched FROM postings
        WHERE term IN ('{q.TERMS[0]}', '{q.TERMS[1]}') GROUP BY event_id HAVING count(*) = 2""",
                      "docs", "docterms", "postings"),
    "search_any": sql(f"SELECT event_id, count(*) AS matched FROM postings WHERE term IN ({IN_TERMS}) GROUP BY event_id",
                      "docs", "docterms", "postings"),
    "search_ranked": sql("SELECT event_id, CAST(matched AS BIGINT) AS matched, score FROM scored",
                         "docs", "docterms", scored=scores("docterms")),
    "search_ranked_scan": sql("SELECT event_id, score FROM scored", "docs", "docterms", scored=scores("docterms")),
    "search_newest": sql(f"SELECT {SHOWN} FROM folded ORDER BY ts DESC, event_id DESC LIMIT 20",
                         "events1", "activity", "folded"),
    "search_kind_app": sql(f"""SELECT {SHOWN} FROM folded WHERE kind = 'screen' AND app = 'error'
        ORDER BY ts DESC, event_id DESC LIMIT 50""", "events1", "activity", "folded"),
    "search_page2_keyset": sql(f"""SELECT {SHOWN} FROM folded WHERE kind = 'screen'
        ORDER BY ts DESC, event_id DESC LIMIT 30 OFFSET 30""", "events1", "activity", "folded"),
    "search_expanded": sql("""SELECT event_id, ts, device, kind, app, "window", CAST(1 AS BIGINT) AS similar_count,
          ts AS first_ts, ts AS last_ts, substring(text, 1, 600) AS text, length(text) AS text_len,
          coalesce(length(text) > 600, false) AS truncated
        FROM activity ORDER BY ts DESC, event_id DESC LIMIT 500""", "events1", "activity"),
    "page_info": sql("""
        SELECT 'full' AS case_name, 25 AS returned, true AS has_more,
          (SELECT min(ts) FROM (SELECT ts FROM folded ORDER BY ts DESC, event_id DESC LIMIT 25)) AS oldest_ts,
          'page is full, more results exist' AS notice, true AS has_cursor
        UNION ALL SELECT 'none', 0, false, NULL, 'no row matches the filters', false
        UNION ALL SELECT 'few', CAST(count(*) AS INTEGER), false, min(ts),
          CASE WHEN count(*) = 0 THEN 'no row matches the filters' END, false
          FROM folded_few WHERE ts >= TIMESTAMP '2024-01-01 23:40:00' AND ts < TIMESTAMP '2024-01-02'""",
                     "events1", "activity", "folded",
                     folded_few=f"""SELECT max(ts) AS ts FROM activity
          WHERE ts >= TIMESTAMP '2024-01-01 23:40:00' AND ts < TIMESTAMP '2024-01-02'
          GROUP BY device, kind, app, "window", CASE WHEN {TOLD} THEN {PRINT} ELSE 'e' || event_id END"""),
    "search_fold": sql("""SELECT device, kind, app, "window", event_id, ts, similar_count, first_ts, last_ts
        FROM folded""", "events1", "activity", "folded"),
    "fold_across_apps": sql(f"""SELECT max(event_id) AS event_id, count(*) AS similar_count,
          TIMESTAMP '2024-01-01' + to_seconds(min(event_id)) AS first_ts,
          TIMESTAMP '2024-01-01' + to_seconds(max(event_id)) AS last_ts
        FROM (SELECT event_id, {PRINT} AS print FROM docs) GROUP BY print""", "docs"),
    "fingerprints": sql(f"SELECT event_id, {PRINT} AS print FROM docs", "docs"),
    # listings
    "list_apps": sql("""SELECT app, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM events1
        GROUP BY app""", "events1"),
    "list_windows": sql("""SELECT "window", count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM activity
        WHERE lower(app) = 'click' AND ts >= TIMESTAMP '2024-01-10 06:00:00' GROUP BY "window" """, "events1", "activity"),
    "app_time": sql("SELECT app, count(*) AS events, CAST(sum(us) AS BIGINT) AS dwell_us FROM dwells GROUP BY app",
                    "events1", dwells=VIEWS["dwells"].format(source="events1")),
    "app_time_range": sql("SELECT app, count(*) AS events, CAST(sum(us) AS BIGINT) AS dwell_us FROM dwells GROUP BY app",
                          "events1", dwells=VIEWS["dwells"].format(source=f"(SELECT * FROM events1 WHERE {RANGE})")
                          .replace("300000000", "14400000000")),
    "timeline": sql("""SELECT date_trunc('hour', ts) AS bucket_start, app, count(*) AS events FROM events1
        GROUP BY ALL""", "events1"),
    "sessions": sql("""
        SELECT device, CAST(session_no AS BIGINT) AS session_no, min(ts) AS session_start, max(ts) AS session_end,
          count(*) AS events
        FROM (SELECT *, sum(fresh) OVER (PARTITION BY device ORDER BY ts, event_id) AS session_no FROM (
          SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY device ORDER BY ts, event_id))
            <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events1)) GROUP BY device, session_no""", "events1"),
    "digest_topk": sql("""
        SELECT day, app, app_us, app_events, place, "window", dwell_us, events FROM (
          SELECT *, CAST(sum(dwell_us) OVER (PARTITION BY day, app) AS BIGINT) AS app_us,
            CAST(sum(events) OVER (PARTITION BY day, app) AS BIGINT) AS app_events,
            CAST(row_number() OVER (PARTITION BY day, app ORDER BY dwell_us DESC, "window") AS INTEGER) AS place
          FROM (SELECT day, app, "window", CAST(sum(us) AS BIGINT) AS dwell_us, count(*) AS events
                FROM dwells GROUP BY ALL)) WHERE place <= 3""", "events1", "activity",
                       dwells=VIEWS["dwells"].format(source="""(SELECT * FROM activity WHERE
          ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15')""")),
    "active_displays": sql("""SELECT device, count(DISTINCT display_id) AS displays FROM events1
        WHERE ts >= TIMESTAMP '2024-01-21' AND display_id IS NOT NULL GROUP BY device""", "events1"),
}

PAGE = f"""
    SELECT event_id, ts, device, kind, app, "window", CAST(similar_count AS BIGINT) AS similar_count, first_ts, last_ts,
      {cut(q.TERMS)} AS text, length(text) AS text_len, coalesce(length(text) > 600, false) AS truncated, score
    FROM (SELECT *, count(*) OVER g AS similar_count, min(ts) OVER g AS first_ts, max(ts) OVER g AS last_ts,
            row_number() OVER (g ORDER BY score DESC, ts DESC, event_id DESC) AS place
          FROM (SELECT a.*, s.score, CASE WHEN {TOLD} THEN {PRINT} ELSE 'e' || a.event_id END AS print
                FROM activity a JOIN scored s USING (event_id) WHERE {RANGE})
          WINDOW g AS (PARTITION BY device, kind, app, "window", print)) WHERE place = 1
    ORDER BY score DESC, ts DESC, event_id DESC LIMIT 40"""
RANKED = {"scored": scores("actterms")}
ACTTERMS = f"SELECT event_id, {TERMS} AS terms FROM activity WHERE text IS NOT NULL"
ORACLES["search_relevance"] = sql(PAGE, "events1", "activity", actterms=ACTTERMS, **RANKED)
ORACLES["search_offset"] = sql(PAGE + " OFFSET 40", "events1", "activity", actterms=ACTTERMS, **RANKED)

# transcript
FAR = 1 << 52
SEG_VIEWS = ("turns0", "segments", "envelopes")
SPOKEN = {
    "timed": f"""SELECT * EXCLUDE (i), terms[i] AS w, coalesce(start_ms + (i - 1) * (5000 // len(terms)), -{FAR}) AS a,
        coalesce(start_ms + i * (5000 // len(terms)), {FAR}) AS b
        FROM (SELECT *, unnest(range(1, len(terms) + 1)) AS i FROM (SELECT *, {TERMS} AS terms FROM segments))""",
    "sysw": "SELECT DISTINCT device, chunk_ts, a, b, w FROM timed WHERE track = 'system'",
    "micw": """SELECT DISTINCT m.device, m.chunk_ts, m.seg_no, m.start_ms, m.text, m.w, m.a, m.b, EXISTS (
          SELECT 1 FROM sysw s WHERE s.device = m.device AND s.chunk_ts = m.chunk_ts AND s.w = m.w
          AND s.a - 250 <= m.b AND s.b + 250 >= m.a) AS said FROM timed m WHERE track = 'mic'""",
    "cover": """SELECT device, chunk_ts, seg_no, start_ms, text, count(DISTINCT w) AS terms,
          count(DISTINCT w) FILTER (said) AS covered FROM micw GROUP BY ALL""",
    "mics": """SELECT s.*, coalesce(c.terms, 0) AS terms, CAST(coalesce(c.covered, 0) AS BIGINT) AS covered,
          coalesce(c.covered / c.terms, 0.0) AS coverage
        FROM segments s LEFT JOIN cover c ON c.device = s.device AND c.chunk_ts = s.chunk_ts
          AND c.seg_no IS NOT DISTINCT FROM s.seg_no AND c.start_ms IS NOT DISTINCT FROM s.start_ms
          AND c.text = s.text WHERE s.track = 'mic'""",
}


def ratio(rms: str) -> str:
    return (f"CASE WHEN len({rms}) > 0 THEN len(list_filter({rms}, lambda x: x > 0.05)) / len({rms}) ELSE 0.0 END")


HEARD = """list_slice(e.rms, CAST(coalesce(floor(s.start_ms / e.step_ms), 0) AS INTEGER) + 1,
    CAST(coalesce(ceil(s.end_ms / e.step_ms), len(e.rms)) AS INTEGER))"""
LABELS = {
    **SPOKEN,
    "has_system": "SELECT DISTINCT device, chunk_ts FROM segments WHERE track = 'system'",
    "untold": "SELECT * FROM envelopes WHERE (device, chunk_ts) NOT IN (SELECT (device, chunk_ts) FROM has_system)",
    "heard": f"""SELECT s.*, coalesce({ratio('span')}, 0.0) AS energy_ratio FROM (
        SELECT s.*, {HEARD} AS span FROM mics s LEFT JOIN untold e ON e.device = s.device AND e.chunk_ts = s.chunk_ts
        WHERE s.coverage < 0.8) s""",
    "labelled": f"""
        SELECT *, CASE WHEN start_ms IS NOT NULL THEN 'exact' WHEN seg_no IS NOT NULL THEN 'sequence'
          ELSE 'approximate' END AS order_confidence FROM (
        SELECT device, chunk_ts, track, seg_no, start_ms, end_ms, text, 'internal' AS origin, 1.0::DOUBLE AS confidence
          FROM segments WHERE track = 'system'
        UNION ALL SELECT device, chunk_ts, track, seg_no, start_ms, end_ms, text,
          CASE WHEN energy_ratio >= 0.5 THEN 'unknown' ELSE 'external' END,
          CASE WHEN energy_ratio >= 0.5 THEN energy_ratio ELSE 1 - coverage END FROM heard
        UNION ALL SELECT device, chunk_ts, track, NULL, NULL, NULL, NULL, 'unknown', {ratio('rms')} FROM untold
          WHERE {ratio('rms')} >= 0.5
          AND (device, chunk_ts) NOT IN (SELECT (device, chunk_ts) FROM segments))""",
}


def turns(gap_ms: int) -> dict[str, str]:
    return {
        **LABELS,
        "placed": """SELECT *, epoch_us(chunk_ts) + coalesce(start_ms, 0) * 1000 AS at_us,
            epoch_us(chunk_ts) + coalesce(end_ms, start_ms, 0) * 1000 AS til,
            coalesce(seg_no, 2147483647) AS seg, coalesce(text, '') AS said FROM labelled""",
        "islands": f"""SELECT *, sum(fresh) OVER (PARTITION BY device ORDER BY at_us, chunk_ts, seg, track, said
              ROWS UNBOUNDED PRECEDING) AS part FROM (
            SELECT *, CASE WHEN lag(origin) OVER w = origin AND lag(order_confidence) OVER w = order_confidence
              AND at_us - lag(til) OVER w <= {gap_ms * 1000} THEN 0 ELSE 1 END AS fresh
            FROM placed WINDOW w AS (PARTITION BY device ORDER BY at_us, chunk_ts, seg, track, said))""",
        "turns": """SELECT device, make_timestamp(at_us) AS ts, CAST(make_timestamp(at_us) AS DATE) AS day,
              row_number() OVER (PARTITION BY device, at_us ORDER BY part) AS turn_no,
              origin, text, length(text) AS text_len, segments, round(confidence, 6) AS confidence, order_confidence
            FROM (SELECT device, part, min(at_us) AS at_us, any_value(origin) AS origin, count(*) AS segments,
                    string_agg(said, ' ' ORDER BY at_us, chunk_ts, seg, track, said) AS text,
                    min(confidence) AS confidence, any_value(order_confidence) AS order_confidence
                  FROM islands GROUP BY device, part)""",
    }


def lean(cap: int = 600) -> str:
    return (f"device, ts, turn_no, origin, substring(text, 1, {cap}) AS text, confidence, order_confidence, "
            f"length(text) AS text_len, length(text) > {cap} AS truncated")


T0 = turns(2000)
ORACLES.update({
    "pair_tracks": sql("""SELECT device, chunk_ts, count(*) FILTER (track = 'system') AS system_segments,
        count(*) FILTER (track = 'mic') AS mic_segments, min(start_ms) AS first_ms, max(end_ms) AS last_ms,
        count(*) FILTER (track = 'system') > 0 AND count(*) FILTER (track = 'mic') > 0 AS paired
        FROM segments GROUP BY device, chunk_ts""", *SEG_VIEWS[:2]),
    "words": sql(f"""SELECT device, chunk_ts, track, seg_no, CAST(i - 1 AS INTEGER) AS word_no, terms[i] AS w,
        start_ms + (i - 1) * (5000 // len(terms)) AS start_ms, start_ms + i * (5000 // len(terms)) AS end_ms
        FROM (SELECT *, unnest(range(1, len(terms) + 1)) AS i FROM (SELECT *, {TERMS} AS terms FROM segments))""",
                 *SEG_VIEWS[:2]),
    "bleed_coverage": sql("""SELECT device, chunk_ts, seg_no, start_ms, md5(text) AS text_md5, terms, covered,
        round(coverage, 6) AS coverage FROM mics""", *SEG_VIEWS[:2], **SPOKEN),
    "drop_bleed": sql("SELECT device, chunk_ts, seg_no, start_ms, text FROM mics WHERE coverage < 0.8",
                      *SEG_VIEWS[:2], **SPOKEN),
    "energy_overlap": sql(f"""SELECT device, chunk_ts, seg_no, start_ms, md5(text) AS text_md5,
        round(coalesce({ratio('span')}, 0.0), 6) AS energy_ratio FROM (
        SELECT s.*, {HEARD} AS span FROM segments s LEFT JOIN envelopes e
          ON e.device = s.device AND e.chunk_ts = s.chunk_ts WHERE s.track = 'mic')""", *SEG_VIEWS),
    "label_origin": sql("""SELECT device, chunk_ts, track, seg_no, start_ms, text, origin,
        round(confidence, 6) AS confidence, order_confidence FROM labelled""", *SEG_VIEWS, **LABELS),
    "turns_all": sql("SELECT * FROM turns", *SEG_VIEWS, **T0),
    "turns_merged": sql("SELECT * FROM turns", *SEG_VIEWS, **turns(q.TURN_GAP)),
    "transcript": sql(f"""SELECT {lean()} FROM turns WHERE ts >= TIMESTAMP '2024-01-01 02:00:00'
        AND ts < TIMESTAMP '2024-01-01 09:00:00' ORDER BY ts, device, turn_no LIMIT 1000""", *SEG_VIEWS, **T0),
    "transcript_origin": sql(f"""SELECT {lean()} FROM turns WHERE origin = 'unknown'
        ORDER BY ts, device, turn_no LIMIT 1000""", *SEG_VIEWS, **T0),
    "transcript_min_conf": sql(f"""SELECT {lean(q.WIDE)} FROM turns WHERE confidence >= 0.9
        ORDER BY ts, device, turn_no LIMIT 1000""", *SEG_VIEWS, **T0),
    "transcript_latest": sql(f"""SELECT {lean()} FROM turns ORDER BY ts DESC, device DESC, turn_no DESC LIMIT 25""",
                             *SEG_VIEWS, **T0),
    "transcript_resume": sql(f"SELECT {lean()} FROM turns ORDER BY ts, device, turn_no LIMIT 40 OFFSET 40",
                             *SEG_VIEWS, **T0),
    "transcript_info": sql("""SELECT 40 AS returned, true AS has_more, min(ts) AS oldest_ts,
        'page is full, more results exist' AS notice FROM turns""", *SEG_VIEWS, **T0),
})

# retention
PLAN = "event_id, device, day, ts, media_path, media_bytes, '{0}' AS reason"
UPTO = "sum(media_bytes) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING)"
SIZED = f"SELECT {PLAN.format('size')} FROM (SELECT *, {UPTO} AS upto FROM {{0}}) WHERE upto > {q.SIZE_CAP}"
AGED = f"SELECT {PLAN.format('age')} FROM events1 WHERE ts < TIMESTAMP '2024-01-11'"
COMBINED = f"{AGED} UNION ALL {SIZED.format('''(SELECT * FROM events1 WHERE ts >= TIMESTAMP '2024-01-11')''')}"
REPORT = """SELECT reason, count(*) AS events, CAST(sum(media_bytes) AS BIGINT) AS media_bytes, true AS dry_run
    FROM plan GROUP BY reason"""
ORACLES.update({
    "prune_age": sql(f"SELECT {PLAN.format('age')} FROM events1 WHERE ts < TIMESTAMP '2024-01-16'", "events1"),
    "prune_size": sql(SIZED.format("events1"), "events1"),
    "prune_combined": sql(COMBINED, "events1"),
    "prune_report": sql(REPORT, "events1", plan=COMBINED),
    "prune_all_dry_run": sql(REPORT, "events1", plan=f"SELECT {PLAN.format('all')} FROM events1"),
    "prune_survivors": sql("SELECT event_id, ts FROM events1 WHERE ts >= TIMESTAMP '2024-01-16'", "events1"),
    "orphans": sql("SELECT path, length FROM media WHERE path NOT IN (SELECT media_path FROM events1)",
                   "events1", "media"),
    "dangling": sql("SELECT event_id, media_path FROM events1 WHERE media_path NOT IN (SELECT path FROM media)",
                    "events1", "media"),
})

# storage density
DONE = "(media_path LIKE '%.heic' OR media_path LIKE '%.flac')"


def plan(cutoff: str, screens: bool = True) -> str:
    chosen = "true" if screens else "pass = 'audio'"
    return f"""
        SELECT event_id, device, day, ts, pass, media_path, target, bytes,
          CASE WHEN ts >= TIMESTAMP '{cutoff}' OR NOT ({chosen}) THEN 'skipped' WHEN {DONE} THEN 'already_done'
            WHEN holders > 1 THEN 'conflicted' WHEN bytes IS NULL THEN 'missing_files' ELSE 'candidate' END AS status
        FROM (SELECT s.*, m.length AS bytes, CASE WHEN kind = 'screen' THEN 'screens' ELSE 'audio' END AS pass,
                {swapped('media_path')} AS target,
                count(*) OVER (PARTITION BY coalesce({swapped('media_path')}, media_path)) AS holders
              FROM stored s LEFT JOIN media m ON m.path = s.media_path)"""


STORE = ("events1", "media", "stored")
HIST = "list_transform(range(0, 16), lambda b: len(list_filter({0}, lambda x: least(15, greatest(0, x // 16)) = b)) / len({0}))"
CHECKS = {
    "mse": """SELECT *, list_sum(list_transform(list_zip(src, dst), lambda p: ((p[1] - p[2]) * (p[1] - p[2]))::DOUBLE))
        / len(src) AS mse FROM manifest""",
    "checks": f"""SELECT *, CASE WHEN mse > 0 THEN 10.0 * log10(65025.0 / mse) END AS db,
        list_sum(list_transform(list_zip({HIST.format('src')}, {HIST.format('dst')}), lambda p: abs(p[1] - p[2]))) AS l1
        FROM mse""",
    "verified": """SELECT old_path, new_path, CAST(new_bytes AS BIGINT) AS new_bytes, medium,
        CASE WHEN medium = 'audio' THEN src = dst
          ELSE same_size AND (mse = 0 OR db >= 30) AND l1 <= 0.05 END AS verified FROM checks""",
}
SETTLED = {
    **CHECKS,
    "plan": plan("2024-01-29"),
    "settled": """SELECT p.* REPLACE (CASE WHEN status <> 'candidate' THEN status
          WHEN event_id % 41 = 0 THEN 'raced' WHEN v.verified IS NULL THEN 'encode_failed'
          WHEN NOT v.verified THEN 'verify_failed' ELSE 'replaced' END AS status), v.new_path, v.new_bytes
        FROM plan p LEFT JOIN verified v ON v.old_path = p.media_path""",
}
REPAIRS = {
    "loose": "SELECT path, length FROM media WHERE path NOT IN (SELECT media_path FROM stored)",
    "repairs": """SELECT CASE WHEN s.media_path IN (SELECT path FROM media) THEN 'remove' ELSE 'adopt' END AS action,
          s.event_id, l.path, s.media_path AS sibling, l.length AS bytes
        FROM stored s JOIN loose l ON regexp_replace(l.path, '\\.[a-z]+$', '') = regexp_replace(s.media_path, '\\.[a-z]+$', '')
          AND l.path <> s.media_path""",
}
FULL = ("scaled", "manifest")
ORACLES.update({
    "compress_plan": sql("SELECT * FROM plan", *STORE, plan=plan("2024-01-29")),
    "compress_plan_audio_only": sql("SELECT event_id, pass, status FROM plan", *STORE, plan=plan("2024-01-21", False)),
    "compress_conflicts": sql(f"""SELECT event_id, media_path, target FROM (
        SELECT *, {swapped('media_path')} AS target,
          count(*) OVER (PARTITION BY coalesce({swapped('media_path')}, media_path)) AS holders FROM stored)
        WHERE holders > 1 AND target IS NOT NULL""", "events1", "stored"),
    "compress_guard": """SELECT count(*) AS outside, min('/data/screenshots/../../else/' || event_id || '.jpg') AS example
        FROM events WHERE event_id % 1000 = 9""",
    "compress_dry_run": sql("""SELECT pass, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM plan
        WHERE status = 'candidate' GROUP BY pass""", *STORE, plan=plan("2024-01-29")),
    "verify_audio": sql("SELECT vec_id, label, src = dst AS verified FROM manifest", *FULL),
    "verify_psnr": sql("""SELECT vec_id, label, round(db, 6) AS psnr, same_size, round(l1, 6) AS hist_l1,
        same_size AND (mse = 0 OR db >= 30) AND l1 <= 0.05 AS verified FROM checks""", *FULL, **CHECKS),
    "verify_manifest": sql("SELECT * FROM verified", *FULL, **CHECKS),
    "settle": sql("""SELECT event_id, pass, media_path, status, CASE WHEN status = 'replaced' THEN new_path END AS new_path,
        CASE WHEN status = 'replaced' THEN new_bytes END AS new_bytes FROM settled""", *STORE, *FULL, **SETTLED),
    "repoint": sql("""SELECT e.event_id, CASE WHEN s.status = 'replaced' THEN s.new_path ELSE e.media_path END AS media_path,
        CASE WHEN s.status = 'replaced' THEN s.new_bytes ELSE e.media_bytes END AS media_bytes
        FROM stored e LEFT JOIN settled s USING (event_id)""", *STORE, *FULL, **SETTLED),
    "reconcile": sql("SELECT * FROM repairs", *STORE, **REPAIRS),
    "adopt": sql("""SELECT e.event_id, coalesce(r.path, e.media_path) AS media_path,
        coalesce(r.bytes, e.media_bytes) AS media_bytes
        FROM stored e LEFT JOIN repairs r ON r.event_id = e.event_id AND r.action = 'adopt'""", *STORE, **REPAIRS),
    "reconcile_report": sql("""SELECT count(DISTINCT path) FILTER (action = 'remove') AS removed_files,
        CAST(coalesce(sum(bytes) FILTER (action = 'remove'), 0) AS BIGINT) AS removed_bytes,
        count(DISTINCT event_id) FILTER (action = 'adopt') AS recovered_events FROM repairs""", *STORE, **REPAIRS),
    "compress_report": sql("""SELECT pass, count(*) FILTER (status = 'replaced') AS files,
        CAST(coalesce(sum(bytes) FILTER (status = 'replaced'), 0) AS BIGINT) AS bytes_before,
        CAST(coalesce(sum(new_bytes) FILTER (status = 'replaced'), 0) AS BIGINT) AS bytes_after, """
        + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in (
            "already_done", "skipped", "missing_files", "encode_failed", "verify_failed", "flush_failed",
            "raced", "conflicted")) + " FROM settled GROUP BY pass", *STORE, *FULL, **SETTLED),
    "savings": sql("""SELECT pass, CAST(sum(bytes) AS BIGINT) AS bytes_before, CAST(sum(new_bytes) AS BIGINT) AS bytes_after,
        round(sum(bytes) / sum(new_bytes), 6) AS ratio FROM settled WHERE status = 'replaced' GROUP BY pass""",
                   *STORE, *FULL, **SETTLED),
    "rebase_paths": sql("""SELECT event_id, '/copy/of data' || substring(media_path, 6) AS media_path FROM stored""",
                        "events1", "stored"),
})

# streaming: what the stream must have emitted once it has read the whole table
LEVELS = sql("""SELECT date_trunc('hour', chunk_ts) AS window_start, device, track,
    round(max(list_max(rms)), 6) AS peak, round(sum(list_sum(rms)) / sum(len(rms)), 6) AS mean
    FROM envelopes GROUP BY ALL""", "envelopes")
ORACLES.update({
    "levels_batch": LEVELS,
    "stream_levels": LEVELS,
    "stream_displays": sql("""SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, device,
        count(DISTINCT display_id) AS displays FROM events1 WHERE display_id IS NOT NULL GROUP BY ALL""", "events1"),
    "stream_sessions": sql("""
        SELECT device, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_until, count(*) AS events
        FROM (SELECT *, sum(fresh) OVER (PARTITION BY device ORDER BY ts, event_id) AS session_no FROM (
          SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY device ORDER BY ts, event_id))
            <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events1)) GROUP BY device, session_no
        HAVING max(ts) + INTERVAL 30 MINUTE <= date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL 2 HOUR""",
                           "events1"),
    "stream_once_each": sql("SELECT event_id, device, ts, app FROM events1", "events1"),
    "stream_index": sql("SELECT * FROM postings", "docs", "docterms", "postings"),
    "stream_track_health": sql("""
        SELECT device, track, ts AS last_ts, ts + INTERVAL 24 HOUR AS no_signal_at
        FROM (SELECT *, lead(ts) OVER (PARTITION BY device, track ORDER BY ts) AS next FROM events1 WHERE kind = 'audio')
        WHERE coalesce(next >= ts + INTERVAL 24 HOUR, true)
          AND ts + INTERVAL 24 HOUR <= date_trunc('milliseconds', (SELECT max(ts) FROM events1 WHERE kind = 'audio')) - INTERVAL 1 HOUR""",
                               "events1"),
    "stream_activity_late": sql("SELECT event_id, device, ts, app FROM events1", "events1"),
    "prune_stale_plan": sql("SELECT event_id, device, ts, app FROM events1 WHERE event_id % 2 = 1", "events1"),
    "settle_flushed": sql("""SELECT event_id, pass, media_path,
        CASE WHEN status = 'replaced' AND NOT there THEN 'flush_failed' ELSE status END AS status,
        CASE WHEN status = 'replaced' AND there THEN new_path END AS new_path,
        CASE WHEN status = 'replaced' AND there THEN new_bytes END AS new_bytes
        FROM (SELECT *, coalesce(new_path IN (SELECT path FROM media), false) AS there FROM settled)""",
                          *STORE, *FULL, **SETTLED),
})

# near fold: components of all pairs of one application that share four of five word triples
TRIPLES = """list_distinct(list_transform(range(1, greatest(len(terms) - 2, 1) + 1),
    lambda i: array_to_string(list_slice(terms, i, i + 2), ' ')))"""
ORACLES["fold_near"] = sql("""
    SELECT "window" AS app, max(rep) AS event_id, CAST(sum(n) AS BIGINT) AS similar_count,
      TIMESTAMP '2024-01-01' + to_seconds(min(lo)) AS first_ts, TIMESTAMP '2024-01-01' + to_seconds(max(rep)) AS last_ts
    FROM reps JOIN roots ON id = rep GROUP BY "window", root""", "docs",
    reps=f"""SELECT "window", max(event_id) AS rep, min(event_id) AS lo, count(*) AS n, any_value({TERMS}) AS terms
        FROM docs GROUP BY "window", {PRINT}""",
    shingles=f'SELECT "window", rep, len(t) AS size, unnest(t) AS s FROM (SELECT *, {TRIPLES} AS t FROM reps)',
    edges="""SELECT a.rep AS a, b.rep AS b FROM shingles a JOIN shingles b ON a."window" = b."window" AND a.s = b.s AND a.rep <> b.rep
        GROUP BY a.rep, b.rep HAVING count(*)::DOUBLE / (max(a.size) + max(b.size) - count(*)) >= 0.8::DOUBLE""",
    roots="""SELECT id, min(root) AS root FROM (WITH RECURSIVE reach(id, root) AS (SELECT rep, rep FROM reps
        UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id) SELECT * FROM reach) GROUP BY id""")
# One page has two ways to be found.
ORACLES["search_newest_scan"] = ORACLES["search_newest"]
ORACLES["search_fold_scan"] = ORACLES["search_fold"]
ORACLES["search_relevance_scan"] = ORACLES["search_relevance"]
ORACLES["search_ranked_page2"] = ORACLES["search_offset"]
