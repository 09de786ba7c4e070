"""DuckDB SQL for the queries that SQL can express, on the same Parquet tables."""

from __future__ import annotations


def escaped(text: str) -> str:
    return rf"replace(replace(replace({text}, '\', '\b'), '<', '\l'), '>', '\g')"


def framed(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def leaf(text: str) -> str:
    return f"sha256({' || '.join(map(framed, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


# CRC-32 of the decimal doc_id, byte by byte and bit by bit; the large constants are its start and its polynomial.
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
  lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""
RUNS = """SELECT tree, lvl + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), CAST(ceil(total / 16) AS BIGINT)
            FROM {0} WHERE total > 1 GROUP BY tree, lvl, idx // 16, total"""
RUN = "OVER (PARTITION BY tree, lvl, idx // 16 ORDER BY idx ROWS BETWEEN"

SAID = r"\### Assistant: </turn> ok"

ORACLES = {
    "op3_top_k_search": """
        WITH v AS MATERIALIZED (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
          FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
          SELECT q.vec_id AS query_id, c.vec_id,
            CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
          FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs)
        WHERE place <= 5""",
    "op4_ngram_jaccard": r"""
        WITH worded AS MATERIALIZED (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS MATERIALIZED (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
            range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s
          FROM worded),
        grams AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        edges AS MATERIALIZED (
          SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))),
        reached AS (
          SELECT id, min(root) AS root FROM (WITH RECURSIVE reach(id, root) AS (
            SELECT doc_id, doc_id FROM sets UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id)
          SELECT * FROM reach) GROUP BY id)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, root AS component_id FROM sets JOIN reached ON id = doc_id""",
    "op7_reply_trees": f"""
        WITH said AS (
          SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '{SAID}' UNION ALL SELECT -7, 1, 'assistant', '{SAID}'),
        whole AS (
          SELECT conv_id, count(*) AS n_turns,
            string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS spoken,
            coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
            CAST(sum(length({escaped('role')}) + length({escaped('text')}) + 15) AS BIGINT) AS formatted_chars
          FROM said GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(learned) AS loss_chars,
          sha256(learned) AS loss_sha256, formatted_chars FROM whole""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE leaves AS MATERIALIZED (
          SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf('text')} AS leaf,
            CASE WHEN {CRC32} % 5 = 0
              THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
              ELSE {leaf('text')} END AS audited FROM documents),
        placed AS MATERIALIZED (
          SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS idx,
            count(*) OVER (PARTITION BY tree) AS total FROM leaves),
        nodes(tree, lvl, idx, digest, total) AS (
          SELECT tree, 0, idx, leaf, total FROM placed UNION ALL {RUNS.format('nodes')}),
        subroots AS MATERIALIZED (
          SELECT tree AS name, lvl AS height, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place
          FROM nodes WHERE total = 1),
        tops(tree, lvl, idx, digest, total) AS (
          SELECT '^', 0, place, subroot, count(*) OVER () FROM subroots UNION ALL {RUNS.format('tops')}),
        every AS MATERIALIZED (SELECT * FROM nodes UNION ALL SELECT * FROM tops),
        links AS MATERIALIZED (
          SELECT tree, lvl, idx, tree AS up, lvl + 1 AS up_lvl, idx // 16 AS up_idx, true AS hashed,
            coalesce(string_agg(digest, '') {RUN} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(digest, '') {RUN} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM every WHERE total > 1
          UNION ALL SELECT name, height, 0, '^', 0, place, false, '', '' FROM subroots),
        climb(doc_id, leaf, name, tree, lvl, idx, h, siblings) AS (
          SELECT doc_id, leaf, tree, tree, 0, idx, audited, '' FROM placed
          UNION ALL SELECT doc_id, leaf, name, up, up_lvl, up_idx, CASE WHEN hashed THEN sha256(l || h || r) ELSE h END,
            siblings || l || r FROM climb JOIN links USING (tree, lvl, idx)),
        crown AS (SELECT lvl AS top, digest AS root FROM tops WHERE total = 1)
        SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, h AS folded_root, h = root AS verified
        FROM climb JOIN subroots USING (name) JOIN crown ON tree = '^' AND lvl = top""",
}
