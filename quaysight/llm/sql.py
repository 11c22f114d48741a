"""DuckDB SQL for the rows of queries, over whole tables."""

from __future__ import annotations


def op12_zone_maps(k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256) -> str:
    """Plain rounds over all pairs of a vector and a centroid, one component a row."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v,
    row_number() OVER (ORDER BY sha256('2:' || vec_id), embedding) - 1 AS place
  FROM embeddings
  WHERE len(embedding) = {width} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {width}),
parts AS MATERIALIZED (
  SELECT place, i, v[i] AS x FROM kept, range(1, {width + 1}) AS r(i)),
c0 AS MATERIALIZED (SELECT place AS c, i, x AS y FROM parts WHERE place < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""
near{n} AS MATERIALIZED (
  SELECT place, arg_min(c, d * {k} + c) AS c, min(d) AS d
  FROM (SELECT place, c, sum((x - y) * (x - y))::BIGINT AS d FROM parts JOIN c{n} USING (i) GROUP BY place, c)
  GROUP BY place)""")
        if n < rounds:
            steps.append(f"""
c{n + 1} AS MATERIALIZED (
  SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, y) AS y
  FROM c{n} LEFT JOIN (SELECT near{n}.c, i, sum(x)::BIGINT AS s, count(*) AS n FROM parts JOIN near{n} USING (place) GROUP BY near{n}.c, i)
    USING (c, i))""")
    return f"""WITH {",".join(steps)},
hashes AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256, NULL::VARCHAR AS wide_distance,
  NULL::VARCHAR AS wide_cluster_inertia, NULL::VARCHAR AS wide_inertia
FROM near{rounds} JOIN kept USING (place) JOIN hashes USING (c)"""


OP13_NORM_BUCKETS = r"""
WITH words AS MATERIALIZED (
  SELECT row_id, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents)),
lengths AS MATERIALIZED (SELECT row_id, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY row_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
counts AS MATERIALIZED (SELECT row_id, term, count(*) AS tf FROM words GROUP BY row_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, whole GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)),
scored AS (
  SELECT item_id, doc_id, row_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (row_id), whole
  GROUP BY item_id, doc_id, row_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


OP4_IMPACT_ORDERED = r"""
WITH kept AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]), 0)::BIGINT AS score
  FROM kept q JOIN kept c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score, NULL::VARCHAR AS wide_score FROM ranked WHERE rank <= 10"""


def op1_schema_fingerprint(control: str) -> str:
    """The formatted text: each turn is its role in a head line, its text and an
    end mark, with a backslash before every backslash, '<' and '>' of role and text."""
    quoted = control.replace("'", "''")

    def escaped(column: str) -> str:
        return f"replace(replace(replace(coalesce({column}, ''), '\\', '\\\\'), '<', '\\<'), '>', '\\>')"

    return f"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, turn, role, '{quoted}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS said(turn, role)),
ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    length('<turn ' || {escaped("role")} || '>' || chr(10) || {escaped("text")} || '</turn>' || chr(10)) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS LAST, role ASC NULLS FIRST, text ASC NULLS FIRST) AS place
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM ordered GROUP BY conv_id"""
