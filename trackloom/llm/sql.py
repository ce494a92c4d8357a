"""The same results in plain SQL, where it can express them."""

_RUNS = """
WITH d AS (
  SELECT p.track_id, p.frame, CAST(c.fps AS DOUBLE) AS fps, p.x, p.y
  FROM (SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY arrived_at) AS rn FROM points) p
  JOIN clips c ON c.clip = p.clip
  WHERE p.rn = 1 AND p.x IS NOT NULL AND p.y IS NOT NULL),
l AS (
  SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(frame) OVER w AS pf
  FROM d WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
r AS (
  SELECT *, sum(CASE WHEN sqrt((x - px) * (x - px) + (y - py) * (y - py)) <= 0.03 + 1e-6 AND frame - pf <= 2.0 * fps THEN 0 ELSE 1 END)
    OVER (PARTITION BY track_id ORDER BY frame) AS k
  FROM l),
g AS (
  SELECT track_id, min(frame) AS start_frame, max(frame) AS end_frame, CAST(count(*) AS BIGINT) AS n_rows,
    (max(frame) - min(frame)) / max(fps) AS duration_s, arg_min(x, frame) AS x, arg_min(y, frame) AS y
  FROM r GROUP BY track_id, k HAVING count(*) >= 2)
"""

_LABELS = """
WITH votes AS (
  SELECT track_id, lower(trim("group")) AS g, lower(trim(class)) AS c FROM points WHERE track_id IS NOT NULL),
gs AS (
  SELECT track_id, g FROM (
    SELECT track_id, g, row_number() OVER (PARTITION BY track_id ORDER BY count(*) DESC, list_position(['people', 'cycles', 'vehicles', 'trains'], g)) AS rn
    FROM votes WHERE g IN ('people', 'cycles', 'vehicles', 'trains') GROUP BY track_id, g) WHERE rn = 1),
cs AS (
  SELECT track_id, c FROM (
    SELECT track_id, c, row_number() OVER (PARTITION BY track_id
      ORDER BY count(*) DESC, list_position(['person', 'bicycle', 'car', 'truck', 'bus', 'motorcycle', 'train'], c)) AS rn
    FROM votes WHERE c IN ('person', 'bicycle', 'car', 'truck', 'bus', 'motorcycle', 'train') GROUP BY track_id, c) WHERE rn = 1),
s AS (
  SELECT coalesce(gs.g, CASE WHEN cs.c = 'person' THEN 'people' WHEN cs.c = 'bicycle' THEN 'cycles' WHEN cs.c = 'train' THEN 'trains'
      WHEN cs.c IS NOT NULL THEN 'vehicles' END, 'unknown') AS g,
    coalesce(cs.c, 'unknown') AS c
  FROM (SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY arrived_at) AS rn FROM points WHERE track_id IS NOT NULL AND frame IS NOT NULL) p
  LEFT JOIN gs ON gs.track_id = p.track_id LEFT JOIN cs ON cs.track_id = p.track_id
  WHERE p.rn = 1 AND p.speed IS NOT NULL AND NOT isnan(p.speed)),
n AS (
  SELECT 'group' AS label, g AS name, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY g
  UNION ALL SELECT 'class', c, CAST(count(*) AS BIGINT) FROM s GROUP BY c)
"""

_LIMITS = """
WITH d AS (
  SELECT doc_id, source, CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes,
    NOT regexp_matches(rtrim(text, E' \\t\\n\\r\\f\\v'), '[.!?;。！？；]["\'\'”’»)\\]}*_`~ ]*$') AS open
  FROM documents WHERE regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g') <> ''),
u AS (SELECT source, 'chars' AS unit, chars AS length FROM d UNION ALL SELECT source, 'bytes', bytes FROM d),
c AS (SELECT source, unit, length, count(*) AS n FROM u GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY source, unit ORDER BY length RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS near FROM c),
l AS (SELECT source, unit, length FROM w WHERE n >= 6 AND length >= 64 AND n * 24.0 / greatest(near - n, 1) >= 5.0)
"""

ORACLES = {
    "p2_within_bound": _LABELS + "SELECT label, name, n, percentile, true AS within FROM n, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS percentile)",
    # what packing promises, stated; the query counts whatever breaks it
    "p7_checked": "SELECT pack_id, 0 AS overlaps, 0 AS gaps, 0 AS beyond, 0 AS split, 0 AS not_whole, true AS least FROM pack_sizes",
    "p8_at_limit": _LIMITS
    + """
SELECT DISTINCT d.doc_id, d.source, d.chars, d.bytes FROM d JOIN l ON l.source IS NOT DISTINCT FROM d.source
  AND ((l.unit = 'chars' AND l.length = d.chars) OR (l.unit = 'bytes' AND l.length = d.bytes)) WHERE d.open""",
    "p1_found": _RUNS + "SELECT track_id, start_frame, end_frame FROM g",
    "p1_runs": _RUNS + "SELECT * FROM g",
}
