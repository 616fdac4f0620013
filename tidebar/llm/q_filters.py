"""Query op12: five filters on every source in every order."""

from __future__ import annotations

from . import filter_audit
from .registry import query
from .store import table

SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
y AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d LEFT JOIN y USING (doc_id)),
f AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) AS fails, good, toxic FROM m),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM s a, s b, s c, s d, s e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
t AS (SELECT part, filter_order, step, filter_order[step] AS filter, count(*) AS n, count(*) FILTER (hit = 0 OR hit > step) AS kept, count(*) FILTER (hit = step) AS removed,
    count(*) FILTER (hit < step AND hit > 0 AND list_contains(fails, filter_order[step])) AS redundant, count(*) FILTER (fails = [filter_order[step]]) AS unique_fails,
    count(*) FILTER (hit = step AND good) AS good_lost, count(*) FILTER (hit = step AND toxic) AS toxic_lost
  FROM (SELECT *, coalesce(list_min(list_transform(fails, lambda x: instr(filter_order, x))), 0) AS hit FROM f, o), (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM t"""


@query("op12_filter_audit", SQL)
def op12(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
