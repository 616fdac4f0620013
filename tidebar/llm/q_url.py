"""Query op7: every page's URL judged by site rules and patterns."""

from __future__ import annotations

from . import url_filter
from .registry import query
from .store import table

_REST = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END"
_CASES = "\n".join(
    f"    WHEN regexp_matches(site, '{r.regex}') THEN {i}" for i, r in sorted(enumerate(url_filter.SITES), key=lambda x: -len(x[1].text)))
_PATTERN_CASES = "\n".join(f"    WHEN regexp_matches(whole, '{r.regex}') THEN '{r.text}'" for r in url_filter.PATTERNS)

SQL = f"""
WITH a AS (SELECT page_id, url, {_REST} AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^?#]*') AS cut FROM a),
c AS (SELECT *, regexp_extract(cut, '^[^/]*') AS raw FROM b),
d AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(cut, length(raw) + 1) AS path,
  lower(CASE WHEN contains(url, '://') THEN '//' || rest ELSE url END) AS whole FROM c),
e AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, whole, '//' || coalesce(host, '') || coalesce(path, '') AS site FROM d),
f AS (SELECT page_id, host, path, CASE
{_CASES}
    END AS no, CASE
{_PATTERN_CASES}
    END AS pattern FROM e)
SELECT page_id, host, path, CASE no {' '.join(f"WHEN {i} THEN '{r.text}'" for i, r in enumerate(url_filter.SITES))} END AS rule,
  CASE no {' '.join(f"WHEN {i} THEN '{r.verdict}'" for i, r in enumerate(url_filter.SITES))}
    ELSE CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END END AS verdict, pattern
FROM f"""


@query("op7_url_filter", SQL)
def op7(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))
