"""Query op2: documents that hold a passage of the benchmark."""

from __future__ import annotations

from . import decontaminate
from .registry import query
from .store import table

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_SHINGLES = "CASE WHEN len({0}) >= 5 THEN list_transform(range(1, len({0}) - 3), lambda k: array_to_string({0}[k:k + 4], ' ')) WHEN len({0}) > 0 THEN [array_to_string({0}, ' ')] ELSE [] END"
_LETTERS = "list_sum(list_transform({0}, lambda x: length(replace(x, ' ', ''))))"

SQL = f"""
WITH i AS (SELECT item_id, w, len(w) AS n, {_SHINGLES.format('w')} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
d AS (SELECT doc_id, w FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
k AS (SELECT DISTINCT least(n, 5) AS k FROM i WHERE n > 0),
ix AS (SELECT item_id, n, least(n, 5) AS k, unnest(s) AS x FROM i),
dx AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, k WHERE len(w) >= k)),
c AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(greatest(p - 1 - greatest(n - 5, 0), 0), p)) AS start FROM dx JOIN ix USING (k, x)),
v AS (SELECT c.doc_id, c.item_id, c.start, c.n, i.s AS a, {_SHINGLES.format('d.w[c.start + 1:c.start + c.n]')} AS b FROM c JOIN d USING (doc_id) JOIN i USING (item_id)),
m AS (SELECT doc_id, item_id, start, n, {_LETTERS.format('list_intersect(a, b)')} / {_LETTERS.format('list_distinct(list_concat(a, b))')} AS y FROM v)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start_word, CAST(n AS INTEGER) AS n_words, round(y, 6) AS similarity FROM m WHERE y >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY y DESC, start) = 1"""


@query("op2_decontamination", SQL)
def op2(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hamming")
