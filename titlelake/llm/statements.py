"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

from titlelake.llm.decontaminate import MASKS, WINDOW
from titlelake.llm.licenses import GAP, LEAST, TEMPLATES


def words(text: str, outside: str) -> str:
    return f"list_filter(string_split_regex({text}, '[^{outside}]+'), lambda x: x <> '')"


def seeds(rows: str, keep: str, number: int, mask: tuple[int, ...]) -> str:
    key = " || ' ' || ".join(f"t[pos + {o + 1}]" for o in mask)
    span = mask[-1]
    return f"""SELECT {keep}, pos, {number} || ':' || {key} AS seed
  FROM (SELECT *, unnest(range(len(t) - {span})) AS pos FROM {rows} WHERE len(t) > {span})"""


def both(rows: str, keep: str) -> str:
    return "\n  UNION ALL ".join(seeds(rows, keep, k, mask) for k, mask in enumerate(MASKS))


TOKENS = r"\p{L}\p{N}"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, * FROM (
    SELECT DISTINCT doc_id, text, {words("lower(coalesce(text, ''))", TOKENS)} AS t FROM documents)),
i AS (SELECT row_number() OVER () AS item, * FROM (
    SELECT DISTINCT item_id, {words("lower(coalesce(text, ''))", TOKENS)} AS t FROM benchmark)),
ds AS ({both('d', 'rid')}),
bs AS ({both('i', 'item')}),
hits AS (SELECT DISTINCT rid, item, ds.pos - bs.pos AS first FROM ds JOIN bs USING (seed)),
same AS (
  SELECT rid, doc_id, item, item_id, least({WINDOW}, len(i.t)) AS width,
    list_transform(range(len(i.t)), lambda j: CASE WHEN first + j >= 0 AND first + j < len(d.t)
      AND d.t[first + j + 1] = i.t[j + 1] THEN 1 ELSE 0 END) AS same
  FROM hits JOIN d USING (rid) JOIN i USING (item)),
best AS (
  SELECT *, list_max(list_transform(range(len(same) - width + 1), lambda s: list_sum(same[s + 1 : s + width]))) AS best
  FROM same)
SELECT doc_id, item_id, CAST(max(list_sum(same)) AS BIGINT) AS n_equal, CAST(max(best) AS BIGINT) AS window_equal
FROM best WHERE best * 5 >= width * 4 GROUP BY rid, doc_id, item, item_id"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LICENSES = f"""
WITH templates(license, text) AS (VALUES {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in TEMPLATES.items())}),
t AS (SELECT license, {words(ASCII_LOWER, 'a-z0-9')} AS w FROM templates),
tb AS (
  SELECT license, size, first, second, count(*) AS times FROM (
    SELECT license, len(w) - 1 AS size, w[pos] AS first, w[pos + 1] AS second
    FROM (SELECT *, unnest(range(1, len(w))) AS pos FROM t)) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS rid, * FROM (SELECT DISTINCT doc_id, text, {words(ASCII_LOWER, 'a-z0-9')} AS w FROM documents)),
hits AS (
  SELECT rid, doc_id, license, size, times, first, second, pos FROM (
    SELECT rid, doc_id, pos - 1 AS pos, w[pos] AS first, w[pos + 1] AS second
    FROM (SELECT *, unnest(range(1, len(w))) AS pos FROM d)) JOIN tb USING (first, second)),
apart AS (SELECT *, pos - lag(pos) OVER own AS apart FROM hits WINDOW own AS (PARTITION BY rid, license ORDER BY pos)),
marked AS (
  SELECT *, sum(CASE WHEN apart <= 1 THEN 0 ELSE 1 END) OVER own AS run,
    sum(CASE WHEN apart <= {GAP + 1} THEN 0 ELSE 1 END) OVER own AS loose
  FROM apart WINDOW own AS (PARTITION BY rid, license ORDER BY pos)),
levels AS (
  SELECT *, 0 AS level, run AS region FROM marked UNION ALL SELECT *, 1 AS level, loose AS region FROM marked),
sized AS (
  SELECT *, max(pos) OVER r - min(pos) OVER r + 1 AS length FROM levels WINDOW r AS (PARTITION BY rid, license, level, region)),
counted AS (
  SELECT rid, doc_id, license, size, loose, level, region, length, first, second, times,
    count(*) AS own, min(pos) AS low, max(pos) AS high FROM sized GROUP BY ALL),
compared AS (
  SELECT rid, doc_id, license, loose, level, CAST(min(low) AS BIGINT) AS first_word, CAST(max(high) + 1 AS BIGINT) AS last_word,
    CAST(2.0 * sum(least(own, times)) AS DOUBLE) / (length + size) AS dice
  FROM counted GROUP BY rid, doc_id, license, size, loose, level, region, length),
found AS (
  SELECT *, min(level) OVER (PARTITION BY rid, license, loose) AS closest FROM compared WHERE dice >= {LEAST})
SELECT doc_id, license, first_word, last_word, dice FROM found WHERE level = closest"""


SEARCH = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({ASCII_LOWER}, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') AS t FROM documents),
sizes AS (SELECT rid, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
whole AS (SELECT count(*) AS docs, sum(n) AS terms FROM sizes),
own AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY ALL),
asked AS (
  SELECT item, item_id, term, count(*) AS times FROM (
    SELECT item, item_id, unnest(regexp_extract_all({ASCII_LOWER}, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term
    FROM (SELECT row_number() OVER () AS item, * FROM (SELECT DISTINCT item_id, text FROM benchmark))) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM own, whole WHERE term IN (SELECT term FROM asked) GROUP BY term),
scores AS (
  SELECT item, item_id, rid, doc_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN own USING (term) JOIN sizes USING (rid), whole
  GROUP BY item, item_id, rid, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex({ASCII_LOWER}, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS own FROM d),
g AS (SELECT doc_id, len(own) AS n, unnest(own) AS shingle FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g AS a JOIN g AS b USING (shingle) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached AS (
  SELECT doc_id AS origin, doc_id AS node FROM s UNION SELECT origin, b FROM reached JOIN links ON a = node)
SELECT doc_id, CAST(len(own) AS BIGINT) AS n_shingles, lowest AS component_id, doc_id = lowest AS kept
FROM s JOIN (SELECT origin AS doc_id, min(node) AS lowest FROM reached GROUP BY origin) USING (doc_id)"""
