"""DuckDB SQL with the results of the queries."""

SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, {SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key)
GROUP BY doc_id
"""

OP5 = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY (source IS NULL), encode(source)) - 1) % 3) + 1]::DOUBLE AS weight,
         [-0.5, 0, 0.5][((row_number() OVER (ORDER BY (source IS NULL), encode(source)) - 1) % 3) + 1]::DOUBLE AS tilt
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
         coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_full
  FROM sources
), tried AS (
  SELECT source_size, weight, 2.0::DOUBLE * source_size AS most,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::DOUBLE - 2.0::DOUBLE * size_full::DOUBLE) / weight_left AS level
  FROM ordered
), levels AS (
  SELECT arg_min(level, source_size / weight) AS level FROM tried WHERE level * weight <= most
), dealt AS (
  SELECT source, source_size, weight, weight * (1 - tilt) AS a, weight * (1 + tilt) AS b,
         least(weight * (SELECT level FROM levels), 2.0::DOUBLE * source_size) AS target
  FROM sources
), placed AS (
  SELECT doc_id, size, source_size, weight, a, b, target, floor(target + 0.5::DOUBLE)::BIGINT AS words,
         coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized JOIN dealt ON sized.source IS NOT DISTINCT FROM dealt.source
), counted AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS whole FROM placed
), taken AS (
  SELECT *, (whole * size + greatest(0, least(size, words - whole * source_size - before)))::BIGINT AS taken,
         before::DOUBLE / target * weight AS demand
  FROM counted
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 AND target > 0 THEN 2 * demand / (a + sqrt(a * a + 2 * (b - a) * demand)) END AS position
FROM taken
"""
