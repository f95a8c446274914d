"""DuckDB twins of the operators that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op7_weighted_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17'), 1, 15) AS BIGINT) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
  FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
               ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, rank, least(3.0::DOUBLE * source_size, weight * max(level) OVER ()) AS target FROM levels),
queued AS (
  SELECT d.doc_id, d.size, d.key, t.source_size, t.rank, t.target,
         CAST(sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT q.*, e, (e * source_size + upto)::DOUBLE / target AS finish
  FROM queued q, (VALUES (0), (1), (2)) AS v(e)
  WHERE target > 0 AND e * source_size + upto - size < target),
taken AS (
  SELECT doc_id, key, size, rank, e,
         sum(size) OVER (ORDER BY finish, rank, key, doc_id, size, e ROWS UNBOUNDED PRECEDING) AS upto
  FROM copies),
counts AS (
  SELECT rank, key, doc_id, count(*) AS n FROM taken
  WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(c.n, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN counts c ON q.rank = c.rank AND q.key = c.key AND q.doc_id IS NOT DISTINCT FROM c.doc_id
"""
