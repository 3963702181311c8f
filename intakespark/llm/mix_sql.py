"""The mix of ``source_mix.plan_mix`` over the documents table, stated in SQL."""

from .source_mix import BLOCK_TOKENS, GOLDEN, SEED

OP2_SQL = rf"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle
  FROM documents
), placed AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY shuffle, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s GROUP BY source
), weighed AS (
  SELECT source, source_size, CAST(CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM totals
), level AS (
  SELECT arg_min(lam, r) AS lam FROM (
    SELECT a.source_size * 2 / a.weight AS r,
      ((SELECT 1.5 * sum(source_size) FROM weighed) - coalesce((SELECT sum(b.source_size * 2) FROM weighed b WHERE b.source_size * 2 / b.weight < a.source_size * 2 / a.weight), 0))
      / (SELECT sum(b.weight) FROM weighed b WHERE b.source_size * 2 / b.weight >= a.source_size * 2 / a.weight) AS lam
    FROM weighed a) WHERE lam <= r
), goals AS (
  SELECT source, source_size, least(CAST(source_size * 2 AS DOUBLE), lam * weight) AS target FROM weighed, level
), plan AS (
  SELECT source, source_size, goal, blocks, quota, substr(md5(source), 1, 3) AS head,
    CAST(coalesce(sum(quota) OVER (ORDER BY coalesce(substr(md5(source), 1, 3), '~'), source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS low
  FROM (
    SELECT source, source_size, goal, CAST(ceil(source_size / {BLOCK_TOKENS}) AS BIGINT) AS blocks,
      CAST((goal // source_size) * ceil(source_size / {BLOCK_TOKENS}) + ceil((goal % source_size) / {BLOCK_TOKENS}) AS BIGINT) AS quota
    FROM (SELECT source, source_size, CAST(floor(target) AS BIGINT) AS goal FROM goals) WHERE goal > 0)
), points AS (
  SELECT k, ((k + 0.5) * CAST({GOLDEN} AS DOUBLE) - floor((k + 0.5) * CAST({GOLDEN} AS DOUBLE))) * CAST(n AS DOUBLE) AS u
  FROM (SELECT CAST(sum(quota) AS BIGINT) AS n FROM plan), LATERAL (SELECT CAST(unnest(range(n)) AS DOUBLE) AS k)
), named AS (
  SELECT p.source, row_number() OVER (PARTITION BY p.source ORDER BY k) - 1 AS rank FROM points JOIN plan p ON u >= low AND u < low + quota
), ranked AS (
  SELECT source, rank FROM named
  UNION ALL
  SELECT p.source, unnest(range(coalesce(c.n, 0), p.quota)) FROM plan p LEFT JOIN (SELECT source, count(*) AS n FROM named GROUP BY source) c ON p.source IS NOT DISTINCT FROM c.source
  WHERE coalesce(c.n, 0) < p.quota
), slots AS (
  SELECT p.source, r.rank % blocks AS block, least({BLOCK_TOKENS}, source_size - (r.rank % blocks) * {BLOCK_TOKENS}, goal - ((r.rank // blocks) * source_size + (r.rank % blocks) * {BLOCK_TOKENS})) AS tokens
  FROM ranked r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source WHERE r.rank < p.quota
), cut AS (
  SELECT source, start, size, unnest(range(start // {BLOCK_TOKENS}, (start + size - 1) // {BLOCK_TOKENS} + 1)) AS block FROM placed WHERE size > 0
), sums AS (
  SELECT c.source, c.start, sum(greatest(0, least(c.start + c.size, c.block * {BLOCK_TOKENS} + tokens) - greatest(c.start, c.block * {BLOCK_TOKENS}))) AS taken
  FROM cut c JOIN slots s ON c.source IS NOT DISTINCT FROM s.source AND c.block = s.block GROUP BY c.source, c.start
)
SELECT d.doc_id, d.size, g.source_size, g.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken
FROM placed d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
LEFT JOIN sums t ON d.size > 0 AND d.source IS NOT DISTINCT FROM t.source AND d.start = t.start
"""
