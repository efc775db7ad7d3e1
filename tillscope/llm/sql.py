"""DuckDB SQL for the results of the queries that SQL can express."""

from __future__ import annotations

_OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM per_source
), levels AS (
  -- Sources by how soon they are full; the level that remains if all before them are.
  SELECT 2.0::DOUBLE * source_size / weight AS full_at,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (
            ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (
            ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), chosen AS (
  SELECT arg_min(level, full_at) FILTER (WHERE level <= full_at) AS level FROM levels
), rates AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, chosen.level * weight) AS target FROM weighted, chosen
), planned AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM planned
"""

_OP6 = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), fitting AS (
  SELECT *,
         host = 'net' OR host LIKE '%.net' AS net, host = 'org' OR host LIKE '%.org' AS org,
         host = 'example.net' OR host LIKE '%.example.net' AS example_net,
         host = 'example.com' OR host LIKE '%.example.com' AS example_com,
         '//' || host || path AS address
  FROM parts
), stated AS (
  SELECT *, CASE WHEN example_net AND path LIKE '/en/%' THEN 'example.net/en/'
                 WHEN example_com AND path LIKE '/de/%' THEN 'example.com/de/'
                 WHEN org AND path LIKE '/fr/%' THEN 'org/fr/'
                 WHEN net AND path LIKE '/%' THEN 'net/' END AS rule
  FROM fitting
), patterned AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN '||' || rule ELSE (
    SELECT pattern FROM (VALUES
      ('*/cart/*', '/cart/'), ('*/checkout/*', '/checkout/'), ('*/cgi-bin/*', '/cgi-bin/'),
      ('*/wp-login.php|', '/wp-login\.php$'), ('*/login|', '/login$'), ('*/signin|', '/signin$'),
      ('||ads.*', '^//([^/]*\.)?ads\.'), ('||adserver.*', '^//([^/]*\.)?adserver\.'),
      ('||casino.*', '^//([^/]*\.)?casino\.'), ('||porn.*', '^//([^/]*\.)?porn\.')) t(pattern, regex)
    WHERE regexp_matches(address, regex) ORDER BY length(pattern) DESC, pattern LIMIT 1) END AS pattern
  FROM stated
)
SELECT page_id, host, path, rule, pattern,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM patterned
"""

_OP12 = r"""
WITH crc_table AS (
  -- CRC-32 of the decimal digits of the id, a byte at a time.
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda v, step: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS entry
), hashed AS (
  SELECT doc_id, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda crc, b: xor(crc >> 8, entry[(xor(crc, b) & 255) + 1])), 4294967295) AS h,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents, crc_table
), planned AS (
  SELECT doc_id, h, w, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS pieces FROM hashed
), edited AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n),
      lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // pieces) + 1] END) ELSE w END AS w
  FROM planned
), placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM edited
), equal_words AS (
  -- All places i where the word q places on is the same, as far as a square of period q could fit.
  SELECT x.doc_id, x.i, y.i - x.i AS q
  FROM placed x JOIN placed y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal_words
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) >= q
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= 12 GROUP BY ALL
), per_document AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
         first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS longest
  FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM placed
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = placed.doc_id AND placed.i >= r.start + r.period AND placed.i < r.start + r.length)
  GROUP BY doc_id
)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, longest.start AS start, longest.length AS length, longest.period AS period,
       1000 * longest.length // longest.period AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM edited e LEFT JOIN per_document p ON e.doc_id = p.doc_id LEFT JOIN kept k ON e.doc_id = k.doc_id
"""

ORACLES = {"op2_mix_sources": _OP2, "op6_filter_urls": _OP6, "op12_find_periodic_runs": _OP12}
