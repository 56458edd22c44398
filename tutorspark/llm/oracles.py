"""DuckDB SQL for the queries of this package that SQL can express.

Values are written out here instead of being imported from the operators they check.
"""

from __future__ import annotations

URL_SQL = r"""
WITH located AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '\A[^/?#]*', 0),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '\A[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), ruled AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM located
), labelled AS (
  SELECT *, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 0 WHEN rule IS NOT NULL THEN 1 END AS bad FROM ruled
), parts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, string_split(host, '.') AS p,
         regexp_full_match(host, '[0-9.]*') AS numeric_host FROM labelled GROUP BY host
), hosts AS (
  SELECT host, n, k, CASE WHEN numeric_host THEN '' WHEN two IN ('ac.uk','co.jp','co.nz','co.uk','com.au','com.br','gov.uk','org.uk') THEN two ELSE p[-1] END AS suffix,
         CASE WHEN numeric_host THEN host WHEN two IN ('ac.uk','co.jp','co.nz','co.uk','com.au','com.br','gov.uk','org.uk')
              THEN array_to_string(p[-3:], '.') ELSE two END AS domain
  FROM (SELECT *, array_to_string(p[-2:], '.') AS two FROM parts)
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (
  SELECT suffix, n, k, c, ((bad - k + 0.5) / (pages - n + 1.0))::DOUBLE AS m, pages - n + 1.0::DOUBLE AS known, ((bad + 0.5) / (pages + 1.0))::DOUBLE AS pooled
  FROM (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
       (SELECT sum(n) AS pages, sum(k) AS bad, count(DISTINCT suffix) FILTER (n > 0) AS c FROM domains)
), spread_s AS (
  SELECT r / (1 - r) AS spread FROM (SELECT least(greatest(CASE WHEN room > 0 THEN (seen - noise) / room ELSE 0 END, 1 / (n + 1.0)::DOUBLE), 0.999::DOUBLE) AS r FROM (
    SELECT coalesce(sum(n * pow(k / n::DOUBLE - pooled, 2)) FILTER (n > 0), 0) AS seen, coalesce(sum(pooled * (1 - pooled) * (c - 1) / c) FILTER (n > 0), 0) AS noise,
           coalesce(sum(pooled * (1 - pooled) * (n - 1) * (c - 1) / c) FILTER (n > 0), 0) AS room, count(*) FILTER (n > 0) AS n FROM suffixes))
), suffixes2 AS (
  SELECT *, 1 / (spread + 1 / known) AS s FROM suffixes, spread_s
), domains2 AS (
  SELECT d.domain, d.n, d.k, (SELECT count(*) FROM domains o WHERE o.suffix = d.suffix AND o.n > 0) AS c,
         (u.k - d.k + s * u.m) / (u.n - d.n + s) AS m, u.n - d.n + s AS known, (u.k + s * u.m) / (u.n + s) AS pooled FROM domains d JOIN suffixes2 u USING (suffix)
), spread_d AS (
  SELECT r / (1 - r) AS spread FROM (SELECT least(greatest(CASE WHEN room > 0 THEN (seen - noise) / room ELSE 0 END, 1 / (n + 1.0)::DOUBLE), 0.999::DOUBLE) AS r FROM (
    SELECT coalesce(sum(n * pow(k / n::DOUBLE - pooled, 2)) FILTER (n > 0), 0) AS seen, coalesce(sum(pooled * (1 - pooled) * (c - 1) / c) FILTER (n > 0), 0) AS noise,
           coalesce(sum(pooled * (1 - pooled) * (n - 1) * (c - 1) / c) FILTER (n > 0), 0) AS room, count(*) FILTER (n > 0) AS n FROM domains2))
), domains3 AS (
  SELECT *, 1 / (spread + 1 / known) AS s FROM domains2, spread_d
), hosts2 AS (
  SELECT h.host, h.n, h.k, (SELECT count(*) FROM hosts o WHERE o.domain = h.domain AND o.n > 0) AS c,
         (d.k - h.k + s * d.m) / (d.n - h.n + s) AS m, d.n - h.n + s AS known, (d.k + s * d.m) / (d.n + s) AS pooled FROM hosts h JOIN domains3 d USING (domain)
), spread_h AS (
  SELECT r / (1 - r) AS spread FROM (SELECT least(greatest(CASE WHEN room > 0 THEN (seen - noise) / room ELSE 0 END, 1 / (n + 1.0)::DOUBLE), 0.999::DOUBLE) AS r FROM (
    SELECT coalesce(sum(n * pow(k / n::DOUBLE - pooled, 2)) FILTER (n > 0), 0) AS seen, coalesce(sum(pooled * (1 - pooled) * (c - 1) / c) FILTER (n > 0), 0) AS noise,
           coalesce(sum(pooled * (1 - pooled) * (n - 1) * (c - 1) / c) FILTER (n > 0), 0) AS room, count(*) FILTER (n > 0) AS n FROM hosts2))
)
, bounds AS (
  SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower_bound
  FROM (SELECT host, s * m + k + 0.5 AS a, s * (1 - m) + (n - k) + 0.5 AS b FROM (SELECT *, 1 / (spread + 1 / known) AS s FROM hosts2, spread_h))
)
SELECT page_id, l.host, path, rule, CASE WHEN bad = 1 THEN 'block' WHEN bad = 0 THEN 'allow' WHEN lower_bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM labelled l JOIN bounds USING (host)
"""

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || left(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 9))::BIGINT AS h FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM sources WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), planned AS (
  SELECT *, least((3 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM levels
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM planned
), summed AS (
  SELECT d.source, d.h, sum(d.size) AS words FROM sized d GROUP BY d.source, d.h
), running AS (
  SELECT b.source, s.h, target - whole * source_size AS budget, words, sum(words) OVER (PARTITION BY b.source ORDER BY s.h) AS upto
  FROM budgets b JOIN summed s ON b.source IS NOT DISTINCT FROM s.source
), ends AS (
  SELECT source, CASE WHEN upto - budget < budget - (upto - words) THEN h ELSE h - 1 END AS threshold
  FROM running WHERE upto - words <= budget AND budget < upto
)
SELECT doc_id, size, b.source_size, b.target, copies, copies * size AS taken FROM (
  SELECT d.*, b.source_size, b.target, (whole + CASE WHEN d.h <= threshold THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN ends e ON e.source IS NOT DISTINCT FROM b.source) b
"""


TOP_K_SQL = r"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""

NEAR_VECTORS_SQL = r"""
WITH RECURSIVE whole AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM whole a JOIN whole b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, b FROM reach r JOIN links ON r.other = a
), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

REPEATS_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM texts WHERE len(w) >= 20
), windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS place FROM starts
), gone AS (
  SELECT DISTINCT doc_id, i + d AS i FROM windows, range(20) AS r(d) WHERE place > 1
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""


HARD_NEGATIVES_SQL = r"""
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negatives AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""

# Node tables by listing every pair of a node and a node below it.  3988292384 is the polynomial of CRC-32.
PREFIXES_SQL = r"""
WITH turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(said ORDER BY i) AS said,
         list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes FROM turns GROUP BY conv_id
), hashed AS (
  SELECT conv_id, said, xor(list_reduce(bytes, lambda crc, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(crc, b)),
         4294967295::BIGINT), 4294967295) % 4 AS h FROM own
), whole AS (
  SELECT c.conv_id, CASE WHEN c.conv_id % 20 = 0 THEN c.said ELSE coalesce(b.said, [])[1:c.h] || c.said[c.h + 1:] END AS said
  FROM hashed c LEFT JOIN hashed b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
  SELECT conv_id, d, len(said) = d AS ends, said[1:d] AS prefix FROM (SELECT *, unnest(range(len(said) + 1)) AS d FROM whole)
), nodes AS (
  SELECT row_number() OVER () AS node, * FROM (
    SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ids,
           CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(prefix[-1].text, '[^\x20\x09-\x0D]+')) END AS saved FROM prefixes GROUP BY prefix, d)
), passed AS (
  SELECT p.conv_id, n.node, n.depth, n.saved FROM prefixes p JOIN nodes n ON p.prefix = n.prefix AND p.d = n.depth
), edges AS (
  SELECT DISTINCT a.node AS parent, b.node AS child FROM passed a JOIN passed b ON a.conv_id = b.conv_id AND b.depth = a.depth + 1
), below AS (
  SELECT DISTINCT a.node, b.node AS lower, b.saved FROM passed a JOIN passed b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), subtrees AS (
  SELECT node, sum(saved) AS saved_tokens, count(*) FILTER (lower NOT IN (SELECT parent FROM edges)) AS n_leaves FROM below GROUP BY node
), children AS (SELECT parent, count(*) AS n FROM edges GROUP BY parent)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM nodes n JOIN subtrees s USING (node) LEFT JOIN children c ON c.parent = n.node
LEFT JOIN edges e ON e.child = n.node LEFT JOIN nodes p ON p.node = e.parent
"""


def llm_oracles() -> dict[str, str]:
    return {
        "op1_url_reputation": URL_SQL,
        "op2_source_mix": MIX_SQL,
        "op6_impact_index": TOP_K_SQL,
        "op7_cover_tree": NEAR_VECTORS_SQL,
        "op8_seed_extend": REPEATS_SQL,
        "op11_kronecker_negatives": HARD_NEGATIVES_SQL,
        "op13_prefix_trie": PREFIXES_SQL,
    }
