"""SQL of the training-data queries that SQL can express."""

from __future__ import annotations

FILL_IN_MIDDLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
r AS (SELECT doc_id, text, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b, units,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

ARCHIVE = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url FROM pages),
k AS (SELECT *, sha1(html) AS h, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS rest FROM p),
s AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(rest, '^([^/?]*)', 1), '^.*@', '')), ':(80|443)$', ''), '^www[0-9]*[.]', '') AS host, regexp_replace(rest, '^[^/?]*', '') AS tail FROM k),
c AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, h,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) % 32 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN rest = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN starts_with(tail, '/') THEN tail ELSE '/' || tail END END AS url_key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(((coalesce(page_id, 0) % 1000000000) + 1000000000) % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS captured, max(page_id) OVER (PARTITION BY h) AS original FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to,
url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS position FROM c"""


def clusters(k: int = 8, rounds: int = 10) -> str:
    """Rounds of assignment and exact floored means, one after the other."""

    def assign(r: int) -> str:
        gaps = f"g{r} AS MATERIALIZED (SELECT v.rid, c.c, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{r} c USING (i) GROUP BY v.rid, c.c)"
        return f"{gaps}, a{r} AS MATERIALIZED (SELECT rid, min({{'d': d, 'c': c}}) AS best FROM g{r} GROUP BY rid)"

    def move(r: int) -> str:
        sums = f"s{r} AS (SELECT best.c AS c, i, sum(x) AS s, count(*) AS n FROM a{r - 1} JOIN v USING (rid) GROUP BY ALL)"
        return f"{sums}, c{r} AS MATERIALIZED (SELECT c.c, i, CASE WHEN n IS NULL THEN c.x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x FROM c{r - 1} c LEFT JOIN s{r} USING (c, i))"

    steps = ", ".join(f"{assign(r - 1)}, {move(r)}" for r in range(1, rounds + 1))
    return f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT rid, i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT rid, embedding, unnest(range(1, 65)) AS i FROM e)),
f AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM e), c0 AS MATERIALIZED (SELECT c, i, x FROM f JOIN v USING (rid) WHERE c < {k}),
{steps}, {assign(rounds)}, z AS (SELECT e.vec_id, best.c AS c, best.d AS d FROM a{rounds} JOIN e USING (rid)), h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM z JOIN h USING (c)"""
