"""SQL twins of the corpus queries, for a second engine over the same tables."""

from __future__ import annotations

_ADDRESS = """
    bare AS (SELECT *, regexp_replace(regexp_replace(trim(uri), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
             FROM records),
    parts AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(bare, '^([^/?]*)', 1),
                     '^[^@]*@', '')), '^www[0-9]*\\.', ''), ':(80|443)?$', '') AS host,
                  regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
                  list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda p: p <> ''
                     AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS asked
              FROM bare),
    placed AS (SELECT *, host || path || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&')
                                              ELSE '' END AS url FROM parts)"""

ORACLE = {
    "op4_revisits": f"""
WITH first AS (
    SELECT page_id * 4 AS record_id, 'response' AS kind, url AS uri, 1704067200 + page_id * 60 AS seconds,
           CASE WHEN page_id % 13 = 7 THEN 404 ELSE 200 END AS status, md5(coalesce(html, '')) AS digest,
           CASE WHEN page_id % 5 <> 0 THEN md5(coalesce(html, '')) END AS etag,
           CASE WHEN page_id % 10 <> 0 THEN page_id::VARCHAR END AS modified,
           strlen(coalesce(html, '')) AS n, NULL::BIGINT AS k
    FROM pages),
later AS (
    SELECT page_id * 4 + 1 + k AS record_id, 'revisit' AS kind,
           CASE WHEN k = 1 THEN url || '#again'
                ELSE regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END
                     || 'utm_source=again' END AS uri,
           1704067200 + page_id * 60 + CASE WHEN k = 0 THEN -86400 ELSE k * 86400 END AS seconds,
           304 AS status, md5(coalesce(html, '')) AS digest,
           CASE WHEN page_id % 5 <> 0 THEN md5(coalesce(html, '')) || CASE WHEN (page_id + k) % 7 = 3
                THEN 'x' ELSE '' END END AS etag,
           CASE WHEN page_id % 10 <> 0 THEN page_id::VARCHAR END AS modified, 0 AS n, k
    FROM pages, (SELECT unnest([0, 1, 2]) AS k) WHERE k > 0 OR page_id % 11 = 5),
records AS (SELECT * FROM first UNION ALL SELECT * FROM later), {_ADDRESS},
earlier AS (
    SELECT r.record_id AS id, max_by(p.record_id, (p.seconds, p.record_id)) AS response
    FROM placed r JOIN placed p ON r.url = p.url AND p.seconds < r.seconds
    WHERE r.kind = 'revisit' AND p.kind = 'response' AND p.status = 200 GROUP BY 1),
told AS (
    SELECT r.*, p.record_id AS response_id, p.seconds AS response_seconds, p.digest AS said, p.etag AS tag, p.n AS bytes,
           p.modified AS changed_at, coalesce(r.etag = p.etag, r.modified = p.modified, r.digest = p.digest) AS agree
    FROM placed r LEFT JOIN earlier e ON r.record_id = e.id LEFT JOIN placed p ON p.record_id = e.response
    WHERE r.kind = 'revisit'),
judged AS (
    SELECT *, CASE WHEN url IS NULL THEN 'unplaced' WHEN response_id IS NULL THEN 'missing'
                   WHEN agree IS NULL THEN 'unchecked' WHEN agree THEN 'resolved' ELSE 'changed' END AS outcome
    FROM told)
SELECT record_id, url, seconds, outcome, response_id, response_seconds, said AS digest,
       CASE WHEN outcome IN ('resolved', 'unchecked') THEN concat_ws(chr(10),
           'cache-control: max-age=' || (k * 60), 'content-length: ' || bytes, 'content-type: text/html',
           'etag: ' || coalesce('W/' || etag, tag), 'expires: day ' || k,
           'last-modified: ' || changed_at) END AS headers
FROM judged""",
}
