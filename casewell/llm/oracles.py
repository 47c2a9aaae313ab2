"""DuckDB SQL for the queries of this subpackage that SQL can express, over whole tables."""

from __future__ import annotations

from . import secrets, url_filter

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP4 = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight FROM sized GROUP BY source),
caps AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS full_at FROM src),
lev AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(weight) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
tgt AS (SELECT source, source_size, least(cap, weight * coalesce(max(CASE WHEN level <= full_at THEN level END) OVER (), 'inf'::DOUBLE)) AS target FROM lev),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN (floor(target)::BIGINT // source_size) ELSE 0 END AS epochs FROM tgt),
pre AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 15))::BIGINT, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM sized),
cut AS (SELECT pre.doc_id, pre.source, pre.size, source_size, target, epochs, greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - (upto - size)))::BIGINT AS part
   FROM pre JOIN plan ON pre.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, source, size, source_size, target, epochs::BIGINT AS epochs, part, (epochs * size + part)::BIGINT AS taken FROM cut
"""

OP8 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP7 = """
WITH l AS (SELECT source, list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x)) > 0)) AS lines FROM documents),
n AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY 1),
c AS (SELECT source, line, count(*) AS pages FROM (SELECT source, unnest(lines) AS line FROM l) GROUP BY 1, 2),
bad AS (SELECT c.source, list(line) AS lines FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE pages >= greatest(2, least(5, host_pages)) AND pages > 0.005 * host_pages GROUP BY 1),
d AS (SELECT doc_id, d.source, string_split(coalesce(text, ''), chr(10)) AS lines, coalesce(bad.lines, []) AS bad FROM documents d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source),
k AS (SELECT *, list_filter(lines, lambda x: length(trim(x)) = 0 OR NOT list_contains(bad, x)) AS kept FROM d)
SELECT doc_id, source, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, sha256(array_to_string(kept, chr(10))) AS clean_sha256 FROM k
"""


#: The contract's rules, stated again: host, path, verdict, longest first.
HOST_RULES = (("example.com", "/de/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"), ("net", "/", "block"))


def op5() -> str:
    """Host and path by splitting, host rules by string functions, patterns as globs."""
    fit = {f"{h}{p}": f"(host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(p)})" for h, p, _ in HOST_RULES}
    rule = " ".join(f"WHEN {c} THEN {quoted(n)}" for n, c in fit.items())
    verdict = " ".join(f"WHEN rule = {quoted(h + p)} THEN {quoted(v)}" for h, p, v in HOST_RULES)
    pattern = lambda text: "*" + "".join({"^": "[!a-z0-9]", "*": "*", "?": "[?]"}.get(c, c.lower()) for c in text) + "*"
    fits = {v: " OR ".join(f"padded GLOB {quoted(pattern(r.text))}" for r in url_filter.read_rules() if r.verdict == v) for v in ("allow", "block")}
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS after FROM pages),
h AS (SELECT *, split_part(split_part(split_part(after, '/', 1), '?', 1), '#', 1) AS raw FROM u),
p AS (SELECT page_id, after IS NOT NULL AS good, coalesce(translate(raw, '{UPPER}', '{UPPER.lower()}'), '') AS host, coalesce(substr(after, length(raw) + 1), '') AS tail FROM h),
s AS (SELECT *, split_part(split_part(tail, '?', 1), '#', 1) AS path, ' ' || translate(host || tail, '{UPPER}', '{UPPER.lower()}') || ' ' AS padded FROM p),
r AS (SELECT *, CASE WHEN NOT good THEN NULL {rule} END AS rule FROM s)
SELECT page_id, host, path, rule, CASE {verdict} WHEN NOT good THEN 'allow' WHEN {fits["allow"]} THEN 'allow' WHEN {fits["block"]} THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


def op2() -> str:
    return rf"""
WITH v AS (SELECT page_id AS i, url, html, unnest([0, 1, 2, 3]) AS v FROM pages),
k AS (SELECT *, v = 0 OR (v = 2 AND i % 4 = 0) AS "full", (CASE WHEN v >= 2 AND i % 4 = 0 THEN 1 ELSE 0 END) + (CASE WHEN v = 3 AND i % 11 = 5 THEN 5 ELSE 0 END) AS version FROM v),
raw AS (SELECT url, i * 4 + v AS record_id, CASE WHEN "full" THEN 'response' ELSE 'revisit' END AS kind, i + v::BIGINT * 1000000000 AS ts,
  CASE WHEN i % 7 <> 0 THEN (CASE WHEN "full" THEN '' ELSE 'W/' END) || '"v' || version::VARCHAR || '"' END AS etag, CASE WHEN i % 5 >= 2 THEN 'day ' || version::VARCHAR END AS modified,
  CASE WHEN "full" THEN sha256(coalesce(html, '')) END AS digest, contains(url, '://') AS good, regexp_extract(url, '(?s)^.*?://([^#]*)', 1) AS rest FROM k),
parts AS (SELECT *, regexp_replace(regexp_replace(translate(regexp_extract(rest, '^([^/?]*)', 1), '{UPPER}', '{UPPER.lower()}'), '^www\.', ''), CASE lower(split_part(url, '://', 1)) WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '$^x' END, '') AS host,
  rtrim(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/') AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '(?s)^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT list_contains(['gclid', 'fbclid', 'phpsessid', 'jsessionid'], lower(split_part(x, '=', 1))))) AS query FROM raw),
r AS (SELECT *, CASE WHEN good THEN host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canonical FROM parts),
a AS (SELECT *, max(CASE WHEN kind = 'response' THEN [ts, record_id] END) OVER (PARTITION BY canonical ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r),
m AS (SELECT a.*, b.record_id AS b_id, b.digest AS b_digest, b.etag AS b_etag, regexp_replace(a.etag, '^\s*W/', '') = regexp_replace(b.etag, '^\s*W/', '') AS same_etag, a.modified = b.modified AS same_day
  FROM a LEFT JOIN r b ON a.kind = 'revisit' AND a.canonical IS NOT NULL AND b.kind = 'response' AND b.canonical = a.canonical AND b.ts = a.best[1] AND b.record_id = a.best[2]),
s AS (SELECT *, CASE WHEN kind = 'response' THEN 'response' WHEN b_id IS NULL THEN 'orphan' WHEN NOT coalesce(same_etag, true) OR NOT coalesce(same_day, true) THEN 'conflict'
  WHEN same_etag IS NOT NULL OR same_day IS NOT NULL THEN 'resolved' ELSE 'unchecked' END AS state FROM m)
SELECT record_id, canonical, kind, state, CASE WHEN kind = 'response' THEN record_id WHEN state IN ('resolved', 'unchecked') THEN b_id END AS resolved_id,
  CASE WHEN kind = 'response' THEN digest WHEN state IN ('resolved', 'unchecked') THEN b_digest END AS resolved_digest,
  CASE WHEN state IN ('response', 'resolved', 'unchecked') THEN 'content-type=text/html;date=' || ts::VARCHAR || ';etag=' || coalesce(etag, CASE WHEN kind = 'revisit' THEN b_etag END, '') END AS resolved_headers FROM s
"""


def op10() -> str:
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    parts = []
    for i, r in enumerate(rules):
        p = quoted(r.regex)
        parts.append(
            f"SELECT doc_id, row_no, {i} AS rank, {quoted(r.kind)} AS kind, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS hits,"
            f" regexp_extract_all(t, {p}, {r.group}) AS parts, {r.least} AS least FROM t WHERE regexp_matches(t, {p})"
        )
    base = len(secrets.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (rank = {i})::BIGINT AS n_{r.kind}" for i, r in enumerate(secrets.BASE_RULES))
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
i AS (SELECT *, unnest(generate_series(1, len(hits))) AS k FROM m),
s AS (SELECT row_no, rank, kind, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS s, length(hits[k]) AS n FROM i WHERE length(parts[k]) >= least),
j AS (SELECT *, kind || ':' || s::BIGINT::VARCHAR || ':' || (s + n)::BIGINT::VARCHAR AS span FROM s),
g AS (SELECT row_no, {counts}, array_to_string(list(span ORDER BY s, rank) FILTER (rank < {base}), ',') AS base, array_to_string(list(span ORDER BY s, rank), ',') AS spans FROM j GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (row_no)
"""


#: CRC-32 of a blob's bytes by its table of 256 entries, made from the reflected polynomial.
CRC_TABLE = "crc AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i))"


def crc32(blob: str) -> str:
    """An expression over a row that also has ``tab``."""
    hexed = f"hex({blob})"
    each = f"list_transform(range(1, length({hexed}) + 1, 2), lambda p: ('0x' || substr({hexed}, p, 2))::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || {each}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"


def op11() -> str:
    return f"""
WITH {CRC_TABLE},
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32("encode(conv_id::VARCHAR)")} % 9 AS h, n FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY 1), crc),
b AS (SELECT c.*, least(h, coalesce(d.n, 0)) AS taken FROM c LEFT JOIN (SELECT conv_id AS base, n FROM c) d USING (base)),
r AS (SELECT b.conv_id, place AS depth, role, text FROM b JOIN o ON o.conv_id = base AND place <= h
  UNION ALL SELECT b.conv_id, taken + place - h, role, text FROM b JOIN o ON o.conv_id = b.conv_id AND place > h),
whole AS (SELECT b.conv_id, coalesce(list(struct_pack(role, text) ORDER BY depth) FILTER (depth IS NOT NULL), []) AS turns FROM b LEFT JOIN r USING (conv_id) GROUP BY 1),
p AS (SELECT conv_id, len(turns) AS len, d AS depth, turns[1:d] AS prefix, turns[1:d - 1] AS before FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM whole)),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(before) AS before, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth) AS ends,
  (count(*) - 1) * coalesce(octet_length(encode(any_value(prefix)[depth].text)), 0) AS saved FROM p GROUP BY 1, 2),
k AS (SELECT depth - 1 AS depth, before AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, prefix)),
s AS (SELECT a.depth, a.prefix, count(*) FILTER (z.n_children = 0) AS n_leaves, sum(z.saved) AS saved_tokens FROM f z JOIN p ON p.conv_id = z.conv_id AND p.depth <= z.depth JOIN f a ON a.depth = p.depth AND a.prefix = p.prefix GROUP BY 1, 2)
SELECT f.conv_id, f.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN s USING (depth, prefix) LEFT JOIN f m ON m.depth = f.depth - 1 AND m.prefix = f.before
"""


def op12() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS row_no, doc_id, {words} AS words FROM documents),
w AS (SELECT row_no, unnest(words) AS word FROM d),
t AS (SELECT unnest({words}) AS word FROM benchmark),
h AS (SELECT word, {crc32("encode(word)")} % 10000 AS bucket FROM (SELECT word FROM w UNION SELECT word FROM t), crc),
s AS (SELECT bucket, count(*) AS s FROM w JOIN h USING (word) GROUP BY 1),
q AS (SELECT bucket, count(*) AS t FROM t JOIN h USING (word) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM w) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN q USING (bucket)),
m AS (SELECT row_no, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM w JOIN h USING (word) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN m USING (row_no)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM r
"""


ORACLES = {"op11_prefix_trie": op11(), "op12_resample": op12(), "op2_warc_revisits": op2(), "op4_mix_sources": OP4, "op5_url_filter": op5(), "op7_line_dedup": OP7, "op8_exact_dedup": OP8, "op10_secret_scan": op10()}
