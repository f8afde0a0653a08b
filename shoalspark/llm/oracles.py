"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import secrets

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, i, md5_number(array_slice(b, i, i + 199)) AS h FROM d, unnest(range(1, octet_length(b) - 198)) AS u(i) WHERE octet_length(b) >= 200),
k AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
p AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM w SEMI JOIN k USING (h)),
s AS (SELECT rid, g, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS g FROM p) GROUP BY 1, 2),
g AS (SELECT rid, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last FROM s GROUP BY 1),
q AS (SELECT rid, g, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY g), 1) AS a, lo AS z FROM s UNION ALL SELECT rid, 1000000000, last, 2147483647 FROM g),
e AS (SELECT rid, string_agg(hex(array_slice(b, a, z - 1)), '' ORDER BY q.g) AS kept FROM q JOIN d USING (rid) GROUP BY 1)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN kept IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM d LEFT JOIN g USING (rid) LEFT JOIN e USING (rid)
"""

OP7 = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, row_number() OVER () AS rid, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
g AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.rid <> b.rid
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""

_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
k AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
z AS (SELECT DISTINCT n FROM k),
x AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, z, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS u(i)),
m AS (SELECT rid, i, k.n, item FROM x JOIN k ON x.n = k.n AND x.g = k.g),
h AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM m) GROUP BY 1),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""

#: CRC-32 of the decimal digits of ``{x}``, by a table made from its polynomial.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({x}::VARCHAR, ''), lambda k: ascii(k)::BIGINT)), lambda c, k: xor(c >> 8, t[(xor(c, k) & 255) + 1])), 4294967295)"
_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
_DAY = "86400000000"


def _used(time: str, h: str) -> str:
    us = f"epoch_us({time})"
    return f"CASE WHEN {h} % 2 = 1 THEN {us} - (({us} % {_DAY}) + {_DAY}) % {_DAY} ELSE {us} END"


OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]') AS w, list_transform(range(4), lambda k: ('0x' || substr(h, k * 8 + 1, 8))::BIGINT) AS h FROM d),
c AS (SELECT doc_id, x, w, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT doc_id, x, n, form, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256
FROM p
"""

OP12 = f"""
WITH {_TABLE},
k AS (SELECT click_id, client_id, {_used("ts", "h")} AS ts_us FROM (SELECT click_id, min(client_id) AS client_id, min(ts) AS ts, {_CRC.format(x="click_id")} AS h FROM clicks, crc GROUP BY click_id, t)),
s AS (SELECT client_id, sale_id, priority, floor(100 * total + 0.5)::BIGINT AS cents, {_CRC.format(x="sale_id")} AS h, sold_at FROM sales, crc),
f AS (SELECT client_id, sale_id, priority, cents, h, {_used("sold_at", "h")} AS z FROM s),
o AS (SELECT client_id, sale_id, priority, cents, z FROM f UNION ALL SELECT client_id, -1 - sale_id, 6 - priority, cents, z FROM f WHERE h % 3 <> 0),
u AS (SELECT client_id, z, sale_id, cents, count(*) OVER (PARTITION BY client_id, z) AS n FROM o WHERE client_id IS NOT NULL AND z IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY client_id, z ORDER BY priority DESC NULLS LAST, sale_id NULLS LAST) = 1),
m AS (SELECT k.*, u.z, u.sale_id, u.cents, u.n, k.ts_us - u.z <= 72 * 3600000000 AS near FROM k ASOF LEFT JOIN u ON k.client_id = u.client_id AND k.ts_us >= u.z)
SELECT click_id, client_id, ts_us, CASE WHEN near THEN sale_id END AS sale_id, CASE WHEN near THEN ts_us - z END AS lag_us, CASE WHEN near THEN cents END AS total_cents, CASE WHEN near THEN n ELSE 0 END::BIGINT AS n_tied FROM m
"""

SQL = {"op2_suffix_dedup": OP2, "op7_embedding_neardup": OP7, "op8_secret_scan": secrets.ORACLE, "op9_minhash_neardup": OP9, "op10_decontaminate": OP10, "op11_fill_in_middle": OP11, "op12_asof_join": OP12}
