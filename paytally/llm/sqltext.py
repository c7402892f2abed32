"""The results of operators as SQL, where SQL can express them."""

from __future__ import annotations

COLLOCATIONS = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
s AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT row_number() OVER () AS id, lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM s),
u AS (SELECT id, lang, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
e AS (SELECT lang, word AS a, lead(word, 1) OVER (PARTITION BY id ORDER BY pos) AS b, lead(word, 2) OVER (PARTITION BY id ORDER BY pos) AS c, lead(word, 3) OVER (PARTITION BY id ORDER BY pos) AS d FROM u),
g AS (SELECT lang, 1 AS k, a AS phrase FROM e UNION ALL SELECT lang, 2, a || ' ' || b FROM e WHERE b IS NOT NULL
 UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM e WHERE c IS NOT NULL UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d FROM e WHERE d IS NOT NULL),
c AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
q AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE k >= 2),
cut AS (SELECT q.lang, q.phrase, q.k, q.a, q.w, x.f AS l, y.f AS r, v.c, CAST(CAST(2000000 AS HUGEINT) * q.a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
 FROM q JOIN (VALUES (1), (2), (3)) AS v(c) ON v.c < q.k JOIN c AS x ON x.lang = q.lang AND x.phrase = array_to_string(q.w[1:v.c], ' ')
 JOIN c AS y ON y.lang = q.lang AND y.phrase = array_to_string(q.w[v.c + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
i AS (SELECT lang, a, n, unnest(list_transform(range(1, k - n + 2), lambda s: array_to_string(w[s:s + n - 1], ' '))) AS phrase FROM q, (VALUES (2), (3)) AS v(n) WHERE n < k),
m AS (SELECT lang, phrase, max(a) AS m FROM i GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN m USING (lang, phrase) WHERE m.m IS NULL OR 100 * CAST(m.m AS HUGEINT) < 80 * CAST(b.a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits,
 row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS r, first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS head FROM pages)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_transform(range(5), lambda j: CAST(substr(bits, 1 + 5 * i + j, 1) AS INTEGER)), lambda x, y: 2 * x + y), 1)), '') AS payload_digest,
CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN head END AS refers_to FROM p
"""

FILL_MIDDLE = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
d AS (SELECT *, CAST('0x' || substr(x, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS UBIGINT) AS h2,
  CAST('0x' || substr(x, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS UBIGINT) AS h4 FROM h),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, CAST(least(h1 % (n+1), h2 % (n+1)) AS BIGINT) AS a, CAST(greatest(h1 % (n+1), h2 % (n+1)) AS BIGINT) AS b FROM d),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
 sha256(text) AS restored_sha256 FROM p
"""

def _words(text: str) -> str:
    """List of a text's words in lower case."""
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(regexp_split_to_array({lower}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


_LEADS = ", ".join(f"lead(word, {i}) OVER (PARTITION BY rid ORDER BY pos) AS w{i}" for i in range(1, 10))
_GRAMS = " UNION ALL ".join(
    f"SELECT rid, pos, {s} AS s, {" || ' ' || ".join(['word', *[f'w{i}' for i in range(1, s)]])} AS g FROM e"
    + (f" WHERE w{s - 1} IS NOT NULL" if s > 1 else "") for s in range(1, 11))

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words('text')} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS w FROM benchmark),
k AS (SELECT item, w, least(len(w), 10) AS s FROM i WHERE len(w) > 0 AND item IS NOT NULL),
v AS (SELECT DISTINCT item, s, array_to_string(w[p:p + s - 1], ' ') AS g
 FROM (SELECT item, w, s, unnest(range(1, len(w) - s + 2)) AS p FROM k)),
u AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
e AS (SELECT rid, pos, word, {_LEADS} FROM u),
n AS ({_GRAMS}),
h AS (SELECT n.rid, n.pos, n.s, v.item FROM n JOIN v ON n.s = v.s AND n.g = v.g),
c AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(pos, pos + s)) AS p FROM h) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS items
 FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN m USING (rid)
"""

ORACLE = {"op9_prefix_join": DECONTAMINATION, "op11_collocations": COLLOCATIONS, "op12_warc": WARC, "op13_fill_middle": FILL_MIDDLE}
