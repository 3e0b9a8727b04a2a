"""DuckDB SQL that gives the results of this subpackage's queries."""

from __future__ import annotations

from . import lines, mixing, quality

KEY = "CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 15) AS BIGINT)"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def crc32_sql(column: str) -> str:
    """CRC-32 of a string's bytes, four bits at a time: the table has 16 entries made by the rule."""
    table = []
    for i in range(16):
        c = i
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    t = "[" + ", ".join(map(str, table)) + "]"
    half = lambda c, x: f"xor({c} >> 4, {t}[((xor({c}, {x})) & 15) + 1])"
    byte = f"list_reduce([c, b, b >> 4], lambda c, b: {half('c', 'b')})"
    return (
        f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(('0x' || h) AS BIGINT) for h in regexp_extract_all(hex(encode({column})), '..')]), "
        f"lambda c, b: {byte}))"
    )


def op1() -> str:
    key = KEY.format(seed="shard-1")
    return f"""
WITH base AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32,
         coalesce('s' || source, 'z') AS source_key, {key} AS key
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY key, doc_id, text_crc32, size) - 1 AS before,
         count(*) OVER (PARTITION BY source_key) AS n
  FROM base),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * before + 1) / (2 * n), source_key, before) - 1 AS position, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, (position * 16) // total AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard,
       CAST(position - (shard * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM cut"""


def op2() -> str:
    rules = list(quality.RULES.values())
    n = len(rules)
    s = quality.PRIOR_VOTES
    (gb, g0, gg), (bb, b0, bg) = quality.START_GOOD, quality.START_BAD

    def weight(j: int, cast: bool) -> str:
        """ln(share among good / share among bad) of rule j's vote or abstention."""
        value = rules[j][0]
        g, b = ((gb, bb) if value < 0 else (gg, bg)) if cast else (g0, b0)
        test = f"v{j} {'<>' if cast else '='} 0"
        return (
            f"ln(((sum(CASE WHEN {test} THEN n * q ELSE 0 END) + {s * g}) / (sum(n * q) + {s}))"
            f" / ((sum(CASE WHEN {test} THEN n * (1 - q) ELSE 0 END) + {s * b}) / (sum(n) - sum(n * q) + {s}))) AS {'c' if cast else 'a'}{j}"
        )

    start = ", ".join(
        f"ln({(gb if r[0] < 0 else gg)!r} / {(bb if r[0] < 0 else bg)!r}) AS c{j}, ln({g0!r} / {b0!r}) AS a{j}" for j, r in enumerate(rules)
    )
    score = " + ".join(f"CASE WHEN v{j} <> 0 THEN c{j} ELSE a{j} END" for j in range(n))
    ctes = [f"w0 AS (SELECT 0.0::DOUBLE AS w, {start})"]
    again = ", ".join(f"{weight(j, True)}, {weight(j, False)}" for j in range(n))
    prior = "((sum(n * q) + 1) / (sum(n) + 2))"
    for k in range(quality.ITERATIONS):
        ctes.append(f"q{k} AS (SELECT pat.*, 1 / (1 + exp(-(w + {score}))) AS q FROM pat, w{k})")
        ctes.append(f"w{k + 1} AS (SELECT ln({prior} / (1 - {prior})) AS w, {again} FROM q{k})")
    votes = ", ".join(f"CASE WHEN n_words > 0 AND ({c}) THEN {v} ELSE 0 END AS v{j}" for j, (v, c) in enumerate(rules))
    v = ", ".join(f"v{j}" for j in range(n))
    return rf"""
WITH parts AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM parts)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
repeated AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM twice, (VALUES (0), (1), (2)) d(k)) GROUP BY 1),
f AS MATERIALIZED (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
         length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals, length(t) - length(translate(t, '.!?', '')) AS n_marks,
         len(list_distinct(w)) AS n_distinct_words
  FROM parts LEFT JOIN repeated USING (doc_id)),
voted AS MATERIALIZED (SELECT *, {votes} FROM f),
pat AS MATERIALIZED (SELECT {v}, CAST(count(*) AS DOUBLE) AS n FROM voted WHERE n_words > 0 GROUP BY ALL),
{", ".join(ctes)},
known AS (SELECT pat.*, 1 / (1 + exp(-(w + {score}))) AS q FROM pat, w{quality.ITERATIONS}),
judged AS (SELECT voted.*, q, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM voted LEFT JOIN known USING ({v}))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(q >= 0.5, false) AS kept
FROM judged"""


def op6() -> str:
    n, d, share, field = lines.MIN_DOCS, lines.DEPTH, lines.SIMILARITY, lines.FIELD
    levels = []
    for k in range(lines.SPLITS + 1):
        levels.append(rf"""
s{k} AS (SELECT *, count(*) OVER (PARTITION BY node) AS of_, sum(n_rows) OVER (PARTITION BY node) AS in_all FROM e{k}),
l{k} AS MATERIALIZED (SELECT * FROM s{k} WHERE of_ > 2 AND in_all >= {n}),
t{k} AS (SELECT leaf, node, content, of_, unnest(w) AS token, unnest(range(0, len(w))) AS at_ FROM l{k}),
c{k} AS MATERIALIZED (SELECT node, of_, at_, token, count(*) AS n FROM t{k} GROUP BY ALL),
b{k} AS (
  SELECT node, at_ FROM c{k} WHERE token <> '{field}' AND n > 1 AND n < of_ QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, at_) = 1),
m{k} AS (
  SELECT t.leaf, t.node, t.content, string_agg(CASE WHEN token <> '{field}' AND 2 * n >= t.of_ THEN token ELSE '{field}' END, ' ' ORDER BY at_) AS template,
         count(*) FILTER (WHERE token <> '{field}' AND 2 * n >= t.of_) >= {share} * count(*) - 1e-9 AS enough
  FROM t{k} t JOIN c{k} c USING (node, at_, token) GROUP BY ALL),
r{k} AS MATERIALIZED (
  SELECT l.*, m.template, enough, b.at_, l.w[b.at_ + 1] AS token FROM l{k} l JOIN m{k} m USING (leaf, node, content) LEFT JOIN b{k} b USING (node)),
d{k} AS (SELECT leaf, content, CASE WHEN enough THEN template ELSE content END AS template FROM r{k} WHERE enough OR at_ IS NULL),
e{k + 1} AS MATERIALIZED (
  SELECT r.leaf, r.node || chr(1) || r.at_ || chr(1) || CASE WHEN c.n > 1 AND {lines.BRANCHES} * c.n >= r.of_ THEN r.token ELSE '' END AS node, r.content, r.w, r.n_rows
  FROM r{k} r JOIN c{k} c ON c.node = r.node AND c.at_ = r.at_ AND c.token = r.token WHERE NOT enough),""")
    settled = " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(lines.SPLITS + 1))
    return rf"""
WITH parts AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS content, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL),
tokens AS (SELECT doc_id, text, line, regexp_extract_all(content, '[^ 	-
]+') AS v FROM parts),
masked AS (SELECT *, list_transform(v, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{field}' ELSE t END) AS w FROM tokens WHERE len(v) > 0),
found AS MATERIALIZED (
  SELECT doc_id, text, line, CAST(len(w) AS VARCHAR) || ' ' || array_to_string(w[1:{d}], ' ') AS leaf, array_to_string(w, ' ') AS content, array_to_string(v, ' ') AS plain, w
  FROM masked),
e0 AS MATERIALIZED (
  SELECT leaf, leaf AS node, content, any_value(w) AS w, count(*) AS n_rows FROM found WHERE len(list_filter(w, lambda t: t <> '{field}')) > 0 GROUP BY leaf, content),
{"".join(levels)}
settled AS ({settled}),
placed AS (
  SELECT f.doc_id, f.text, f.line, f.leaf, coalesce(s.template, f.content) AS template
  FROM found f JOIN (SELECT leaf, content FROM e0) USING (leaf, content) LEFT JOIN settled s USING (leaf, content)),
recurring AS (SELECT leaf, template, min(ROW(doc_id, line)) AS first_ FROM placed GROUP BY leaf, template HAVING count(DISTINCT text) >= {n}),
passages AS (SELECT plain, min(ROW(doc_id, line)) AS first_ FROM found WHERE len(w) >= {lines.LONG_TOKENS} GROUP BY plain HAVING count(DISTINCT text) >= 2),
drops AS (
  SELECT doc_id, text, line FROM placed JOIN recurring USING (leaf, template) WHERE ROW(doc_id, line) <> first_
  UNION SELECT doc_id, text, line FROM found JOIN passages USING (plain) WHERE ROW(doc_id, line) <> first_),
clean AS (
  SELECT p.doc_id, p.text AS whole, string_agg(p.content, chr(10) ORDER BY p.line) FILTER (WHERE x.line IS NULL) AS text, count(x.line) AS n_dropped
  FROM parts p LEFT JOIN drops x ON p.doc_id = x.doc_id AND p.line = x.line AND p.text = x.text GROUP BY p.doc_id, p.text)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
       CAST(coalesce(length(c.text), 0) AS BIGINT) AS n_chars, md5(coalesce(c.text, '')) AS text_md5
FROM documents d LEFT JOIN clean c ON d.doc_id = c.doc_id AND d.text = c.whole"""


def op5() -> str:
    return """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM r JOIN pairs p ON r.b = p.a) SELECT a, min(b) AS least FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a),
out AS (SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(least(reach.least, e.vec_id), e.vec_id) AS component_id
  FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN reach ON reach.a = e.vec_id)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM out"""


def op7() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    four = " || ".join(f"substr('{letters}', ((x >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS kept FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform([CAST('0x' || substr(h, 5 * k + 1, 5) AS BIGINT) for k in range(8)], lambda x: {four}), '') AS payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM d"""


def op8() -> str:
    key = KEY.format(seed="mix-1")
    return f"""
WITH base AS (SELECT doc_id, len({WORDS}) AS size, coalesce('s' || source, 'z') AS source_key, {key} AS key FROM documents),
sizes AS (SELECT source_key, sum(size) AS source_size FROM base GROUP BY 1),
weighed AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source_key) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(most) OVER (ORDER BY most / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
filled AS (SELECT source_key, source_size, weight, most, arg_min(level, ROW(most / weight, source_key)) FILTER (WHERE level * weight <= most) OVER () AS fill FROM levels),
goals AS (SELECT source_key, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least(most, coalesce(fill, 'inf'::DOUBLE) * weight) END AS target FROM filled),
quotas AS (SELECT *, CAST(round(target) AS BIGINT) AS quota FROM goals),
words AS (SELECT CAST(sum(quota) AS BIGINT) AS words FROM quotas),
slots AS (SELECT words, k, words / k AS step FROM (SELECT words, least(words, greatest({mixing.SLOTS}, (words + {mixing.BLOCK - 1}) // {mixing.BLOCK})) AS k FROM words)),
upto AS (SELECT source_key, quota, CAST(sum(quota) OVER (ORDER BY source_key) AS BIGINT) AS upto FROM quotas),
shares AS (SELECT source_key, ceil((upto - quota)::DOUBLE / words::DOUBLE * {float(1 << mixing.POINT_BITS)}) AS from_, ceil(upto::DOUBLE / words::DOUBLE * {float(1 << mixing.POINT_BITS)}) AS to_ FROM upto, slots WHERE quota > 0),
-- van der Corput points: the bits of the slot's number in reverse
points AS (SELECT CAST(list_sum(list_transform(range(0, {mixing.POINT_BITS}), lambda i: ((k >> i) & 1) << ({mixing.POINT_BITS - 1} - i))) AS BIGINT) AS point FROM (SELECT unnest(range(0, k)) AS k FROM slots)),
given AS (SELECT source_key, count(*) AS n FROM shares JOIN points ON point >= from_ AND point < to_ GROUP BY source_key),
-- a source's slots take its first blocks
ends AS (SELECT q.*, coalesce(CAST(floor(n * step) AS BIGINT), 0) AS stop FROM quotas q LEFT JOIN given USING (source_key), slots),
streams AS (
  SELECT doc_id, size, source_key, coalesce(sum(size) OVER (PARTITION BY source_key ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM base)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
       CAST(least(size, greatest(0, stop - start)) + least(size, greatest(0, stop - source_size - start)) AS BIGINT) AS taken
FROM streams JOIN ends USING (source_key)"""


def op11() -> str:
    return f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM t),
r AS (
  SELECT c.conv_id, 0 AS part, pos, said FROM c JOIN t ON t.conv_id = base AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, said FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(said.text)) AS bytes, list(said) OVER w AS prefix
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
m AS (
  SELECT conv_id, depth, bytes, prefix FROM p
  UNION ALL SELECT conv_id, 0, 0, [] FROM c),
lengths AS (SELECT conv_id, max(depth) AS n FROM m GROUP BY 1),
v AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
         sha256(coalesce(string_agg(CASE WHEN depth = n THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM m JOIN lengths USING (conv_id) GROUP BY 1, 2),
kids AS (
  SELECT a.depth, a.prefix, count(*) AS n FROM v JOIN m a ON a.conv_id = v.conv_id AND a.depth = v.depth - 1 GROUP BY 1, 2),
w AS (
  SELECT v.*, coalesce(k.n, 0) AS n_children FROM v LEFT JOIN kids k ON k.depth = v.depth AND k.prefix = v.prefix),
sums AS (
  SELECT a.depth, a.prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w.bytes) AS saved
  FROM w JOIN m a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY 1, 2),
above AS (
  SELECT w.depth, w.prefix, u.conv_id FROM w JOIN m a ON a.conv_id = w.conv_id AND a.depth = w.depth - 1 JOIN v u ON u.depth = a.depth AND u.prefix = a.prefix)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM w JOIN sums s ON s.depth = w.depth AND s.prefix = w.prefix LEFT JOIN above u ON u.depth = w.depth AND u.prefix = w.prefix
"""


def op12() -> str:
    form = lambda name: rf"nullif(regexp_replace(translate({name}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]', '', 'g'), '')"
    some = lambda top, test: f"list_bool_or([{test} for i in range(1, {top} + 1)])"
    cut = lambda a: f"left({a}, i - 1) || substr({a}, i + 1)"
    swap = "left(a, i - 1) || substr(a, i + 1, 1) || substr(a, i, 1) || substr(a, i + 2)"
    return f"""
WITH v AS (
  SELECT vendor_id, CASE WHEN h % 2 = 0 AND length(name) > 1
           THEN left(name, h % (length(name) - 1)) || substr(name, h % (length(name) - 1) + 2, 1) || substr(name, h % (length(name) - 1) + 1, 1) || substr(name, h % (length(name) - 1) + 3)
           ELSE name END AS name
  FROM (SELECT vendor_id, name, {crc32_sql("CAST(vendor_id AS VARCHAR)")} AS h FROM vendors)),
a AS (SELECT vendor_id, {form("name")} AS a FROM v),
b AS (
  SELECT {form("name")} AS b, count(*) AS n, min(client_id) AS first, sum(coalesce({crc32_sql("CAST(client_id AS VARCHAR)")}, 0)) AS crc
  FROM clients GROUP BY 1),
d AS (
  SELECT vendor_id, n, first, crc, CASE
    WHEN a = b THEN 0
    WHEN length(a) = length(b) AND ({some("length(a)", f"({cut('a')}) = ({cut('b')})")} OR {some("length(a)", f"({swap}) = b")}) THEN 1
    WHEN length(a) = length(b) + 1 AND {some("length(a)", f"({cut('a')}) = b")} THEN 1
    WHEN length(b) = length(a) + 1 AND {some("length(b)", f"({cut('b')}) = a")} THEN 1 END AS distance
  FROM a JOIN b ON a IS NOT NULL AND b IS NOT NULL AND abs(length(a) - length(b)) <= 1)
SELECT vendor_id, CAST(distance AS INT) AS distance, CAST(sum(n) AS BIGINT) AS n_clients, min(first) AS first_client_id, CAST(sum(crc) AS BIGINT) AS clients_crc
FROM d WHERE distance IS NOT NULL GROUP BY 1, 2
"""
