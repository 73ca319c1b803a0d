"""SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from . import licenses, queries, secrets, sharding

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_text(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


# -- op2: each level shares its parents' budgets; the path of a node stands for it.


def _level(depth: int) -> str:
    path, given = queries.mixing.LEVELS[:depth], {k: w for k, w in queries.WEIGHTS.items() if len(k) == depth}
    same = lambda key: " AND ".join(f"{p} = {_text(v)}" for p, v in zip(path, key))
    weight = "CASE " + " ".join(f"WHEN {same(k)} THEN {w}" for k, w in given.items()) + " ELSE 1 END" if given else "1"
    up, name, above = ", ".join(path[:-1]), path[-1], f"s{depth - 1}"
    budget = f"(SELECT quota FROM {above} a WHERE " + " AND ".join(f"a.{p} IS NOT DISTINCT FROM n.{p}" for p in path[:-1]) + ")" if depth > 1 else "(SELECT budget FROM total)"
    by = f"PARTITION BY {up} " if up else ""
    before = f"({by}ORDER BY cap / weight NULLS LAST, {name} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    upto = f"({by}ORDER BY cap / weight NULLS LAST, {name} NULLS FIRST ROWS UNBOUNDED PRECEDING)"
    return f"""n{depth} AS (SELECT {', '.join(path)}, sum(cap)::HUGEINT AS cap, ({weight})::HUGEINT AS weight FROM leaves GROUP BY {', '.join(path)}),
b{depth} AS (SELECT *, {budget}::HUGEINT AS budget FROM n{depth} n),
f{depth} AS (SELECT *, cap * (sum(weight) OVER ({by}) - coalesce(sum(weight) OVER {before}, 0)) <= weight * (budget - coalesce(sum(cap) OVER {before}, 0)) AS filled FROM b{depth}),
r{depth} AS (SELECT *, budget - coalesce(sum(cap) FILTER (filled) OVER ({by}), 0) AS rest, sum(weight) FILTER (NOT filled) OVER ({by}) AS weights, sum(weight) FILTER (NOT filled) OVER {upto} AS upto FROM f{depth}),
s{depth} AS (SELECT *, CASE WHEN filled THEN cap ELSE upto::HUGEINT * rest::HUGEINT // weights::HUGEINT - (upto - weight)::HUGEINT * rest::HUGEINT // weights::HUGEINT END AS quota FROM r{depth})"""


_MIX = f"""
WITH d AS (SELECT doc_id, lang, source, [{', '.join(map(_text, queries.DOMAINS))}][coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), '') AS INTEGER), 0) % {len(queries.DOMAINS)} + 1] AS domain,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS document FROM documents),
total AS (SELECT floor(sum(tokens) * {queries.FRACTION}::DOUBLE)::BIGINT AS budget FROM d),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens, sum(tokens) * {queries.EPOCHS} AS cap FROM d GROUP BY ALL),
{_level(1)},
{_level(2)},
{_level(3)},
plan AS (SELECT l.domain, l.lang, l.source, CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END AS whole, quota - CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END * tokens AS rest
  FROM leaves l JOIN s3 ON l.domain IS NOT DISTINCT FROM s3.domain AND l.lang IS NOT DISTINCT FROM s3.lang AND l.source IS NOT DISTINCT FROM s3.source),
keyed AS (SELECT d.*, whole, rest, md5('{queries.SEED}:' || whole::BIGINT || ':' || document) AS key FROM d JOIN plan p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM keyed)
SELECT doc_id, domain, lang, source, unnest(range((whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT)) AS epoch FROM run"""


# -- op3: five hexadecimal digits are four digits of base 32.

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, {5 * k + 1}, 5))::INTEGER >> {shift}) & 31) + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))
_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f"""


# -- op5: positions from the pieces between the matches.


def _secret(rank: int, rule: secrets.Rule) -> str:
    regex = _text(rule.regex)
    return f"""SELECT r, {rank} AS rank, '{rule.kind}' AS kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS size FROM
  (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, string_split_regex(t, {regex}) AS p, regexp_extract_all(t, {regex}) AS m, regexp_extract_all(t, {regex}, {rule.group}) AS g FROM d WHERE regexp_matches(t, {regex}))) WHERE length(g[i]) >= {rule.least}"""


_RULES = [*secrets.BASE, *secrets.MORE]
_SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(_secret(i, r) for i, r in enumerate(_RULES))}),
j AS (SELECT *, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM s),
a AS (SELECT r, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)}, string_agg(span, ',' ORDER BY start, rank, size) FILTER (rank < {len(secrets.BASE)}) AS base, string_agg(span, ',' ORDER BY start, rank, size) AS spans FROM j GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}' for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""


# -- op6: one step for each large group, one for each size of the others.

_SHARDS = 16
_STEP = f"list_sort(flatten(list_transform(range({_SHARDS}), lambda s: list_transform(range(n), lambda k: {{'load': loads[s + 1] + k * size, 'shard': s}}))))[1:n]"
_SHARDING = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, strlen(t) + 1 AS size, md5(t) AS g, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(t)) AS row_key, t FROM d),
least AS (SELECT ceil(sum(size) / {_SHARDS * sharding.EXACT}) AS least FROM m), groups AS (SELECT g, sum(size)::BIGINT AS bytes FROM m GROUP BY g),
kinds AS (SELECT bytes AS size, CASE WHEN bytes >= least THEN g END AS one, count(*) AS n FROM groups, least GROUP BY ALL),
steps AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY one IS NULL, size DESC, one) AS step FROM kinds),
deal(step, loads, got) AS (SELECT 0::BIGINT, list_transform(range({_SHARDS}), lambda x: 0::BIGINT), NULL::BIGINT[]
  UNION ALL SELECT step, list_transform(range({_SHARDS}), lambda s: loads[s + 1] + size * got[s + 1]), got FROM
    (SELECT s.step, loads, size, list_transform(range({_SHARDS}), lambda s: len(list_filter(dealt, lambda x: x.shard = s))) AS got FROM
      (SELECT steps.step, loads, size, {_STEP} AS dealt FROM deal JOIN steps ON steps.step = deal.step + 1) s)),
runs AS (SELECT step, list_transform(range(1, {_SHARDS} + 1), lambda i: list_sum(got[1:i])) AS ends FROM deal WHERE step > 0),
ranked AS (SELECT g, step, row_number() OVER (PARTITION BY step ORDER BY g) - 1 AS rank FROM groups JOIN steps ON size = bytes AND (one IS NULL OR one = g)),
homes AS (SELECT g, len(list_filter(ends, lambda e: e <= rank))::INTEGER AS shard FROM ranked JOIN runs USING (step)),
bits AS (SELECT list_transform(range(256), lambda v: list_reduce([v, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table),
sums AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(t)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT g, t, hex(encode(t)) AS h FROM m), bits)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY row_key) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM m JOIN homes USING (g) JOIN sums USING (g)"""


# -- op7

_TEMPLATE = [(k, label, i, w) for k, (label, t, _) in enumerate(licenses.TEMPLATES) for i, w in enumerate(t.split())]
_KEYS = []
for _k, (_, _t, _key) in enumerate(licenses.TEMPLATES):
    _w, _kw = _t.split(), _key.split()
    _at = next(i for i in range(len(_w)) if _w[i : i + len(_kw)] == _kw)
    _KEYS += [(_k, _at + i, w) for i, w in enumerate(_kw)]


def _phrase(phrase: str, label: str) -> str:
    words = phrase.split()
    joins = " ".join(f"JOIN u u{i} ON u{i}.r = u0.r AND u{i}.pos = u0.pos + {i} AND u{i}.word = {_text(w)}" for i, w in enumerate(words[1:], 1))
    return f"SELECT u0.r, u0.pos, {_text(label)} AS label FROM u u0 {joins} WHERE u0.word = {_text(words[0])}"


_LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
u AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
t(template, label, spot, word) AS {_values(_TEMPLATE)}, k(template, spot, word) AS {_values(_KEYS)},
kt AS (SELECT *, count(*) OVER (PARTITION BY template) AS total FROM k), tt AS (SELECT *, count(*) OVER (PARTITION BY template) AS total FROM t),
have AS (SELECT word, count(DISTINCT r) AS n FROM u JOIN (SELECT DISTINCT word FROM t) USING (word) GROUP BY word),
rare AS (SELECT template, word FROM (SELECT DISTINCT template, word, n FROM t JOIN have USING (word)) QUALIFY row_number() OVER (PARTITION BY template ORDER BY n, word) <= {licenses.POSTED}),
posted AS (SELECT template, spot, word, count(*) OVER (PARTITION BY template) AS posted FROM t JOIN rare USING (template, word)),
likely AS (SELECT r, template, pos - spot AS place FROM u JOIN posted USING (word) GROUP BY ALL HAVING count(*) >= greatest({licenses.LEAST}, ceil({licenses.SHARE} * any_value(posted)))),
keyed AS (SELECT r, template, place FROM likely JOIN kt USING (template) JOIN u USING (r, word) WHERE pos = place + spot GROUP BY r, template, place HAVING count(*) = any_value(total)),
shares AS (SELECT r, template, place, label, count(*) / any_value(total) AS share FROM keyed JOIN tt USING (template) JOIN u USING (r, word) WHERE pos = place + spot GROUP BY r, template, place, label),
base AS ({' UNION ALL '.join(_phrase(p, label) for p, label in licenses.PHRASES.items())}),
b AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM shares) GROUP BY r),
s AS (SELECT r, max(share) AS share FROM shares GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
coalesce(share, CASE WHEN n_base > 0 THEN 0.5 END, 0)::DOUBLE AS score FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r) LEFT JOIN s USING (r)"""


SQL = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, size, w[p:p + size - 1] AS k FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM i)),
dw AS (SELECT doc_id, size, p, w[p:p + size - 1] AS k FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
hit AS (SELECT doc_id, p, dw.size, item_id FROM dw JOIN iw USING (size, k)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op2_mixing": _MIX,
    "op3_warc": _WARC,
    "op5_secrets": _SECRETS,
    "op6_sharding": _SHARDING,
    "op7_licenses": _LICENSES,
}
