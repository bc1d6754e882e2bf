"""What the training-data queries return, as DuckDB SQL, where SQL can say it."""
from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT s.doc_id, len(s.s) AS n_shingles, min(reach.b) AS component_id FROM s JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, len(s.s)"""

_WORDS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT item, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda k: w[k:k + 9])) AS t FROM i WHERE len(w) > 0),
wins AS (SELECT t, list(DISTINCT item) AS items FROM win GROUP BY t),
pos AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
df AS (SELECT x, count(*) AS n FROM pos GROUP BY x),
rare AS (SELECT t, items, arg_min(x, (n, x)) AS x, list(x) AS seen FROM (SELECT t, items, unnest(list_distinct(t)) AS x FROM wins) JOIN df USING (x) GROUP BY t, items),
cand AS (SELECT d.doc_id, t, items, p, d.w FROM rare JOIN pos USING (x) JOIN d ON d.doc_id = pos.doc_id WHERE len(seen) = len(list_distinct(t))),
exact AS (SELECT DISTINCT doc_id, t, items, unnest(list_filter(range(greatest(1, p - len(t) + 1), p + 1), lambda s: w[s:s + len(t) - 1] = t)) AS s FROM cand),
close_ AS (SELECT DISTINCT doc_id, t, items FROM cand WHERE len(list_filter(range(greatest(1, p - len(t) - 4), p + 1), lambda s: list_has_all(w[s:s + len(t) + 4], t))) > 0),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + len(t))) AS p FROM exact) GROUP BY doc_id),
ei AS (SELECT DISTINCT doc_id, unnest(items) AS item FROM exact),
ni AS (SELECT DISTINCT doc_id, unnest(items) AS item FROM close_ ANTI JOIN exact USING (doc_id, t)),
es AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM ei GROUP BY doc_id),
ns AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, item FROM ni EXCEPT SELECT doc_id, item FROM ei) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(es.n, 0) AS n_items, coalesce(ns.n, 0) AS n_near, sha256(coalesce(es.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN es USING (doc_id) LEFT JOIN ns USING (doc_id)"""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, least length of a match (of the second group for assign)
_RULES = (("assign", _ASSIGN, 6), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24), ("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 1), ("git_token", "gh[pousr]_[A-Za-z0-9]+", 40), ("chat_token", "xox[abprs]-[A-Za-z0-9-]+", 15))


def _spans(k: int, kind: str, pattern: str, least: int) -> str:
    """Where the matches of a rule stand: behind the gaps and matches before them."""
    value = f"regexp_extract(hits[i], '{pattern}', 2)" if kind == "assign" else "hits[i]"
    return f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, a, a + len AS e FROM (SELECT doc_id, i, length({value}) AS size, length(hits[i]) AS len, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a
FROM (SELECT doc_id, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits FROM d WHERE regexp_matches(t, '{pattern}')))) WHERE size >= {least}"""


OP6 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_spans(k, *rule) for k, rule in enumerate(_RULES))}),
told AS (SELECT doc_id, k, a, kind || ':' || a::BIGINT || ':' || e::BIGINT AS s FROM found),
agg AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, string_agg(s, ',' ORDER BY a, k) FILTER (WHERE k < 3) AS base, string_agg(s, ',' ORDER BY a, k) AS spans FROM told GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN agg USING (doc_id)"""


def _lloyd(rounds: int = 6) -> str:
    """Rounds of assignment and update over the distinct parts d (p, x, n); books b0, b1, ... (p, e, c)."""
    near = "a{k} AS MATERIALIZED (SELECT p, x, n, arg_min(e, (g, e)) AS e, min(g) AS g FROM (SELECT d.p, x, n, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS g FROM d JOIN b{k} b ON b.p = d.p) GROUP BY p, x, n)"
    means = "m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT p, e, i, CAST(sum(n * x[i]) AS BIGINT) AS s, CAST(sum(n) AS BIGINT) AS n FROM a{k}, range(1, (SELECT any_value(len(x)) FROM d) + 1) t(i) GROUP BY p, e, i) GROUP BY p, e)"
    update = "b{j} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e)"
    steps = [", ".join((near.format(k=k), means.format(k=k), update.format(k=k, j=k + 1))) for k in range(rounds)]
    return ",\n".join([*steps, near.format(k=rounds)])


OP11 = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT max(len(v)) // 8 AS w FROM kept),
parts AS MATERIALIZED (SELECT r, p, v[p * w + 1:(p + 1) * w] AS x FROM kept, w, range(8) t(p)),
d AS MATERIALIZED (SELECT p, x, count(*) AS n FROM parts GROUP BY p, x),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v[p * w + 1:(p + 1) * w] AS c FROM (SELECT vec_id, v FROM kept ORDER BY vec_id LIMIT 16), w, range(8) t(p)),
{_lloyd()},
coded AS (SELECT r, string_agg(printf('%02x', a.e), '' ORDER BY a.p) AS code, CAST(sum(a.g) AS BIGINT) AS error FROM parts JOIN a6 a ON a.p = parts.p AND a.x = parts.x GROUP BY r),
labels AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM kept JOIN coded USING (r) GROUP BY label),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b6)
SELECT vec_id, code, error, label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r) JOIN labels ON labels.label IS NOT DISTINCT FROM kept.label, books"""


def _rule(host: str, path: str) -> str:
    """Which of the contract's rules fits, the longest first."""
    fits = lambda of, at: f"(({host} = '{of}' OR ends_with({host}, '.{of}')) AND starts_with({path}, '{at}'))"
    rules = (("example.net", "/en/"), ("example.com", "/de/"), ("org", "/fr/"), ("net", "/"))
    return "CASE " + " ".join(f"WHEN {fits(of, at)} THEN '{of}{at}'" for of, at in rules) + " END"


def _host(url: str) -> str:
    return _LOWER.format(rf"regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1)")


def _path(url: str) -> str:
    return rf"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _form(url: str) -> str:
    kept = rf"list_filter(string_split(regexp_extract({url}, '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|gclid|fbclid|ref)(=|$)'))"
    return rf"CASE WHEN {_host(url)} <> '' THEN md5({_host(url)} || regexp_replace({_path(url)}, '/+$', '') || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END) END"


_VERDICT = "CASE WHEN {r} IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN {r} IS NOT NULL THEN 'block' END"
_QUOTED = r"""\s*=\s*(?:"\s*([^"]*)|''\s*([^'']*)|([^\s"''>]+))"""

OP12 = rf"""
WITH RECURSIVE p AS MATERIALIZED (SELECT row_number() OVER () AS r, page_id, url, html, {_host("url")} AS host, {_path("url")} AS path, {_form("url")} AS node FROM pages),
tag AS (SELECT r, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS t FROM p WHERE host <> ''),
raw AS (SELECT r, replace(trim(CASE WHEN regexp_matches(t, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b') THEN concat(regexp_extract(t, '(?is)\bhref{_QUOTED}', 1), regexp_extract(t, '(?is)\bhref{_QUOTED}', 2), regexp_extract(t, '(?is)\bhref{_QUOTED}', 3))
  WHEN regexp_matches(t, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(t, '(?is)\burl\s*=\s*["'']?\s*([^"''>\s]+)', 1) END), '&amp;', '&') AS x FROM tag),
url2 AS (SELECT r, node, CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN x WHEN x = '' OR starts_with(x, '#') OR regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(x, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || x
  WHEN starts_with(x, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || x WHEN starts_with(x, '?') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || path || x ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || regexp_replace('/' || ltrim(path, '/'), '[^/]*$', '') || x END AS u FROM raw JOIN p USING (r) WHERE x IS NOT NULL),
link AS (SELECT node, {_form("u")} AS e, {_rule(_host("u"), _path("u"))} AS rule FROM url2 WHERE u IS NOT NULL),
edge AS (SELECT node AS a, e AS b FROM link WHERE e IS NOT NULL UNION SELECT e, node FROM link WHERE e IS NOT NULL),
ruled AS (SELECT *, {_rule("host", "path")} AS rule FROM p),
said AS (SELECT node, {_VERDICT.format(r="rule")} AS v FROM ruled WHERE node IS NOT NULL UNION ALL SELECT e, {_VERDICT.format(r="rule")} FROM link WHERE e IS NOT NULL),
reach AS (SELECT DISTINCT node AS a, node AS b FROM said UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
told AS (SELECT a, min(b) AS cls, bool_or(v = 'allow') AS allow, bool_or(v = 'block') AS block FROM reach JOIN said ON said.node = reach.b GROUP BY a)
SELECT page_id, host, path, rule, coalesce({_VERDICT.format(r="rule")}, CASE WHEN block AND NOT coalesce(allow, FALSE) THEN 'block' ELSE 'allow' END) AS verdict, cls AS alias_class FROM ruled LEFT JOIN told ON told.a = ruled.node"""


def _tree(name: str, leaves: str, levels: int) -> str:
    """Levels 0, 1, ... over leaves (g, i, h): nodes with the size n of their tree and what stands left and right in their run (null where a node is its whole tree)."""
    run = "OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
    out = []
    for k in range(levels + 1):
        src = leaves if not k else f"SELECT g, j AS i, h FROM (SELECT g, i // 16 AS j, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {name}{k - 1} GROUP BY g, n, i // 16)"
        side = lambda frame: f"CASE WHEN n > 1 THEN coalesce(string_agg(h, '') {run} {frame}), '') END"
        out.append(f"{name}{k} AS MATERIALIZED (SELECT g, i, h, n, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM ({src})))")
    return ",\n".join(out)


def _climb(name: str, start: str, levels: int) -> str:
    """From start (q, g, i, now, sib) up a tree: what a row folds to and its siblings so far."""
    up = "{name}up{j} AS MATERIALIZED (SELECT c.q, c.g, c.i // 16 AS i, CASE WHEN t.n > 1 THEN sha256(t.l || c.now || t.r) ELSE c.now END AS now, c.sib || coalesce(t.l || t.r, '') AS sib FROM {came} c JOIN {name}{k} t ON t.g IS NOT DISTINCT FROM c.g AND t.i = c.i)"
    return ",\n".join(up.format(name=name, j=k + 1, k=k, came=f"{name}up{k}" if k else start) for k in range(levels))


def _leaf(text: str) -> str:
    said = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    return f"sha256({' || '.join(said.format(f) for f in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: Levels of a source and of the sources: 16^5 documents of one source, and as many sources.
_UP = 5

#: CRC-32 of a decimal id: a table by its polynomial, then a step for each byte.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c FROM range(256) r(n)))"
_CRC = "xor(list_reduce(list_transform(string_split(CAST({} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295)"

OP13 = f"""
WITH {_CRC_TABLE},
rows_ AS MATERIALIZED (SELECT row_number() OVER () AS q, doc_id, source AS g, {_leaf("text")} AS h, {_leaf(_LOWER.format("text"))} AS low FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM rows_),
{_tree("t", "SELECT g, i, h FROM placed", _UP)},
{_tree("s", f"SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h FROM t{_UP}", _UP)},
names AS (SELECT g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h AS subroot FROM t{_UP}),
leaf0 AS (SELECT q, g, i, CASE WHEN {_CRC.format('doc_id')} % 5 = 0 THEN low ELSE h END AS now, '' AS sib FROM placed, crc),
{_climb("t", "leaf0", _UP)},
top0 AS (SELECT q, 0 AS g, names.i, now, sib FROM tup{_UP} u JOIN names ON names.g IS NOT DISTINCT FROM u.g),
{_climb("s", "top0", _UP)},
root AS (SELECT h AS root FROM s{_UP})
SELECT doc_id, placed.h AS leaf, subroot, root, sha256(sib) AS proof_sha256, now AS folded_root, now = root AS verified
FROM placed JOIN sup{_UP} u USING (q) JOIN names ON names.g IS NOT DISTINCT FROM placed.g, root"""
