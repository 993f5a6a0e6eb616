"""DuckDB SQL for the queries that SQL can express."""

from .chat import BLOCK
from .mixing import TOP_CLASS
from .oracle_simhash import OP11

_q = lambda s: "'" + s.replace("'", "''") + "'"

OP1 = f"""
WITH r AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, role, text FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list({{'t': turn, 'r': role, 'x': text}} ORDER BY turn, role, text) AS l FROM r GROUP BY conv_id),
k AS (
  SELECT a.conv_id, a.n, (SELECT count(*) FROM c e WHERE e.n = a.n AND e.l = a.l) AS copies FROM c a
  WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.conv_id <> a.conv_id AND b.l[1:a.n] = a.l AND (b.n > a.n OR b.n = a.n AND b.conv_id < a.conv_id)))
SELECT r.conv_id, CAST((pos - 1) // {BLOCK} AS BIGINT) AS part, any_value(k.n) AS n_turns, any_value(k.copies) AS copies,
  length(string_agg('<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn, role, text)) AS n_chars,
  string_agg('<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM r) r JOIN k ON r.conv_id = k.conv_id GROUP BY r.conv_id, (pos - 1) // {BLOCK}
"""


def _spans(kind: str, pattern: str, value: str = "h[i]") -> str:
    return f"""
SELECT doc_id, owner, repo, '{kind}' AS kind, s AS start, s + length(v) AS stop, v FROM (
  SELECT doc_id, owner, repo, h[i] AS v, list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in h[1:i-1]]), 0) AS s
  FROM (SELECT doc_id, owner, repo, g, h, unnest(range(1, len(h) + 1)) AS i FROM (
    SELECT doc_id, owner, repo, regexp_split_to_array(t, {_q(pattern)}) AS g, regexp_extract_all(t, {_q(pattern)}) AS h FROM d)))"""


def _order(k: str = "kind") -> str:
    return "start, " + f"list_position(['assign', 'access', 'hex', 'live'], {k})"


# The patterns of the query, as its text states them; the operator has its own.
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS, _HEX, _BLOB = "AKIA[A-Z0-9]+", "[0-9a-f]+", "[A-Za-z0-9+/_=-]+"

OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS owner, concat_ws('/', source, lang) AS repo FROM documents),
a AS (SELECT *, regexp_extract(v, {_q(_ASSIGN)}, 2) AS val FROM ({_spans("assign", _ASSIGN)})),
base AS (
  SELECT * FROM a WHERE length(val) >= 6
  UNION ALL SELECT *, v AS val FROM ({_spans("access", _ACCESS)}) WHERE length(v) >= 20
  UNION ALL SELECT *, v AS val FROM ({_spans("hex", _HEX)}) WHERE length(v) >= 24),
blob AS (
  SELECT *, v AS val FROM ({_spans("live", _BLOB)}) b
  WHERE length(v) >= 28 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = b.doc_id AND x.start < b.stop AND b.start < x.stop)),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM blob),
live AS (SELECT val FROM cand GROUP BY val HAVING count(DISTINCT owner) <= 1 AND count(DISTINCT (owner, repo)) <= 2),
spans AS (SELECT *, val IN (SELECT val FROM live) AS is_live FROM cand),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY {_order()}) FILTER (kind <> 'live') AS b,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY {_order()}) FILTER (kind <> 'live' OR is_live) AS s,
    count(*) FILTER (kind = 'live' AND is_live) AS n_live, count(*) FILTER (kind <> 'live' AND is_live) AS live_base
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(live_base, 0) AS live_base
FROM d LEFT JOIN per ON d.doc_id = per.doc_id
"""


# The rules of the query, as its text states them.
_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _rules(h: str, p: str, what: int) -> str:
    longest_first = sorted(_RULES, key=lambda r: -len(r[1] + r[2]))
    out = lambda r: (r[1] + r[2], r[0])[what]
    return "CASE " + " ".join(f"WHEN ({h} = '{r[1]}' OR ends_with({h}, '.{r[1]}')) AND starts_with({p}, '{r[2]}') THEN '{out(r)}'" for r in longest_first) + " END"


_LOW = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_AFTER = lambda u: f"substr({u}, strpos({u}, '://') + 3)"
_HOST = lambda u: f"CASE WHEN contains({u}, '://') THEN {_LOW(f"split_part(split_part(split_part({_AFTER(u)}, '/', 1), '?', 1), '#', 1)")} ELSE '' END"
_PLAIN = lambda u: f"split_part({u}, '#', 1)"
_TAIL = lambda u: f"substr({_AFTER(u)}, length({_HOST(u)}) + 1)"
_PATH = lambda u: f"CASE WHEN contains({u}, '://') THEN split_part(split_part({_TAIL(u)}, '?', 1), '#', 1) ELSE '' END"
_NODE = lambda u: f"({_LOW(f"substr({u}, 1, strpos({u}, '://') + 2)")} || {_HOST(u)} || {_TAIL(_PLAIN(u))})"
_ATTR = lambda x, name: f"""regexp_extract({x}, '(?i)\\s{name}\\s*=\\s*["'']?([^"''\\s>]+)', 1)"""

#: Knows canonical links and refreshes to absolute, rooted, relative and query-only targets; neither base tags nor . and .. in paths.
OP7 = f"""
WITH RECURSIVE tag AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\s[^>]*>')) AS x FROM pages WHERE contains(url, '://')),
link AS (
  SELECT url, replace({_ATTR("x", "href")}, '&amp;', '&') AS t FROM tag WHERE x ILIKE '<link%' AND lower({_ATTR("x", "rel")}) = 'canonical'
  UNION ALL SELECT url, replace(regexp_extract(x, '(?i)url\\s*=\\s*["'']?([^"''\\s>]+)', 1), '&amp;', '&') FROM tag WHERE x ILIKE '<meta%' AND lower({_ATTR("x", "http-equiv")}) = 'refresh'),
full_link AS (
  SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(t, '//') THEN split_part(url, ':', 1) || ':' || t
    WHEN starts_with(t, '/') THEN substr(url, 1, strpos(url, '://') + 2 + length({_HOST("url")})) || t
    WHEN starts_with(t, '?') THEN split_part(split_part(url, '#', 1), '?', 1) || t
    WHEN contains({_AFTER("split_part(split_part(url, '#', 1), '?', 1)")}, '/') THEN regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '[^/]*$', '') || t
    ELSE split_part(split_part(url, '#', 1), '?', 1) || '/' || t END AS t FROM link WHERE t <> ''),
edge AS (SELECT {_NODE("url")} AS u, {_NODE("t")} AS v FROM full_link WHERE t IS NOT NULL),
sym AS (SELECT u, v FROM edge UNION SELECT v, u FROM edge),
reach(u, v) AS (SELECT u, v FROM sym UNION SELECT reach.u, sym.v FROM reach JOIN sym ON reach.v = sym.u),
alias AS (
  SELECT u, CASE WHEN bool_or(rv = 'allow') THEN 'allow' WHEN bool_or(rv = 'block') THEN 'block' END AS a
  FROM (SELECT u, {_rules(_HOST("v"), _PATH("v"), 1)} AS rv FROM reach) GROUP BY u),
p AS (SELECT page_id, url, coalesce({_HOST("url")}, '') AS host, coalesce({_PATH("url")}, '') AS path, CASE WHEN contains(url, '://') THEN {_NODE("url")} END AS node FROM pages)
SELECT page_id, host, path, {_rules("host", "path", 0)} AS rule, coalesce({_rules("host", "path", 1)}, a, 'allow') AS verdict, coalesce(a, 'none') AS alias_verdict
FROM p LEFT JOIN alias ON p.node = alias.u
"""

OP10 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    md5(concat_ws(':', 'mix', doc_id::VARCHAR, md5(coalesce(text, '')), row_number() OVER (PARTITION BY doc_id, source, text))) AS draw
  FROM documents),
x AS (SELECT *, least({TOP_CLASS}, length(bin(size // 8)))::INT AS weight, ('0x' || substr(draw, 1, 13))::BIGINT::DOUBLE * {2.0**-52} + {2.0**-53} AS u FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM x GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
capped AS (
  SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(w) OVER (ORDER BY source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total FROM w),
rate AS (SELECT coalesce(list(r ORDER BY source_size / w, source)[1], 0) AS rate FROM (SELECT (3 * total - 4 * held)::BIGINT / (2 * rest)::BIGINT AS r, w, source_size, source FROM capped) WHERE r * w <= 2 * source_size),
t AS (SELECT source, source_size, least(rate * w, (2 * source_size)::DOUBLE) AS target FROM w, rate),
cls AS (SELECT source, weight, sum(size)::BIGINT AS words FROM x GROUP BY ALL),
steps AS (
  SELECT cls.source, weight, target, coalesce(sum(words) OVER (PARTITION BY cls.source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS held,
    (sum(weight * words) OVER (PARTITION BY cls.source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest
  FROM cls JOIN t ON cls.source IS NOT DISTINCT FROM t.source),
scale AS (SELECT source, arg_max(c, weight) AS c FROM (SELECT source, weight, CASE WHEN rest > 0 THEN (target - held * 2) / rest END AS c FROM steps) WHERE c * weight <= 2 GROUP BY source),
e AS (
  SELECT x.*, source_size, target, (CASE WHEN c * weight < 2 - 1e-9 THEN c * weight ELSE 2.0 END)::DOUBLE AS expected
  FROM x JOIN t ON x.source IS NOT DISTINCT FROM t.source LEFT JOIN scale ON x.source IS NOT DISTINCT FROM scale.source),
p AS (SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS p FROM e),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM p),
lack AS (SELECT source, any_value(target) - sum(whole * size)::BIGINT AS lack FROM q GROUP BY source),
r AS (
  SELECT q.*, lack, sum(size) OVER (PARTITION BY q.source ORDER BY q, draw ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM q JOIN lack ON q.source IS NOT DISTINCT FROM lack.source WHERE q IS NOT NULL),
last AS (SELECT source, max((q, draw)) AS last FROM r WHERE upto - size < lack AND (upto <= lack OR upto - lack < lack - (upto - size)) GROUP BY source),
c AS (SELECT q.*, whole + CASE WHEN q IS NOT NULL AND (q, draw) <= last THEN 1 ELSE 0 END AS copies FROM q LEFT JOIN last ON q.source IS NOT DISTINCT FROM last.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""

OP3 = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c, any_value(a.n) AS nu, any_value(b.n) AS nv FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM p WHERE 100 * c >= 75 * (nu + nv - c)),
sym AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
reach(u, v) AS (SELECT u, v FROM sym UNION SELECT reach.u, sym.v FROM reach JOIN sym ON reach.v = sym.u),
c AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM s LEFT JOIN c ON s.doc_id = c.u
"""

_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(first: str, name: str, levels: int) -> str:
    """Runs r0, r1, ... of a tree's nodes below ``first``, and the nodes that remain; for 16^levels nodes."""
    out, below = [], first
    for k in range(levels):
        out.append(f"{name}r{k} AS (SELECT source, pos // 16 AS run, list(h ORDER BY pos) AS hs, any_value(n) AS n FROM {below} GROUP BY source, pos // 16)")
        out.append(f"{name}{k + 1} AS (SELECT source, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, (n + 15) // 16 AS n FROM {name}r{k})")
        below = f"{name}{k + 1}"
    return ", ".join(out)


def _folds(first: str, name: str, runs: str, pos: str, levels: int, tree: str) -> str:
    """The rows of ``first`` with x folded and siblings added to proof, level by level."""
    out, below = [], first
    for k in range(levels):
        i = f"({pos} // {16**k}) % 16"
        before, after = f"array_to_string(hs[1:{i}], '')", f"array_to_string(hs[{i} + 2:], '')"
        out.append(
            f"{name}{k + 1} AS (SELECT f.* EXCLUDE (x, proof), CASE WHEN n > 1 THEN sha256({before} || x || {after}) ELSE x END AS x, proof || {before} || {after} AS proof "
            f"FROM {below} f JOIN {runs}r{k} r ON {tree} AND r.run = {pos} // {16 ** (k + 1)})"
        )
        below = f"{name}{k + 1}"
    return ", ".join(out)


_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda c, b: xor(c >> 8, crcs[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)"

#: For up to 16^6 leaves of a source and 16^4 sources.
OP12 = f"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda x: 0::UBIGINT)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS crcs FROM range(256) t(i)),
d AS (SELECT doc_id, source, {_LEAF("text")} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF(_LOW("text"))} END AS tampered FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
a0 AS (SELECT source, pos, leaf AS h, n FROM l), {_tree("a0", "a", 6)},
s AS (SELECT source AS name, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spos FROM a6),
b0 AS (SELECT 0 AS source, spos AS pos, subroot AS h, count(*) OVER () AS n FROM s), {_tree("b0", "b", 4)},
f0 AS (SELECT doc_id, source, leaf, pos, spos, subroot, coalesce(tampered, leaf) AS x, '' AS proof FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.name),
{_folds("f0", "f", "a", "pos", 6, "f.source IS NOT DISTINCT FROM r.source")}, {_folds("f6", "g", "b", "spos", 4, "true")}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = h AS verified FROM g4, (SELECT h FROM b4)
"""

_SHARE = lambda n, total: f"(1 + 1000000000::HUGEINT * ({n} + 1) // ({total}))"
_RANK = "CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tok AS (SELECT r, lang, source, unnest(regexp_extract_all({_LOW("t")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM tok GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM tok SEMI JOIN k USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total, coalesce(any_value(v), 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN size USING (lang) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_SHARE("coalesce(c.n, 0)", "total + v")} AS p FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
w AS (SELECT lang, sum(total) + any_value(v) AS total FROM g GROUP BY lang),
q AS (SELECT lang, term, {_SHARE("sum(n)", "any_value(total)")} AS q FROM p JOIN w USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, {_RANK} FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, {_RANK} FROM term) WHERE rank <= 200
"""

ORACLE: dict[str, str] = {"op1_chat_format": OP1, "op3_minhash_neardup": OP3, "op5_secret_scan": OP5, "op7_url_filter": OP7, "op10_mixing": OP10, "op11_simhash_pivots": OP11, "op12_merkle_manifest": OP12, "op13_source_divergence": OP13}
