"""DuckDB SQL for SimHash near-duplicates, with XXH64 spelled out in whole numbers modulo 2^64."""

# The five primes of XXH64, and the seed of the query.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
SEED = 42

_n = lambda x: f"{x % 2**64}::UHUGEINT"
_P = [_n(p) for p in PRIMES]
_MOD = f"{2**64}::UHUGEINT"


def _mul(a: str, b: str) -> str:
    return f"(({a}) * ({b}) % {_MOD})"


def _add(*terms: str) -> str:
    return f"(({' + '.join(f'({t})' for t in terms)}) % {_MOD})"


def _turn(x: str, r: int) -> str:
    """x rotated left by r bits."""
    return f"(({x}) * {2**r}::UHUGEINT % {_MOD} + ({x}) // {2 ** (64 - r)}::UHUGEINT)"


def _fold(start: str, items: str, step: str) -> str:
    """Items x put into a one after the other."""
    return f"list_reduce(list_prepend({start}, {items}), lambda a, x: {step})"


def _number(first: str, n: int) -> str:
    """n bytes as a little-endian number."""
    return f"list_reduce(list_prepend(0::UHUGEINT, list_reverse(b[{first} + 1:{first} + {n}])), lambda s, y: s * 256::UHUGEINT + y)"


def _mixed(x: str) -> str:
    return _mul(_turn(_mul(x, _P[1]), 31), _P[0])


_STRIPE = _mul(_turn(_add("a", _mul("x", _P[1])), 31), _P[0])
_LANES = ", ".join(_fold(_n(v), f"list_transform(range(n // 32), lambda i: eights[4 * i + {j + 1}])", _STRIPE) + f" AS v{j}" for j, v in enumerate((SEED + PRIMES[0] + PRIMES[1], SEED + PRIMES[1], SEED, SEED - PRIMES[0])))
_MERGED = _fold(_add(_turn("v0", 1), _turn("v1", 7), _turn("v2", 12), _turn("v3", 18)), "[v0, v1, v2, v3]", _add(_mul(f"xor(a, {_mixed('x')})", _P[0]), _P[3]))
_EIGHT = _add(_mul(_turn(f"xor(a, {_mixed('x')})", 27), _P[0]), _P[3])
_FOUR = _add(_mul(_turn(f"xor(h, {_mul(_number('n - n % 8', 4), _P[0])})", 23), _P[1]), _P[2])
_ONE = _mul(_turn(f"xor(a, {_mul('x', _P[4])})", 11), _P[0])
_low = lambda x, r: f"xor({x}, ({x}) // {2**r}::UHUGEINT)"

_BITS = " + ".join(f"CASE WHEN 2 * sum((h >> {k}) & 1) > count(*) THEN {2**k}::UHUGEINT ELSE 0::UHUGEINT END" for k in range(64))

OP11 = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS t FROM w),
raw AS (SELECT t, hex(encode(t)) AS x, octet_length(encode(t))::BIGINT AS n FROM (SELECT DISTINCT t FROM s)),
bytes AS (SELECT t, n, list_transform(range(n), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UHUGEINT) AS b FROM raw),
eights AS (SELECT *, list_transform(range(n // 8), lambda i: {_number("8 * i", 8)}) AS eights FROM bytes),
lanes AS (SELECT *, {_LANES} FROM eights),
h0 AS (SELECT t, n, b, eights, {_add(f"CASE WHEN n >= 32 THEN {_MERGED} ELSE {_n(SEED + PRIMES[4])} END", "n::UHUGEINT")} AS h FROM lanes),
h1 AS (SELECT t, n, b, {_fold("h", "eights[4 * (n // 32) + 1:]", _EIGHT)} AS h FROM h0),
h2 AS (SELECT t, n, b, CASE WHEN n % 8 >= 4 THEN {_FOUR} ELSE h END AS h FROM h1),
h3 AS (SELECT t, {_fold("h", "b[n - n % 4 + 1:]", _ONE)} AS h FROM h2),
h4 AS (SELECT t, {_mul(_low("h", 33), _P[1])} AS h FROM h3),
h5 AS (SELECT t, {_mul(_low("h", 29), _P[2])} AS h FROM h4),
hashed AS (SELECT t, ({_low("h", 32)})::UBIGINT AS h FROM h5),
f AS (SELECT r, ({_BITS})::UBIGINT AS fp FROM s JOIN hashed USING (t) GROUP BY r),
d AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM w LEFT JOIN f ON w.r = f.r),
k AS (SELECT fp, min(doc_id) AS least FROM d GROUP BY fp),
sym AS (SELECT a.fp AS u, b.fp AS v FROM k a JOIN k b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 3),
reach(u, v) AS (SELECT u, v FROM sym UNION SELECT reach.u, sym.v FROM reach JOIN sym ON reach.v = sym.u),
c AS (SELECT u, min(least) AS m FROM reach JOIN k ON v = fp GROUP BY u)
SELECT doc_id, lower(lpad(hex(d.fp), 16, '0')) AS fingerprint, least(k.least, coalesce(m, k.least)) AS component_id FROM d JOIN k ON d.fp = k.fp LEFT JOIN c ON c.u = d.fp
"""
