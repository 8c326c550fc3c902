"""What SQL can say of this package's queries, for DuckDB."""

from __future__ import annotations

from lodestat.llm.secret_scan import ACCESS, ASSIGN, CORRELATION, ENCODINGS, FALSE, HEX, RUNS, TOKEN, _ERFC

_SPACED = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_SPACED} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END) AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits % 4 <> 0 AS base_failed, bits = 0 AS kept,
    CAST(bits AS BIGINT) AS failed FROM f
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM (
        SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
h AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM k))),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM h JOIN k USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS said FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def _strength(table: str) -> str:
    """Pseudo-counts of a level's beta prior, by moments."""
    return f"""(SELECT coalesce(CASE WHEN count(*) > 0 THEN (1 - share) / share END, 1.0) FROM (
        SELECT k, least(greatest(CASE WHEN n - sq / n - (k - 1) > 0 THEN (spread - (k - 1)) / (n - sq / n - (k - 1)) ELSE 0 END, 0.001), 0.99) AS share
        FROM (SELECT sum(n * (good / n - mean) ** 2 / (mean * (1 - mean))) AS spread, count(*) AS k, sum(n) AS n, sum(CAST(n AS DOUBLE) * n) AS sq
            FROM {table} WHERE n > 0 AND mean > 0 AND mean < 1)) WHERE k > 0 GROUP BY share)"""


URL_FILTER = rf"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '') AS raw,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
g AS (SELECT doc_id AS page_id, min(quality) AS good FROM labels GROUP BY doc_id),
h AS (SELECT host, count(good) AS n, CAST(coalesce(sum(good), 0) AS DOUBLE) AS good,
    array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix
    FROM p LEFT JOIN g USING (page_id) GROUP BY host),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT sum(good) / sum(n) FROM h) AS mean FROM h GROUP BY suffix),
s AS (SELECT suffix, (good + {_strength('s0')} * mean) / (n + {_strength('s0')}) AS mean FROM s0),
d0 AS (SELECT domain, d.n, d.good, mean FROM (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY domain, suffix) d JOIN s USING (suffix)),
d AS (SELECT domain, (good + {_strength('d0')} * mean) / (n + {_strength('d0')}) AS mean FROM d0),
h0 AS (SELECT host, n, good, mean FROM h JOIN d USING (domain)),
r AS (SELECT host, (good + {_strength('h0')} * mean) / (n + {_strength('h0')}) AS mean, n + {_strength('h0')} AS size FROM h0),
j AS (SELECT page_id, host, path, mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)) AS low, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p JOIN r USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN low >= 0.5 THEN 'allow' ELSE 'block' END AS verdict FROM j
"""


# crc32 of a text of ASCII letters, bit by bit
_CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda a, c: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)), xor(a, c)), 4294967295), 4294967295)"""
_MANIFEST_LEVELS = 12  # 8 ** 12 leaves of a language
_field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"
_leaf = lambda text: "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


def _tree(name: str, leaves: str, levels: int) -> str:
    """CTEs <name>0 ... of nodes (tree, place, n, h) and <name>p0 ... with the siblings of each."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(levels):
        out.append(f"""{name}r{k} AS (SELECT tree, place // 8 AS up, any_value(n) AS n, list(h ORDER BY place) AS run FROM {name}{k} GROUP BY ALL),
{name}p{k} AS (SELECT c.tree, place, CASE WHEN c.n > 1 THEN array_to_string(run[:place % 8], '') END AS pre, CASE WHEN c.n > 1 THEN array_to_string(run[place % 8 + 2:], '') END AS post
    FROM {name}{k} c JOIN {name}r{k} r ON c.tree = r.tree AND place // 8 = up),
{name}{k + 1} AS (SELECT tree, up AS place, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM {name}r{k})""")
    return ",\n".join(out)


def _climb(name: str, base: str, levels: int) -> str:
    """CTEs that lead from `base` (no, tree, place, fold, proof) to <name>c<levels> with both taken further."""
    out, last = [], base
    for k in range(levels):
        out.append(f"""{name}c{k + 1} AS (SELECT no, b.tree, b.place // 8 AS place, CASE WHEN pre IS NULL THEN fold ELSE sha256(pre || fold || post) END AS fold,
    proof || coalesce(pre || post, '') AS proof FROM {last} b JOIN {name}p{k} p ON b.tree = p.tree AND b.place = p.place)""")
        last = f"{name}c{k + 1}"
    return ",\n".join(out)


MANIFEST = f"""
WITH d AS (SELECT *, CASE WHEN {_CRC} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS late FROM documents),
v AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('text')} AS h, {_leaf('late')} AS found FROM d),
w AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS no FROM v),
{_tree('a', 'SELECT tree, place, n, h FROM w', _MANIFEST_LEVELS)},
{_tree('b', f"SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n, h, tree AS own FROM a{_MANIFEST_LEVELS}", 4)},
wc0 AS (SELECT no, tree, place, found AS fold, '' AS proof FROM w),
{_climb('a', 'wc0', _MANIFEST_LEVELS)},
xc0 AS (SELECT no, 0 AS tree, b0.place, fold, proof FROM ac{_MANIFEST_LEVELS} c JOIN b0 ON c.tree = b0.own),
{_climb('b', 'xc0', 4)}
SELECT doc_id, w.h AS leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.h AS verified
FROM w JOIN a{_MANIFEST_LEVELS} s USING (tree) CROSS JOIN (SELECT h FROM b4) r JOIN bc4 USING (no)
"""

_TOKENS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": TOKEN}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found(kind: str) -> str:
    """Matches of a pattern with their places, from what lies between them."""
    return f"""SELECT no, {_quoted(kind)} AS kind, m, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY no ORDER BY i) AS BIGINT) AS stop FROM (
    SELECT no, i, ms[i] AS m, gaps[i] AS gap FROM (SELECT no, regexp_extract_all(t, {_quoted(_TOKENS[kind])}) AS ms,
        string_split_regex(t, {_quoted(_TOKENS[kind])}) AS gaps FROM d), unnest(generate_series(1, len(ms))) AS g(i))"""


_ENCODED = "CASE WHEN regexp_matches(b, '^[0-9]+$') THEN NULL " + " ".join(
    f"WHEN regexp_matches(b, '^[{a.replace('-', '')}{'-' * ('-' in a)}]+$') THEN {{'a': '{a}', 'k': {len(a)}, 'far': {far}, 'half': '{'0' * (len(a) // 2)}{'1' * (len(a) - len(a) // 2)}'}}"
    for a, far in ENCODINGS.values()) + " END"
_poly = str(_ERFC[-1])
for _c in _ERFC[-2::-1]:
    _poly = f"({_c} + u * {_poly})"

SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS no, doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT no, kind, stop - length(m) AS start, stop, row_number() OVER () AS id FROM ({_found('assign')} UNION ALL {_found('access')} UNION ALL {_found('hex')})
    WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, {_quoted(ASSIGN)}, 2)) >= 6 WHEN 'access' THEN length(m) >= 20 ELSE true END),
tok AS (SELECT no, stop - length(m) AS start, stop, rtrim(m, '=') AS b, {_ENCODED.replace('(b,', "(rtrim(m, '='),")} AS e FROM ({_found('random')})),
apart AS (SELECT *, length(b) + 0.0::DOUBLE AS n, row_number() OVER () AS id FROM tok WHERE e IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM base WHERE base.no = tok.no AND base.start < tok.stop AND tok.start < base.stop)),
chars AS (SELECT id, i, instr(e.a, b[i]) AS v, b[i] AS c FROM apart, unnest(generate_series(1, length(b))) AS g(i)),
sq AS (SELECT id, sum(k * k)::DOUBLE AS squares FROM (SELECT id, c, count(*)::DOUBLE AS k FROM chars GROUP BY id, c) GROUP BY id),
mo AS (SELECT id, sum(v)::DOUBLE AS s1, sum(v * v)::DOUBLE AS s2, sum(v * w)::DOUBLE AS sp, arg_min(v, i)::DOUBLE AS f, arg_max(v, i)::DOUBLE AS l
    FROM (SELECT *, coalesce(lead(v) OVER (PARTITION BY id ORDER BY i), 0) AS w FROM chars) GROUP BY id),
c1 AS (SELECT id, no, start, stop, n, e.k::DOUBLE AS k, squares, s1, s2, sp, f, l, s1 / n AS mu, n * e.far AS lam, e.k - 1.0::DOUBLE AS dof,
    translate(b, e.a, e.half) AS bits FROM apart JOIN sq USING (id) JOIN mo USING (id)),
c2 AS (SELECT *, k / n * squares - n AS x, 1 - 2 * (dof + lam) * (dof + 3 * lam) / (3 * (dof + 2 * lam) * (dof + 2 * lam)) AS h,
    (dof + 2 * lam) / ((dof + lam) * (dof + lam)) AS p, length(replace(bits, '0', ''))::DOUBLE AS ones,
    (2 * n - length(replace(bits, '01', '')) - length(replace(bits, '10', ''))) / 2 AS turns,
    sp - mu * (2 * s1 - f - l) + (n - 1) * mu * mu AS inside, s2 - n * mu * mu AS around FROM c1),
c3 AS (SELECT *, (h - 1) * (1 - 3 * h) AS m, 2 * ones * (n - ones) / n + 1 AS mean FROM c2),
c4 AS (SELECT *, (pow(greatest(x, 0.0) / (dof + lam), h) - (1 + h * p * (h - 1 - (2 - h) * m * p / 2))) / (h * sqrt(2 * p) * (1 + m * p / 2)) AS z1,
    sqrt(greatest((mean - 1) * (mean - 2) / (n - 1), 0.0)) AS spread FROM c3),
c5 AS (SELECT *, greatest(z1, CASE WHEN spread > 0 THEN (abs(turns + 1 - mean) - {RUNS} * mean) / spread ELSE 0 END,
    CASE WHEN around > 0 THEN (atanh(least(abs(inside / around), 0.999999)) - atanh({CORRELATION})) * sqrt(n - 3) ELSE 0 END) AS z FROM c4),
c6 AS (SELECT *, -z / sqrt(2.0::DOUBLE) AS x2, 1 / (1 - z / sqrt(2.0::DOUBLE) / 2) AS u, CAST(floor(log2(n) * 2) AS INT) AS band FROM c5),
c7 AS (SELECT no, start, stop, band, CASE WHEN z < 0 THEN least(CAST(floor((ln(u / 2) - x2 * x2 + {_poly}) / ln(10.0::DOUBLE) * -100) AS BIGINT), 3000) ELSE 0 END AS bin FROM c6),
hist AS (SELECT band, bin, count(*) AS c FROM c7 GROUP BY band, bin),
low AS (SELECT band, min(bin) AS least_bin FROM (SELECT band, bin, sum(c) OVER (PARTITION BY band ORDER BY bin DESC) AS above, sum(c) OVER (PARTITION BY band) AS every FROM hist)
    WHERE pow(10.0::DOUBLE, bin / -100.0::DOUBLE) * every <= {FALSE} * above GROUP BY band),
spans AS (SELECT no, kind, start, stop FROM base UNION ALL SELECT no, 'random', start, stop FROM c7 JOIN low USING (band) WHERE bin >= least_bin),
said AS (SELECT no, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END) AS spans,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END) FILTER (kind <> 'random') AS fixed,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM spans GROUP BY no)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(fixed, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN said USING (no)
"""
