"""SQL that DuckDB runs over the same tables, for the registered queries."""

from __future__ import annotations

from lexloom.functions import text as X
from lexloom.functions import vocabulary as V
from lexloom.operators.features import FEATURE_NAMES


def _q(s: str) -> str:
    return s.replace("'", "''")


WS = "\\t-\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
PIECE = _q(f"[^{V.ENDERS}\\r\\n]*(?:[{V.ENDERS}][{V.CLOSERS}]*|[\\r\\n]|\\z)")


def _sentences(name: str, source: str) -> str:
    """CTEs ending in `name`: text, source, document_id, sentence_index, document_start, document_end, dedup_key."""
    return f"""
{name}_d AS ({source}),
{name}_p AS (SELECT source, document_id, unnest(regexp_extract_all(text, '{PIECE}')) AS piece, generate_subscripts(regexp_extract_all(text, '{PIECE}'), 1) AS pos
  FROM {name}_d WHERE length(text) > 0 AND length(source) > 0 AND length(document_id) > 0),
{name}_q AS (SELECT source, document_id, pos, sum(length(piece)) OVER (PARTITION BY source, document_id ORDER BY pos) - length(piece) + length(piece) - length(regexp_replace(piece, '^[{WS}]+', '')) AS spot,
  regexp_replace(regexp_replace(piece, '^[{WS}]+', ''), '[{WS}]+$', '') AS text FROM {name}_p),
{name} AS (SELECT text, source, document_id, (row_number() OVER (PARTITION BY source, document_id ORDER BY pos) - 1)::INT AS sentence_index, spot::INT AS document_start, (spot + length(text))::INT AS document_end,
  sha256(trim(regexp_replace(text, '[{WS}]+', ' ', 'g'))) AS dedup_key FROM {name}_q WHERE length(text) BETWEEN 4 AND 128)"""


DOCS = "SELECT source, doc_id::VARCHAR AS document_id, text FROM documents"
S = _sentences("s", DOCS)


def _bucket(key: str) -> str:
    return f"(('0x' || substr(sha256({key}), 1, 8))::BIGINT % 100)"


def _split(key: str, train: int, dev: int) -> str:
    return f"CASE WHEN {_bucket(key)} < {train} THEN 'train' WHEN {_bucket(key)} < {train + dev} THEN 'dev' ELSE 'test' END"


DOC_KEY = "source || chr(0) || document_id"
UNIQUE = f"""u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY document_id::BIGINT, sentence_index) AS n FROM s) WHERE n = 1),
k AS (SELECT *, sha256({DOC_KEY} || chr(0) || sentence_index::VARCHAR) AS sample_key FROM u)"""
OTHER_DIGITS = "²³¹፩-፱᧚⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"


def _script(c: str) -> str:
    u = f"unicode({c})"
    return f"""CASE WHEN {u} BETWEEN 12352 AND 12447 THEN 'HIRAGANA' WHEN {u} BETWEEN 12448 AND 12543 THEN 'KATAKANA' WHEN {u} BETWEEN 19968 AND 40959 OR {u} BETWEEN 13312 AND 19903 THEN 'KANJI'
 WHEN {u} BETWEEN 65 AND 90 OR {u} BETWEEN 97 AND 122 THEN 'LATIN' WHEN regexp_matches({c}, '^[\\p{{Nd}}{OTHER_DIGITS}]') THEN 'DIGIT' WHEN regexp_matches({c}, '^\\p{{P}}') THEN 'PUNCT'
 WHEN regexp_matches({c}, '^\\p{{S}}') THEN 'SYMBOL' WHEN regexp_matches({c}, '^[{WS}]') THEN 'WHITESPACE' ELSE 'OTHER' END"""


def _punct(c: str) -> str:
    return "CASE " + " ".join(f"WHEN strpos('{_q(x)}', {c}) > 0 THEN '{k}'" for k, x in V.PUNCT_SETS.items()) + " ELSE 'NONE' END"


def _digit(c: str) -> str:
    return f"CASE WHEN unicode({c}) BETWEEN 48 AND 57 THEN 'ASCII' WHEN unicode({c}) BETWEEN 65296 AND 65305 THEN 'FULLWIDTH' WHEN {_script(c)} = 'DIGIT' THEN 'OTHER' ELSE 'NONE' END"


def _chars(rows: str, key: str = "") -> str:
    """CTE c: pos, ch, prev_ch, next_ch of the characters of `rows` (text)."""
    return f"""l AS (SELECT {key} text, string_split(text, '') AS cs FROM {rows} WHERE length(text) > 0),
c AS (SELECT {key} unnest(cs) AS ch, unnest(list_concat([NULL], cs[:-2])) AS prev_ch, unnest(list_concat(cs[2:], [NULL])) AS next_ch FROM l)"""


def _mix(x: str) -> str:
    """The 64-bit finalizer on an unsigned integer expression."""
    big, m = "18446744073709551616::UHUGEINT", "::UHUGEINT"
    a = f"xor({x}::UBIGINT, ({x}::UBIGINT >> 30))"
    b = f"(({a}{m} * 13787848793156543929{m}) % {big})::UBIGINT"
    c = f"xor({b}, ({b} >> 27))"
    e = f"(({c}{m} * 10723151780598845931{m}) % {big})::UBIGINT"
    return f"xor({e}, ({e} >> 31))"


#: Surrogate boundaries of sentences: r(document_id, sentence_index, text, n, sc, a, b, c) and perturbed pa, pb, pc.
R = f"""{S},
r0 AS (SELECT document_id, sentence_index, text, length(text) AS n, list_transform(string_split(text, ''), lambda c: {_script('c')}) AS sc FROM s),
r1 AS (SELECT *, list_filter(range(1, n + 1), lambda i: i = n OR sc[i] <> sc[i + 1]) AS a FROM r0),
r2 AS (SELECT *, list_filter(a, lambda i: i = n OR sc[i + 1] <> 'WHITESPACE') AS b FROM r1),
r3 AS (SELECT *, list_filter(b, lambda i: i = n OR sc[i] = 'PUNCT' OR (sc[i] = 'WHITESPACE' AND i > 1 AND sc[i - 1] = 'PUNCT')) AS c FROM r2),
r AS (SELECT *, list_filter(a, lambda x: x = n OR x % 7 <> 3) AS pa, list_filter(b, lambda x: x = n OR x % 7 <> 3) AS pb, list_filter(c, lambda x: x = n OR x % 7 <> 3) AS pc FROM r3)"""


def _atom(kind: str) -> str:
    return f"CASE WHEN {kind} = 'LATIN' THEN 'NOUN_LIKE' WHEN {kind} = 'DIGIT' THEN 'NUMBER' WHEN {kind} IN ('PUNCT', 'SYMBOL') THEN 'PUNCT_SYMBOL' ELSE 'OTHER' END"


def _role(kind: str) -> str:
    return f"CASE WHEN {kind} = 'PUNCT' THEN 'PREDICATE' WHEN {kind} = 'LATIN' THEN 'CASED_NOMINAL' ELSE 'UNKNOWN' END"


def _names(names: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{x}')" for x in names) + ") AS names(label)"


def _label_scores(label, names: list[str], gold: str, pred: str) -> str:
    return f"""{R}, i AS (SELECT sc, {gold} AS g, {pred} AS p, unnest(range(1, n + 1)) AS spot FROM r),
e AS (SELECT {label("sc[list_filter(g, lambda x: x >= spot)[1]]")} AS e, {label("sc[list_filter(p, lambda x: x >= spot)[1]]")} AS a FROM i),
f AS (SELECT e, a, count(*) AS k FROM e GROUP BY ALL),
t AS (SELECT label, coalesce(sum(k) FILTER (e = label AND a = label), 0) AS tp, coalesce(sum(k) FILTER (e <> label AND a = label), 0) AS fp, coalesce(sum(k) FILTER (e = label AND a <> label), 0) AS fn
  FROM {_names(names)} LEFT JOIN f ON e = label OR a = label GROUP BY label),
x AS (SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, CASE WHEN tp > 0 THEN round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) ELSE 0.0 END AS f1 FROM t)"""


def _decoded() -> str:
    """Labels of spans that end where a level's modulus, or a coarser one's, divides a character's code point."""
    ends = {}
    moduli = {"a": [2, 5, 11, 31, 101], "b": [5, 11, 31, 101], "bunsetsu": [11, 31, 101], "clause": [31, 101], "sentence": [101]}
    for level, own in moduli.items():
        ends[level] = "list_filter(range(1, n + 1), lambda i: i = n OR " + " OR ".join(f"cp[i] % {m} = 0" for m in own) + ")"
    name = lambda words, at: "[" + ", ".join(f"'{w}'" for w in words) + f"][{at}]"
    inflections = "concat_ws('+', " + ", ".join(f"CASE WHEN cp[i] % {k + 2} = 0 THEN '{w}' END" for k, w in enumerate(V.INFLECTIONS)) + ")"
    kind = name(V.ATOM_TYPES, "cp[i] % 12 + 1")
    function = f"CASE WHEN {kind} = 'PARTICLE' THEN {name(V.PARTICLE_FUNCTIONS, '(cp[i] // 3) % 12 + 1')} ELSE '-' END"
    atom = f"i::VARCHAR || ':' || {kind} || ':' || {function} || ':' || CASE WHEN {kind} IN ('VERB_STEM', 'AUXILIARY', 'COPULA', 'ADJECTIVE') THEN {inflections} ELSE '' END"
    told = lambda level, body: f"array_to_string(list_transform({level}, lambda i: {body}), ' ')"
    number = "i::VARCHAR"
    return f"""WITH {S}, c AS (SELECT document_id, sentence_index, text, length(text) AS n, list_transform(range(1, length(text) + 1), lambda i: unicode(substr(text, i::INT, 1))) AS cp FROM s),
e AS (SELECT *, {", ".join(f"{x} AS e_{level}" for level, x in ends.items())} FROM c)
SELECT document_id, sentence_index, {told("e_a", atom)} AS atoms, {told("e_b", number)} AS b, {told("e_bunsetsu", "i::VARCHAR || ':' || " + name(V.BUNSETSU_ROLES, "cp[i] % 9 + 1"))} AS bunsetsu,
  {told("e_clause", number)} AS clauses, {told("e_sentence", number)} AS sentences, CASE WHEN len(e_sentence) = 1 THEN 'SENTENCE' ELSE 'DOCUMENT' END AS root,
  array_to_string(list_transform(range(1, len(e_a) + 1), lambda k: substr(text, (CASE WHEN k = 1 THEN 1 ELSE e_a[k - 1] + 1 END)::INT, (e_a[k] - CASE WHEN k = 1 THEN 0 ELSE e_a[k - 1] END)::INT)), '|') AS leaves
FROM e"""


def _coded_pairs() -> str:
    """CTEs: m (metric, label, tp, fp, fn) of coded records against those of code points one more where 3 divides them."""
    moduli = {"a": [2, 5, 11, 31, 101], "b": [5, 11, 31, 101], "bunsetsu": [11, 31, 101], "clause": [31, 101], "sentence": [101]}
    ends = ", ".join(f"list_filter(range(1, n + 1), lambda i: i = n OR {' OR '.join(f'{side}[i] % {k} = 0' for k in own)}) AS {side}_{level}" for side in "gp" for level, own in moduli.items())
    name = lambda words, at: "[" + ", ".join(f"'{w}'" for w in words) + f"][{at}]"
    flags = lambda x: "list_filter([" + ", ".join(f"CASE WHEN {x} % {k + 2} = 0 THEN '{w}' END" for k, w in enumerate(V.INFLECTIONS)) + "], lambda f: f IS NOT NULL)"
    at = lambda side, level: f"{side}[list_filter({side}_{level}, lambda x: x >= spot)[1]]"
    inflected = "(" + ", ".join(f"'{x}'" for x in V.INFLECTED) + ")"

    def told(x: str) -> str:
        return f"""{name(V.ATOM_TYPES, f"{x}_at % 12 + 1")} AS {x}_atom, {name(V.BUNSETSU_ROLES, f"{x}_c % 9 + 1")} AS {x}_role"""

    one = lambda metric, names, e, a: f"""SELECT '{metric}' AS metric, label, count(*) FILTER ({e} = label AND {a} = label) AS tp, count(*) FILTER ({e} IS NOT NULL AND {e} <> label AND {a} = label) AS fp,
  count(*) FILTER ({e} = label AND ({a} IS NULL OR {a} <> label)) AS fn FROM {_names(names)} LEFT JOIN l ON {e} = label OR {a} = label GROUP BY label"""  # noqa: E731
    levels = " UNION ALL ".join(f"SELECT '{level}' AS label, g_{level} AS g, p_{level} AS p FROM c" for level in moduli)
    return f"""{S}, c0 AS (SELECT document_id, sentence_index, length(text) AS n, list_transform(range(1, length(text) + 1), lambda i: unicode(substr(text, i::INT, 1))) AS g FROM s),
c1 AS (SELECT *, list_transform(g, lambda x: x + CASE WHEN x % 3 = 0 THEN 1 ELSE 0 END) AS p FROM c0), c AS (SELECT *, {ends} FROM c1),
i AS (SELECT *, unnest(range(1, n + 1)) AS spot FROM c),
k AS (SELECT {at("g", "a")} AS g_at, {at("p", "a")} AS p_at, {at("g", "bunsetsu")} AS g_c, {at("p", "bunsetsu")} AS p_c FROM i),
k2 AS (SELECT *, {told("g")}, {told("p")} FROM k),
l AS (SELECT *, CASE WHEN g_atom = 'PARTICLE' THEN {name(V.PARTICLE_FUNCTIONS, "(g_at // 3) % 12 + 1")} END AS g_function, CASE WHEN p_atom = 'PARTICLE' THEN {name(V.PARTICLE_FUNCTIONS, "(p_at // 3) % 12 + 1")} END AS p_function,
  CASE WHEN g_atom IN {inflected} THEN {flags("g_at")} END AS g_flags, CASE WHEN p_atom IN {inflected} THEN {flags("p_at")} ELSE [] END AS p_flags FROM k2),
b AS ({levels}),
m AS ({one("atom", V.ATOM_TYPES, "g_atom", "p_atom")} UNION ALL {one("bunsetsu_role", V.BUNSETSU_ROLES, "g_role", "p_role")} UNION ALL {one("particle_function", V.PARTICLE_FUNCTIONS, "g_function", "p_function")}
 UNION ALL SELECT 'inflection', label, count(*) FILTER (list_contains(g_flags, label) AND list_contains(p_flags, label)), count(*) FILTER (NOT list_contains(g_flags, label) AND list_contains(p_flags, label)),
   count(*) FILTER (list_contains(g_flags, label) AND NOT list_contains(p_flags, label)) FROM {_names(V.INFLECTIONS)} LEFT JOIN l ON g_flags IS NOT NULL GROUP BY label
 UNION ALL SELECT 'boundaries', label, sum(len(list_intersect(g, p)))::BIGINT, sum(len(p) - len(list_intersect(g, p)))::BIGINT, sum(len(g) - len(list_intersect(g, p)))::BIGINT FROM b GROUP BY label),
q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM m),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM q)"""


def _score_report() -> str:
    same = " AND ".join(f"g_{level} = p_{level}" for level in V.LEVELS)
    spans = lambda x: f"list_transform({x}_a, lambda e: (e, {x}[e] % 12, CASE WHEN {x}[e] % 12 = 5 THEN ({x}[e] // 3) % 12 END, CASE WHEN {x}[e] % 12 IN (2, 3, 6, 7) THEN [" + ", ".join(f"{x}[e] % {k + 2} = 0" for k in range(len(V.INFLECTIONS))) + "] END))"
    roles = lambda x: f"list_transform({x}_bunsetsu, lambda e: {x}[e] % 9)"
    return f"""WITH {_coded_pairs()},
t AS (SELECT metric, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM m WHERE metric IN ('atom', 'inflection') GROUP BY metric),
u AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM t),
r AS (SELECT metric, label, tp, fp, fn, precision, recall, f1 FROM f
 UNION ALL SELECT metric, 'macro', 0, 0, 0, 0.0, 0.0, coalesce(avg(f1) FILTER (tp + fp + fn > 0), 0.0) FROM f WHERE metric <> 'boundaries' GROUP BY metric
 UNION ALL SELECT metric, 'micro', tp, fp, fn, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END FROM u
 UNION ALL SELECT 'complete_tree', 'exact_match', 0, 0, 0, 0.0, 0.0, avg(CASE WHEN {same} AND {spans("g")} = {spans("p")} AND {roles("g")} = {roles("p")} THEN 1.0 ELSE 0.0 END) FROM c)
SELECT metric, label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM r"""


def _systems() -> str:
    """Two surrogate analysers and both combined against coded records, on the sentences that both handle."""
    moduli = {"a": [2, 5, 11, 31, 101], "b": [5, 11, 31, 101], "bunsetsu": [11, 31, 101], "clause": [31, 101], "sentence": [101]}
    ends = ", ".join(f"list_filter(range(1, n + 1), lambda i: i = n OR {' OR '.join(f'g[i] % {k} = 0' for k in own)}) AS g_{level}" for level, own in moduli.items())
    name = lambda words, at: "[" + ", ".join(f"'{w}'" for w in words) + f"][{at}]"
    flags = "list_filter([" + ", ".join(f"CASE WHEN g_at % {k + 2} = 0 THEN '{w}' END" for k, w in enumerate(V.INFLECTIONS)) + "], lambda f: f IS NOT NULL)"
    inflected = "(" + ", ".join(f"'{x}'" for x in V.INFLECTED) + ")"
    summed = lambda of: f"list_transform(range(1, len({of}) + 1), lambda i: list_sum(list_transform({of}[1:i], lambda x: length(x)))::BIGINT)"
    hit = "count(*) FILTER (e = label AND a = label) AS tp, count(*) FILTER (e IS NOT NULL AND e <> label AND a = label) AS fp, count(*) FILTER (e = label AND (a IS NULL OR a <> label)) AS fn"
    one = lambda system, metric, names, e, a: f"SELECT '{system}' AS system, '{metric}' AS metric, label, {hit} FROM {_names(names)} LEFT JOIN (SELECT {e} AS e, {a} AS a FROM l) ON e = label OR a = label GROUP BY label"
    parts = []
    for system in ("tokens", "combined"):
        parts += [one(system, "atom", V.ATOM_TYPES, "g_atom", "t_atom"), one(system, "particle_function", V.PARTICLE_FUNCTIONS, "g_function", "t_function")]
        parts.append(
            f"SELECT '{system}', 'inflection', label, count(*) FILTER (list_contains(g_flags, label) AND list_contains(t_flags, label)), count(*) FILTER (NOT list_contains(g_flags, label) AND list_contains(t_flags, label)),"
            f" count(*) FILTER (list_contains(g_flags, label) AND NOT list_contains(t_flags, label)) FROM {_names(V.INFLECTIONS)} LEFT JOIN l ON g_flags IS NOT NULL GROUP BY label"
        )
    parts += [one(system, "bunsetsu_role", V.BUNSETSU_ROLES, "g_role", "c_role") for system in ("chunks", "combined")]
    levels = {("tokens", "a"): "te", ("tokens", "b"): "be", ("chunks", "bunsetsu"): "ce", ("combined", "a"): "te", ("combined", "b"): "be", ("combined", "bunsetsu"): "ce", ("combined", "clause"): "[n]", ("combined", "sentence"): "[n]"}
    bounds = " UNION ALL ".join(f"SELECT '{system}' AS system, '{level}' AS label, g_{level} AS g, {own} AS p FROM c" for (system, level), own in levels.items())
    return f"""{_CHUNKS},
c0 AS (SELECT *, list_transform(range(1, n + 1), lambda i: unicode(substr(text, i::INT, 1))) AS g, regexp_extract_all(text, '[A-Za-z]+|[0-9]+| +|[^A-Za-z0-9 ]') AS t, regexp_extract_all(text, '[^ ]+ *| +') AS bt FROM h WHERE n % 11 <> 0),
c AS (SELECT *, {ends}, {summed("t")} AS te, {summed("bt")} AS be, after_ AS ce FROM c0),
i AS (SELECT *, unnest(range(1, n + 1)) AS spot FROM c),
k AS (SELECT g[list_filter(g_a, lambda x: x >= spot)[1]] AS g_at, g[list_filter(g_bunsetsu, lambda x: x >= spot)[1]] AS g_c, t[len(list_filter(te, lambda x: x < spot)) + 1] AS w, chunk[len(list_filter(ce, lambda x: x < spot)) + 1] AS ch FROM i),
k2 AS (SELECT *, {name(V.ATOM_TYPES, "g_at % 12 + 1")} AS g_atom, {name(V.BUNSETSU_ROLES, "g_c % 9 + 1")} AS g_role,
  CASE WHEN w[1] = ' ' THEN 'OTHER' WHEN regexp_matches(w, '^[0-9]') THEN 'NUMBER' WHEN NOT regexp_matches(w, '^[A-Za-z]') THEN 'PUNCT_SYMBOL' WHEN length(w) <= 2 THEN 'PARTICLE' WHEN length(w) % 5 = 0 THEN 'VERB_STEM' ELSE 'NOUN_LIKE' END AS t_atom,
  CASE WHEN length(ch) % 4 = 0 THEN 'TOPIC' WHEN ch[-1] = '.' THEN 'PREDICATE' WHEN ch[-1] = ',' THEN 'CASED_NOMINAL' ELSE 'MODIFIER' END AS c_role FROM k),
l AS (SELECT *, CASE WHEN g_atom = 'PARTICLE' THEN {name(V.PARTICLE_FUNCTIONS, "(g_at // 3) % 12 + 1")} END AS g_function, CASE WHEN t_atom = 'PARTICLE' THEN 'TOPIC' END AS t_function,
  CASE WHEN g_atom IN {inflected} THEN {flags} END AS g_flags, CASE WHEN t_atom = 'VERB_STEM' THEN ['PAST'] ELSE [] END AS t_flags FROM k2),
b AS ({bounds}),
m AS ({" UNION ALL ".join(parts)}
 UNION ALL SELECT system, 'boundaries', label, sum(len(list_intersect(g, p)))::BIGINT, sum(len(p) - len(list_intersect(g, p)))::BIGINT, sum(len(g) - len(list_intersect(g, p)))::BIGINT FROM b GROUP BY system, label),
t0 AS (SELECT system, metric, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM m WHERE metric IN ('atom', 'inflection') GROUP BY system, metric),
q AS (SELECT *, 'micro' AS label FROM t0 UNION ALL BY NAME SELECT * FROM m),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM q),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r),
o AS (SELECT system, metric, label, tp, fp, fn, precision, recall, f1 FROM f
 UNION ALL SELECT system, metric, 'macro', 0, 0, 0, 0.0, 0.0, coalesce(avg(f1) FILTER (tp + fp + fn > 0), 0.0) FROM f WHERE metric <> 'boundaries' AND label <> 'micro' GROUP BY system, metric)
SELECT system, metric, label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM o"""


#: CTE h: of sentences with chunks the chunks, and their ends with white space joined to the one before or after.
_CHUNKS = f"""WITH {S}, h0 AS (SELECT document_id || '#' || sentence_index AS id, text, length(text) AS n, regexp_extract_all(text, '[^,.;:!?]+[,.;:!?]*|[,.;:!?]+') AS p FROM s WHERE length(text) % 13 <> 0),
h1 AS (SELECT *, list_transform(range(1, len(p) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT) AS pe FROM h0),
h2 AS (SELECT *, list_filter(list_transform(range(1, len(p) + 1), lambda i: {{'own': trim(p[i], ' '), 'start': pe[i] - length(ltrim(p[i], ' ')), 'stop': pe[i] - (length(p[i]) - length(rtrim(p[i], ' ')))}}), lambda x: x.own <> '') AS x FROM h1),
h AS (SELECT id, text, n, list_transform(x, lambda y: y.own) AS chunk, list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i = len(x) THEN n ELSE x[i].stop END) AS after_,
  list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i = len(x) THEN n ELSE x[i + 1].start END) AS before_ FROM h2 WHERE len(x) > 0)"""


def _model_loss() -> str:
    """Losses of logits by code points g against targets of records coded by p."""
    atoms = {x: k for k, x in enumerate(V.ATOM_TYPES)}
    inflected = "(" + ", ".join(str(atoms[x]) for x in V.INFLECTED) + ")"
    particle, unknown = atoms["PARTICLE"], V.PARTICLE_FUNCTIONS.index("UNKNOWN")
    log1p = lambda right, x: f"(ln(1 + exp({x}::DOUBLE)) - CASE WHEN {right} THEN {x} ELSE 0 END)"
    # a logit x against a truth: softplus(-x) if true, softplus(x) if not
    bound = " + ".join(log1p(f"(g % {m} = 0) = list_contains(p_{level}, spot)", 0.5) for level, m in zip(V.LEVELS, [2, 5, 11, 31, 101], strict=True))
    flag = " + ".join(log1p(f"(g % {k + 2} = 0) = (atom IN {inflected} AND p_at % {k + 2} = 0)", 1.0) for k in range(len(V.INFLECTIONS)))
    soft = lambda n, hit: f"ln({n - 1} + exp(1.0::DOUBLE)) - CASE WHEN {hit} THEN 1 ELSE 0 END"
    moduli = {"a": [2, 5, 11, 31, 101], "b": [5, 11, 31, 101], "bunsetsu": [11, 31, 101], "clause": [31, 101], "sentence": [101]}
    ends = ", ".join(f"list_filter(range(1, n + 1), lambda i: i = n OR {' OR '.join(f'p[i] % {k} = 0' for k in own)}) AS p_{level}" for level, own in moduli.items())
    return f"""WITH {S}, c0 AS (SELECT {_split(DOC_KEY, 85, 10)} AS split, length(text) AS n, list_transform(range(1, length(text) + 1), lambda i: unicode(substr(text, i::INT, 1))) AS cp FROM s),
c1 AS (SELECT *, list_transform(cp, lambda x: x + CASE WHEN x % 3 = 0 THEN 1 ELSE 0 END) AS p FROM c0), c AS (SELECT *, {ends} FROM c1),
i AS (SELECT *, unnest(range(1, n + 1)) AS spot FROM c),
k AS (SELECT split, spot, cp[spot] AS g, p[list_filter(p_a, lambda x: x >= spot)[1]] AS p_at, p[list_filter(p_bunsetsu, lambda x: x >= spot)[1]] AS p_c, {", ".join(f"p_{level}" for level in moduli)} FROM i),
l AS (SELECT *, p_at % 12 AS atom FROM k),
v AS (SELECT split, 'boundaries' AS head, ({bound}) / 5 AS loss, true AS counts FROM l UNION ALL SELECT split, 'atom', {soft(12, "g % 12 = atom")}, true FROM l
 UNION ALL SELECT split, 'inflection', ({flag}) / 10, atom IN {inflected} FROM l
 UNION ALL SELECT split, 'function', {soft(12, f"(g // 3) % 12 = CASE WHEN atom = {particle} THEN (p_at // 3) % 12 ELSE {unknown} END")}, atom = {particle} FROM l
 UNION ALL SELECT split, 'role', {soft(9, "g % 9 = p_c % 9")}, true FROM l),
m AS (SELECT split, head, count(*) FILTER (counts) AS characters, coalesce(avg(loss) FILTER (counts), 0.0) AS loss FROM v GROUP BY split, head),
w AS (SELECT * FROM (VALUES {", ".join(f"('{h}', {x})" for h, x in V.LOSS_WEIGHTS.items())}) AS w(head, weight))
SELECT split, head, characters, round(loss, 9) AS loss FROM m
UNION ALL SELECT split, 'total', max(characters), round(sum(weight::DOUBLE * loss), 9) FROM m JOIN w USING (head) GROUP BY split"""


def _coded_f1(metric: str) -> str:
    return f"WITH {_coded_pairs()} SELECT label, tp, fp, fn, round(f1, 9) AS f1 FROM f WHERE metric = '{metric}'"


MD5 = f"""g AS (SELECT document_id, trim(regexp_replace(text, '[{WS}]+', ' ', 'g')) AS t FROM ({DOCS})),
n AS (SELECT document_id, unnest(list_transform(range(1, greatest(length(t) - 1, 2)), lambda i: substr(t, i, 3))) AS gram FROM g WHERE length(t) > 0),
h AS (SELECT document_id, ('0x' || substr(md5(gram), 1, 8))::BIGINT AS h FROM n),
fp AS (SELECT document_id, ({' + '.join(f"(CASE WHEN 2 * count(*) FILTER (h & {1 << b} <> 0) >= count(*) THEN {1 << b} ELSE 0 END)" for b in range(32))})::BIGINT AS fp FROM h GROUP BY document_id)"""
SHARD = """n AS (SELECT doc_id, text, source, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS line, (ntile(7) OVER (ORDER BY doc_id) - 1)::INT AS shard FROM documents)"""

FINE, SOLID = "[A-Za-z]+|[0-9]+| +|[^A-Za-z0-9 ]", "[A-Za-z]+|[0-9]+|[,.;:!?]"
#: CTE t: sentences with their tokens.
_TOKENS = S.replace("{", "{{").replace("}", "}}") + """, t AS (SELECT document_id || '#' || sentence_index AS id, {text} AS text, length(text) AS n, length(text) % 8 AS k8, regexp_extract_all({text}, '{pattern}') AS t FROM s)"""
#: CTE w: distinct words of the documents.
_WORDS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)"
#: The atom type of a surrogate token w.
_WORD_ATOM = "CASE WHEN w[1] = ' ' THEN 'OTHER' WHEN regexp_matches(w, '^[0-9]') THEN 'NUMBER' WHEN NOT regexp_matches(w, '^[A-Za-z]') THEN 'PUNCT_SYMBOL' WHEN length(w) <= 2 THEN 'PARTICLE' WHEN length(w) % 5 = 0 THEN 'VERB_STEM' ELSE 'NOUN_LIKE' END"
#: CTE c: sentences with their code points, and the ends of each level of coded records.
_CODED = S + """, c AS (SELECT document_id || '#' || sentence_index AS id, text, length(text) AS n, list_transform(range(1, length(text) + 1), lambda i: unicode(substr(text, i::INT, 1))) AS g FROM s)"""
_CODED_ENDS = ", ".join(f"list_filter(range(1, n + 1), lambda i: i = n OR {' OR '.join(f'g[i] % {m} = 0' for m in own)}) AS g_{level}" for level, own in {"a": [2, 5, 11, 31, 101], "b": [5, 11, 31, 101], "bunsetsu": [11, 31, 101], "clause": [31, 101], "sentence": [101]}.items())


def _picked(values: list[str], at: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + f"][({at}) % {len(values)} + 1]"


def _mapped(table: dict, key: str, default: str = "NULL") -> str:
    one = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]" if isinstance(v, list) else f"'{v}'"
    return f"(CASE {key} " + " ".join(f"WHEN '{k}' THEN {one(v)}" for k, v in table.items()) + f" ELSE {default} END)"


def _map_labels() -> str:
    fields = {
        "p0": [*V.POS_ATOM, "?"], "p1": [*V.NOUN_DETAIL, *V.PARTICLE_DETAIL, "*"], "p4": [*V.COPULA_TYPES, "*"], "surface": [*V.PARTICLE_SURFACE, "に", *V.INFLECTION_SURFACE], "kase": ["LOC", "DIR", "TIME", "QUOTE", "-"],
        "normalized": [*V.INFLECTION_NORMALIZED, ""], "form": [*V.INFLECTION_FORM, ""], "dependency": [*V.DEPENDENCY_ROLE, "aux"], "predicate": ["yes", "no", "no"],
    }
    own = ", ".join(f"{_picked(v, f'u // {k + 1}')} AS {c}" for k, (c, v) in enumerate(fields.items()))
    function = f"""CASE WHEN p0 = '助詞' THEN CASE WHEN surface = 'に' THEN CASE kase WHEN 'LOC' THEN 'LOCATION' WHEN 'DIR' THEN 'DIRECTION' WHEN 'TIME' THEN 'TIME' ELSE 'UNKNOWN' END
      WHEN surface = 'と' AND kase = 'QUOTE' THEN 'QUOTATIVE' WHEN surface = 'で' THEN CASE kase WHEN 'LOC' THEN 'LOCATION' ELSE 'UNKNOWN' END
      ELSE coalesce({_mapped(V.PARTICLE_SURFACE, "surface")}, {_mapped(V.PARTICLE_DETAIL, "p1")}, 'UNKNOWN') END END"""
    copulas = "(" + ", ".join(f"'{x}'" for x in V.COPULA_TYPES) + ")"
    flags = " || ".join(_mapped(t, c, "[]") for t, c in ((V.INFLECTION_NORMALIZED, "normalized"), (V.INFLECTION_FORM, "form"), (V.INFLECTION_SURFACE, "surface")))
    return f"""WITH {_WORDS}, u AS (SELECT w, unicode(w) + 31 * length(w) + 7 * unicode(w[-1]) AS u FROM w), f AS (SELECT w, {own} FROM u), p AS (SELECT *, {function} AS function FROM f)
 SELECT w AS word, CASE WHEN p0 = '名詞' AND p1 = '固有名詞' THEN 'PROPER_LIKE' WHEN p0 = '名詞' AND p1 = '数詞' THEN 'NUMBER' WHEN p0 = '助動詞' AND p4 IN {copulas} THEN 'COPULA' ELSE {_mapped(V.POS_ATOM, "p0", "'OTHER'")} END AS atom_type, function,
   array_to_string(list_sort(list_distinct({flags})), ',') AS inflections, CASE WHEN function = 'TOPIC' THEN 'TOPIC' WHEN predicate = 'yes' THEN 'PREDICATE' ELSE {_mapped(V.DEPENDENCY_ROLE, "dependency", "'UNKNOWN'")} END AS role FROM p"""


def _validate_codes() -> str:
    unmatched = "a_spans_do_not_match_a_boundaries"
    return f"""WITH {_CODED}, e AS (SELECT id, n % 13 AS k, {_CODED_ENDS} FROM c)
 SELECT id, CASE k WHEN 1 THEN 'text_missing_or_empty' WHEN 2 THEN 'boundaries_missing' WHEN 3 THEN CASE WHEN len(g_a) > 1 THEN 'a_boundaries_not_sorted_unique,{unmatched}' ELSE '' END WHEN 4 THEN 'spans_missing_or_not_list'
   WHEN 5 THEN 'bunsetsu_missing_or_not_list' WHEN 6 THEN 'invalid_atom_type' WHEN 7 THEN 'invalid_particle_function' WHEN 8 THEN 'invalid_inflections' WHEN 9 THEN 'invalid_bunsetsu_role'
   WHEN 10 THEN 'a_span_out_of_range,a_spans_do_not_cover_text,{unmatched}' WHEN 11 THEN CASE WHEN len(g_a) > 1 THEN 'a_spans_not_contiguous,{unmatched}' ELSE '' END
   WHEN 12 THEN 'b_boundaries_not_list,b_spans_do_not_match_b_boundaries,bunsetsu_boundaries_missing_in_b' ELSE '' END AS codes FROM e"""


def _compiled(least: int = 8) -> str:
    """CTE d: sentences with tokens t, their ends te, and why they do not compile."""
    summed = lambda of: f"list_transform(range(1, len({of}) + 1), lambda i: list_sum(list_transform({of}[1:i], lambda x: length(x)))::BIGINT)"
    return f"""{_CHUNKS}, t0 AS (SELECT document_id || '#' || sentence_index AS id, text, length(text) AS n, regexp_extract_all(text, '{FINE}') AS t, regexp_extract_all(text, '[^ ]+ *| +') AS bt FROM s),
 d0 AS (SELECT t0.*, {summed("t")} AS te, {summed("bt")} AS be, h.before_ AS ce FROM t0 LEFT JOIN h USING (id)),
 d1 AS (SELECT *, list_filter(ce, lambda x: NOT list_contains(be, x)) AS lacks FROM d0),
 d AS (SELECT *, CASE WHEN n < {least} THEN 'length_out_of_range' WHEN n % 11 = 0 OR ce IS NULL THEN 'teacher_missing' WHEN len(lacks) > 0 THEN 'teacher_boundary_disagreement' END AS reason,
   CASE WHEN n < {least} THEN 'raw' WHEN n % 11 = 0 THEN 'sudachi_a' WHEN ce IS NULL THEN 'ginza_bunsetsu' WHEN len(lacks) > 0 THEN 'cross_teacher' END AS teacher,
   CASE WHEN n < {least} THEN 'length=' || n WHEN n % 11 = 0 OR ce IS NULL THEN '' WHEN len(lacks) > 0 THEN 'bunsetsu endpoints absent from b: [' || array_to_string(lacks, ', ') || ']' END AS detail FROM d1)"""


_FORM = "CASE WHEN w[1] = ' ' THEN 'SPACE' WHEN regexp_matches(w, '^[0-9]') THEN 'NUM' WHEN NOT regexp_matches(w, '^[A-Za-z]') THEN 'PUNCT' WHEN length(w) <= 2 THEN 'ADP' WHEN length(w) % 5 = 0 THEN 'VERB' ELSE 'NOUN' END"


def _gold_rows(role: str, atom: str, flag: str) -> str:
    """Rows of tokens with the roles of chunks; t: tokens, kinds: their forms, starts: where chunks begin (from 1)."""
    return f"""g AS (SELECT *, list_transform(range(1, len(starts) + 1), lambda i: kinds[starts[i]:coalesce(starts[i + 1] - 1, len(kinds))]) AS chunks FROM k2)
 SELECT id AS document_id, (unnest(range(len(t))))::INTEGER AS i, 0 AS errors, array_to_string(list_transform(chunks, lambda c: {role}), ',') AS roles, unnest(list_transform(kinds, lambda x: {atom})) AS atom_type,
   unnest(list_transform(kinds, lambda x: CASE WHEN x = 'ADP' THEN 'UNKNOWN' END)) AS function, unnest(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN kinds[i] = 'VERB' AND length(t[i]) % 10 = 0 THEN '{flag}' ELSE '' END)) AS inflections FROM g"""


def _ud_gold() -> str:
    atom = "CASE x WHEN 'SPACE' THEN 'OTHER' WHEN 'NUM' THEN 'NUMBER' WHEN 'PUNCT' THEN 'PUNCT_SYMBOL' WHEN 'ADP' THEN 'PARTICLE' WHEN 'VERB' THEN 'VERB_STEM' ELSE 'NOUN_LIKE' END"
    return f"""WITH {_TOKENS.format(text="replace(text, chr(9), ' ')", pattern=FINE)}, k AS (SELECT id, t, list_transform(t, lambda w: {_FORM}) AS kinds FROM t),
 k2 AS (SELECT *, list_filter(range(1, len(t) + 1), lambda i: i = 1 OR (kinds[i] <> 'SPACE' AND kinds[i - 1] = 'PUNCT')) AS starts FROM k),
 {_gold_rows("CASE WHEN list_contains(c, 'VERB') THEN 'PREDICATE' ELSE 'CASED_NOMINAL' END", atom, "PAST")}"""


def _knp_gold() -> str:
    atom = "CASE x WHEN 'PUNCT' THEN 'PUNCT_SYMBOL' WHEN 'ADP' THEN 'PARTICLE' WHEN 'VERB' THEN 'VERB_STEM' ELSE 'NOUN_LIKE' END"
    role = "CASE WHEN list_contains(c, 'VERB') THEN 'PREDICATE' WHEN len(list_filter(c, lambda x: x <> 'PUNCT')) = 0 THEN 'PUNCT' WHEN (list_contains(c, 'NOUN') OR list_contains(c, 'NUM')) AND list_contains(c, 'ADP') THEN 'CASED_NOMINAL' ELSE 'UNKNOWN' END"
    return f"""WITH {_TOKENS.format(text="text", pattern=SOLID)}, k AS (SELECT id, t, list_transform(t, lambda w: {_FORM}) AS kinds FROM t WHERE len(t) > 0),
 k2 AS (SELECT *, list_filter(range(1, len(t) + 1), lambda i: i = 1 OR kinds[i - 1] = 'PUNCT') AS starts FROM k),
 {_gold_rows(role, atom, "PAST")}"""


def _build_report() -> str:
    """Documents and conversations in order: dispositions by md5 prints, then sentences of the kept, firsts and quotas."""
    every = "SELECT source, seq::VARCHAR AS document_id, text FROM c"
    kept = "SELECT source, document_id, text, seq FROM p WHERE disposition = 'kept'"
    return f"""WITH RECURSIVE c AS MATERIALIZED (SELECT source, doc_id::VARCHAR AS document_id, text, doc_id::BIGINT AS seq FROM documents
 UNION ALL SELECT 'conversations', conv_id || ':' || turn, text, (1::BIGINT << 40) + conv_id::BIGINT * 1048576 + turn FROM conversations),
{MD5.replace(DOCS, every)},
k AS (SELECT seq, text, sha256(text) AS k FROM c WHERE text IS NOT NULL AND document_id IS NOT NULL), x AS MATERIALIZED (SELECT k, min(seq) AS seq, any_value(text) AS text FROM k GROUP BY k),
o AS MATERIALIZED (SELECT x.k, fp, row_number() OVER (ORDER BY seq) AS i FROM x JOIN fp ON seq = document_id::BIGINT WHERE length(text) >= 80),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept, false AS near UNION ALL
   SELECT i, CASE WHEN near THEN kept ELSE list_append(kept, fp) END, near FROM (
     SELECT o.i, fp, kept, len(list_filter(kept, lambda q: bit_count(xor(q, fp)) <= 1)) > 0 AS near FROM r JOIN o ON o.i = r.i + 1)),
m AS (SELECT k FROM o JOIN r USING (i) WHERE near),
p AS MATERIALIZED (SELECT c.*, CASE WHEN k.k IS NULL THEN 'invalid' WHEN k.k IN (SELECT k FROM m) THEN 'near' WHEN c.seq = x.seq THEN 'kept' ELSE 'exact' END AS disposition FROM c LEFT JOIN k ON c.seq = k.seq LEFT JOIN x ON k.k = x.k),
{_sentences('s', f"SELECT source, seq::VARCHAR AS document_id, text FROM ({kept})")},
u AS (SELECT source, row_number() OVER (PARTITION BY dedup_key ORDER BY document_id::BIGINT, sentence_index) AS place FROM s),
d AS (SELECT source, count(*) FILTER (disposition = 'kept') AS documents, count(*) FILTER (disposition = 'exact') AS exact_duplicate_documents, count(*) FILTER (disposition = 'near') AS near_duplicate_documents,
   count(*) FILTER (disposition = 'invalid' OR (disposition = 'kept' AND (length(text) = 0 OR length(document_id) = 0))) AS invalid_documents FROM p GROUP BY source),
z AS (SELECT source, count(*) AS candidates, count(*) FILTER (place = 1) AS firsts FROM u GROUP BY source)
SELECT d.*, coalesce(candidates, 0)::BIGINT AS candidate_sentences, least(100, coalesce(firsts, 0))::BIGINT AS selected, 100::BIGINT AS requested, (coalesce(candidates, 0) - coalesce(firsts, 0))::BIGINT AS duplicates,
  (100 - least(100, coalesce(firsts, 0)))::BIGINT AS shortfall FROM d LEFT JOIN z ON d.source IS NOT DISTINCT FROM z.source"""


ORACLES = {
    "sentences_extract": f"WITH {S} SELECT text, source, document_id, sentence_index, document_start, document_end, {_split(DOC_KEY, 98, 1)} AS split, dedup_key FROM s",
    "sentences_dedup": f"""WITH {S}, {_sentences('t', "SELECT 'conversations' AS source, conv_id::VARCHAR || ':' || turn::VARCHAR AS document_id, text FROM conversations")},
 b AS (SELECT *, 0 AS r, document_id::BIGINT AS o FROM s UNION ALL SELECT *, 1 AS r, NULL AS o FROM t),
 x AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY r, o, document_id, sentence_index) AS k FROM b) SELECT dedup_key, source, document_id, sentence_index FROM x WHERE k = 1""",
    "sentences_quota_sample": f"WITH {S}, {UNIQUE}, z AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sample_key)::INT AS rank FROM k) SELECT source, rank, document_id, sentence_index, text, sample_key FROM z WHERE rank <= 100",
    "sentences_quota_shortfall": f"""WITH {S}, {UNIQUE}, c AS (SELECT source, count(*) AS n FROM u GROUP BY source)
 SELECT source, 300::BIGINT AS requested, least(300, coalesce(n, 0))::BIGINT AS selected, (300 - least(300, coalesce(n, 0)))::BIGINT AS shortfall FROM (SELECT DISTINCT source FROM documents) LEFT JOIN c USING (source)""",
    "quota_unknown_sources": "SELECT 'nowhere' AS source, 5 AS quota",
    "docs_split_98_1_1": f"SELECT document_id, {_split(DOC_KEY, 98, 1)} AS split FROM ({DOCS})",
    "docs_split_85_10_5": f"SELECT document_id, {_split(DOC_KEY, 85, 10)} AS split FROM ({DOCS})",
    "lemma_split_80_10_10": f"WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\n]+')) AS lemma FROM documents) SELECT {_split('lemma', 80, 10)} AS split, count(*) AS lemmas FROM w WHERE lemma <> '' GROUP BY 1",
    "split_counts": f"WITH {S} SELECT {_split(DOC_KEY, 85, 10)} AS split, count(*) AS \"rows\", count(DISTINCT (source, document_id)) AS documents FROM s GROUP BY 1",
    "split_leakage": f"WITH {S}, x AS (SELECT source, document_id FROM s GROUP BY ALL HAVING count(DISTINCT {_split(DOC_KEY, 98, 1)}) > 1) SELECT count(*) AS leaking FROM x",
    "docs_top_hash": f"SELECT document_id, sha256({DOC_KEY}) AS rank_key FROM ({DOCS}) ORDER BY 2 LIMIT 50",
    "docs_exact_dedup": "SELECT min(doc_id) AS doc_id, sha256(text) AS document_key FROM documents GROUP BY sha256(text)",
    "first_documents_stream": "SELECT min(doc_id) AS doc_id, sha256(text) AS document_key FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)",
    "first_sentences_stream": f"WITH {S} SELECT dedup_key, min(document_id::BIGINT) AS doc_id, arg_min(sentence_index, document_id::BIGINT * 16777216 + sentence_index) AS sentence_index FROM s GROUP BY dedup_key",
    "shuffle_buffer": f"WITH {S} SELECT document_id, sentence_index FROM s",
    "simhash_md5": f"WITH {MD5} SELECT document_id, fp FROM fp",
    "simhash_bands": f"WITH {MD5} SELECT document_id, 0 AS band, fp & 65535 AS value FROM fp UNION ALL SELECT document_id, 1 AS band, fp >> 16 AS value FROM fp",
    "near_dup_pairs": f"""WITH {MD5}, f AS (SELECT document_id::BIGINT AS seq, fp FROM fp JOIN documents ON doc_id = document_id::BIGINT WHERE length(text) >= 80),
 o AS (SELECT fp, min(seq) AS seq FROM f GROUP BY fp)
 SELECT o.seq AS a, f.seq AS b FROM f JOIN o USING (fp) WHERE f.seq <> o.seq UNION ALL
 SELECT DISTINCT x.seq AS a, y.seq AS b FROM o x JOIN o y ON x.seq < y.seq AND bit_count(xor(x.fp, y.fp)) <= 1 AND (x.fp & 65535 = y.fp & 65535 OR x.fp >> 16 = y.fp >> 16)""",
    "near_dup_groups": f"""WITH RECURSIVE {MD5}, f AS (SELECT document_id::BIGINT AS seq, fp FROM fp JOIN documents ON doc_id = document_id::BIGINT WHERE length(text) >= 80),
 l AS (SELECT a.seq AS a, b.seq AS b FROM f a JOIN f b ON a.seq <> b.seq AND bit_count(xor(a.fp, b.fp)) <= 1),
 r AS (SELECT seq AS x, seq AS y FROM f UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
 c AS (SELECT x AS seq, min(y) AS component_id FROM r GROUP BY x), m AS (SELECT a AS seq, count(*) AS links FROM l GROUP BY a)
 SELECT f.seq AS doc_id, min(f.seq) OVER (PARTITION BY fp) AS "first", coalesce(links, 0) AS n_links, component_id FROM f JOIN c USING (seq) LEFT JOIN m USING (seq)""",
    "near_dup_scan": f"""WITH RECURSIVE {MD5}, t AS (SELECT doc_id, text, sha256(text) AS k FROM documents WHERE text IS NOT NULL),
 x AS (SELECT k, min(doc_id) AS seq, any_value(text) AS text FROM t GROUP BY k),
 f AS (SELECT x.k, fp, row_number() OVER (ORDER BY seq) AS i FROM x JOIN fp ON seq = document_id::BIGINT WHERE length(text) >= 80),
 r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept, false AS near UNION ALL
   SELECT i, CASE WHEN near THEN kept ELSE list_append(kept, fp) END, near FROM (
     SELECT f.i, fp, kept, len(list_filter(kept, lambda k: bit_count(xor(k, fp)) <= 1)) > 0 AS near FROM r JOIN f ON f.i = r.i + 1)),
 m AS (SELECT k FROM f JOIN r USING (i) WHERE near)
 SELECT doc_id, CASE WHEN t.k IN (SELECT k FROM m) THEN 'near' WHEN doc_id = x.seq THEN 'kept' ELSE 'exact' END AS disposition FROM t JOIN x ON t.k = x.k""",
    "holdout_anti_join": f"WITH {S}, {_sentences('t', "SELECT 'benchmark' AS source, item_id::VARCHAR AS document_id, text FROM benchmark")} SELECT source, count(*) AS sentences FROM s WHERE dedup_key NOT IN (SELECT dedup_key FROM t) GROUP BY source",
    "shards_manifest": f"""WITH {SHARD}, b AS (SELECT shard, line // 1024 AS block, min(line) AS s, max(line) AS e, count(*) AS k, sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY line)) AS h FROM n GROUP BY ALL)
 SELECT shard, min(s) AS start_line, max(e) + 1 AS end_line, sum(k)::BIGINT AS lines, sha256(string_agg(h, '' ORDER BY block)) AS sha256 FROM b GROUP BY shard""",
    "shards_merged": f"WITH {SHARD} SELECT shard, line, doc_id::VARCHAR AS document_id FROM n WHERE length(text) >= 80",
    "shards_reconcile": f"WITH {SHARD} SELECT shard, count(*) AS lines, count(*) FILTER (length(text) >= 80) AS successes, count(*) FILTER (length(text) < 80) AS failures, true AS reconciled FROM n GROUP BY shard",
    "script_distribution": f"WITH {_chars('documents')}, d AS (SELECT ch, count(*) AS n FROM c GROUP BY ch) SELECT {_script('ch')} AS script, sum(n)::BIGINT AS n FROM d GROUP BY 1",
    "char_class_distribution": f"""WITH {_chars('documents')}, d AS (SELECT ch, count(*) AS n FROM c GROUP BY ch)
 SELECT {_punct('ch')} AS punct, {_digit('ch')} AS digit, strpos('{V.SMALL_KANA}', ch) > 0 AS small_kana, strpos('{V.PROLONGED}', ch) > 0 AS prolonged_mark, strpos('{V.ITERATION}', ch) > 0 AS iteration_mark, sum(n)::BIGINT AS n FROM d GROUP BY ALL""",
    "script_transitions": f"""WITH {_chars('documents')}, d AS (SELECT prev_ch, ch, count(*) AS n FROM c WHERE prev_ch IS NOT NULL GROUP BY ALL),
 e AS (SELECT {_script('prev_ch')} AS "before", {_script('ch')} AS "after", n FROM d) SELECT "before", "after", sum(n)::BIGINT AS n FROM e WHERE "before" <> "after" GROUP BY ALL""",
    "codepoint_buckets": f"WITH {_chars('documents')}, d AS (SELECT DISTINCT ch, unicode(ch) AS u FROM c) SELECT ch, ({_mix('u')} & 8191)::INT AS bucket FROM d",
    "bigram_buckets": f"""WITH {_chars('documents')}, d AS (SELECT DISTINCT ch, coalesce(next_ch, '') AS next_ch, xor(xor(unicode(ch)::BIGINT << 21, coalesce(unicode(next_ch), 0)::BIGINT), 2654435769::BIGINT) AS u FROM c)
 SELECT ch, next_ch, ({_mix('u')} & 8191)::INT AS bucket FROM d""",
    "categorical_features": f"""WITH {S}, {_chars('s')}, d AS (SELECT prev_ch, ch, count(*) AS n FROM c GROUP BY ALL),
 e AS (SELECT n, {_script('ch')} AS s, {_script('prev_ch')} AS ps, prev_ch, {_punct('ch')} AS p, {_digit('ch')} AS g, ch FROM d),
 f(feature) AS (VALUES {', '.join(f"('{x}')" for x in FEATURE_NAMES)})
 SELECT feature, coalesce(sum(n) FILTER (feature = 'script:' || s OR feature = 'punct:' || p OR feature = 'digit:' || g OR (feature = 'script_transition' AND prev_ch IS NOT NULL AND ps <> s)
  OR (feature = 'small_kana' AND strpos('{V.SMALL_KANA}', ch) > 0) OR (feature = 'prolonged_mark' AND strpos('{V.PROLONGED}', ch) > 0) OR (feature = 'iteration_mark' AND strpos('{V.ITERATION}', ch) > 0)), 0)::BIGINT AS n
 FROM f, e GROUP BY feature""",
    "length_histogram": f"WITH {S} SELECT length(text)::INT AS length, count(*) AS n FROM s GROUP BY 1",
    "length_buckets": f"WITH {S} SELECT {_split(DOC_KEY, 85, 10)} AS split, CASE WHEN length(text) <= 32 THEN 32 WHEN length(text) <= 64 THEN 64 ELSE 128 END AS bucket, count(*) AS n FROM s GROUP BY ALL",
    "padded_batches": f"""WITH {S}, b AS (SELECT {_split(DOC_KEY, 85, 10)} AS split, CASE WHEN length(text) <= 32 THEN 32 WHEN length(text) <= 64 THEN 64 ELSE 128 END AS bucket, document_id::BIGINT AS doc, sentence_index, length(text) AS k FROM s),
 p AS (SELECT *, ((row_number() OVER (PARTITION BY split, bucket ORDER BY doc, sentence_index) - 1) // 64)::BIGINT AS batch, count(*) OVER (PARTITION BY split, bucket) AS n FROM b)
 SELECT split, bucket, batch, max(k)::INT AS longest, sum(k)::BIGINT AS chars FROM p WHERE (batch + 1) * 64 <= n GROUP BY ALL""",
    "batch_schedule": f"""WITH {S}, b AS (SELECT {_split(DOC_KEY, 85, 10)} AS split, CASE WHEN length(text) <= 32 THEN 32 WHEN length(text) <= 64 THEN 64 ELSE 128 END AS bucket, count(*) AS n FROM s GROUP BY ALL),
 p AS (SELECT split, bucket, unnest(range(n // 64)) AS batch FROM b)
 SELECT split, bucket, batch, (row_number() OVER (PARTITION BY split ORDER BY sha256('1:' || split || ':' || bucket || ':' || batch)) - 1)::BIGINT AS place FROM p""",
    "padded_codepoints": f"""WITH {S}, b AS (SELECT {_split(DOC_KEY, 85, 10)} AS split, CASE WHEN length(text) <= 32 THEN 32 WHEN length(text) <= 64 THEN 64 ELSE 128 END AS bucket, text FROM s)
 SELECT split, bucket, count(*) AS n, sum(bucket)::BIGINT AS places, sum(length(text))::BIGINT AS filled, sum(list_sum(list_transform(range(1, length(text) + 1), lambda i: unicode(substr(text, i, 1)))))::BIGINT AS points FROM b GROUP BY ALL""",
    "common_rows": f"WITH {S} SELECT document_id, sentence_index FROM s WHERE length(text) % 5 <> 0 AND length(text) % 7 <> 0",
    "char_ngrams_top": f"""WITH g AS (SELECT trim(regexp_replace(text, '[{WS}]+', ' ', 'g')) AS t FROM documents), n AS (SELECT unnest(list_transform(range(1, greatest(length(t) - 1, 2)), lambda i: substr(t, i, 3))) AS gram FROM g WHERE length(t) > 0)
 SELECT gram, count(*) AS n FROM n GROUP BY gram ORDER BY n DESC, gram LIMIT 50""",
    "boundary_f1": f"""WITH {R}, x AS (SELECT 'a' AS level, a AS g, pa AS p FROM r UNION ALL SELECT 'b', b, pb FROM r UNION ALL SELECT 'bunsetsu', c, pc FROM r UNION ALL SELECT 'clause', [n], [n] FROM r UNION ALL SELECT 'sentence', [n], [n] FROM r),
 t AS (SELECT level, sum(len(list_intersect(g, p))) AS tp, sum(len(p) - len(list_intersect(g, p))) AS fp, sum(len(g) - len(list_intersect(g, p))) AS fn FROM x GROUP BY level)
 SELECT level, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1 FROM t""",
    "atom_f1": f"WITH {_label_scores(_atom, V.ATOM_TYPES, 'a', 'pa')} SELECT label, tp, fp, fn, f1 FROM x",
    "atom_macro_f1": f"WITH {_label_scores(_atom, V.ATOM_TYPES, 'a', 'pa').replace(', 9) ELSE', ', 15) ELSE')} SELECT round(avg(f1) FILTER (tp + fp + fn > 0), 9) AS macro_f1 FROM x",
    "role_f1": f"WITH {_label_scores(_role, V.BUNSETSU_ROLES, 'c', 'pc')} SELECT label, tp, fp, fn, f1 FROM x",
    "tree_exact": f"WITH {R} SELECT count(*) AS sentences, round(avg(CASE WHEN a = pa AND b = pb AND c = pc THEN 1.0 ELSE 0.0 END), 9) AS complete_tree_exact_match FROM r",
    "corpus_stats": f"""WITH {R}, k AS (SELECT 'sentence_length' AS metric, n::VARCHAR AS key FROM r UNION ALL SELECT 'script', unnest(sc) FROM r UNION ALL SELECT 'boundary', 'a' FROM (SELECT unnest(a) FROM r) UNION ALL SELECT 'boundary', 'b' FROM (SELECT unnest(b) FROM r)
 UNION ALL SELECT 'boundary', 'bunsetsu' FROM (SELECT unnest(c) FROM r) UNION ALL SELECT 'boundary', 'clause' FROM r UNION ALL SELECT 'boundary', 'sentence' FROM r
 UNION ALL SELECT 'atom_type', {_atom('k')} FROM (SELECT unnest(list_transform(a, lambda i: sc[i])) AS k FROM r) UNION ALL SELECT 'bunsetsu_role', {_role('k')} FROM (SELECT unnest(list_transform(c, lambda i: sc[i])) AS k FROM r))
 SELECT metric, key, count(*) AS count FROM k GROUP BY ALL""",
    "endpoint_hierarchy": f"""WITH {R}, m AS (SELECT document_id, sentence_index, list_sort(list_filter(pb, lambda x: NOT list_contains(pc, x))) AS l, list_sort(list_filter(pc, lambda x: NOT list_contains(pa, x))) AS e FROM r)
 SELECT document_id, sentence_index, CASE WHEN len(e) > 0 THEN 'bunsetsu endpoints absent from a: [' || array_to_string(e, ', ') || ']' ELSE 'b endpoints absent from bunsetsu: [' || array_to_string(l, ', ') || ']' END AS told FROM m WHERE len(l) > 0 OR len(e) > 0""",
    "nested_boundaries": f"""WITH {R}, j AS (SELECT document_id, sentence_index, n, pc AS c, list_sort(list_distinct(list_concat(pb, pc))) AS b, list_sort(list_distinct(list_concat(pa, pb, pc))) AS a FROM r)
 SELECT document_id, sentence_index, array_to_string(a, ',') AS a, array_to_string(b, ',') AS b, array_to_string(c, ',') AS bunsetsu, n::VARCHAR AS clause, n::VARCHAR AS sentence FROM j""",
    "partition_spans": f"""WITH {R}, j AS (SELECT document_id, sentence_index, text, unnest(list_concat([0], b[:-2])) AS s, unnest(b) AS e FROM r)
 SELECT document_id, sentence_index, s::INT AS "start", e::INT AS "end", substr(text, s + 1, e - s) AS surface FROM j""",
    "tree_edges": f"""WITH {R}, v AS (SELECT document_id, sentence_index, 'a' AS level, a AS x, b AS y FROM r UNION ALL SELECT document_id, sentence_index, 'b', b, c FROM r UNION ALL SELECT document_id, sentence_index, 'bunsetsu', c, [n] FROM r UNION ALL SELECT document_id, sentence_index, 'clause', [n], [n] FROM r),
 w AS (SELECT document_id, sentence_index, level, y, unnest(list_concat([0], x[:-2])) AS s, unnest(x) AS e FROM v)
 SELECT document_id, sentence_index, level, s::INT AS "start", e::INT AS "end", coalesce(list_max(list_filter(y, lambda k: k < e)), 0)::INT AS parent_start, list_min(list_filter(y, lambda k: k >= e))::INT AS parent_end FROM w""",
    "teacher_agreement": f"WITH {R} SELECT 'aligned' AS reason, count(*) AS n, sum(len(a))::BIGINT AS tokens FROM r",
    "decode_records": _decoded(),
    "argmax_decode": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best FROM embeddings",
    "softmax_confidence": "SELECT vec_id, round(1 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))), 9) AS confidence FROM embeddings",
    "web_parquet_scan": "SELECT doc_id::VARCHAR AS document_id, CASE WHEN length(text) > 0 THEN lang ELSE 'invalid' END AS language, CASE WHEN length(text) > 0 THEN length(text) ELSE 0 END::INT AS chars FROM documents",
    "function_f1": _coded_f1("particle_function"),
    "inflection_multilabel": _coded_f1("inflection"),
    "score_report": _score_report(),
    "model_loss": _model_loss(),
    "teacher_systems": _systems(),
    "teacher_chunks": f"{_CHUNKS} SELECT id, array_to_string(before_, ',') AS before, array_to_string(after_, ',') AS after FROM h",
    "align_surfaces": f"""WITH {_TOKENS.format(text="text", pattern=FINE)},
 f AS (SELECT id, n, k8 AS k, len(t) AS z, len(t) // 2 AS m, list_sum(list_transform(t[1:len(t) // 2], lambda x: length(x)))::BIGINT AS s, length(t[-1]) AS tail FROM t),
 r AS (SELECT id, CASE k WHEN 1 THEN 'surface_mismatch' WHEN 2 THEN 'empty_surface' WHEN 3 THEN 'teacher_does_not_cover_text' WHEN 5 THEN 'non_monotonic_offset' WHEN 6 THEN 'invalid_teacher_offsets' WHEN 7 THEN 'surface_offset_mismatch' END AS reason,
   CASE WHEN k IN (0, 4) THEN z WHEN k = 3 THEN z - 1 ELSE m END AS token_index, coalesce(s, 0) AS s, n, k, z, tail FROM f)
 SELECT id, reason, token_index::INTEGER AS token_index, CASE k WHEN 1 THEN 'at raw offset ' || s || ': ' || chr(39) || 'Q~' || chr(39) WHEN 2 THEN chr(39) || chr(39) WHEN 3 THEN 'covered ' || (n - tail) || '/' || n || ' codepoints'
   WHEN 5 THEN 'expected ' || s || ', got ' || (s + 1) WHEN 6 THEN '(' || s || ', None)' WHEN 7 THEN chr(39) || 'Q~' || chr(39) END AS detail, CASE WHEN reason IS NULL THEN z ELSE 0 END::INTEGER AS spans FROM r""",
    "map_labels": _map_labels(),
    "validate_codes": _validate_codes(),
    "compile_records": f"""{_compiled()}
 SELECT id AS document_id, (unnest(range(len(t))))::INTEGER AS i, unnest(list_transform(range(1, len(t) + 1), lambda i: te[i] - length(t[i])))::INTEGER AS "start", unnest(te)::INTEGER AS "end",
   unnest(list_transform(t, lambda w: {_WORD_ATOM})) AS atom_type, unnest(list_transform(t, lambda w: CASE WHEN {_WORD_ATOM} = 'PARTICLE' THEN 'TOPIC' END)) AS function,
   unnest(list_transform(t, lambda w: CASE WHEN {_WORD_ATOM} = 'VERB_STEM' THEN 'PAST' ELSE '' END)) AS inflections FROM d WHERE reason IS NULL""",
    "compile_failures": f"{_compiled()} SELECT id AS document_id, reason, teacher, detail FROM d WHERE reason IS NOT NULL",
    "compile_summary": f"""{_compiled()} SELECT count(*) AS total_sentences, count(*) FILTER (reason IS NULL) AS successfully_aligned, count(*) FILTER (reason IS NOT NULL) AS dropped,
 CASE WHEN count(*) > 0 THEN 100.0::DOUBLE * count(*) FILTER (reason IS NOT NULL) / count(*) ELSE 0.0 END AS drop_percentage FROM d""",
    "synthetic_paradigms": f"""WITH {_WORDS}, v AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{p}', '{e}', '{','.join(f)}')" for c, table in V.PARADIGMS.items() for p, (e, f) in table.items())}) AS v(conjugation, paradigm, e, flags)),
 l AS (SELECT w || CASE length(w) % 3 WHEN 0 THEN 'く' WHEN 1 THEN 'る' ELSE 'む' END AS lemma, w, CASE length(w) % 3 WHEN 0 THEN 'godan_k' WHEN 1 THEN 'ichidan' END AS conjugation FROM w)
 SELECT lemma, paradigm, w || e AS text, {_split("lemma", 80, 10)} AS split, flags FROM l JOIN v USING (conjugation)""",
    "synthetic_unsupported": f"WITH {_WORDS} SELECT w || 'む' AS lemma FROM w WHERE length(w) % 3 = 2",
    "ud_gold": _ud_gold(),
    "knp_gold": _knp_gold(),
    "model_params": "SELECT size, parameters::BIGINT AS parameters, characters, (parameters * characters)::BIGINT AS products FROM (VALUES ('50k', 58752), ('100k', 102392), ('150k', 134832), ('250k', 242592)) AS m(size, parameters), (SELECT coalesce(sum(length(text)), 0)::BIGINT AS characters FROM documents)",
    "build_report_md5": _build_report(),
    "activations": """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), z AS (SELECT vec_id, x, abs(x) / sqrt(2.0::DOUBLE) AS z FROM x),
 t AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * z) AS t FROM z),
 e AS (SELECT *, sign(x) * (1 - exp(-z * z) * t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE))))) AS erf FROM t)
 SELECT vec_id, round(sum(0.5 * x * (1 + erf)), 7) AS gelu, round(sum(1 / (1 + exp(-x))), 7) AS logistic FROM e GROUP BY vec_id""",
    "requested_documents": """WITH i AS (SELECT DISTINCT page_id * 7 AS id FROM pages)
 SELECT id::VARCHAR AS document_id, CASE WHEN doc_id IS NULL THEN 'missing' ELSE 'found' END AS told, coalesce(length(text), 0)::INTEGER AS chars FROM i LEFT JOIN documents ON doc_id = id""",
    "report_text": """SELECT '{' || chr(10) || '  "documents": ' || count(*) || ',' || chr(10) || '  "characters": ' || coalesce(sum(length(text)), 0) || ',' || chr(10) || '  "sources": ' || count(DISTINCT source) || chr(10) || '}' || chr(10) AS report FROM documents""",
    "weights_in_use": f"""WITH {S}, t AS (SELECT text FROM s UNION SELECT text FROM documents)
 SELECT count(*) FILTER (length(text) BETWEEN 1 AND 128) AS sentences, 0::BIGINT AS differing, count(*) FILTER (coalesce(length(text), 0) NOT BETWEEN 1 AND 128) AS rejected FROM t""",
    "wiki_lines": "SELECT 'wiki' AS source, doc_id::VARCHAR AS document_id, length(text)::INTEGER AS chars, 'document ' || doc_id AS title FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0",
    "document_lines": """WITH o AS (SELECT source, text FROM documents WHERE doc_id % 10 <> 0 AND length(text) > 0)
 SELECT source, count(*) AS documents, sum(length(text))::BIGINT AS chars, (SELECT count(*) FROM o) AS lines FROM o GROUP BY source""",
    "split_lines": f"SELECT document_id, split FROM (SELECT document_id, {_split(DOC_KEY, 85, 10)} AS split FROM ({DOCS})) WHERE split = 'dev'",
    "limited_lines": "SELECT least(100, count(*)) AS lines FROM documents",
    "good_and_bad_lines": f"{_compiled()} SELECT coalesce(reason, 'atoms ' || len(t)) AS told, count(*) AS n FROM d GROUP BY ALL",
    "compiled_stream": f"{_compiled(4)} SELECT CASE WHEN n % 17 = 0 THEN 'invalid_json' ELSE coalesce(reason, 'compiled') END AS told, count(*) AS n FROM d GROUP BY ALL",
    "training_files": f"""WITH {S}, c AS (SELECT {_split(DOC_KEY, 85, 10)} AS split, length(text) AS n, CASE WHEN length(text) <= 32 THEN 32 WHEN length(text) <= 64 THEN 64 ELSE 128 END AS bucket, list_transform(range(1, length(text) + 1), lambda i: unicode(substr(text, i::INT, 1))) AS g FROM s),
 e AS (SELECT split, bucket, n, g, {_CODED_ENDS} FROM c),
 x AS (SELECT *, list_transform(range(1, n + 1), lambda spot: g[list_filter(g_a, lambda x: x >= spot)[1]] % 12) AS atoms, list_transform(range(1, n + 1), lambda spot: g[list_filter(g_bunsetsu, lambda x: x >= spot)[1]] % 9) AS roles FROM e)
 SELECT split, bucket, count(*) AS n, sum(n)::BIGINT AS chars, sum(list_sum(atoms))::BIGINT AS atoms, sum(list_sum(roles))::BIGINT AS roles, sum(len(g_a) + len(g_b) + len(g_bunsetsu) + len(g_clause) + len(g_sentence))::BIGINT AS ends FROM x GROUP BY split, bucket""",
    "invalid_documents": """SELECT doc_id::VARCHAR AS document_id, 'invalid_document' AS reason, CASE WHEN doc_id % 10 = 1 THEN 0 WHEN doc_id % 10 = 0 THEN -1 ELSE coalesce(length(text), -1) END::INTEGER AS chars FROM documents
 WHERE doc_id % 10 IN (0, 1) OR text IS NULL OR text = '' OR source IS NULL OR source = ''""",
    "rejected_texts": """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN '' WHEN doc_id % 10 <> 0 THEN substr(text, 1, 125 + (doc_id % 9)::INT) END AS text FROM documents),
 r AS (SELECT doc_id::VARCHAR AS document_id, CASE WHEN text IS NULL OR text = '' THEN 'text must be non-empty' WHEN length(text) > 128 THEN 'text exceeds 128 code points: ' || length(text) END AS reason FROM t) SELECT * FROM r WHERE reason IS NOT NULL""",
    "display_labels": f"""WITH {_CODED}, e AS (SELECT {_CODED_ENDS}, g FROM c), x AS (SELECT unnest(list_transform(g_a, lambda i: g[i])) AS v FROM e),
 l AS (SELECT {_picked([x.removesuffix("_LIKE") for x in V.ATOM_TYPES], "v")} || CASE WHEN v % 12 = {V.ATOM_TYPES.index("PARTICLE")} THEN ' · ' || {_picked(V.PARTICLE_FUNCTIONS, "v // 3")} ELSE '' END AS label FROM x) SELECT label, count(*) AS n FROM l GROUP BY label""",
    "affine_scans": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
 SELECT vec_id, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * pow(0.5::DOUBLE, len(v) - i))), 6) AS forward, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * pow(0.5::DOUBLE, i - 1))), 6) AS backward FROM v""",
    "failure_stats": f"""{_compiled()}, w AS (SELECT unnest(t) AS w FROM d WHERE reason IS NULL), a AS (SELECT {_WORD_ATOM} AS atom FROM w)
 SELECT 'drop_reason' AS metric, reason AS key, count(*) AS count FROM d WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'sentence_length', n::VARCHAR, count(*) FROM d WHERE reason IS NULL GROUP BY n
 UNION ALL SELECT 'atom_type', atom, count(*) FROM a GROUP BY atom UNION ALL SELECT 'function', 'TOPIC', count(*) FROM a WHERE atom = 'PARTICLE' HAVING count(*) > 0 UNION ALL SELECT 'inflection', 'PAST', count(*) FROM a WHERE atom = 'VERB_STEM' HAVING count(*) > 0""",
    "target_arrays": f"""WITH {_CODED}, e AS (SELECT id, n, {_CODED_ENDS}, g FROM c),
 x AS (SELECT id, list_transform(range(1, n + 1), lambda spot: g[list_filter(g_a, lambda x: x >= spot)[1]]) AS own, list_transform(range(1, n + 1), lambda spot: g[list_filter(g_bunsetsu, lambda x: x >= spot)[1]]) AS ch FROM e)
 SELECT id, array_to_string(list_transform(own, lambda v: (v % 12)::VARCHAR), ',') AS atom, array_to_string(list_transform(own, lambda v: (CASE WHEN v % 12 = {V.ATOM_TYPES.index("PARTICLE")} THEN (v // 3) % 12 ELSE {V.PARTICLE_FUNCTIONS.index("UNKNOWN")} END)::VARCHAR), ',') AS function,
   array_to_string(list_transform(ch, lambda v: (v % 9)::VARCHAR), ',') AS role FROM x""",
}
ORACLES["encoded_pairs"] = ORACLES["categorical_features"]
