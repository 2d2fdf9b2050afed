"""DuckDB statements for the training-data queries that SQL can express."""

from __future__ import annotations

from keyroll.llm import mixing, rules, secrets, turn_repair

# Words (position i from 0) of every document.
_WORDS = r"""
w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             coalesce(text, '') AS t FROM documents)"""


def _quality_rules() -> str:
    stops = ", ".join(f"'{s}'" for s in rules.STOP_FORMS)
    tests = " AND ".join(f"{n} >= {lo}" if hi is None else f"{n} <= {hi}" if lo is None else f"{n} BETWEEN {lo} AND {hi}"
                         for n, lo, hi in rules.THRESHOLDS)
    return rf"""
WITH {_WORDS},
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
m AS (
 SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: x IN ({stops}))) AS n_stop,
  len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha,
  len(list_filter(range(2, len(sp) - 1), lambda i: sp[i] = sp[i + 1] AND sp[i] <> '' AND NOT regexp_matches(sp[i], '[\x09-\x0D]'))) AS n_pairs
 FROM (SELECT *, string_split(t, ' ') AS sp FROM w) w LEFT JOIN cov USING (doc_id)),
r AS (
 SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word_length,
  CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbol_ratio,
  CASE WHEN n_words > 0 THEN n_stop::DOUBLE / n_words ELSE 0 END AS stop_word_ratio,
  CASE WHEN len(ls) > 0 THEN (len(ls) - len(list_distinct(ls)))::DOUBLE / len(ls) ELSE 0 END AS dup_line_ratio,
  CASE WHEN n_words > 0 THEN n_pairs::DOUBLE / n_words ELSE 0 END AS pair_repeat_ratio,
  CASE WHEN n_words > 0 THEN n_alpha::DOUBLE / n_words ELSE 0 END AS alpha_word_ratio FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 (NOT base_failed AND {tests}) AS kept FROM r"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _secret_scan() -> str:
    def spans(kind: str, pattern: str, group: int) -> str:
        p = _quoted(pattern)
        return f"""
SELECT doc_id, {secrets.KINDS.index(kind)} AS kind, m[i] AS word, v[i] AS val,
 (list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0))::BIGINT AS s,
 length(m[i]) AS n
FROM (SELECT doc_id, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (
 SELECT doc_id, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS v, string_split_regex(t, {p}) AS g FROM t))"""

    cls = " ".join(f"WHEN regexp_matches(word, {_quoted(p)}) THEN {secrets._s_limit(b)}" for p, _, b in secrets.CLASSES)
    allowed = " OR ".join(f"regexp_matches(word, {_quoted(p)})" for p in secrets.ALLOWED)
    names = "['" + "','".join(secrets.KINDS) + "']"
    text = f"{names}[kind + 1] || ':' || s || ':' || (s + n)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT * FROM ({spans('assign', secrets.ASSIGN, 2)}) WHERE length(val) >= {secrets.ASSIGN_VALUE}
 UNION ALL {spans('access', secrets.ACCESS, 0)} UNION ALL {spans('hex', secrets.HEX, 0)}),
whole AS ({spans('entropy', secrets.CANDIDATE, 0)}),
cut AS (SELECT DISTINCT r.doc_id, r.s, r.word, r.n FROM whole r JOIN base b ON b.doc_id = r.doc_id AND b.s < r.s + r.n AND b.s + b.n > r.s),
letter AS (SELECT doc_id, s, n, i, substr(word, i, 1) AS c FROM (SELECT *, unnest(range(1, (n + 1)::BIGINT)) AS i FROM cut)),
hid AS (SELECT DISTINCT l.doc_id, l.s, l.i FROM letter l JOIN base b ON b.doc_id = l.doc_id AND l.s + l.i - 1 >= b.s AND l.s + l.i - 1 < b.s + b.n),
masked AS (SELECT l.doc_id, l.s, string_agg(CASE WHEN h.i IS NULL THEN c ELSE ' ' END, '' ORDER BY l.i) AS t
 FROM letter l LEFT JOIN hid h ON h.doc_id = l.doc_id AND h.s = l.s AND h.i = l.i GROUP BY l.doc_id, l.s),
piece AS (SELECT doc_id, s0 + (list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x)))
   + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0))::BIGINT AS s, m[i] AS word, length(m[i]) AS n
 FROM (SELECT doc_id, s0, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, s AS s0,
  regexp_extract_all(t, {_quoted(secrets.CANDIDATE)}, 0) AS m, string_split_regex(t, {_quoted(secrets.CANDIDATE)}) AS g FROM masked))),
run AS (SELECT doc_id, s, word, n FROM (SELECT doc_id, s, word, n FROM piece UNION ALL
  SELECT r.doc_id, r.s, r.word, r.n FROM whole r WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.doc_id = r.doc_id AND c.s = r.s)) WHERE NOT ({allowed})),
win AS (SELECT doc_id, s, word, n, i, substr(word, i, {secrets.WINDOW}) AS x
 FROM (SELECT *, unnest(range(1, (n - {secrets.WINDOW} + 2)::BIGINT)) AS i FROM run)),
chars AS (SELECT doc_id, s, word, n, i, c, count(*) AS k FROM (SELECT *, unnest(string_split(x, '')) AS c FROM win) GROUP BY ALL),
low AS (SELECT doc_id, s, word, n, min(sk) AS low FROM (
 SELECT doc_id, s, word, n, i, sum(round(k * log2(k) * {secrets.SCALE})) AS sk FROM chars GROUP BY ALL) GROUP BY ALL),
hits AS (SELECT doc_id, {secrets.KINDS.index('entropy')} AS kind, s, n FROM low WHERE low <= CASE {cls} END),
agg AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
  count(*) FILTER (kind = 2) AS n_hex, string_agg({text}, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
  string_agg({text}, ',' ORDER BY s, kind) AS spans
 FROM (SELECT doc_id, kind, s, n FROM base UNION ALL SELECT doc_id, kind, s, n FROM hits) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN agg USING (doc_id)"""


def _source_mix(weights: dict, total: str, epochs: int, seed: int = 17) -> str:
    def weight(level: str) -> str:
        cases = "".join(f" WHEN {level} = '{n}' THEN {w}" for n, w in weights.get(level, {}).items())
        return f"(CASE{cases} ELSE 1 END)" if cases else "1"

    def fill(src: str, parent: str, name: str, budget: str, out: str) -> str:
        part = f"PARTITION BY {parent} " if parent else ""
        order = f"{part}ORDER BY cap::DOUBLE / weight, {name}"
        return f"""
SELECT *, CASE WHEN mf IS NULL OR k < mf THEN cap ELSE least(cap, ({budget} - mu) * weight // mo) END AS {out} FROM (
 SELECT *, min(CASE WHEN NOT ok THEN k END) OVER ({part}) AS mf,
  arg_min(used, CASE WHEN NOT ok THEN k END) OVER ({part}) AS mu, arg_min(open, CASE WHEN NOT ok THEN k END) OVER ({part}) AS mo
 FROM (SELECT *, cap::HUGEINT * open <= ({budget} - used) * weight AS ok FROM (
  SELECT *, row_number() OVER ({order}) AS k,
   coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS used,
   (sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS open FROM ({src}))))"""

    top = fill(f"SELECT domain, cap, {weight('domain')} AS weight, total FROM dom, tot", "", "domain", "total", "b1")
    mid = fill(f"SELECT domain, lang, m.cap, {weight('lang')} AS weight, b1 FROM lng m JOIN t1 USING (domain)",
               "domain", "lang", "b1", "b2")
    low = fill(f"SELECT domain, lang, source, l.cap, l.tokens, {weight('source')} AS weight, b2 FROM leaf l JOIN t2 USING (domain, lang)",
               "domain, lang", "source", "b2", "budget")
    return rf"""
WITH d AS (SELECT doc_id, coalesce('d' || (try_cast(nullif(regexp_extract(source, '[0-9]+$'), '') AS INT) % 3), '') AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens, (sum(tokens) * {epochs})::HUGEINT AS cap FROM d GROUP BY ALL),
lng AS (SELECT domain, lang, sum(cap)::HUGEINT AS cap FROM leaf GROUP BY ALL),
dom AS (SELECT domain, sum(cap)::HUGEINT AS cap FROM lng GROUP BY ALL),
tot AS (SELECT {total} AS total FROM (SELECT sum(tokens)::HUGEINT AS available FROM leaf)),
t1 AS (SELECT domain, b1 FROM ({top})), t2 AS (SELECT domain, lang, b2 FROM ({mid})),
plan AS (SELECT domain, lang, source, tokens AS leaf_tokens, budget::BIGINT AS budget,
  budget // greatest(tokens, 1) AS whole, budget % greatest(tokens, 1) AS part FROM ({low})),
k AS (SELECT d.*, budget, whole, part, md5('{seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM d JOIN plan USING (domain, lang, source)),
c AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, tokens
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k),
e AS (SELECT *, whole + (CASE WHEN part > 0 AND start < part THEN 1 ELSE 0 END) AS epochs FROM c)
SELECT doc_id, unnest(range(epochs::BIGINT))::INT AS epoch, tokens, domain, lang, source, budget FROM e"""


def _chat_format() -> str:
    return """
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1)::BIGINT AS turn, role, text FROM conversations),
one AS (SELECT conv_id, turn, role, text, md5(concat_ws('|', turn, coalesce('r' || role, ''), coalesce('t' || text, ''))) AS h FROM t),
per AS (SELECT conv_id, turn, string_agg(h, '' ORDER BY role NULLS FIRST, text NULLS FIRST) AS h FROM one GROUP BY ALL),
pre AS (SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS last,
  string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM per),
whole AS (SELECT p, min(conv_id) AS conv_id, count(*) AS copies FROM pre WHERE last GROUP BY p),
kept AS (SELECT conv_id, copies FROM whole WHERE p NOT IN (SELECT p FROM pre WHERE NOT last))
SELECT k.conv_id, count(*) AS n_turns, k.copies,
 string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), ''
  ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS rendered
FROM kept k JOIN t ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY k.conv_id, k.copies"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, byte by byte over the table of its polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: "
            f"xor(c >> 8, {table}[((xor(c, b) & 255) + 1)::BIGINT]::BIGINT)), 4294967295)")


def _turn_repair() -> str:
    t, keep = turn_repair, "code NOT IN ('-')"

    def add(state: str, cost: str, edit: str) -> str:
        """A state is its cost in six digits, then its edits: the least string is the cheapest, then ASCII-least."""
        return f"(lpad((substr({state}, 1, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({state}, 7) || '{edit}')"

    late = f"CASE WHEN code IN ('S', 'U', 'A', 'X') THEN {t.TRUNCATED} ELSE 0 END"
    kept = {c: add("{0}", late, "K") for c in "sua"}
    open_ = "least(c0, c1, c3)"
    return rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate FROM conversations),
hurt AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS k, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, fate FROM src),
twice AS (SELECT k, turn, role, text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM hurt WHERE fate <> 0),
num AS (SELECT k, turn, role, text, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i,
  right(regexp_replace(text, '[ 	-
]+$', ''), 1) AS tail FROM twice),
seen AS (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY i) AS nth, left(role, 1) AS r1 FROM num),
f AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated'
  ELSE '' END AS fault, lead(r1) OVER (PARTITION BY k ORDER BY i) AS r2 FROM seen),
l AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN '-' WHEN fault = 'truncated' THEN upper(c) ELSE c END AS code
  FROM (SELECT *, CASE WHEN r1 IN ('s', 'u', 'a') THEN r1 ELSE 'x' END AS c FROM f)),
dp AS (
 SELECT DISTINCT k, 0::BIGINT AS i, '000000' AS c0, NULL::VARCHAR AS c1, '{t.INSERT:06d}I' AS c2, '{2 * t.INSERT:06d}II' AS c3 FROM l
 UNION ALL
 SELECT k, i, n0, n1, m2, least(n3, {add("m2", t.INSERT, "I")}) FROM (
  SELECT *, least(n2, {add("n0", t.INSERT, "I")}, {add("n1", t.INSERT, "I")}, {add("n3", t.INSERT, "I")}) AS m2 FROM (
   SELECT dp.k, l.i, {add("c0", t.DELETE, "D")} AS n0,
    least({add("c1", t.DELETE, "D")}, CASE WHEN code IN ('s', 'S') THEN {kept["s"].format("c0")} END) AS n1,
    least({add("c2", t.DELETE, "D")}, CASE WHEN code IN ('u', 'U') THEN {kept["u"].format(open_)} END,
     CASE WHEN {keep} THEN {add(open_, f"{t.REROLE} + {late}", "R")} END) AS n2,
    least({add("c3", t.DELETE, "D")}, CASE WHEN code IN ('a', 'A') THEN {kept["a"].format("c2")} END,
     CASE WHEN {keep} THEN {add("c2", f"{t.REROLE} + {late}", "R")} END) AS n3
   FROM dp JOIN l ON l.k = dp.k AND l.i = dp.i + 1))),
best AS (SELECT k, least(c0, c3) AS b FROM dp JOIN (SELECT k, max(i) AS i FROM l GROUP BY k) USING (k, i)),
cost AS (SELECT k, substr(b, 1, 6)::BIGINT AS cost, substr(b, 7) AS audit FROM best),
act AS (
 SELECT k, 0::BIGINT AS j, 0::BIGINT AS i, 0 AS state, audit, NULL::VARCHAR AS line FROM cost
 UNION ALL
 SELECT k, j, i, state, audit, CASE WHEN e = 'D' THEN NULL WHEN e = 'K' THEN role || ':' || text
   ELSE CASE WHEN state = 2 THEN 'user:' ELSE 'assistant:' END || CASE WHEN e = 'R' THEN text ELSE '' END END FROM (
  SELECT act.k, act.j + 1 AS j, act.i + (CASE WHEN substr(audit, act.j + 1, 1) = 'I' THEN 0 ELSE 1 END) AS i, audit,
   substr(audit, act.j + 1, 1) AS e, l.role, l.text,
   CASE WHEN substr(audit, act.j + 1, 1) = 'D' THEN state WHEN substr(audit, act.j + 1, 1) = 'K' AND lower(code) = 's' THEN 1
    WHEN state = 2 THEN 3 ELSE 2 END AS state
  FROM act LEFT JOIN l ON l.k = act.k AND l.i = act.i + 1 WHERE act.j < length(audit))),
told AS (SELECT k, sha256(coalesce(string_agg(line, chr(10) ORDER BY j), '')) AS h FROM act GROUP BY k),
n AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (r2 IS NOT NULL AND (r1 || r2) NOT IN ('su', 'ua', 'au')) AS illegal FROM l GROUP BY k),
ids AS (SELECT DISTINCT conv_id, dense_rank() OVER (ORDER BY conv_id) AS k FROM src)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
 coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
 coalesce(h, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN n USING (k) LEFT JOIN cost USING (k) LEFT JOIN told USING (k)"""


ORACLES = {"op3_quality_rules": _quality_rules(), "op4_secret_scan": _secret_scan(),
           "op5_source_mix": _source_mix(mixing.WEIGHTS, mixing.TOTAL.replace("div", "//"), mixing.EPOCHS),
           "op6_chat_format": _chat_format(), "op13_turn_repair": _turn_repair()}
