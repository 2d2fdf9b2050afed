"""DuckDB oracle SQL, one statement per registered query.

Each statement restates the bridge rules and the query semantics in plain
SQL over the raw tables (``orders``, ``lineitem``, ``events`` ...), written
independently of the Spark code. Column names equal the Spark output.
"""

from __future__ import annotations

RUNS_B = """runs_b AS (
 SELECT o_orderkey AS run_id, CAST(o_orderkey AS VARCHAR) AS run_hash,
  CAST(CASE o_orderkey % 8 WHEN 0 THEN 2291 WHEN 1 THEN 2289 WHEN 2 THEN 2284 WHEN 3 THEN 2287
       WHEN 4 THEN 2290 WHEN 5 THEN 2285 WHEN 6 THEN 2286 ELSE 2293 END AS BIGINT) AS dungeon_id,
  CAST(2 + o_orderkey % 19 AS BIGINT) AS key_level,
  CAST(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 900000 + (o_orderkey * 7919) % 2100000 END AS BIGINT) AS duration,
  CAST(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 END AS BIGINT) AS finished,
  CAST(9 + o_orderkey % 2 AS BIGINT) AS two_affix_id,
  CAST(CASE o_orderkey % 6 WHEN 0 THEN 123 WHEN 1 THEN 7 WHEN 2 THEN 11 WHEN 3 THEN 8 WHEN 4 THEN 6 ELSE 122 END AS BIGINT) AS four_affix_id,
  CAST(CASE o_orderkey % 6 WHEN 0 THEN 13 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 124 WHEN 4 THEN 14 ELSE 12 END AS BIGINT) AS seven_affix_id,
  CAST(CASE WHEN o_orderkey % 19 >= 8 THEN 121 ELSE NULL END AS BIGINT) AS ten_affix_id,
  CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN '9.0.2' ELSE '9.0.5' END AS patch,
  epoch_ms(o_orderdate) AS date
 FROM orders),
runs_named AS (
 SELECT *, CASE dungeon_id WHEN 2291 THEN 'De Other Side' WHEN 2289 THEN 'Plaguefall' WHEN 2284 THEN 'Sanguine Depths'
   WHEN 2287 THEN 'Halls of Atonement' WHEN 2290 THEN 'Mists of Tirna Scithe' WHEN 2285 THEN 'Spires of Ascension'
   WHEN 2286 THEN 'Necrotic Wake' WHEN 2293 THEN 'Theater of Pain' END AS dungeon_name
 FROM runs_b)"""

DAMAGE_B = """damage_b AS (
 SELECT l_orderkey AS run_id, CAST(l_orderkey AS VARCHAR) AS run_hash,
  'Player-' || CAST(l_suppkey % 5 AS VARCHAR) AS caster_id,
  'name' || CAST(l_suppkey % 5 AS VARCHAR) AS caster_name,
  CASE WHEN l_linenumber % 4 = 3 THEN '0xa48' WHEN l_suppkey % 5 = 0 THEN '0x511' ELSE '0x512' END AS caster_type,
  CAST(l_partkey % 40 AS BIGINT) AS spell_id,
  'spell' || CAST(l_partkey % 40 AS VARCHAR) AS spell_name,
  CAST(floor(l_extendedprice) AS BIGINT) AS damage
 FROM lineitem)"""

# Timer limits (ms) and scores, as SQL expressions over a row with
# ``dungeon_id`` and ``duration``.
T_IN = ("CASE dungeon_id WHEN 2291 THEN 2580000 WHEN 2289 THEN 2280000 WHEN 2284 THEN 2460000 "
        "WHEN 2287 THEN 1860000 WHEN 2290 THEN 1800000 WHEN 2285 THEN 2340000 WHEN 2286 THEN 2160000 "
        "WHEN 2293 THEN 2220000 ELSE 0 END")
T_TWO = ("CASE dungeon_id WHEN 2291 THEN 2065000 WHEN 2289 THEN 1824000 WHEN 2284 THEN 1968000 "
         "WHEN 2287 THEN 1488000 WHEN 2290 THEN 1440000 WHEN 2285 THEN 1872000 WHEN 2286 THEN 1728000 "
         "WHEN 2293 THEN 1776000 ELSE 0 END")
T_THREE = ("CASE dungeon_id WHEN 2291 THEN 1549000 WHEN 2289 THEN 1368000 WHEN 2284 THEN {sd} "
           "WHEN 2287 THEN 1116000 WHEN 2290 THEN 1080000 WHEN 2285 THEN 1404000 WHEN 2286 THEN 1296000 "
           "WHEN 2293 THEN 1332000 ELSE 0 END")
PCT = f"(CASE WHEN duration = 0 THEN 1000.0 ELSE (CAST({T_IN} AS DOUBLE) / CAST(duration AS DOUBLE)) * 100.0 END)"


def intime_sql(corrected: bool = False) -> str:
    three = T_THREE.format(sd=1476000 if corrected else 0)
    return (f"CAST(CASE WHEN duration = 0 THEN 0 WHEN duration <= {three} THEN 3 WHEN duration <= {T_TWO} THEN 2 "
            f"WHEN duration <= {T_IN} THEN 1 ELSE 0 END AS INTEGER)")


MMSS = ("lpad(CAST((duration // 60000) % 60 AS VARCHAR), 2, '0') || ':' || "
        "lpad(CAST((duration // 1000) % 60 AS VARCHAR), 2, '0')")
SK = f"printf('%02d#%3.6f#%s', CAST(key_level AS INTEGER), {PCT}, run_hash)"


def _name(ids: dict[int, str], col: str) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in ids.items())
    return f"coalesce(CASE {col} {whens} END, '')"


_A2 = {9: "Tyrannical", 10: "Fortified"}
_A4 = {123: "Spiteful", 7: "Bolstering", 11: "Bursting", 8: "Sanguine", 6: "Raging", 122: "Inspiring"}
_A7 = {13: "Explosive", 4: "Necrotic", 3: "Volcanic", 124: "Storming", 14: "Quaking", 12: "Grievous"}
_A10 = {121: "Prideful"}
AFFIXES = (f"CASE WHEN coalesce(four_affix_id, 0) = 0 THEN {_name(_A2, 'two_affix_id')} "
           f"WHEN coalesce(seven_affix_id, 0) = 0 THEN {_name(_A2, 'two_affix_id')} || ', ' || {_name(_A4, 'four_affix_id')} "
           f"WHEN coalesce(ten_affix_id, 0) = 0 THEN {_name(_A2, 'two_affix_id')} || ', ' || {_name(_A4, 'four_affix_id')} || ', ' || {_name(_A7, 'seven_affix_id')} "
           f"ELSE {_name(_A2, 'two_affix_id')} || ', ' || {_name(_A4, 'four_affix_id')} || ', ' || {_name(_A7, 'seven_affix_id')} || ', ' || {_name(_A10, 'ten_affix_id')} END")

PLAYER = "caster_type IN ('0x511', '0x512') AND caster_id <> '0000000000000000'"
KEYS_META = ("finished <> 0 AND dungeon_id IS NOT NULL AND key_level IS NOT NULL AND duration IS NOT NULL "
             "AND two_affix_id IS NOT NULL AND four_affix_id IS NOT NULL AND seven_affix_id IS NOT NULL "
             "AND ten_affix_id IS NOT NULL AND patch IS NOT NULL AND date IS NOT NULL")
BREAKDOWN_META = ("dungeon_id IS NOT NULL AND key_level IS NOT NULL AND duration IS NOT NULL AND finished IS NOT NULL "
                  "AND two_affix_id IS NOT NULL AND four_affix_id IS NOT NULL AND seven_affix_id IS NOT NULL "
                  "AND ten_affix_id IS NOT NULL AND date IS NOT NULL")

A6 = f"""WITH {DAMAGE_B}
SELECT run_hash, caster_name, caster_id, CAST(sum(damage) AS BIGINT) AS damage
FROM damage_b WHERE {PLAYER} GROUP BY run_hash, caster_name, caster_id"""

A7 = f"""WITH {DAMAGE_B}
SELECT run_hash, caster_name, caster_id, spell_id, spell_name, CAST(sum(damage) AS BIGINT) AS damage
FROM damage_b WHERE {PLAYER} GROUP BY run_hash, caster_name, caster_id, spell_id, spell_name"""

_KEYS_SELECT = ("d.damage, d.caster_name, d.caster_id, d.run_hash AS combatlog_hash, r.dungeon_name, r.dungeon_id, "
                "r.key_level, r.duration, r.finished, r.two_affix_id, r.four_affix_id, r.seven_affix_id, "
                "r.ten_affix_id, r.patch, r.date")

A11 = f"""WITH {RUNS_B}, {DAMAGE_B},
d AS (SELECT run_hash, caster_name, caster_id, CAST(sum(damage) AS BIGINT) AS damage
      FROM damage_b WHERE {PLAYER} GROUP BY run_hash, caster_name, caster_id)
SELECT {_KEYS_SELECT} FROM d JOIN (SELECT * FROM runs_named WHERE {KEYS_META}) r ON d.run_hash = r.run_hash"""

A11_LEFT = f"""WITH {RUNS_B}, {DAMAGE_B},
d AS (SELECT run_hash, caster_name, caster_id, CAST(sum(damage) AS BIGINT) AS damage
      FROM damage_b WHERE {PLAYER} GROUP BY run_hash, caster_name, caster_id)
SELECT {_KEYS_SELECT} FROM d LEFT JOIN runs_named r ON d.run_hash = r.run_hash
WHERE d.run_hash NOT IN (SELECT run_hash FROM runs_named WHERE finished = 0)"""

A12 = f"""WITH {RUNS_B}, {DAMAGE_B},
d AS (SELECT run_hash, caster_name, caster_id, spell_id, spell_name, CAST(sum(damage) AS BIGINT) AS damage
      FROM damage_b WHERE {PLAYER} GROUP BY run_hash, caster_name, caster_id, spell_id, spell_name)
SELECT d.damage, d.caster_name, d.caster_id, d.run_hash AS combatlog_hash, r.dungeon_name, r.dungeon_id,
  r.key_level, r.duration, r.finished, r.two_affix_id, r.four_affix_id, r.seven_affix_id, r.ten_affix_id,
  d.spell_id, d.spell_name, r.date
FROM d JOIN (SELECT * FROM runs_named WHERE {BREAKDOWN_META}) r ON d.run_hash = r.run_hash"""

A10 = f"""WITH {RUNS_B}, {DAMAGE_B}
SELECT DISTINCT run_hash, 'empty_breakdown' AS reason FROM damage_b
WHERE run_hash NOT IN (
  SELECT d.run_hash FROM damage_b d JOIN (SELECT * FROM runs_named WHERE {BREAKDOWN_META}) r
    ON d.run_hash = r.run_hash WHERE d.caster_type IN ('0x511', '0x512') AND d.caster_id <> '0000000000000000')"""

_MEASURES_UNION = " UNION ALL ".join(
    [f"SELECT run_hash, '{m}' AS measure_name, CAST({m} AS BIGINT) AS measure_value_bigint, "
     f"CAST(NULL AS VARCHAR) AS measure_value_varchar, "
     f"{'dungeon_name' if m == 'dungeon_id' else 'CAST(NULL AS VARCHAR)'} AS dungeon_name FROM runs_named "
     f"WHERE {m} IS NOT NULL"
     for m in ("dungeon_id", "key_level", "date", "two_affix_id", "four_affix_id", "seven_affix_id",
               "ten_affix_id", "duration", "finished")]
    + ["SELECT run_hash, 'patch', CAST(NULL AS BIGINT), patch, CAST(NULL AS VARCHAR) FROM runs_named "
       "WHERE patch IS NOT NULL"])

F1 = f"""WITH {RUNS_B} {_MEASURES_UNION}"""

F2 = f"""WITH {RUNS_B}
SELECT run_hash, dungeon_name, dungeon_id, key_level, date, two_affix_id, four_affix_id, seven_affix_id,
  ten_affix_id, duration, finished, patch FROM runs_named"""

X_SCORING = f"""WITH {RUNS_B}
SELECT run_hash, {MMSS} AS duration_text,
  CAST(((duration // 60000) % 60) * 60000 + ((duration // 1000) % 60) * 1000 AS BIGINT) AS mmss_ms,
  CAST({T_IN} AS BIGINT) AS intime_ms,
  {intime_sql()} AS intime, {intime_sql(True)} AS intime_corrected,
  round({PCT}, 6) AS percent, {SK} AS sk,
  'LOG#KEY#' || patch AS pk, 'LOG#KEY#' || patch || '#' || CAST(dungeon_id AS VARCHAR) AS gsi1pk,
  'LOG#KEY#' || run_hash || '#OVERALL_PLAYER_DAMAGE' AS detail_pk, 'DEDUP#' || run_hash AS dedup_pk,
  {AFFIXES} AS affixes, finished <> 0 AS finished
FROM runs_b"""

_DOCS = f"""WITH {RUNS_B}, {DAMAGE_B},
d AS (SELECT run_hash, caster_name, caster_id, CAST(sum(damage) AS BIGINT) AS damage
      FROM damage_b WHERE {PLAYER} GROUP BY run_hash, caster_name, caster_id),
r AS (SELECT * FROM runs_named WHERE {KEYS_META}),
docs AS (
 SELECT 'LOG#KEY#' || r.patch AS pk, {SK} AS sk,
   'LOG#KEY#' || r.patch || '#' || CAST(r.dungeon_id AS VARCHAR) AS gsi1pk, {SK} AS gsi1sk,
   r.run_hash AS combatlog_hash, {MMSS} AS duration_text, 0 AS deaths, {AFFIXES} AS affixes,
   CAST(r.key_level AS INTEGER) AS keylevel, r.dungeon_name, CAST(r.dungeon_id AS INTEGER) AS dungeon_id,
   r.finished <> 0 AS finished, {intime_sql()} AS intime, r.date
 FROM r WHERE r.run_hash IN (SELECT run_hash FROM d))"""

N1 = _DOCS + """
SELECT docs.pk, docs.sk, docs.gsi1pk, docs.combatlog_hash,
  CAST(row_number() OVER (PARTITION BY d.run_hash ORDER BY d.damage DESC, d.caster_id) - 1 AS INTEGER) AS player_pos,
  d.damage, d.caster_name AS player_name, d.caster_id AS player_id, 'unsupported' AS class, 'unsupported' AS specc,
  docs.duration_text, docs.deaths, docs.affixes, docs.keylevel, docs.dungeon_name, docs.dungeon_id, docs.finished,
  docs.intime, docs.date
FROM docs JOIN d ON d.run_hash = docs.combatlog_hash"""

N3 = f"""WITH {DAMAGE_B},
s AS (SELECT run_hash, caster_name, caster_id, spell_id, CAST(sum(damage) AS BIGINT) AS damage
      FROM damage_b WHERE {PLAYER} GROUP BY run_hash, caster_name, caster_id, spell_id, spell_name),
p AS (SELECT run_hash, caster_name, CAST(sum(damage) AS BIGINT) AS damage, CAST(count(*) AS BIGINT) AS n_spells
      FROM s GROUP BY run_hash, caster_name),
first_id AS (SELECT run_hash, caster_name, caster_id FROM (
      SELECT *, row_number() OVER (PARTITION BY run_hash, caster_name ORDER BY damage DESC, caster_id) AS rn FROM s)
    WHERE rn = 1),
top_spell AS (SELECT run_hash, caster_name, spell_id AS top_spell_id, damage AS top_spell_damage FROM (
      SELECT *, row_number() OVER (PARTITION BY run_hash, caster_name ORDER BY damage DESC, spell_id) AS rn FROM s)
    WHERE rn = 1)
SELECT p.run_hash, p.caster_name, f.caster_id, p.damage, p.n_spells, t.top_spell_id, t.top_spell_damage
FROM p JOIN first_id f USING (run_hash, caster_name) JOIN top_spell t USING (run_hash, caster_name)"""

_BREAKDOWN = f"""WITH {RUNS_B}, {DAMAGE_B},
s AS (SELECT run_hash, caster_name, caster_id, spell_id, spell_name, CAST(sum(damage) AS BIGINT) AS damage
      FROM damage_b WHERE {PLAYER} GROUP BY run_hash, caster_name, caster_id, spell_id, spell_name),
p AS (SELECT run_hash, caster_name, CAST(sum(damage) AS BIGINT) AS player_total FROM s GROUP BY run_hash, caster_name),
pid AS (SELECT run_hash, caster_name, caster_id AS player_id FROM (
      SELECT *, row_number() OVER (PARTITION BY run_hash, caster_name ORDER BY damage DESC, caster_id) AS rn FROM s)
    WHERE rn = 1),
pp AS (SELECT p.*, pid.player_id,
         CAST(row_number() OVER (PARTITION BY p.run_hash ORDER BY p.player_total DESC, p.caster_name) - 1 AS INTEGER)
           AS player_pos
       FROM p JOIN pid USING (run_hash, caster_name)),
sp AS (SELECT run_hash, caster_name, spell_id, spell_name, damage AS spell_damage,
         CAST(row_number() OVER (PARTITION BY run_hash, caster_name ORDER BY damage DESC, spell_id) - 1 AS INTEGER)
           AS spell_pos
       FROM s),
r AS (SELECT * FROM runs_named WHERE {BREAKDOWN_META})"""

N6 = _BREAKDOWN + f"""
SELECT 'LOG#KEY#' || r.run_hash || '#OVERALL_PLAYER_DAMAGE' AS pk, r.run_hash AS combatlog_hash,
  {MMSS} AS duration_text, {AFFIXES} AS affixes, CAST(r.key_level AS INTEGER) AS keylevel,
  CAST(r.dungeon_id AS INTEGER) AS dungeon_id, {intime_sql()} AS intime, r.finished <> 0 AS finished,
  pp.player_pos, pp.caster_name AS player_name, pp.player_id, pp.player_total,
  sp.spell_pos, sp.spell_id, sp.spell_name, sp.spell_damage
FROM r JOIN pp ON pp.run_hash = r.run_hash JOIN sp ON sp.run_hash = pp.run_hash AND sp.caster_name = pp.caster_name"""

K8 = _BREAKDOWN + """
SELECT 'LOG#KEY#' || r.run_hash || '#OVERALL_PLAYER_DAMAGE' AS pk, r.run_hash AS combatlog_hash,
  pp.player_pos, pp.caster_name AS player_name, pp.player_total,
  (SELECT CAST(count(*) AS BIGINT) FROM sp WHERE sp.run_hash = pp.run_hash AND sp.caster_name = pp.caster_name) AS n_spells
FROM r JOIN pp ON pp.run_hash = r.run_hash WHERE r.run_hash = '{run}'"""


def _page(board: str, key: str, sk: str, cursor_filter: str, backward: bool, first_request: bool) -> str:
    read_dir = "ASC" if backward else "DESC"
    last_page = "false" if backward else "(n < 11)"
    first_page = "(n < 11)" if backward else ("true" if first_request else "false")
    return _DOCS + f""",
board AS (SELECT * FROM docs WHERE {key} = '{board}' {cursor_filter}),
read AS (SELECT *, row_number() OVER (ORDER BY {sk} {read_dir}) AS rn FROM board ORDER BY {sk} {read_dir} LIMIT 11),
cnt AS (SELECT count(*) AS n FROM read),
kept AS (SELECT * FROM read WHERE rn <= 10)
SELECT CAST(row_number() OVER (ORDER BY {sk} DESC) AS INTEGER) AS pos, duration_text, deaths, affixes, keylevel,
  dungeon_name, dungeon_id, combatlog_hash, intime, {sk},
  (SELECT max({sk}) FROM kept) AS first_sk, (SELECT min({sk}) FROM kept) AS last_sk,
  {first_page} AS first_page, {last_page} AS last_page,
  (SELECT string_agg(d.caster_id || '=' || CAST(d.damage AS VARCHAR), ';' ORDER BY d.damage DESC, d.caster_id)
   FROM d WHERE d.run_hash = combatlog_hash) AS players
FROM kept, cnt"""


K1 = _page("LOG#KEY#9.0.2", "pk", "sk", "", False, True)
K2 = _page("LOG#KEY#9.0.2#2291", "gsi1pk", "gsi1sk", "", False, True)
K3 = _page("LOG#KEY#9.0.2", "pk", "sk", "AND sk < '15#'", False, False)
K4 = _page("LOG#KEY#9.0.2", "pk", "sk", "AND sk > '15#'", True, False)

K9 = _DOCS + """
SELECT pk, sk, combatlog_hash, CAST(row_number() OVER (PARTITION BY pk ORDER BY sk DESC) AS BIGINT) AS rank,
  CAST((row_number() OVER (PARTITION BY pk ORDER BY sk DESC) - 1) // 10 AS BIGINT) AS page
FROM docs"""

K9_DUNGEON = _DOCS + """
SELECT gsi1pk, gsi1sk, combatlog_hash,
  CAST(row_number() OVER (PARTITION BY gsi1pk ORDER BY gsi1sk DESC) AS BIGINT) AS rank,
  CAST((row_number() OVER (PARTITION BY gsi1pk ORDER BY gsi1sk DESC) - 1) // 10 AS BIGINT) AS page
FROM docs"""

# The batch whose version of a document is the newest one (see plans/boards.py).
S10 = _DOCS + """
SELECT docs.pk, docs.sk, docs.gsi1pk, docs.combatlog_hash, substr(docs.pk, 9) AS patch, docs.dungeon_id,
  CAST(CASE WHEN CAST(docs.combatlog_hash AS BIGINT) % 3 = 0 OR CAST(docs.combatlog_hash AS BIGINT) % 7 = 0 THEN 2 ELSE 1 END AS BIGINT)
    AS batch_id, d.caster_id AS player_id, d.damage
FROM docs JOIN d ON d.run_hash = docs.combatlog_hash"""

RELATIONAL = {
    "s10_board_upsert": S10,
    "a6_damage_per_player": A6,
    "a7_damage_per_player_spell": A7,
    "a11_keys_result": A11,
    "a11_keys_result_left": A11_LEFT,
    "a12_breakdown_result": A12,
    "a10_missing_breakdowns": A10,
    "f1_unpivot_meta": F1,
    "f2_pivot_meta": F2,
    "x_scoring": X_SCORING,
    "n1_leaderboard_docs": N1,
    "n3_player_totals": N3,
    "n6_breakdown_docs": N6,
    "k1_top_keys": K1,
    "k2_top_keys_dungeon": K2,
    "k3_next_page": K3,
    "k4_prev_page": K4,
    "k8_run_detail": K8.format(run="32"),
    "k9_page_numbers": K9,
    "k9_page_numbers_dungeon": K9_DUNGEON,
}

_PLAYER_RUNS = _DOCS + """,
pr AS (SELECT docs.combatlog_hash, docs.sk, docs.dungeon_id, docs.keylevel, docs.date, d.caster_id AS player_id,
         d.caster_name AS player_name, d.damage
       FROM docs JOIN d ON d.run_hash = docs.combatlog_hash)"""

O3 = _DOCS + """
SELECT combatlog_hash, sk, affixes FROM docs WHERE list_contains(string_split(affixes, ', '), 'Prideful')"""

O4 = _PLAYER_RUNS + """
SELECT player_id, dungeon_id, combatlog_hash, sk, keylevel, runs FROM (
  SELECT *, row_number() OVER (PARTITION BY player_id, dungeon_id ORDER BY sk DESC) AS rn,
    CAST(count(*) OVER (PARTITION BY player_id, dungeon_id) AS BIGINT) AS runs FROM pr) WHERE rn = 1"""

O5 = _PLAYER_RUNS + """
SELECT player_id, recent, combatlog_hash, date FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY player_id ORDER BY date DESC, combatlog_hash) AS INTEGER) AS recent
  FROM pr) WHERE recent <= 5"""

O6 = f"""WITH {DAMAGE_B},
s AS (SELECT run_hash, caster_name, caster_id, spell_id, CAST(sum(damage) AS BIGINT) AS damage
      FROM damage_b WHERE {PLAYER} GROUP BY run_hash, caster_name, caster_id, spell_id, spell_name)
SELECT run_hash, caster_name, 'spell' || CAST(spell_id % 10 AS VARCHAR) AS spell_name,
  CAST(sum(damage) AS BIGINT) AS damage, min(spell_id) AS spell_id
FROM s GROUP BY run_hash, caster_name, 'spell' || CAST(spell_id % 10 AS VARCHAR)"""

O7 = _DOCS + f""",
t AS (SELECT run_hash, sum(damage) AS total FROM d GROUP BY run_hash),
dd AS (SELECT docs.*, r.duration, r.dungeon_id AS did, t.total FROM docs JOIN runs_b r ON r.run_hash = docs.combatlog_hash
       JOIN t ON t.run_hash = docs.combatlog_hash)
SELECT dungeon_id, CAST(count(*) AS BIGINT) AS runs, CAST(sum(CASE WHEN intime > 0 THEN 1 ELSE 0 END) AS BIGINT) AS intime_runs,
  round(avg(p), 6) AS avg_percent, round(min(p), 6) AS min_percent, round(max(p), 6) AS max_percent,
  round(avg(total), 3) AS avg_damage
FROM (SELECT *, (CASE WHEN duration = 0 THEN 1000.0 ELSE (CAST(CASE did WHEN 2291 THEN 2580000 WHEN 2289 THEN 2280000
        WHEN 2284 THEN 2460000 WHEN 2287 THEN 1860000 WHEN 2290 THEN 1800000 WHEN 2285 THEN 2340000
        WHEN 2286 THEN 2160000 WHEN 2293 THEN 2220000 ELSE 0 END AS DOUBLE) / CAST(duration AS DOUBLE)) * 100.0 END) AS p
      FROM dd) GROUP BY dungeon_id"""

RELATIONAL.update({
    "o3_affix_filter": O3,
    "o4_best_run_per_dungeon": O4,
    "o5_recent_runs": O5,
    "o6_merge_spells": O6,
    "o7_dungeon_statistics": O7,
})

A1 = f"""WITH {RUNS_B}, {DAMAGE_B}
SELECT run_hash, caster_name, caster_id, CAST(sum(damage) AS BIGINT) AS damage
FROM damage_b WHERE {PLAYER}
  AND run_hash IN (SELECT run_hash FROM runs_b WHERE patch = '9.0.5' AND finished <> 0)
GROUP BY run_hash, caster_name, caster_id"""

A2 = f"""WITH {DAMAGE_B.replace("FROM lineitem)", ", l_shipdate AS ingest_time FROM lineitem)")}
SELECT run_hash, caster_name, caster_id, CAST(sum(damage) AS BIGINT) AS damage
FROM damage_b WHERE {PLAYER}
  AND ingest_time BETWEEN TIMESTAMP '1995-06-16 23:58:00' AND TIMESTAMP '1995-06-17 00:01:00'
GROUP BY run_hash, caster_name, caster_id"""

RELATIONAL.update({"a1_filter_runs": A1, "a2_fresh_damage": A2})

_ONE_PLAYER = _DOCS + """,
mine AS (SELECT docs.*, substr(docs.pk, 9) AS patch, d.damage FROM docs JOIN d ON d.run_hash = docs.combatlog_hash
         WHERE d.caster_id = 'Player-1')"""

RELATIONAL.update({
    "o4_player_dungeon_runs": _ONE_PLAYER + """
SELECT combatlog_hash, sk, keylevel, damage, date FROM mine WHERE patch = '9.0.2' AND dungeon_id = 2291""",
    "o4_player_best": _ONE_PLAYER + """
SELECT dungeon_id, sk, combatlog_hash, keylevel, damage, runs FROM (
 SELECT *, row_number() OVER (PARTITION BY dungeon_id ORDER BY sk DESC, combatlog_hash DESC) AS rn,
  CAST(count(*) OVER (PARTITION BY dungeon_id) AS BIGINT) AS runs FROM mine WHERE patch = '9.0.2') WHERE rn = 1""",
    "o5_player_recent": _ONE_PLAYER + """
SELECT combatlog_hash, patch, dungeon_id, date, damage FROM mine ORDER BY date DESC, combatlog_hash LIMIT 10""",
    "o5_player_by_id": _ONE_PLAYER + """
SELECT 'Player-1' AS player_id, 'name1' AS player_name, CAST(count(*) AS BIGINT) AS runs, max(date) AS last_date FROM mine
HAVING count(*) > 0""",
    "o5_player_search": _DOCS + """
SELECT lower(caster_name) || '#' || caster_id AS sk, caster_name AS player_name, caster_id AS player_id
FROM (SELECT DISTINCT caster_name, caster_id FROM d WHERE run_hash IN (SELECT combatlog_hash FROM docs))
WHERE lower(caster_name) LIKE 'name%' ORDER BY sk LIMIT 3 OFFSET 3""",
    "o7_dungeon_percentiles": _DOCS + """
SELECT dungeon_id, CAST(rank AS DOUBLE) AS rank, CAST(count(*) AS BIGINT) AS runs, true AS damage_near, true AS percent_near
FROM docs, (SELECT unnest([0.1, 0.5, 0.9, 0.99]) AS rank) GROUP BY dungeon_id, rank""",
})
