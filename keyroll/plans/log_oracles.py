"""DuckDB oracles for the text-path queries (``log_queries``).

They start from ``events`` and the B3/B4/B5 bridge rules (what each event
renders to) and compute the expected runs, facts and decisions directly —
no text is rendered or parsed here. The pet owner is found with DuckDB's
ASOF JOIN, runs with a range join on event time.
"""

from __future__ import annotations

DAMAGE_EVENTS = "('SWING_DAMAGE', 'SPELL_DAMAGE', 'SPELL_PERIODIC_DAMAGE', 'RANGE_DAMAGE')"


def _base(copies: bool) -> str:
    src = ("SELECT CAST(user_id AS VARCHAR) AS upload_id, ts, event_id AS e, event_type, "
           "CAST(floor(value) AS BIGINT) AS amount FROM events")
    if copies:
        src += (" UNION ALL SELECT CAST(user_id AS VARCHAR) || '-copy', ts, event_id, event_type, "
                "CAST(floor(value) AS BIGINT) FROM events WHERE user_id % 3 = 0")
    return f"""ev AS (
 SELECT *, CASE event_type WHEN 'signup' THEN 'START' WHEN 'purchase' THEN 'END' WHEN 'error' THEN 'SUMMON'
             WHEN 'click' THEN 'PET_HIT' ELSE 'HIT' END AS kind
 FROM ({src})),
x AS (
 SELECT *,
  CASE WHEN kind = 'START' THEN 'CHALLENGE_MODE_START' WHEN kind = 'END' THEN 'CHALLENGE_MODE_END'
       WHEN kind = 'SUMMON' THEN 'SPELL_SUMMON'
       WHEN kind = 'PET_HIT' THEN CASE WHEN e % 2 = 0 THEN 'SWING_DAMAGE' ELSE 'SPELL_DAMAGE' END
       WHEN e % 25 = 7 THEN 'COMBAT_LOG_VERSION' WHEN e % 50 = 17 THEN 'COMBATANT_INFO'
       WHEN e % 25 = 13 THEN 'SPELL_HEAL' WHEN e % 50 = 29 THEN 'ENCOUNTER_START'
       WHEN e % 50 = 39 THEN 'ENCOUNTER_END'
       WHEN e % 4 = 1 THEN 'SWING_DAMAGE' WHEN e % 3 = 0 THEN 'SPELL_DAMAGE'
       WHEN e % 3 = 1 THEN 'SPELL_PERIODIC_DAMAGE' ELSE 'RANGE_DAMAGE' END AS event
 FROM ev),
m AS (
 SELECT upload_id, ts, e, kind, lead(ts) OVER w AS nts, lead(kind) OVER w AS nk
 FROM x WHERE kind IN ('START', 'END') WINDOW w AS (PARTITION BY upload_id ORDER BY ts)),
runs AS (
 SELECT upload_id, e AS start_event, ts AS s_ts,
   CASE WHEN nk = 'END' THEN nts WHEN nk = 'START' THEN nts - INTERVAL 1 MICROSECOND
        ELSE TIMESTAMP '9999-12-31 00:00:00' END AS e_ts,
   coalesce(nk = 'END', false) AS closed
 FROM m WHERE kind = 'START'),
xr AS (SELECT * FROM x WHERE event NOT IN ('SPELL_HEAL', 'ENCOUNTER_START', 'ENCOUNTER_END')),
la AS (
 SELECT x.*, r.start_event, r.s_ts FROM x JOIN runs r ON x.upload_id = r.upload_id AND x.ts BETWEEN r.s_ts AND r.e_ts),
lr AS (SELECT * FROM la WHERE event NOT IN ('SPELL_HEAL', 'ENCOUNTER_START', 'ENCOUNTER_END')),
dmg AS (
 SELECT *, e % 13 = 6 AS friendly, e % 1000 = 999 AS bad_amount, 'Pet-0-' || CAST(e % 7 AS VARCHAR) AS guid,
   CASE WHEN kind = 'HIT' THEN CASE WHEN e % 9 = 4 THEN '0xa48' WHEN e % 5 = 0 THEN '0x511' ELSE '0x512' END
        ELSE '0x1112' END AS own_flag
 FROM lr WHERE event IN {DAMAGE_EVENTS}),
summons AS (
 SELECT upload_id, ts, 'Pet-0-' || CAST(e % 7 AS VARCHAR) AS guid, e AS se FROM lr
 WHERE kind = 'SUMMON' AND e % 6 <> 5),
pet AS (
 SELECT d.*, s.se FROM (SELECT * FROM dmg WHERE kind = 'PET_HIT') d
 ASOF LEFT JOIN summons s ON d.upload_id = s.upload_id AND d.guid = s.guid AND d.ts > s.ts),
booked AS (
 SELECT upload_id, start_event, 'Player-' || CAST(e % 5 AS VARCHAR) AS caster_id,
   'name' || CAST(e % 5 AS VARCHAR) || '-Realm' AS caster_name, own_flag AS caster_type,
   CAST(CASE WHEN event = 'SWING_DAMAGE' THEN 42013370310 ELSE 100 + e % 17 END AS BIGINT) AS spell_id,
   CASE WHEN event = 'SWING_DAMAGE' THEN 'Auto Attack' ELSE 'Spell ' || CAST(100 + e % 17 AS VARCHAR) END AS spell_name,
   amount AS damage
 FROM dmg WHERE kind = 'HIT' AND NOT friendly AND own_flag IN ('0x511', '0x512') AND NOT bad_amount
 UNION ALL
 SELECT upload_id, start_event, 'Player-' || CAST(se % 5 AS VARCHAR), 'name' || CAST(se % 5 AS VARCHAR) || '-Realm',
   '0x512', CAST(30000 + se % 3 AS BIGINT), 'Summon ' || CAST(30000 + se % 3 AS VARCHAR), amount
 FROM pet WHERE se IS NOT NULL AND NOT friendly AND NOT bad_amount),
hashed AS (
 SELECT upload_id, start_event, CAST(count(*) AS BIGINT) AS hashed_lines,
   string_agg(CAST(e AS VARCHAR), ',' ORDER BY ts) AS content
 FROM lr WHERE event IN {DAMAGE_EVENTS[:-1]}, 'COMBATANT_INFO') GROUP BY upload_id, start_event),
dec AS (
 SELECT h.*, r.s_ts, CAST(count(*) OVER (PARTITION BY content) AS BIGINT) AS copies,
   row_number() OVER (PARTITION BY content ORDER BY h.upload_id, r.s_ts) > 1 AS duplicate
 FROM hashed h JOIN runs r USING (upload_id, start_event)),
meta AS (
 SELECT r.upload_id, r.start_event,
   CASE r.start_event % 8 WHEN 0 THEN 'De Other Side' WHEN 1 THEN 'Plaguefall' WHEN 2 THEN 'Sanguine Depths'
     WHEN 3 THEN 'Halls of Atonement' WHEN 4 THEN 'Mists of Tirna Scithe' WHEN 5 THEN 'Spires of Ascension'
     WHEN 6 THEN 'Necrotic Wake' ELSE 'Theater of Pain' END AS dungeon_name,
   CAST(CASE r.start_event % 8 WHEN 0 THEN 2291 WHEN 1 THEN 2289 WHEN 2 THEN 2284 WHEN 3 THEN 2287 WHEN 4 THEN 2290
     WHEN 5 THEN 2285 WHEN 6 THEN 2286 ELSE 2293 END AS BIGINT) AS dungeon_id,
   CAST(2 + r.start_event % 19 AS BIGINT) AS key_level, CAST(epoch_us(r.s_ts) // 1000 AS BIGINT) AS date,
   CAST(9 + r.start_event % 2 AS BIGINT) AS two_affix_id,
   CAST(CASE r.start_event % 6 WHEN 0 THEN 123 WHEN 1 THEN 7 WHEN 2 THEN 11 WHEN 3 THEN 8 WHEN 4 THEN 6 ELSE 122 END AS BIGINT) AS four_affix_id,
   CAST(CASE r.start_event % 6 WHEN 0 THEN 13 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 124 WHEN 4 THEN 14 ELSE 12 END AS BIGINT) AS seven_affix_id,
   CAST(CASE WHEN r.start_event % 19 >= 8 THEN 121 END AS BIGINT) AS ten_affix_id,
   fin.finished, fin.duration, pv.patch, fv.patch AS file_patch
 FROM runs r
 LEFT JOIN (SELECT upload_id, start_event, CAST(CASE WHEN e % 10 = 0 THEN 0 ELSE 1 END AS BIGINT) AS finished,
              CAST(CASE WHEN e % 10 = 0 THEN 0 ELSE 900000 + (e * 7919) % 2100000 END AS BIGINT) AS duration
            FROM lr WHERE kind = 'END') fin USING (upload_id, start_event)
 LEFT JOIN (SELECT upload_id, start_event, max(CASE WHEN e % 2 = 0 THEN '9.0.2' ELSE '9.0.5' END) AS patch
            FROM lr WHERE event = 'COMBAT_LOG_VERSION' GROUP BY upload_id, start_event) pv USING (upload_id, start_event)
 LEFT JOIN (SELECT r2.upload_id, r2.start_event, v.patch FROM runs r2 ASOF LEFT JOIN
              (SELECT upload_id, ts, CASE WHEN e % 2 = 0 THEN '9.0.2' ELSE '9.0.5' END AS patch FROM x
               WHERE event = 'COMBAT_LOG_VERSION') v
              ON r2.upload_id = v.upload_id AND r2.s_ts > v.ts) fv USING (upload_id, start_event))"""


P2 = f"""WITH {_base(False)}
SELECT upload_id, event,
  CAST(CASE kind WHEN 'START' THEN CASE WHEN e % 19 >= 8 THEN 9 ELSE 8 END WHEN 'END' THEN 5 WHEN 'SUMMON' THEN 12
     ELSE CASE event WHEN 'COMBAT_LOG_VERSION' THEN 8 WHEN 'COMBATANT_INFO' THEN 8 WHEN 'SWING_DAMAGE' THEN 36 ELSE 39 END
  END AS BIGINT) AS n_tokens,
  CASE kind WHEN 'START' THEN '"' || CASE e % 8 WHEN 0 THEN 'De Other Side' WHEN 1 THEN 'Plaguefall'
         WHEN 2 THEN 'Sanguine Depths' WHEN 3 THEN 'Halls of Atonement' WHEN 4 THEN 'Mists of Tirna Scithe'
         WHEN 5 THEN 'Spires of Ascension' WHEN 6 THEN 'Necrotic Wake' ELSE 'Theater of Pain' END || '"'
     WHEN 'END' THEN CAST(CASE e % 8 WHEN 0 THEN 2291 WHEN 1 THEN 2289 WHEN 2 THEN 2284 WHEN 3 THEN 2287 WHEN 4 THEN 2290
         WHEN 5 THEN 2285 WHEN 6 THEN 2286 ELSE 2293 END AS VARCHAR)
     WHEN 'PET_HIT' THEN 'Pet-0-' || CAST(e % 7 AS VARCHAR)
     ELSE CASE WHEN event = 'COMBAT_LOG_VERSION' THEN '20' ELSE 'Player-' || CAST(e % 5 AS VARCHAR) END END AS t1,
  CASE kind WHEN 'START' THEN CAST(CASE e % 8 WHEN 0 THEN 2291 WHEN 1 THEN 2289 WHEN 2 THEN 2284 WHEN 3 THEN 2287
         WHEN 4 THEN 2290 WHEN 5 THEN 2285 WHEN 6 THEN 2286 ELSE 2293 END AS VARCHAR)
     WHEN 'END' THEN CASE WHEN e % 10 = 0 THEN '0' ELSE '1' END
     WHEN 'PET_HIT' THEN 'Pet' || CAST(e % 7 AS VARCHAR)
     ELSE CASE event WHEN 'COMBAT_LOG_VERSION' THEN 'ADVANCED_LOG_ENABLED' WHEN 'COMBATANT_INFO' THEN CAST(e AS VARCHAR)
          ELSE 'name' || CAST(e % 5 AS VARCHAR) || '-Realm' END END AS t2,
  CASE kind WHEN 'START' THEN CAST(CASE e % 6 WHEN 0 THEN 123 WHEN 1 THEN 7 WHEN 2 THEN 11 WHEN 3 THEN 8 WHEN 4 THEN 6
         ELSE 122 END AS VARCHAR)
     WHEN 'END' THEN NULL
     WHEN 'SUMMON' THEN '"Pet' || CAST(e % 7 AS VARCHAR) || '"'
     ELSE CASE event WHEN 'COMBAT_LOG_VERSION' THEN 'PROJECT_ID' WHEN 'COMBATANT_INFO' THEN '(3'
          ELSE '"Enemy, the Big"' END END AS t6
FROM xr"""

R1 = f"""WITH {_base(False)}
SELECT r.upload_id, r.start_event, r.closed, CAST(count(*) AS BIGINT) AS n_lines,
  CAST(sum(CASE WHEN lr.event IN {DAMAGE_EVENTS} THEN 1 ELSE 0 END) AS BIGINT) AS n_damage_lines
FROM runs r JOIN lr USING (upload_id, start_event) GROUP BY r.upload_id, r.start_event, r.closed"""

P9 = f"""WITH {_base(False)}
SELECT m.upload_id, m.start_event, dungeon_name, dungeon_id, key_level, date, two_affix_id, four_affix_id,
  seven_affix_id, ten_affix_id, finished, duration, patch
FROM meta m JOIN hashed h USING (upload_id, start_event)"""

R4 = f"""WITH {_base(False)}
SELECT b.upload_id, b.start_event, caster_id, caster_name, caster_type, spell_id, spell_name,
  CAST(sum(damage) AS BIGINT) AS damage, CAST(count(*) AS BIGINT) AS hits
FROM booked b JOIN hashed h USING (upload_id, start_event)
GROUP BY b.upload_id, b.start_event, caster_id, caster_name, caster_type, spell_id, spell_name"""

P13 = f"""WITH {_base(False)},
rej AS (
 SELECT upload_id, event, 'bad_int' AS reason FROM dmg
   WHERE kind = 'HIT' AND NOT friendly AND own_flag IN ('0x511', '0x512') AND bad_amount
 UNION ALL SELECT upload_id, event, 'bad_int' FROM pet WHERE se IS NOT NULL AND NOT friendly AND bad_amount
 UNION ALL SELECT upload_id, 'CHALLENGE_MODE_START', 'no_hash' FROM runs r
   WHERE NOT EXISTS (SELECT 1 FROM hashed h WHERE h.upload_id = r.upload_id AND h.start_event = r.start_event))
SELECT upload_id, event, reason, CAST(count(*) AS BIGINT) AS n FROM rej GROUP BY upload_id, event, reason"""

D1 = f"""WITH {_base(True)}
SELECT upload_id, start_event, hashed_lines, copies FROM dec"""

D3 = f"""WITH {_base(True)}
SELECT upload_id, start_event, duplicate FROM dec"""

_TWO_BATCHES = f"""WITH {_base(True)},
b AS (SELECT h.*, r.s_ts, CASE WHEN h.upload_id NOT LIKE '%-copy' AND TRY_CAST(h.upload_id AS BIGINT) % 2 = 0 THEN 1 ELSE 2 END AS batch
      FROM (SELECT * FROM hashed) h JOIN runs r USING (upload_id, start_event)),
led AS (SELECT *, min(batch) OVER (PARTITION BY content) AS first_batch,
          row_number() OVER (PARTITION BY content, batch ORDER BY upload_id, s_ts) AS rn FROM b)"""

D2 = _TWO_BATCHES + """
SELECT upload_id, start_event, (first_batch = 1 OR rn > 1) AS duplicate FROM led WHERE batch = 2"""

D6 = _TWO_BATCHES + """
SELECT upload_id, start_event, CAST(batch AS BIGINT) AS batch_id, true AS keyed FROM led
WHERE batch = first_batch AND rn = 1 AND CAST(regexp_extract(upload_id, '^[0-9]+') AS BIGINT) % 5 <> 0"""

D5 = f"""WITH {_base(True)}
SELECT upload_id, CAST(count(DISTINCT content) AS BIGINT) AS n_hashes,
  CAST(count(DISTINCT CASE WHEN duplicate THEN content END) AS BIGINT) AS n_duplicates
FROM dec GROUP BY upload_id"""

E2E = f"""WITH {_base(True)},
kept AS (SELECT m.* REPLACE (coalesce(m.patch, m.file_patch) AS patch) FROM meta m JOIN dec d USING (upload_id, start_event)
         WHERE NOT d.duplicate AND m.finished <> 0 AND m.ten_affix_id IS NOT NULL
           AND coalesce(m.patch, m.file_patch) IS NOT NULL
           AND m.duration IS NOT NULL AND m.date IS NOT NULL),
pd AS (SELECT upload_id, start_event, caster_name, caster_id, CAST(sum(damage) AS BIGINT) AS damage
       FROM booked WHERE caster_type IN ('0x511', '0x512') AND caster_id <> '0000000000000000'
       GROUP BY upload_id, start_event, caster_name, caster_id)
SELECT pd.damage, pd.caster_name, pd.caster_id, k.dungeon_name, k.dungeon_id, k.key_level, k.duration, k.finished,
  k.two_affix_id, k.four_affix_id, k.seven_affix_id, k.ten_affix_id, k.patch, k.date, k.upload_id, k.start_event
FROM pd JOIN kept k USING (upload_id, start_event)"""

ORACLES = {
    "p2_tokenize": P2,
    "r1_run_segments": R1,
    "p9_run_meta": P9,
    "r4_damage_attribution": R4,
    "p13_rejects": P13,
    "d1_duplicate_groups": D1,
    "d3_kept_runs": D3,
    "d2_ledger_skips": D2,
    "d4_compacted_ledger": D2,
    "d6_ledger_delete": D6,
    "d5_hash_lists": D5,
    "e2e_keys_result": E2E,
}

S2 = f"""WITH {_base(False)}
SELECT upload_id, CAST(row_number() OVER (PARTITION BY upload_id ORDER BY ts) AS BIGINT) AS line_no, event FROM x"""

S7 = """SELECT CAST(user_id AS VARCHAR) AS upload_id, CAST(min(ts) AS DATE) AS upload_date,
  CAST(hour(min(ts)) AS INTEGER) AS upload_hour,
  CASE user_id % 5 WHEN 1 THEN 'gz' WHEN 2 THEN 'zip' ELSE 'txt' END AS file_type, true AS accepted
FROM events GROUP BY user_id"""

ORACLES.update({
    "s1_file_runs": R1,
    "s2_line_numbers": S2,
    "s7_upload_keys": S7,
})

T1 = f"""SELECT * EXCLUDE (upload_id) FROM ({E2E})"""

ORACLES["t1_stream_keys_result"] = T1

T2 = f"""SELECT start_event, patch, CAST(dungeon_id AS INTEGER) AS dungeon_id, CAST(key_level AS INTEGER) AS keylevel,
  caster_id AS player_id, damage FROM ({E2E})"""

# An upload and its copy: file types as in the fixtures, every run of the copy a duplicate.
S13 = f"""WITH {_base(True)},
f AS (SELECT upload_id, regexp_extract(upload_id, '^[0-9]+') AS upload, CAST(count(*) AS BIGINT) AS records FROM x GROUP BY upload_id),
t AS (SELECT *, CASE (CAST(upload AS BIGINT) + CASE WHEN upload <> upload_id THEN 1 ELSE 0 END) % 5
        WHEN 1 THEN 'gz' WHEN 2 THEN 'zip' ELSE 'txt' END AS file_type FROM f),
n AS (SELECT upload_id, CAST(count(*) AS BIGINT) AS runs FROM hashed GROUP BY upload_id)
SELECT upload, CAST(count(*) AS BIGINT) AS files, string_agg(DISTINCT file_type, '+' ORDER BY file_type) AS types,
  CAST(sum(records) AS BIGINT) AS records, CAST(sum(coalesce(runs, 0)) AS BIGINT) AS runs,
  CAST(sum(CASE WHEN upload <> t.upload_id THEN coalesce(runs, 0) ELSE 0 END) AS BIGINT) AS duplicate_runs, true AS sized
FROM t LEFT JOIN n ON n.upload_id = t.upload_id GROUP BY upload"""

T3 = """SELECT CAST(u AS VARCHAR) || CASE u % 5 WHEN 0 THEN '.log' WHEN 1 THEN '.txt.gz' WHEN 2 THEN '.zip' ELSE '.txt' END AS file,
  CASE u % 5 WHEN 0 THEN 'suffix' WHEN 3 THEN 'key' ELSE 'archive' END AS reason
FROM (SELECT DISTINCT user_id AS u FROM events) WHERE u % 5 <> 4"""

# Hour of an upload's first line; the watermark before a batch is the highest hour of the
# earlier ones, of which the latest upload decides what the retention keeps.
T5 = f"""WITH {_base(False)},
u AS (SELECT upload_id, date_trunc('hour', min(ts)) AS h, CAST(upload_id AS BIGINT) % 4 AS batch FROM x GROUP BY upload_id),
s AS (SELECT *, coalesce(h < (SELECT max(v.h) FROM u v WHERE v.batch < u.batch) - INTERVAL 12 HOUR, false) AS late FROM u),
top AS (SELECT CAST(max(h) - INTERVAL 18 HOUR AS DATE) AS oldest FROM u),
n AS (SELECT upload_id, CAST(count(*) AS BIGINT) AS runs FROM hashed GROUP BY upload_id),
d AS (SELECT upload_id, CAST(sum(damage) AS BIGINT) AS damage FROM booked JOIN hashed USING (upload_id, start_event) GROUP BY upload_id)
SELECT upload_id, 'late' AS state, CAST(0 AS BIGINT) AS runs, CAST(0 AS BIGINT) AS damage FROM s WHERE late
UNION ALL
SELECT s.upload_id, 'kept', n.runs, coalesce(d.damage, 0) FROM s JOIN n ON n.upload_id = s.upload_id
LEFT JOIN d ON d.upload_id = s.upload_id, top WHERE NOT late AND CAST(h AS DATE) >= oldest"""

T4 = f"""WITH {_base(True)}
SELECT start_event, CAST(1 AS BIGINT) AS in_stream, true AS in_ledger FROM dec WHERE NOT duplicate"""

ORACLES.update({"t2_stream_documents": T2, "t4_stream_dedup": T4, "s13_upload_metrics": S13, "t3_stream_rejects": T3, "t5_late_and_expired": T5})

O1 = f"""WITH {_base(False)},
em AS (
 SELECT upload_id, start_event, ts, e, event, lead(event) OVER w AS ne, lead(e) OVER w AS nexte,
   lead(ts) OVER w AS nts
 FROM la WHERE event IN ('ENCOUNTER_START', 'ENCOUNTER_END')
 WINDOW w AS (PARTITION BY upload_id, start_event ORDER BY ts))
SELECT upload_id, start_event, CAST(2400 + e % 4 AS BIGINT) AS encounter_id,
  'Boss ' || CAST(2400 + e % 4 AS VARCHAR) || ', the Big' AS encounter_name,
  coalesce(ne = 'ENCOUNTER_END', false) AS closed,
  CAST(CASE WHEN ne = 'ENCOUNTER_END' THEN nexte % 2 END AS BIGINT) AS kill,
  CAST(CASE WHEN ne = 'ENCOUNTER_END' THEN epoch_us(nts) // 1000 - epoch_us(ts) // 1000 END AS BIGINT) AS duration_ms
FROM em WHERE event = 'ENCOUNTER_START'"""

O2 = f"""WITH {_base(False)}
SELECT upload_id, start_event, 'Player-' || CAST(e % 5 AS VARCHAR) AS caster_id,
  'name' || CAST(e % 5 AS VARCHAR) || '-Realm' AS caster_name,
  CAST(sum(amount) AS BIGINT) AS heal, CAST(sum(e % 100) AS BIGINT) AS overheal, CAST(0 AS BIGINT) AS absorbed,
  CAST(count(*) AS BIGINT) AS n
FROM la WHERE event = 'SPELL_HEAL' AND e % 1000 <> 999
GROUP BY upload_id, start_event, e % 5"""

ORACLES.update({"o1_encounters": O1, "o2_healing": O2})

E2E_FANOUT = f"""WITH {_base(True)},
pc AS (SELECT upload_id, start_event, count(*) AS patch_facts FROM lr WHERE event = 'COMBAT_LOG_VERSION'
       GROUP BY upload_id, start_event),
kept AS (SELECT m.*, pc.patch_facts FROM meta m JOIN dec d USING (upload_id, start_event)
         JOIN pc USING (upload_id, start_event)
         WHERE NOT d.duplicate AND m.finished <> 0 AND m.ten_affix_id IS NOT NULL AND m.patch IS NOT NULL),
pd AS (SELECT upload_id, start_event, caster_name, caster_id, CAST(sum(damage) AS BIGINT) AS damage
       FROM booked WHERE caster_type IN ('0x511', '0x512') AND caster_id <> '0000000000000000'
       GROUP BY upload_id, start_event, caster_name, caster_id)
SELECT * EXCLUDE (c) FROM (
  SELECT pd.damage, pd.caster_name, pd.caster_id, k.dungeon_name, k.dungeon_id, k.key_level, k.duration, k.finished,
    k.two_affix_id, k.four_affix_id, k.seven_affix_id, k.ten_affix_id, k.patch, k.date, k.upload_id, k.start_event,
    unnest(range(k.patch_facts)) AS c
  FROM pd JOIN kept k USING (upload_id, start_event))"""

ORACLES["e2e_keys_result_fanout"] = E2E_FANOUT

O2_DOCS = f"""WITH {_base(False)},
k AS (SELECT m.* FROM meta m JOIN hashed h USING (upload_id, start_event) WHERE finished IS NOT NULL AND duration IS NOT NULL
      AND ten_affix_id IS NOT NULL AND date IS NOT NULL),
sp AS (SELECT upload_id, start_event, 'Player-' || CAST(e % 5 AS VARCHAR) AS player_id, 'name' || CAST(e % 5 AS VARCHAR) || '-Realm' AS player_name,
   CAST(2000 + e % 7 AS BIGINT) AS spell_id, CAST(sum(amount) AS BIGINT) AS spell_healing
 FROM la WHERE event = 'SPELL_HEAL' AND e % 1000 <> 999 GROUP BY upload_id, start_event, e % 5, e % 7),
pl AS (SELECT upload_id, start_event, player_id, player_name, CAST(sum(spell_healing) AS BIGINT) AS player_total FROM sp GROUP BY ALL)
SELECT k.start_event, CAST(k.key_level AS INTEGER) AS keylevel, CAST(k.dungeon_id AS INTEGER) AS dungeon_id,
  CAST(dense_rank() OVER (PARTITION BY k.upload_id, k.start_event ORDER BY pl.player_total DESC, pl.player_name) - 1 AS INTEGER) AS player_pos,
  pl.player_id, pl.player_total,
  CAST(row_number() OVER (PARTITION BY k.upload_id, k.start_event, pl.player_id ORDER BY sp.spell_healing DESC, sp.spell_id) - 1 AS INTEGER) AS spell_pos,
  sp.spell_id, sp.spell_healing
FROM k JOIN pl USING (upload_id, start_event) JOIN sp USING (upload_id, start_event, player_id)"""

P13_ALL = f"""WITH {_base(False)},
rej AS (
 SELECT upload_id, event, 'bad_int' AS reason, 1 AS line FROM dmg
   WHERE kind = 'HIT' AND NOT friendly AND own_flag IN ('0x511', '0x512') AND bad_amount
 UNION ALL SELECT upload_id, event, 'bad_int', 1 FROM pet WHERE se IS NOT NULL AND NOT friendly AND bad_amount
 UNION ALL SELECT upload_id, event, 'bad_int', 1 FROM la WHERE event = 'SPELL_HEAL' AND e % 1000 = 999
 UNION ALL SELECT upload_id, 'CHALLENGE_MODE_START', 'no_hash', 0 FROM runs r
   WHERE NOT EXISTS (SELECT 1 FROM hashed h WHERE h.upload_id = r.upload_id AND h.start_event = r.start_event))
SELECT upload_id, event, reason, CAST(count(*) AS BIGINT) AS n, CAST(sum(line) AS BIGINT) AS lines FROM rej GROUP BY upload_id, event, reason"""

ORACLES.update({"o2_healing_docs": O2_DOCS, "p13_rejects_all_events": P13_ALL})
