"""SQL over the driver's tables that must give the same rows as the registered queries."""

from __future__ import annotations

from contest_panel.operators.sequences import SUMMARY_SETS

ORACLES: dict[str, str] = {}

_BASE = """
WITH ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events
), ev2 AS (
  SELECT *, CASE WHEN k % 4 = 0 THEN 1 + k % 3 ELSE 0 END AS v FROM ev
), side AS (
  SELECT event_id // 2 AS bid, event_id % 2 AS half, ts, event_type,
    'U' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS tag,
    [CAST(26000000 + (user_id * 7 + 3 * v + i) % 102 AS INTEGER) FOR i IN range(8)] AS cards,
    [CAST(1 + (k + 3 * i + user_id) % 13 AS INTEGER) FOR i IN range(8)] AS levels,
    CAST(floor(value) AS INTEGER) % 4 AS crowns,
    CASE WHEN event_type <> 'error' THEN CAST((user_id * 97 + k * 5) % 8000 AS INTEGER) END AS trophies,
    CASE WHEN k % 10 <> 0 THEN 1000 + k END AS king_hp,
    CASE WHEN k % 7 <> 0 THEN 'C' || CAST(user_id % 20 AS VARCHAR) END AS clan
  FROM ev2
), battle AS (
  SELECT h.bid, h.ts AS battle_time, date_trunc('week', h.ts) + INTERVAL 7 DAY AS collected_at,
    CAST(h.ts AS DATE) AS day, h.event_type AS type,
    CASE h.event_type WHEN 'click' THEN 72000006 WHEN 'view' THEN 72000201 WHEN 'purchase' THEN 72000044
      WHEN 'error' THEN 72000006 WHEN 'signup' THEN 72000099 END AS game_mode,
    h, w
  FROM side h JOIN side w ON h.bid = w.bid AND h.half = 0 AND w.half = 1 AND h.tag <> w.tag
), live AS (
  SELECT bid, battle_time, collected_at, type, game_mode, strftime(collected_at, '%Y%m%d') || '-a' AS run_id,
    h AS team, w AS opp FROM battle
  UNION ALL
  SELECT bid, battle_time, collected_at, type, game_mode, strftime(collected_at, '%Y%m%d') || '-b', w, h FROM battle
), oriented AS (
  SELECT strftime(battle_time, '%Y%m%dT%H%M%S.%gZ') || '|' || least(team.tag, opp.tag) || '|' ||
      greatest(team.tag, opp.tag) AS battle_key,
    date_trunc('millisecond', battle_time) AS battle_time, collected_at, run_id, type, game_mode,
    CASE WHEN team.tag <= opp.tag THEN team ELSE opp END AS a,
    CASE WHEN team.tag <= opp.tag THEN opp ELSE team END AS b
  FROM live
), parsed AS (
  SELECT *, CASE WHEN a.crowns > b.crowns THEN 'a' WHEN b.crowns > a.crowns THEN 'b' ELSE 'tie' END AS winner,
    CASE WHEN a.crowns > b.crowns THEN 1 WHEN b.crowns > a.crowns THEN 0 END AS label_a_win,
    a.crowns <> b.crowns AS clean
  FROM oriented
), first_row AS (
  SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY battle_key ORDER BY collected_at, run_id) = 1
), clean_row AS (
  SELECT * FROM parsed WHERE clean
  QUALIFY row_number() OVER (PARTITION BY battle_key ORDER BY collected_at, run_id) = 1
), focal0 AS (
  SELECT battle_key, battle_time, collected_at, a.tag AS player_tag, a.cards AS cards, a.levels AS levels,
    CASE WHEN label_a_win = 1 THEN 1 ELSE -1 END AS result, a.crowns - b.crowns AS crown_difference,
    CAST(a.trophies AS DOUBLE) AS trophies FROM clean_row
  UNION ALL
  SELECT battle_key, battle_time, collected_at, b.tag, b.cards, b.levels,
    CASE WHEN label_a_win = 0 THEN 1 ELSE -1 END, b.crowns - a.crowns, CAST(b.trophies AS DOUBLE) FROM clean_row
), focal AS (
  SELECT battle_key, battle_time, collected_at, player_tag, list_sort(cards) AS deck,
    [p.y FOR p IN list_sort([{'x': c, 'y': levels[list_position(cards, c)]} FOR c IN cards])] AS levels,
    result, crown_difference, trophies
  FROM focal0
), decided AS (
  SELECT day, battle_time, game_mode,
    CASE WHEN h.crowns > w.crowns THEN h ELSE w END AS win, CASE WHEN h.crowns > w.crowns THEN w ELSE h END AS lose
  FROM battle WHERE h.crowns <> w.crowns
), season AS (
  SELECT day, battle_time, game_mode, 54000000 AS arena, CASE WHEN win.tag < lose.tag THEN 1 ELSE 0 END AS a_won,
    CASE WHEN win.tag < lose.tag THEN win ELSE lose END AS a, CASE WHEN win.tag < lose.tag THEN lose ELSE win END AS b
  FROM decided
), ladder AS (
  SELECT * FROM season WHERE game_mode IN (72000006, 72000201, 72000044)
), melted AS (
  SELECT battle_time, a.tag || '|' || b.tag AS pairing, a.tag AS tag, list_sort(a.cards) AS deck,
    CAST(list_sum(a.levels) AS INTEGER) AS total_level, coalesce(a.trophies, 0) AS trophies, a_won AS won FROM ladder
  UNION ALL
  SELECT battle_time, a.tag || '|' || b.tag, b.tag, list_sort(b.cards), CAST(list_sum(b.levels) AS INTEGER), coalesce(b.trophies, 0),
    1 - a_won FROM ladder
), flipped AS (
  SELECT *, (('0x' || substr(md5('0|' || epoch_us(battle_time) || '|' || a.tag || '|' || b.tag), 1, 8))::BIGINT) % 2 = 1
    AS flip FROM season
), cells0 AS (
  SELECT greatest(0, least(79, (coalesce(a.trophies, 0) + coalesce(b.trophies, 0)) // 200)) AS band,
    greatest(-40, least(40, CASE WHEN flip THEN list_sum(b.levels) - list_sum(a.levels)
      ELSE list_sum(a.levels) - list_sum(b.levels) END)) AS advantage,
    CASE WHEN flip THEN 1 - a_won ELSE a_won END AS won
  FROM flipped WHERE game_mode IN (72000006, 72000201, 72000044)
), cells AS (
  SELECT CAST(band AS INTEGER) AS band, CAST(advantage AS INTEGER) AS advantage, count(*) AS battles,
    CAST(sum(won) AS BIGINT) AS wins FROM cells0 GROUP BY ALL
), raw_c AS (
  SELECT advantage, CAST(sum(battles) AS BIGINT) AS battles, sum(wins) / sum(battles) AS win_rate FROM cells
  GROUP BY advantage HAVING sum(battles) >= 20
), weights AS (
  SELECT band, sum(battles) AS w FROM cells GROUP BY band
), std_c AS (
  SELECT advantage, sum(w * wins / battles) / sum(w) AS win_rate, CAST(sum(battles) AS BIGINT) AS battles
  FROM cells JOIN weights USING (band) WHERE battles >= 5 GROUP BY advantage HAVING sum(battles) >= 20
), steps AS (
  SELECT *, lag(deck) OVER o AS pdeck, lag(won) OVER o AS pwon, row_number() OVER o AS rn,
    row_number() OVER (PARTITION BY tag ORDER BY battle_time DESC, pairing DESC) AS rrn
  FROM melted WINDOW o AS (PARTITION BY tag ORDER BY battle_time, pairing)
), moves AS (
  SELECT *, pdeck IS NOT NULL AS follows, pdeck IS NOT NULL AND pdeck <> deck AS switched,
    len(list_intersect(deck, pdeck)) AS shared FROM steps
), drifts AS (
  SELECT *, CASE WHEN switched THEN 1 - shared / (16.0 - shared) END AS drift FROM moves
), panel0 AS (
  SELECT tag, count(*) AS battles, avg(won) AS win_rate, count(DISTINCT deck) AS distinct_decks,
    avg(total_level) AS level_mean, max(CASE WHEN rn = 1 THEN total_level END) AS level_first,
    max(CASE WHEN rrn = 1 THEN total_level END) AS level_last, max(total_level) AS level_max,
    max(CASE WHEN rn = 1 THEN trophies END) AS trophies_first, max(CASE WHEN rrn = 1 THEN trophies END) AS trophies_last,
    avg(CASE WHEN follows THEN CAST(switched AS INTEGER) END) AS switch_rate,
    avg(CASE WHEN follows AND pwon = 0 THEN CAST(switched AS INTEGER) END) AS switch_after_loss,
    avg(CASE WHEN follows AND pwon = 1 THEN CAST(switched AS INTEGER) END) AS switch_after_win,
    avg(drift) AS switch_drift
  FROM drifts GROUP BY tag
), top_deck AS (
  SELECT tag, max(n) AS top FROM (SELECT tag, deck, count(*) AS n FROM melted GROUP BY tag, deck) GROUP BY tag
), panel AS (
  SELECT p.*, top / battles AS top_deck_share, switch_after_loss - switch_after_win AS loss_reactivity,
    level_last - level_first AS level_gain, trophies_last - trophies_first AS trophy_gain
  FROM panel0 p JOIN top_deck USING (tag)
), card AS (
  SELECT CAST(26000000 + i AS INTEGER) AS id, ['common','rare','epic','legendary','champion'][1 + (26000000 + i) % 5] AS rarity
  FROM range(102) t(i)
)"""


def sql(name: str, body: str) -> None:
    ORACLES[name] = f"{_BASE}\n{body.strip()}"


sql("season_scan", """
SELECT strftime(battle_time, '%Y-%m-%d %H:%M:%S.%f') AS "battleTime", game_mode, win.tag AS winner_tag,
  lose.tag AS loser_tag, coalesce(win.trophies, 0) AS winner_trophies, coalesce(lose.trophies, 0) AS loser_trophies,
  win.king_hp AS winner_king_hp, lose.clan AS loser_clan, array_to_string(win.cards, ',') AS winner_cards,
  array_to_string(lose.levels, ',') AS loser_levels FROM decided""")
sql("day_exclusion", """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS battles FROM season
WHERE day <> (SELECT max(day) FROM battle) GROUP BY 1""")
sql("season_neutral", """
SELECT epoch_us(battle_time) AS at, CASE WHEN flip THEN b.tag ELSE a.tag END AS a_tag,
  CASE WHEN flip THEN a.tag ELSE b.tag END AS b_tag, CASE WHEN flip THEN 1 - a_won ELSE a_won END AS a_won,
  coalesce(CASE WHEN flip THEN b.trophies ELSE a.trophies END, 0) AS a_trophies
FROM flipped WHERE day <> (SELECT max(day) FROM battle)""")
sql("conversion_report", """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS rows_read, count(*) AS rows_written,
  round(avg(a_won), 6) AS side_a_win_rate FROM season GROUP BY 1""")
sql("live_scan", """
SELECT strftime(battle_time, '%Y-%m-%d') AS date, count(*) AS "rows", count(*) FILTER (clean) AS clean,
  CAST(sum(list_sum(a.levels)) AS BIGINT) AS a_levels, count(b.trophies) AS b_trophies_known FROM parsed GROUP BY 1""")
sql("live_load", """
SELECT battle_key, run_id, winner, label_a_win, a.crowns AS a_crowns, b.crowns AS b_crowns FROM first_row WHERE clean""")
sql("parse_battle", """
SELECT battle_key, epoch_us(battle_time) AS at, run_id, type, CAST(game_mode AS VARCHAR) AS game_mode, 'arena' AS arena,
  'collection' AS deck_selection, winner, label_a_win, CAST(clean AS INTEGER) AS clean, a.tag AS a_tag,
  'name-' || a.tag AS a_name, a.clan AS a_clan, a.crowns AS a_crowns, a.king_hp AS a_king_hp, a.trophies AS a_trophies,
  a.crowns * 10 - 15 AS a_trophy_change, CAST(a.crowns * 0.5 AS DOUBLE) AS a_elixir_leaked, b.tag AS b_tag,
  b.clan AS b_clan, b.king_hp AS b_king_hp, 1 AS a_team_size, 8 AS b_n_cards,
  array_to_string(a.cards, ',') AS a_card_ids, array_to_string(b.levels, ',') AS b_card_levels,
  '1,1,0,0,0,0,0,0' AS a_card_evo, CAST(159000000 + b.crowns AS VARCHAR) AS b_support_ids,
  CAST(a.crowns * 100 AS VARCHAR) || ',' || CAST(a.crowns * 50 AS VARCHAR) AS a_princess_hp
FROM parsed""")
sql("battle_key", """
SELECT battle_key, count(*) AS copies, count(DISTINCT run_id) AS runs FROM parsed GROUP BY 1""")
sql("parse_time", """
SELECT event_id, CASE WHEN k % 9 <> 0 AND k % 11 <> 0 THEN epoch_us(date_trunc('millisecond', ts)) END AS at FROM ev""")
sql("canonical_live", """
SELECT a.tag AS a_tag, b.tag AS b_tag, count(*) AS "rows", count(*) FILTER (label_a_win = 1) AS a_wins,
  count(*) FILTER (winner = 'tie') AS ties FROM parsed GROUP BY 1, 2""")
sql("canonical_season", """
SELECT epoch_us(battle_time) AS at, game_mode, arena, a_won, a.tag AS a_tag, b.tag AS b_tag,
  coalesce(a.trophies, 0) AS a_trophies, coalesce(b.trophies, 0) AS b_trophies, a.crowns AS a_crowns,
  b.crowns AS b_crowns, coalesce(a.king_hp, 0) AS a_king_hp, coalesce(b.king_hp, 0) AS b_king_hp,
  coalesce(a.clan, '') AS a_clan, coalesce(b.clan, '') AS b_clan, array_to_string(a.cards, ',') AS a_cards,
  array_to_string(b.levels, ',') AS b_levels FROM season""")
sql("neutral_sides", """
SELECT epoch_us(battle_time) AS at, CASE WHEN f THEN 1 - a_won ELSE a_won END AS a_won,
  CASE WHEN f THEN b.tag ELSE a.tag END AS a_tag, CASE WHEN f THEN a.tag ELSE b.tag END AS b_tag,
  coalesce(CASE WHEN f THEN b.trophies ELSE a.trophies END, 0) AS a_trophies,
  coalesce(CASE WHEN f THEN a.king_hp ELSE b.king_hp END, 0) AS b_king_hp,
  array_to_string(CASE WHEN f THEN b.cards ELSE a.cards END, ',') AS a_cards
FROM (SELECT *, (('0x' || substr(md5('7|' || epoch_us(battle_time) || '|' || a.tag || '|' || b.tag), 1, 8))::BIGINT) % 2 = 1
  AS f FROM season)""")
sql("melt_sides", """
SELECT tag, epoch_us(battle_time) // 60000000 AS minute, pairing, CAST(total_level AS INTEGER) AS total_level,
  trophies, won, array_to_string(deck, ',') AS deck FROM melted""")
sql("focal_rows", """
SELECT battle_key, player_tag, result, crown_difference, trophies, epoch_us(collected_at) AS collected,
  array_to_string(deck, ',') AS deck, array_to_string(levels, ',') AS levels FROM focal""")
sql("season_files", """
SELECT strftime(day, '%d%m%Y') AS day, count(*) AS battles, CAST(sum(a_won) AS BIGINT) AS a_wins,
  CAST(sum(list_sum(b.levels)) AS BIGINT) AS b_levels FROM season WHERE strftime(day, '%d%m%Y') NOT LIKE '%1012024%' GROUP BY 1""")
sql("focal_rows_planted", """
SELECT battle_key, player_tag, result FROM focal0 JOIN (SELECT battle_key, a.tag AS bad, a.king_hp AS hp FROM clean_row) USING (battle_key)
WHERE NOT coalesce(hp % 5 = 0 AND player_tag = bad, false)""")
sql("focal_violations", """
SELECT battle_key, a.tag AS player_tag, 'incomplete deck' AS problem FROM clean_row WHERE a.king_hp % 5 = 0""")
sql("norm_tag", """
SELECT event_id, '#U' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS tag FROM ev""")
sql("dedup_first", """
SELECT battle_key, run_id, a.tag AS a_tag, b.tag AS b_tag, winner FROM first_row""")
sql("dedup_clean", "SELECT battle_key, run_id, label_a_win FROM clean_row")
sql("dedup_last", """
SELECT battle_key, run_id, winner FROM parsed
QUALIFY row_number() OVER (PARTITION BY battle_key ORDER BY collected_at DESC, run_id DESC) = 1""")
sql("dedup_entity", """
SELECT 'U' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS tag, event_id, event_type FROM ev
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
sql("incremental_new", """
SELECT battle_key, min(run_id) AS run_id, min(a.crowns) AS a_crowns FROM parsed WHERE run_id LIKE '%-b'
  AND battle_key NOT IN (SELECT battle_key FROM parsed WHERE run_id LIKE '%-a' AND a.crowns % 2 = 0)
GROUP BY battle_key""")
sql("eligible_players", """
SELECT tag, count(*) AS battles FROM (SELECT a.tag AS tag FROM clean_row UNION ALL SELECT b.tag FROM clean_row)
GROUP BY tag HAVING count(*) >= 11""")
sql("eligible_rows", """
SELECT player_tag, battle_key, result FROM focal
WHERE player_tag IN (SELECT player_tag FROM focal GROUP BY 1 HAVING count(*) >= 60)""")
sql("cohort_merge", """
SELECT 'M' || c_custkey AS tag, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE upper(c_name) END AS name,
  CAST(floor(greatest(c_acctbal, 0)) AS BIGINT) + CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END AS trophies
FROM customer""")
sql("cohort_upsert_repeated", """
SELECT 'U' || lpad(CAST(c.user_id AS VARCHAR), 9, '0') AS tag,
  epoch_us(coalesce(p.polled_at, CASE WHEN c.user_id % 5 <> 0 THEN c.last END)) AS last_polled,
  CASE WHEN c.user_id % 5 = 0 THEN 0 ELSE c.n END + coalesce(p.ok, 0) AS n_polls,
  CAST(c.n * 2 + coalesce(p.kept, 0) AS BIGINT) AS n_battles, c.bad + coalesce(p.fail, 0) AS n_fail
FROM (SELECT user_id, max(ts) AS last, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM ev GROUP BY 1) c
LEFT JOIN (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS polled_at, count(*) FILTER (event_type <> 'error') AS ok,
    sum(k) FILTER (event_type <> 'error') AS kept, count(*) FILTER (event_type = 'error') AS fail FROM ev
  WHERE event_type <> 'signup' AND user_id % 3 <> 0 GROUP BY 1) p ON c.user_id = p.user_id""")
sql("cohort_upsert", """
SELECT 'U' || lpad(CAST(c.user_id AS VARCHAR), 9, '0') AS tag,
  epoch_us(coalesce(p.polled_at, CASE WHEN c.user_id % 5 <> 0 THEN c.last END)) AS last_polled,
  CASE WHEN c.user_id % 5 = 0 THEN 0 ELSE c.n END + CASE WHEN p.polled_at IS NOT NULL THEN 1 ELSE 0 END AS n_polls,
  c.n * 2 + CASE WHEN p.polled_at IS NOT NULL THEN p.kept ELSE 0 END AS n_battles,
  c.bad + CASE WHEN p.user_id IS NOT NULL AND p.polled_at IS NULL THEN 1 ELSE 0 END AS n_fail
FROM (SELECT user_id, max(ts) AS last, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM ev GROUP BY 1) c
LEFT JOIN (SELECT user_id, max(ts) FILTER (event_type = 'click') AS polled_at, count(*) AS kept FROM ev
  WHERE event_type <> 'signup' AND user_id % 3 <> 0 GROUP BY 1) p ON c.user_id = p.user_id""")
sql("level_counts", "SELECT * FROM cells")
sql("raw_curve", "SELECT advantage, round(win_rate, 6) AS win_rate, battles FROM raw_c")
sql("standardised_curve", "SELECT advantage, round(win_rate, 6) AS win_rate, battles FROM std_c")
sql("curve_report", """
SELECT r.advantage, round(r.win_rate, 6) AS win_rate, r.battles,
  round(r.battles / (SELECT sum(battles) FROM raw_c), 6) AS share,
  round(sqrt(r.win_rate * (1 - r.win_rate) / greatest(r.battles, 1)), 6) AS standard_error,
  round(s.win_rate, 6) AS standardised_win_rate, round(r.advantage / 8.0, 6) AS per_item
FROM raw_c r LEFT JOIN std_c s ON r.advantage = s.advantage WHERE abs(r.advantage) <= 20""")
sql("level_histogram", """
SELECT card, greatest(0, least(15, level)) AS level, count(*) AS observations FROM (
  SELECT unnest(a.cards) AS card, unnest(a.levels) AS level FROM ladder
  UNION ALL SELECT unnest(b.cards), unnest(b.levels) FROM ladder) GROUP BY 1, 2""")
sql("conditioning_cells", """
SELECT CAST(greatest(0, least(79, (coalesce(a.trophies, 0) + coalesce(b.trophies, 0)) // 200)) AS INTEGER) AS band,
  CAST(greatest(-40, least(40, list_sum(a.levels) - list_sum(b.levels))) AS INTEGER) AS gap, count(*) AS battles
FROM ladder GROUP BY 1, 2""")
sql("difference_histogram", """
SELECT CAST(least(200, abs(coalesce(a.trophies, 0) - coalesce(b.trophies, 0))) AS INTEGER) AS difference,
  count(*) AS battles, (SELECT count(*) FROM season) AS rows_read, (SELECT count(*) FROM ladder) AS rows_kept
FROM ladder GROUP BY 1""")
sql("transitions", """
SELECT tag, epoch_us(battle_time) AS at, pairing, follows, switched, pwon AS previous_won, round(drift, 6) AS drift FROM drifts""")
sql("switch_drift", """
SELECT tag, epoch_us(battle_time) AS at, pairing, shared, round(drift, 6) AS drift FROM drifts WHERE switched""")
sql("player_panel", """
SELECT tag, battles, round(win_rate, 6) AS win_rate, distinct_decks, round(level_mean, 6) AS level_mean, level_first,
  level_last, level_max, trophies_first, trophies_last, round(top_deck_share, 6) AS top_deck_share,
  round(switch_rate, 6) AS switch_rate, round(switch_after_loss, 6) AS switch_after_loss,
  round(switch_after_win, 6) AS switch_after_win, round(switch_drift, 6) AS switch_drift,
  round(loss_reactivity, 6) AS loss_reactivity, level_gain, trophy_gain FROM panel""")
_METRICS = (
    "battles", "win_rate", "distinct_decks", "top_deck_share", "switch_rate", "switch_after_loss",
    "switch_after_win", "loss_reactivity", "switch_drift", "level_mean", "level_gain", "trophy_gain",
)
sql("panel_summary", "\nUNION ALL\n".join(f"""
SELECT '{m}' AS metric, round(avg({m}) FILTER (battles >= 20), 6) AS mean, round(stddev_samp({m}) FILTER (battles >= 20), 6) AS std,
  round(quantile_cont(CAST({m} AS DOUBLE), 0.25) FILTER (battles >= 20), 6) AS q25,
  round(quantile_cont(CAST({m} AS DOUBLE), 0.5) FILTER (battles >= 20), 6) AS q50,
  round(quantile_cont(CAST({m} AS DOUBLE), 0.75) FILTER (battles >= 20), 6) AS q75, count(*) AS players,
  count(*) FILTER (battles >= 10) AS players_10, count(*) FILTER (battles >= 20) AS players_20,
  count(*) FILTER (battles >= 50) AS players_50 FROM panel""" for m in _METRICS))
sql("day_summary", """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS battles, epoch_us(min(battle_time)) AS first_battle,
  epoch_us(max(battle_time)) AS last_battle FROM season GROUP BY 1""")
sql("duplicate_audit", """
SELECT CAST(sum(n) AS BIGINT) AS battles, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (
  SELECT battle_time, a.tag, b.tag, count(*) AS n FROM (
    SELECT * FROM season UNION ALL SELECT * FROM season WHERE coalesce(a.trophies, 0) % 3 = 0) GROUP BY 1, 2, 3)""")
sql("activity_thresholds", """
, app AS (
  SELECT tag, count(*) AS n FROM (SELECT a.tag AS tag FROM season UNION ALL SELECT b.tag FROM season) GROUP BY 1)
SELECT t AS threshold, (SELECT count(*) FROM app) AS all_players, round((SELECT avg(n) FROM app), 6) AS mean_battles,
  (SELECT count(*) FROM app WHERE n >= t) AS players,
  CAST((SELECT coalesce(sum(n), 0) FROM app WHERE n >= t) AS BIGINT) AS appearances,
  round((SELECT quantile_cont(CAST(n AS DOUBLE), 0.5) FROM app), 6) AS median_battles
FROM unnest([5, 10, 25, 50, 100]) u(t)""")
sql("period_compare", """
, marked AS (SELECT *, day = (SELECT max(day) FROM battle) AS final FROM season), lines AS (
  SELECT final, CAST(count(*) AS DOUBLE) AS battles, sum(list_sum(a.levels)) / (count(*) * 8.0) AS mean_card_level,
    avg(coalesce(a.trophies, 0)) AS mean_trophies, CAST(count(DISTINCT a.cards[1]) AS DOUBLE) AS distinct_first_cards
  FROM marked GROUP BY 1), long AS (UNPIVOT lines ON battles, mean_card_level, mean_trophies, distinct_first_cards INTO NAME metric VALUE value)
SELECT metric, round(max(value) FILTER (final), 6) AS selected, round(max(value) FILTER (NOT final), 6) AS rest,
  round(max(value) FILTER (final) - max(value) FILTER (NOT final), 6) AS difference FROM long GROUP BY 1""")

_SEQ = """, numbered AS (
  SELECT *, row_number() OVER o AS seq, lag(deck) OVER o AS pdeck, lag(result) OVER o AS presult,
    lag(battle_time) OVER o AS ptime,
    CASE WHEN count(collected_at) OVER c = 11 AND min(collected_at) OVER c = max(collected_at) OVER c THEN 1 ELSE 0 END AS whole
  FROM focal WINDOW o AS (PARTITION BY player_tag ORDER BY battle_time, battle_key),
    c AS (PARTITION BY player_tag ORDER BY battle_time, battle_key ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)
), stepped AS (
  SELECT *, CASE WHEN pdeck IS NOT NULL AND pdeck <> deck THEN 1 ELSE 0 END AS changed,
    CASE WHEN pdeck IS NULL THEN 0.0 ELSE 1 - len(list_intersect(deck, pdeck)) / len(list_distinct(list_concat(deck, pdeck))) END AS mag,
    CASE WHEN ptime IS NULL THEN 0.0 ELSE ln(1 + (epoch_us(battle_time) - epoch_us(ptime)) / 3600000000.0) END AS gap
  FROM numbered
), upto AS (
  SELECT t.player_tag, t.seq, count(*) AS n, sum(p.changed) AS sw, count(*) FILTER (p.presult = -1) AS ln_,
    sum(p.changed) FILTER (p.presult = -1) AS ls, count(*) FILTER (p.presult = 1) AS wn,
    sum(p.changed) FILTER (p.presult = 1) AS ws, sum(p.mag) FILTER (p.changed = 1) AS ms,
    t.seq - max(p.seq) FILTER (p.changed = 1 OR p.seq = 1) + 1 AS tenure,
    count(*) FILTER (p.deck = t.deck) AS deck_n
  FROM stepped t JOIN stepped p ON t.player_tag = p.player_tag AND p.seq <= t.seq GROUP BY t.player_tag, t.seq, t.deck
), nine AS (
  SELECT player_tag, seq, CASE WHEN n > 1 THEN sw / (n - 1) END AS historical_switch_rate,
    CASE WHEN ln_ > 0 THEN ls / ln_ END AS post_loss_switch_rate, CASE WHEN wn > 0 THEN ws / wn END AS post_win_switch_rate,
    CASE WHEN sw > 0 THEN ms / sw END AS mean_switch_magnitude, ln(1.0 + tenure) AS log1p_current_deck_tenure,
    ln(1.0 + n) AS log1p_prior_battle_count, ln(1.0 + ln_) AS log1p_post_loss_opportunities,
    ln(1.0 + wn) AS log1p_post_win_opportunities, ln(1.0 + deck_n) AS log1p_current_deck_battle_count
  FROM upto
), example AS (
  SELECT t.player_tag || '|' || t.battle_key AS example_id, t.player_tag, t.battle_key, t.battle_time AS target_time,
    t.deck AS target_deck, t.changed AS next_switch, CASE WHEN t.result = 1 THEN 1 ELSE 0 END AS next_win, t.seq, t.whole,
    s.* EXCLUDE (player_tag, seq)
  FROM stepped t JOIN nine s ON s.player_tag = t.player_tag AND s.seq = t.seq - 1 WHERE t.seq > 10
), line AS (
  SELECT e.example_id, e.whole, e.seq AS target_seq, h.seq - e.seq + 11 AS position, h.battle_time, h.deck, h.levels, h.result,
    h.crown_difference, CASE WHEN h.seq = e.seq - 10 THEN 0 ELSE h.changed END AS changed_deck,
    CASE WHEN h.seq = e.seq - 10 THEN 0 ELSE h.mag END AS switch_magnitude,
    CASE WHEN h.seq = e.seq - 10 THEN 0 ELSE h.gap END AS log1p_time_gap_hours, h.trophies
  FROM example e JOIN stepped h ON h.player_tag = e.player_tag AND h.seq BETWEEN e.seq - 10 AND e.seq - 1
), eligible AS (
  SELECT player_tag AS tag, count(*) AS battles FROM focal GROUP BY 1 HAVING count(*) >= 11
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY md5('20260910|' || tag), tag) - 1 AS place, count(*) OVER () AS total FROM eligible
), split AS (
  SELECT tag, CASE WHEN place < floor(0.7 * total) THEN 0 WHEN place < floor(0.85 * total) THEN 1 ELSE 2 END AS split FROM ordered
), sized AS (
  SELECT tag, split, count(*) AS examples FROM example JOIN split ON tag = player_tag GROUP BY 1, 2
), dealt AS (
  SELECT *, (row_number() OVER (ORDER BY examples DESC, md5('20260913|' || tag), tag) - 1) % 10 AS m FROM sized WHERE split = 0
), folds AS (
  SELECT tag, split, examples, CASE WHEN m < 5 THEN m ELSE 9 - m END AS fold FROM dealt
  UNION ALL SELECT tag, split, examples, 255 FROM sized WHERE split <> 0
), placed AS (
  SELECT e.*, f.split, f.fold FROM example e JOIN folds f ON f.tag = e.player_tag
), shown AS (
  SELECT l.*, p.split, p.fold, [levels[i] + [0, 2, 5, 8, 10][1 + deck[i] % 5] FOR i IN range(1, 9)] AS displayed
  FROM line l JOIN placed p USING (example_id)
), scored AS (
  SELECT event_id, user_id % 3 AS run, (k + 1) / 101.0::DOUBLE AS score,
    CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END AS label, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS action
  FROM ev
), member AS (
  SELECT 'M' || c_custkey AS tag, CAST(floor(greatest(c_acctbal, 0)) AS BIGINT) AS trophies,
    CAST(least(4, floor(floor(greatest(c_acctbal, 0)) * 5.0 / 14000.0)) AS INTEGER) AS band FROM customer
), both_decks AS (
  SELECT a.cards AS deck FROM ladder UNION ALL SELECT b.cards FROM ladder
), pair AS (
  SELECT x AS card_i, y AS card_j, count(*) AS n FROM (
    SELECT x, unnest(deck) AS y FROM (SELECT deck, unnest(deck) AS x FROM both_decks)) WHERE x <> y GROUP BY 1, 2
), marginal AS (SELECT card_i AS card, sum(n) AS n FROM pair GROUP BY 1), pmi AS (
  SELECT p.card_i, p.card_j, p.n, ln(p.n * (SELECT sum(n) FROM pair)::DOUBLE / (a.n::DOUBLE * b.n)) AS pmi
  FROM pair p JOIN marginal a ON a.card = p.card_i JOIN marginal b ON b.card = p.card_j
)"""


def seq(name: str, body: str) -> None:
    ORACLES[name] = f"{_BASE}{_SEQ}\n{body.strip()}"


def _rounds(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


_BASE_NAMES = (
    "historical_switch_rate", "post_loss_switch_rate", "post_win_switch_rate", "mean_switch_magnitude",
    "log1p_current_deck_tenure", "log1p_prior_battle_count", "log1p_post_loss_opportunities",
    "log1p_post_win_opportunities",
)
_NINE_NAMES = (*_BASE_NAMES, "log1p_current_deck_battle_count")
_CONTINUOUS = ("crown_difference", "switch_magnitude", "log1p_time_gap_hours", "trophies")

seq("displayed_levels", """
SELECT battle_key, player_tag,
  array_to_string([levels[i] + [0, 2, 5, 8, 10][1 + deck[i] % 5] FOR i IN range(1, 9)], ',') AS displayed FROM focal""")
seq("displayed_levels_incomplete", """
SELECT battle_key, player_tag,
  array_to_string([CASE WHEN deck[i] % 51 = 50 THEN '?' ELSE CAST(levels[i] + [0, 2, 5, 8, 10][1 + deck[i] % 5] AS VARCHAR) END
    FOR i IN range(1, 9)], ',') AS displayed,
  CAST(len([c FOR c IN deck IF c % 51 = 50]) AS INTEGER) AS unknown FROM focal""")
seq("vocab_encode", """
, words AS (SELECT id, row_number() OVER (ORDER BY id) AS idx FROM card WHERE id % 51 <> 50), coded AS (
  SELECT battle_key, player_tag, c, coalesce(idx, 0) AS idx
  FROM (SELECT battle_key, player_tag, unnest(deck) AS c FROM focal) LEFT JOIN words ON id = c)
SELECT battle_key, player_tag, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY c) AS idx FROM coded GROUP BY 1, 2""")
seq("entity_index", """
SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS idx FROM (SELECT a.tag AS tag FROM season UNION SELECT b.tag FROM season)""")
seq("deck_key", """
SELECT CAST(sum((deck[i] - 26000000 + 1)::BIGINT * (1::BIGINT << (7 * (i - 1)))) AS BIGINT) AS deck_key,
  array_to_string(deck, ',') AS deck, uses
FROM (SELECT deck, count(*) AS uses FROM melted GROUP BY 1), unnest(range(1, 9)) r(i) GROUP BY deck, uses""")
seq("jaccard", """
SELECT epoch_us(battle_time) AS at, a.tag AS a_tag, b.tag AS b_tag,
  round(1 - len(list_intersect(a.cards, b.cards)) / len(list_distinct(list_concat(a.cards, b.cards))), 6) AS distance FROM season""")
seq("item_universe", "SELECT unnest(a.cards) AS card FROM season UNION SELECT unnest(b.cards) FROM season")
seq("cooccurrence", "SELECT * FROM pair")
seq("pmi", "SELECT card_i, card_j, n, round(pmi, 6) AS pmi FROM pmi")
seq("sign_checks", """
, expected AS (
  SELECT id AS card_i, CAST(26000000 + (id - 26000000 + 1) % 102 AS INTEGER) AS card_j, 'positive' AS sign FROM card
  UNION ALL SELECT id, CAST(26000000 + (id - 26000000 + 13) % 102 AS INTEGER), 'negative' FROM card)
SELECT e.card_i, e.card_j, sign, round(coalesce(pmi, 0), 6) AS pmi,
  CASE WHEN sign = CASE WHEN coalesce(pmi, 0) < 0 THEN 'negative' ELSE 'positive' END THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM expected e LEFT JOIN pmi p ON p.card_i = e.card_i AND p.card_j = e.card_j""")
seq("deck_vectors", """
, item AS (
  SELECT deck, c, embedding FROM (SELECT DISTINCT deck FROM melted) m, unnest(m.deck) u(c)
  LEFT JOIN embeddings ON vec_id = c - 26000000 AND vec_id % 10 <> 9
), part AS (
  SELECT deck, d, CAST(round(sum(CAST(embedding[d] AS DOUBLE)) * 1000000) AS BIGINT) AS v FROM item, range(1, 65) r(d) GROUP BY 1, 2
), gap AS (SELECT deck, count(*) FILTER (embedding IS NULL) AS missing FROM item GROUP BY 1)
SELECT array_to_string(deck, ',') AS deck, CASE WHEN missing = 0 THEN string_agg(CAST(v AS VARCHAR), ',' ORDER BY d) END AS vector, missing
FROM part JOIN gap USING (deck) GROUP BY deck, missing""")
seq("difference_long", """
SELECT "at", a_tag, card, CAST(sum(v) AS INTEGER) AS value FROM (
  SELECT epoch_us(battle_time) AS "at", a.tag AS a_tag, unnest(a.cards) AS card, 1 AS v FROM season
  UNION ALL SELECT epoch_us(battle_time), a.tag, unnest(b.cards), -1 FROM season) GROUP BY 1, 2, 3 HAVING sum(v) <> 0""")
seq("nearest_items", """
, asked AS (SELECT min(vec_id) AS q FROM embeddings GROUP BY label), scores AS (
  SELECT q AS query, v.vec_id AS item,
    list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(w.embedding AS DOUBLE[])) AS similarity
  FROM asked JOIN embeddings w ON w.vec_id = q JOIN embeddings v ON v.vec_id <> q)
SELECT query, item, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) AS rank
FROM scores QUALIFY rank <= 6""")
seq("nearest_items_named", """
, vec AS (SELECT 'v' || vec_id AS item, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id % 7 <> 3), scores AS (
  SELECT q.item AS query, v.item, list_cosine_similarity(v.x, q.x) AS similarity
  FROM vec q JOIN vec v ON v.item <> q.item WHERE q.vec_id % 40 = 0 OR q.vec_id = 3)
SELECT query, item, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) AS rank
FROM scores QUALIFY rank <= 3""")
seq("sequence_windows", """
SELECT e.example_id, e.seq - 11 AS window_start, count(*) AS length, epoch_us(min(l.battle_time)) AS starts,
  epoch_us(e.target_time) AS target_at, max(CASE WHEN l.position = 10 THEN array_to_string(l.deck, ',') END) AS last_deck
FROM example e JOIN line l USING (example_id) GROUP BY e.example_id, e.seq, e.target_time""")
seq("windows_continuous", "SELECT example_id, seq - 11 AS window_start, next_switch, next_win FROM example WHERE whole = 1")
seq("window_counts", """
SELECT player_tag, greatest(count(*) - 10, 0) AS windows, CAST(sum(whole) AS BIGINT) AS continuous FROM stepped GROUP BY 1""")
seq("sequence_features", f"""
SELECT example_id, position, result, crown_difference, changed_deck, {_rounds('switch_magnitude', 'log1p_time_gap_hours')}, trophies
FROM line WHERE whole = 1""")
seq("prefix_summary", f"SELECT example_id, {_rounds(*_BASE_NAMES)} FROM example")
seq("deck_tenure", "SELECT player_tag, battle_key, tenure FROM upto JOIN stepped USING (player_tag, seq)")
seq("deck_lifetime", "SELECT player_tag, battle_key, deck_n FROM upto JOIN stepped USING (player_tag, seq)")
seq("sequence_targets", """
SELECT example_id, array_to_string(target_deck, ',') AS target_deck, next_switch, next_win FROM example""")
seq("window_at", "SELECT example_id, player_tag, next_switch, next_win FROM example WHERE seq = 14")
seq("prebattle_context", f"""
, last AS (SELECT *, max(seq) OVER (PARTITION BY player_tag) AS top FROM stepped)
SELECT l.player_tag, epoch_us(l.battle_time) AS latest, array_to_string(l.deck, ',') AS last_deck, 0 AS first_changed,
  l.changed AS last_changed, {_rounds(*_NINE_NAMES)}
FROM last l JOIN nine s ON s.player_tag = l.player_tag AND s.seq = l.seq WHERE l.seq = l.top AND l.seq >= 10""")
seq("example_long", f"""
SELECT example_id, position, epoch_us(battle_time) AS at, array_to_string(deck, ',') AS deck,
  array_to_string(levels, ',') AS levels, result, crown_difference, changed_deck,
  {_rounds('switch_magnitude', 'log1p_time_gap_hours')}, trophies FROM line WHERE target_seq = 11""")
seq("global_rank", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS rank FROM events")
seq("time_split", """
SELECT epoch_us(battle_time) AS at, a.tag AS a_tag, row_number() OVER (ORDER BY battle_time, a.tag, b.tag) AS position,
  CASE WHEN row_number() OVER (ORDER BY battle_time, a.tag, b.tag) <= floor(0.75 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS part
FROM season""")
seq("player_split", "SELECT tag, split FROM split")
seq("player_folds", "SELECT tag, split, examples, fold FROM folds")
seq("stratified_cohort", """
SELECT tag, trophies, band FROM member QUALIFY row_number() OVER (PARTITION BY band ORDER BY md5('11|' || tag), tag) <= 100""")
seq("band_supply", """
, supply AS (
  SELECT b AS band, CAST(CAST(b * 2800 AS INTEGER) AS VARCHAR) || '-' || CAST(CAST((b + 1) * 2800 AS INTEGER) AS VARCHAR) AS label,
    count(tag) AS available, least(count(tag), 100) AS taken FROM range(5) r(b) LEFT JOIN member ON band = b GROUP BY b)
SELECT *, (SELECT max(taken) FROM supply) - taken AS shortfall, (SELECT min(available) FROM supply) * 5 AS balanced_ceiling FROM supply""")
seq("poll_order", """
SELECT 'U' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS tag, epoch_us(CASE WHEN user_id % 5 <> 0 THEN max(ts) END) AS last_polled,
  CASE WHEN user_id % 5 = 0 THEN 0 ELSE count(*) END AS n_polls
FROM ev GROUP BY user_id ORDER BY CASE WHEN user_id % 5 <> 0 THEN max(ts) END NULLS FIRST, user_id LIMIT 40""")
seq("hash_sample", "SELECT tag, trophies FROM member ORDER BY md5('5|' || tag), tag LIMIT 100")
seq("run_stats", """
, log AS (
  SELECT *, type <> 'signup' AS wanted, CASE WHEN a.crowns + b.crowns < 6 THEN battle_key END AS k FROM parsed
), win AS (
  SELECT run_id, type, clean FROM (SELECT * FROM log WHERE wanted AND k IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY collected_at, run_id, type) = 1)
  WHERE k NOT IN (SELECT battle_key FROM parsed WHERE a.crowns = 0))
SELECT s.*, coalesce(w.new, 0) AS new, coalesce(w.clean, 0) AS clean,
  seen - filtered - unparseable - coalesce(w.new, 0) AS duplicate
FROM (SELECT run_id, type, count(*) AS seen, count(*) FILTER (NOT wanted) AS filtered,
    count(*) FILTER (wanted AND k IS NULL) AS unparseable FROM log GROUP BY 1, 2) s
LEFT JOIN (SELECT run_id, type, count(*) AS new, count(*) FILTER (clean) AS clean FROM win GROUP BY 1, 2) w
  ON w.run_id = s.run_id AND w.type = s.type""")
seq("poll_coverage", """
, polls AS (
  SELECT event_type AS run_id, user_id % 5 = 0 AS first_one,
    CASE WHEN k % 13 = 0 THEN NULL WHEN k < 80 THEN k % 30 ELSE 30 END AS returned FROM ev)
SELECT run_id, count(*) FILTER (returned IS NULL) AS failed, count(*) FILTER (returned IS NOT NULL AND first_one) AS first_polls,
  count(*) FILTER (NOT first_one AND returned >= 30) AS full_pages, count(*) FILTER (NOT first_one AND returned < 30) AS partial_pages,
  count(*) FILTER (NOT first_one AND returned >= 30) > 0.1 * count(*) FILTER (NOT first_one AND returned IS NOT NULL) AS poll_more_often
FROM polls GROUP BY 1""")
seq("example_audit", """
SELECT 'split' AS level, split AS id, count(DISTINCT player_tag) AS players, count(*) AS examples,
  round(avg(next_switch), 6) AS switch_rate, round(avg(next_win), 6) AS win_rate FROM placed GROUP BY split
UNION ALL
SELECT 'fold', fold, count(DISTINCT player_tag), count(*), round(avg(next_switch), 6), round(avg(next_win), 6)
FROM placed WHERE fold <> 255 GROUP BY fold""")
seq("cell_sample", """
, one AS (SELECT * FROM placed WHERE split = 0
  QUALIFY row_number() OVER (PARTITION BY player_tag ORDER BY md5('3|' || example_id), example_id) = 1)
SELECT example_id, next_switch, next_win FROM one
QUALIFY row_number() OVER (PARTITION BY next_switch, next_win ORDER BY md5('3|' || example_id), example_id) <= 5""")
seq("level_scaling", """
SELECT 'level' AS feature, count(*) AS n, round(avg(l), 6) AS mean, round(stddev_pop(l), 6) AS sd
FROM (SELECT unnest(displayed) AS l FROM shown WHERE split = 0)""")
seq("battle_scaling", "\nUNION ALL\n".join(f"""
SELECT '{f}' AS feature, count({f}) AS n, round(avg({f}), 6) AS mean, round(stddev_pop({f}), 6) AS sd FROM shown WHERE split = 0"""
    for f in _CONTINUOUS))
seq("summary_scaling", "\nUNION ALL\n".join(f"""
SELECT '{f}' AS feature, count({f}) AS n, round(avg({f}), 6) AS mean, round(stddev_pop({f}), 6) AS sd FROM placed WHERE split = 0"""
    for f in _NINE_NAMES))
seq("fold_scaling", "\nUNION ALL\n".join(f"""
SELECT g AS fold, '{f}' AS feature, count({f}) AS n, round(avg({f}), 6) AS mean, round(stddev_pop({f}), 6) AS sd
FROM range(5) r(g) JOIN shown ON fold <> g WHERE split = 0 GROUP BY g""" for f in _CONTINUOUS))
seq("scaled_examples", """
, sc AS (
  SELECT g, avg(historical_switch_rate) AS m1, stddev_pop(historical_switch_rate) AS s1, avg(log1p_prior_battle_count) AS m2,
    stddev_pop(log1p_prior_battle_count) AS s2 FROM range(5) r(g) JOIN placed ON fold <> g WHERE split = 0 GROUP BY g
), tc AS (SELECT g, avg(trophies) AS m, stddev_pop(trophies) AS s FROM range(5) r(g) JOIN shown ON fold <> g WHERE split = 0 GROUP BY g
), lc AS (SELECT g, avg(l) AS m, stddev_pop(l) AS s FROM (
    SELECT g, unnest(displayed) AS l FROM range(5) r(g) JOIN shown ON fold <> g WHERE split = 0) GROUP BY g)
SELECT p.example_id, round(coalesce((p.historical_switch_rate - sc.m1) / sc.s1, 0), 5) AS historical_switch_rate,
  round((p.log1p_prior_battle_count - sc.m2) / sc.s2, 5) AS log1p_prior_battle_count,
  round(coalesce((h.trophies - tc.m) / tc.s, 0), 5) AS trophies, CAST(h.trophies IS NULL AS DOUBLE) AS missing,
  round((z.displayed[1] - lc.m) / lc.s, 5) AS level
FROM placed p JOIN sc ON sc.g = p.fold JOIN tc ON tc.g = p.fold JOIN lc ON lc.g = p.fold
JOIN shown h ON h.example_id = p.example_id AND h.position = 4 JOIN shown z ON z.example_id = p.example_id AND z.position = 10
WHERE p.split = 0""")
seq("split_leaks", """
, t AS (SELECT 'U' || user_id AS player_tag, CASE WHEN user_id % 10 = 7 THEN k % 2 ELSE user_id % 3 END AS split,
  CASE WHEN user_id % 10 = 3 THEN k % 2 ELSE user_id % 5 END AS fold FROM ev)
SELECT player_tag, count(DISTINCT split) AS splits, count(DISTINCT fold) FILTER (split = 0) AS folds FROM t GROUP BY 1
HAVING count(DISTINCT split) > 1 OR count(DISTINCT fold) FILTER (split = 0) > 1""")
seq("unknown_items", """
SELECT c AS card, count(*) AS observations FROM (SELECT unnest(deck) AS c FROM melted) WHERE c % 51 = 50 GROUP BY 1""")
seq("fold_rules", """
, t AS (SELECT user_id % 3 AS split, CASE WHEN user_id % 3 <> 0 AND k <> 7 THEN 255 ELSE k % 6 END AS fold,
  (user_id % 3 = 0 AND k > 2) OR k = 50 AS has FROM ev)
SELECT count(*) FILTER (split <> 0 AND fold <> 255) AS folds_outside_training,
  count(*) FILTER (split = 0 AND fold NOT IN (0, 1, 2, 3, 4)) AS training_without_fold,
  5 - count(DISTINCT fold) FILTER (split = 0 AND fold < 5) AS uncovered_folds,
  count(*) FILTER (split = 0 AND NOT has) AS training_without_score,
  count(*) FILTER (split <> 0 AND has) AS scores_outside_training FROM t""")
seq("history_violations", """
, copies AS (
  SELECT battle_key, a.tag AS player_tag, a.crowns - b.crowns AS d, a.trophies AS t FROM parsed WHERE clean
  UNION ALL SELECT battle_key, b.tag, b.crowns - a.crowns, b.trophies FROM parsed WHERE clean)
SELECT player_tag, battle_key, 'repeated key' AS problem FROM copies GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT player_tag, battle_key, 'bad result' FROM copies WHERE d = 3
UNION ALL SELECT player_tag, battle_key, p FROM copies, unnest(['incomplete deck', 'uneven levels']) u(p) WHERE t % 50 = 0""")
seq("sigmoid", """
SELECT event_id, round(1 / (1 + exp(-greatest(-30, least(30, (k - 50) * 0.8)))), 6) AS probability FROM ev""")
_LOSS = "-(label * ln(score) + (1 - label) * ln(1 - score))"
_SIX = f"""count(*) AS examples, round(avg(label), 6) AS positive_rate, round(avg({_LOSS}), 6) AS log_loss,
  round(avg((score - label) ** 2), 6) AS brier_score,
  round(avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy"""
seq("binary_metrics", f"SELECT run, {_SIX} FROM scored GROUP BY run")
seq("roc_auc", """
SELECT p.run, round(sum(CASE WHEN p.score > q.score THEN p.n * q.n WHEN p.score = q.score THEN p.n * q.n / 2 ELSE 0 END)
  / sum(p.n * q.n), 6) AS roc_auc
FROM (SELECT run, score, CAST(count(*) AS DOUBLE) AS n FROM scored WHERE label = 1 GROUP BY 1, 2) p
JOIN (SELECT run, score, CAST(count(*) AS DOUBLE) AS n FROM scored WHERE label = 0 GROUP BY 1, 2) q ON p.run = q.run GROUP BY p.run""")
seq("one_class_metrics", """
, own AS (SELECT run, score, CASE WHEN run = 1 THEN 1 ELSE label END AS label FROM scored), pairs AS (
  SELECT p.run, sum(CASE WHEN p.score > q.score THEN p.n * q.n WHEN p.score = q.score THEN p.n * q.n / 2 ELSE 0 END) / sum(p.n * q.n) AS auc
  FROM (SELECT run, score, CAST(count(*) AS DOUBLE) AS n FROM own WHERE label = 1 GROUP BY 1, 2) p
  JOIN (SELECT run, score, CAST(count(*) AS DOUBLE) AS n FROM own WHERE label = 0 GROUP BY 1, 2) q ON p.run = q.run GROUP BY p.run)
SELECT r.run, round(auc, 6) AS roc_auc FROM (SELECT DISTINCT run FROM own) r LEFT JOIN pairs USING (run)""")
seq("average_precision", """
, s AS (SELECT score, sum(label) AS pos, count(*) AS n FROM scored GROUP BY 1), c AS (
  SELECT pos, sum(pos) OVER o AS tp, sum(n) OVER o AS seen FROM s WINDOW o AS (ORDER BY score DESC))
SELECT round(sum(pos * tp / seen) / (SELECT sum(label) FROM scored), 6) AS average_precision FROM c""")
seq("calibration", """
SELECT CAST(least(9, floor(score * 10)) AS INTEGER) AS bin, round(avg(score), 6) AS mean_score,
  round(avg(label), 6) AS observed_rate, count(*) AS examples FROM scored GROUP BY 1""")
seq("calibration_error", """
SELECT run, round(sum(n * abs(p - y)) / sum(n), 6) AS calibration_error FROM (
  SELECT run, least(9, floor(score * 10)) AS bin, avg(score) AS p, avg(label) AS y, count(*) AS n FROM scored GROUP BY 1, 2)
GROUP BY run""")
seq("factual_metrics", f"""
, seg AS (SELECT *, 'overall' AS segment FROM scored
  UNION ALL SELECT *, CASE WHEN action = 1 THEN 'switch' ELSE 'stay' END FROM scored
), basic AS (SELECT segment, {_SIX} FROM seg GROUP BY 1
), ties AS (SELECT segment, score, CAST(sum(label) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM seg GROUP BY 1, 2
), runs AS (
  SELECT segment, pos, n - pos AS neg, sum(n - pos) OVER (PARTITION BY segment ORDER BY score) - (n - pos) AS below,
    sum(pos) OVER (PARTITION BY segment ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY segment ORDER BY score DESC) AS seen
  FROM ties
), ranked AS (
  SELECT segment, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc,
    round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision FROM runs GROUP BY 1
), ece AS (
  SELECT segment, round(sum(n * abs(p - y)) / sum(n), 6) AS calibration_error FROM (
    SELECT segment, least(9, floor(score * 10)) AS bin, avg(score) AS p, avg(label) AS y, count(*) AS n FROM seg GROUP BY 1, 2)
  GROUP BY 1)
SELECT * FROM basic JOIN ranked USING (segment) JOIN ece USING (segment)""")
seq("propensity_coverage", """
SELECT 'q' || printf('%.2f', q) AS measure, round(v, 6) AS value FROM (
  SELECT unnest([0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS q,
    unnest(quantile_cont(score, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])) AS v FROM scored)
UNION ALL
SELECT 'within ' || printf('%.2f', lo) || '-' || printf('%.2f', hi), round(avg(CASE WHEN score BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6)
FROM scored, (VALUES (0.05, 0.95), (0.10, 0.90), (0.20, 0.80), (0.40, 0.60)) w(lo, hi) GROUP BY lo, hi""")
seq("overlap_ess", """
, w AS (SELECT action, score, CASE WHEN action = 1 THEN 1 / score ELSE 1 / (1 - score) END AS w FROM scored)
SELECT action, count(*) AS examples, round(min(score), 5) AS lowest, round(avg(score), 5) AS mean_score,
  round(max(score), 5) AS highest, round(min(w), 5) AS lowest_weight, round(max(w), 5) AS highest_weight,
  round(sum(w) ** 2 / sum(w * w), 5) AS effective_size FROM w GROUP BY action""")
_RUNS = f"""
, per_run AS (SELECT action, run, avg({_LOSS}) AS log_loss, avg((score - label) ** 2) AS brier_score,
  avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM scored GROUP BY 1, 2
), lines AS (UNPIVOT per_run ON log_loss, brier_score, accuracy INTO NAME metric VALUE value
), agg AS (SELECT action, metric, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS runs FROM lines GROUP BY 1, 2)"""
seq("run_aggregate", f"{_RUNS} SELECT metric, {_rounds('mean', 'sd')}, runs FROM agg WHERE action = 0")
seq("run_compare", f"""{_RUNS}
SELECT metric, round(a.mean, 6) AS baseline, round(a.sd, 6) AS baseline_sd, round(b.mean, 6) AS candidate,
  round(b.sd, 6) AS candidate_sd, round(b.mean - a.mean, 6) AS difference
FROM (SELECT * FROM agg WHERE action = 0) a JOIN (SELECT * FROM agg WHERE action = 1) b USING (metric)""")
seq("variance_shares", """
, c AS (SELECT var_samp(user_id % 17) AS skill, var_samp(k / 10) AS investment, var_samp(value / 7) AS deck, var_samp(sin(k)) AS counters FROM ev
), l AS (UNPIVOT c ON skill, investment, deck, counters INTO NAME component VALUE variance)
SELECT component, round(variance, 6) AS variance, round(variance / (SELECT sum(variance) FROM l), 6) AS share,
  CASE WHEN component IN ('deck', 'counters') THEN round(variance / (SELECT deck + counters FROM c), 6) END AS deck_share FROM l""")
seq("oof_cover", """
SELECT count(*) FILTER (split = 0) AS training_rows, count(*) FILTER (split = 0) AS scored_once, 0 AS wrong_times,
  0 AS scored_elsewhere FROM placed""")

seq("item_vectors_gram", "SELECT card_i, card_j, round(pmi, 6) + 0.0 AS pmi FROM pmi")
seq("spectrum_energy", "SELECT round(sum(pmi * pmi), 3) AS energy FROM pmi")
seq("switch_score_check", """
SELECT split, count(*) AS rows, count(DISTINCT example_id) AS examples, CAST(sum(next_switch) AS BIGINT) AS switches, 0 AS out_of_range
FROM placed WHERE split <> 0 GROUP BY split""")
seq("oof_score_check", """
SELECT fold, count(*) AS examples, round(avg(next_switch), 6) AS positive_rate, 1 AS sound FROM placed WHERE split = 0 GROUP BY fold""")
seq("uplift_check", "SELECT player_tag, 1 AS sound FROM stepped GROUP BY player_tag HAVING count(*) >= 10")
seq("matchup_check", """
SELECT CASE WHEN place <= floor(0.75 * total) THEN 'train' ELSE 'test' END AS part, count(*) AS contests, count(*) AS distinct_contests,
  0 AS not_additive, 1 AS loss_in_bound
FROM (SELECT row_number() OVER (ORDER BY battle_time, a.tag, b.tag) AS place, count(*) OVER () AS total FROM season) GROUP BY 1""")
seq("matchup_variance_check", "SELECT 4 AS components, 1::DOUBLE AS shares, 1::DOUBLE AS deck_shares")
seq("capacity_ablation_check", """
SELECT head, metric, (SELECT count(*) FROM placed WHERE split <> 0) AS examples, 1 AS sound
FROM (VALUES ('small'), ('large')) h(head), (VALUES ('log_loss'), ('brier_score'), ('accuracy')) m(metric)""")

_PAIRS = """
, played AS (SELECT a.tag AS player, b.tag AS other, a_won AS won FROM season UNION ALL SELECT b.tag, a.tag, 1 - a_won FROM season)"""
seq("skill_balance", f"{_PAIRS} SELECT player, count(*) AS games, CAST(sum(won) AS BIGINT) AS wins, 0::DOUBLE AS short FROM played GROUP BY player")
# The isotonic fit as the largest of the smallest means of runs around a size.
seq("investment_curve", """
, counts AS (
  SELECT abs(d) AS size, count(*) AS n, sum(CASE WHEN d > 0 THEN a_won WHEN d < 0 THEN 1 - a_won ELSE 0.5 END)::DOUBLE AS wins
  FROM (SELECT CAST(list_sum(a.levels) - list_sum(b.levels) AS INTEGER) AS d, a_won FROM season) GROUP BY 1
), run AS (
  SELECT j.size AS lo, k.size AS hi, sum(m.wins + 0.5) / sum(m.n + 1) AS rate
  FROM counts j JOIN counts k ON j.size <= k.size JOIN counts m ON m.size BETWEEN j.size AND k.size WHERE j.size > 0 GROUP BY 1, 2
), least_mean AS (
  SELECT c.size, lo, min(rate) AS rate FROM counts c JOIN run ON c.size BETWEEN lo AND hi GROUP BY 1, 2
), fitted AS (SELECT size, max(rate) AS rate FROM least_mean GROUP BY 1)
SELECT c.size, n, round(wins, 6) AS wins, CASE WHEN c.size = 0 THEN 0 ELSE min(c.size) OVER (PARTITION BY rate) END AS block,
  round(greatest(0.5, coalesce(rate, 0.5)), 6) AS block_rate,
  round(ln(greatest(0.5, coalesce(rate, 0.5)) / (1 - greatest(0.5, coalesce(rate, 0.5)))), 6) AS log_odds
FROM counts c LEFT JOIN fitted f ON c.size = f.size""")
seq("facing_items", """
, met AS (
  SELECT unnest(flatten([[{'i': i, 'j': j} FOR j IN b.cards IF i <> j AND NOT (list_contains(b.cards, i) AND list_contains(a.cards, j))]
    FOR i IN a.cards])) AS p, a_won - 0.5::DOUBLE AS r FROM season
), ends AS (SELECT p.i AS i, p.j AS j, r FROM met UNION ALL SELECT p.j, p.i, -r FROM met)
SELECT i, j, round(0.25 * count(*), 6)::DOUBLE AS n, round(sum(r) / (0.25 * count(*)), 6) AS r FROM ends GROUP BY 1, 2""")
seq("counter_check", "SELECT DISTINCT unnest(a.cards || b.cards) AS card, 1 AS sound FROM season")
seq("key_store", "SELECT strftime(battle_time, '%Y-%m-%d') AS date, count(*) AS contests FROM first_row GROUP BY 1")
sql("season_csv_scan", """
SELECT strftime(day, '%d%m%Y') AS day, count(*) AS battles, CAST(sum(a_won) AS BIGINT) AS a_wins,
  CAST(sum(list_sum(b.levels)) AS BIGINT) AS b_levels, count(b.clan) AS b_clans FROM season GROUP BY 1""")

_PANEL = ORACLES["player_panel"]
ORACLES["bucketed_panel"] = f"""SELECT tag, battles, win_rate, distinct_decks, switch_rate, level_gain, battles AS rows
FROM ({_PANEL}) WHERE battles >= 20"""
seq("head_ablation_check", """
SELECT head, split, count(*) AS examples, round(avg(next_switch), 6) AS positive_rate, 1 AS sound
FROM placed, (VALUES ('summary'), ('history'), ('full')) h(head) WHERE split <> 0 GROUP BY 1, 2""")
ORACLES["permutation_check"] = "SELECT feature, 1 AS known FROM (VALUES " + ", ".join(
    f"('{name}')" for name in SUMMARY_SETS["current_deck_count"]
) + ") f(feature)"
seq("dimension_file", """
SELECT file, rarity, count(*) AS cards, CASE WHEN file = 'cards.parquet' THEN count(*) ELSE 0 END AS named, min(id) AS first
FROM card, (VALUES ('cards.csv'), ('cards.parquet')) f(file) GROUP BY 1, 2""")
