"""Contest tables derived from the driver's parquet tables (mapping in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from contest_panel.operators import orient

FIRST_CARD = 26_000_000
CARD_COUNT = 102
RARITIES = ("common", "rare", "epic", "legendary", "champion")
MODES = {"click": 72000006, "view": 72000201, "purchase": 72000044, "error": 72000006, "signup": 72000099}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with an instant (not zone-less) time and the parsed ``k``."""
    return table(spark, folder, "events").selectExpr(
        "event_id",
        "cast(ts AS timestamp) AS ts",
        "user_id",
        "event_type",
        "value",
        "cast(get_json_object(props, '$.k') AS int) AS k",
    )


def user_tag(user: Column) -> Column:
    return F.concat(F.lit("U"), F.lpad(user.cast("string"), 9, "0"))


def _side_columns(prefix: str) -> dict[str, str]:
    """SQL of the side fields of the event whose raw columns carry ``prefix``."""
    user, k, value, kind = (f"{prefix}{c}" for c in ("user_id", "k", "value", "event_type"))
    base = f"{user} * 7 + CASE WHEN {k} % 4 = 0 THEN 3 + 3 * ({k} % 3) ELSE 0 END"
    cards = f"transform(sequence(0, 7), i -> cast({FIRST_CARD} + ({base} + i) % {CARD_COUNT} AS int))"
    levels = f"transform(sequence(0, 7), i -> cast(1 + ({k} + 3 * i + {user}) % 13 AS int))"
    return {
        "tag": f"concat('U', lpad(cast({user} AS string), 9, '0'))",
        "cards": cards,
        "levels": levels,
        "crowns": f"cast(floor({value}) % 4 AS int)",
        "trophies": f"CASE WHEN {kind} <> 'error' THEN cast(({user} * 97 + {k} * 5) % 8000 AS int) END",
        "king_hp": f"CASE WHEN {k} % 10 <> 0 THEN 1000 + {k} END",
        "clan": f"CASE WHEN {k} % 7 <> 0 THEN concat('C', cast({user} % 20 AS string)) END",
    }


def mode_sql(kind: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{name}' THEN {mode}" for name, mode in MODES.items()) + " END"


def battles(spark: SparkSession, folder: str) -> DataFrame:
    """Even events meet the following odd one: one scan, one shuffle on the pair number, no join."""
    raw = ("ts", "user_id", "event_type", "value", "k")
    pair = Window.partitionBy("bid").orderBy("event_id")
    partner = F.lead(F.struct(*raw)).over(pair)
    placed = events(spark, folder).withColumn("bid", F.expr("event_id DIV 2")).withColumn("w", partner)
    pairs = placed.filter("event_id % 2 = 0 AND w IS NOT NULL AND user_id <> w.user_id").selectExpr(
        "bid", *[f"{c} AS h_{c}" for c in raw], *[f"w.{c} AS w_{c}" for c in raw]
    )
    sides = [
        f"{expr} AS {side}_{name}"
        for side, prefix in (("home", "h_"), ("away", "w_"))
        for name, expr in _side_columns(prefix).items()
    ]
    return pairs.selectExpr(
        "bid",
        "h_ts AS battle_time",
        "date_trunc('week', h_ts) + INTERVAL 7 DAYS AS collected_at",
        "to_date(h_ts) AS day",
        "h_event_type AS type",
        f"{mode_sql('h_event_type')} AS game_mode",
        *sides,
    )


def _player(side: str) -> str:
    """SQL of one player of a raw contest, in the nested layout of the source logs."""
    card = f"(c, i) -> named_struct('id', c, 'level', {side}_levels[i], 'evolutionLevel', CASE WHEN i < 2 THEN 1 END)"
    return f"""array(named_struct(
        'tag', {side}_tag,
        'name', concat('name-', {side}_tag),
        'clan', CASE WHEN {side}_clan IS NOT NULL THEN named_struct('tag', {side}_clan) END,
        'crowns', {side}_crowns,
        'kingTowerHitPoints', {side}_king_hp,
        'princessTowersHitPoints', array({side}_crowns * 100, {side}_crowns * 50),
        'startingTrophies', {side}_trophies,
        'trophyChange', {side}_crowns * 10 - 15,
        'globalRank', cast(NULL AS int),
        'elixirLeaked', cast({side}_crowns * 0.5D AS double),
        'cards', transform({side}_cards, {card}),
        'supportCards', array(named_struct('id', 159000000 + {side}_crowns))))"""


def raw_log(spark: SparkSession, folder: str) -> DataFrame:
    """The live log: every contest twice, once from each participant's page."""
    base = battles(spark, folder).selectExpr(
        "date_format(battle_time, \"yyyyMMdd'T'HHmmss.SSS'Z'\") AS battleTime",
        "type",
        "named_struct('name', cast(game_mode AS string)) AS gameMode",
        "named_struct('name', 'arena') AS arena",
        "'collection' AS deckSelection",
        "false AS isLadderTournament",
        "false AS isHostedMatch",
        "cast(NULL AS int) AS leagueNumber",
        "cast(NULL AS string) AS eventTag",
        "collected_at",
        f"{_player('home')} AS home",
        f"{_player('away')} AS away",
    )
    pages = """inline(array(
        named_struct('team', home, 'opponent', away, 'suffix', '-a'),
        named_struct('team', away, 'opponent', home, 'suffix', '-b')))"""
    kept = [c for c in base.columns if c not in ("home", "away")]
    return base.selectExpr(*kept, pages).selectExpr(
        *kept, "team", "opponent", "concat(date_format(collected_at, 'yyyyMMdd'), suffix) AS run_id"
    )


def raw_json(spark: SparkSession, folder: str) -> DataFrame:
    """The live log as JSON text with its collection stamp."""
    log = raw_log(spark, folder)
    body = [c for c in log.columns if c not in ("collected_at", "run_id")]
    return log.select(F.to_json(F.struct(*body)).alias("value"), "collected_at", "run_id")


def parsed_log(spark: SparkSession, folder: str) -> DataFrame:
    """The parsed live log, both copies of every contest, partition column ``date`` included."""
    return orient.parse_battles(raw_log(spark, folder)).withColumn("date", F.to_date("battle_time"))


def season_source(spark: SparkSession, folder: str) -> DataFrame:
    """Decided contests in winner/loser layout; ``day`` stands for the daily source file."""
    columns = []
    for field in orient.SEASON_FIELDS:
        home, away = f"home_{field}", f"away_{field}"
        if field == "trophies":
            home, away = f"coalesce({home}, 0)", f"coalesce({away}, 0)"
        columns.append(f"CASE WHEN home_crowns > away_crowns THEN {home} ELSE {away} END AS winner_{field}")
        columns.append(f"CASE WHEN home_crowns > away_crowns THEN {away} ELSE {home} END AS loser_{field}")
    return battles(spark, folder).filter("home_crowns <> away_crowns").selectExpr(
        "day",
        "date_format(battle_time, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS battleTime",
        "game_mode",
        "54000000 AS arena",
        *columns,
    )


def season_csv(spark: SparkSession, folder: str, path: str) -> None:
    """The season source as wide CSV files under ``path``, a folder ``day=ddMMyyyy`` for each day.

    Days of even numbers have their columns in reverse order, and a card list lies beside the battles.
    """
    source = season_source(spark, folder)
    wide = [F.col("battleTime"), F.col("game_mode").alias("gameMode.id"), F.col("arena").alias("arena.id")]
    for side in ("winner", "loser"):
        for part, name in (("id", "cards"), ("level", "levels")):
            wide += [F.get(f"{side}_{name}", F.lit(n - 1)).alias(f"{side}.card{n}.{part}") for n in range(1, 9)]
        scalars = {"tag": "tag", "startingTrophies": "trophies", "crowns": "crowns", "kingTowerHitPoints": "king_hp", "clan.tag": "clan"}
        wide += [F.col(f"{side}_{name}").alias(f"{side}.{scalar}") for scalar, name in scalars.items()]
    day = F.date_format("day", "ddMMyyyy").alias("day")
    for odd, columns in ((1, wide), (0, wide[::-1])):
        rows = source.filter(F.dayofmonth("day") % 2 == odd).select(day, *columns)
        rows.write.mode("append").option("header", True).partitionBy("day").csv(path)
    card_dimension(spark).coalesce(1).write.option("header", True).csv(f"{path}/cards")


def season(spark: SparkSession, folder: str) -> DataFrame:
    return orient.canonicalise_season(season_source(spark, folder))


def card_dimension(spark: SparkSession, complete: bool = True) -> DataFrame:
    """Card ids and rarities; the incomplete copy misses two cards."""
    names = ", ".join(f"'{r}'" for r in RARITIES)
    cards = spark.range(FIRST_CARD, FIRST_CARD + CARD_COUNT).selectExpr(
        "cast(id AS int) AS id", f"array({names})[cast(id % 5 AS int)] AS rarity"
    )
    return cards if complete else cards.filter("id % 51 <> 50")


def cohort_state(spark: SparkSession, folder: str) -> DataFrame:
    """One row per user with polling counters derived from the events."""
    per_user = events(spark, folder).groupBy("user_id").agg(
        F.max("ts").alias("last"), F.expr("count(*) AS n"), F.expr("count_if(event_type = 'error') AS bad")
    )
    return per_user.selectExpr(
        "concat('U', lpad(cast(user_id AS string), 9, '0')) AS tag",
        "CASE WHEN user_id % 5 <> 0 THEN last END AS last_polled",
        "CASE WHEN user_id % 5 = 0 THEN 0L ELSE n END AS n_polls",
        "n * 2 AS n_battles",
        "bad AS n_fail",
    )


def scored_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a score, a label and an observed action, for the metric operators."""
    return events(spark, folder).selectExpr(
        "event_id",
        "cast(user_id % 3 AS int) AS run",
        "(k + 1) / 101.0D AS score",
        "cast(event_type IN ('purchase', 'click') AS int) AS label",
        "cast(k % 4 = 0 AS int) AS action",
    )
