"""From raw contests to oriented rows: parsing, canonical sides, fair coin, melting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from contest_panel.functions.decks import DECK_SIZE, deck_total, is_full_deck
from contest_panel.functions.scalars import (
    LADDER_MODES,
    battle_timestamp,
    contest_key,
    fair_coin,
    minute_of,
)

# A destroyed tower has no hit points, a player without a clan an empty tag.
_DOCUMENTED_NULLS = {"king_hp": "0", "clan": "''"}
SEASON_FIELDS = ("cards", "levels", "trophies", "crowns", "king_hp", "tag", "clan")


def _side(players: str, cards: str) -> dict[str, str]:
    """SQL of one flattened side: items of every player (already in ``cards``), scalars of the first."""
    lead = f"{players}[0]"
    return {
        "tag": f"{lead}.tag",
        "name": f"{lead}.name",
        "clan": f"{lead}.clan.tag",
        "crowns": f"{lead}.crowns",
        "king_hp": f"{lead}.kingTowerHitPoints",
        "princess_hp": f"coalesce({lead}.princessTowersHitPoints, array())",
        "trophies": f"{lead}.startingTrophies",
        "trophy_change": f"{lead}.trophyChange",
        "global_rank": f"{lead}.globalRank",
        "elixir_leaked": f"{lead}.elixirLeaked",
        "card_ids": f"{cards}.id",
        "card_levels": f"{cards}.level",
        "card_evo": f"transform({cards}.evolutionLevel, e -> coalesce(e, 0))",
        "support_ids": f"{_joined(players, 'supportCards')}.id",
        "team_size": f"size({players})",
        "n_cards": f"size({cards})",
    }


def _joined(players: str, field: str) -> str:
    """SQL of one array over all players of a side."""
    return f"flatten(filter({players}.{field}, x -> x IS NOT NULL))"


def _routed(first: str, field: str, left: str, right: str) -> list[str]:
    """SQL of ``a_field`` and ``b_field``: left/right when ``first`` holds, swapped otherwise."""
    return [
        f"CASE WHEN {first} THEN {left} ELSE {right} END AS a_{field}",
        f"CASE WHEN {first} THEN {right} ELSE {left} END AS b_{field}",
    ]


#: Condition for two identified sides; other rows can't be parsed.
IDENTIFIED = (
    "size(team) > 0 AND size(opponent) > 0 AND coalesce(team[0].tag, '') <> '' AND coalesce(opponent[0].tag, '') <> ''"
)


def parse_battles(raw: DataFrame) -> DataFrame:
    """Nested contests (``team`` / ``opponent`` arrays) to one flat row each.

    Side A is the lexicographically smaller tag. Rows without two identified sides are dropped;
    everything else is kept and flagged by ``is_clean_1v1``. Needs ``collected_at`` and ``run_id``.
    """
    # Orient the two nested sides once, then flatten only the oriented ones.
    oriented = raw.filter(IDENTIFIED).selectExpr(
        "battleTime", "collected_at", "run_id", "type", "gameMode", "arena", "deckSelection",
        "isLadderTournament", "isHostedMatch", "leagueNumber", "eventTag",
        "CASE WHEN team[0].tag <= opponent[0].tag THEN team ELSE opponent END AS __a",
        "CASE WHEN team[0].tag <= opponent[0].tag THEN opponent ELSE team END AS __b",
    ).selectExpr("*", f"{_joined('__a', 'cards')} AS __ac", f"{_joined('__b', 'cards')} AS __bc")
    flat = oriented.select(
        contest_key("battleTime", F.col("__a"), F.col("__b")).alias("battle_key"),
        battle_timestamp("battleTime").alias("battle_time"),
        "collected_at",
        "run_id",
        "type",
        *[
            F.expr(text)
            for text in (
                "gameMode.name AS game_mode", "arena.name AS arena", "deckSelection AS deck_selection",
                "isLadderTournament AS is_ladder_tournament", "isHostedMatch AS is_hosted_match",
                "leagueNumber AS league_number", "eventTag AS event_tag",
            )
        ],
        *[F.expr(f"{expr} AS a_{field}") for field, expr in _side("__a", "__ac").items()],
        *[F.expr(f"{expr} AS b_{field}") for field, expr in _side("__b", "__bc").items()],
    )
    return with_outcome(flat)


def with_outcome(flat: DataFrame) -> DataFrame:
    """Add ``winner``, ``label_a_win`` and ``is_clean_1v1`` to parsed rows."""
    return flat.selectExpr(
        "*",
        "CASE WHEN a_crowns > b_crowns THEN 'a' WHEN b_crowns > a_crowns THEN 'b' WHEN a_crowns = b_crowns THEN 'tie' END"
        " AS winner",
        "CASE WHEN a_crowns > b_crowns THEN 1 WHEN b_crowns > a_crowns THEN 0 END AS label_a_win",
        f"a_team_size = 1 AND b_team_size = 1 AND a_n_cards = {DECK_SIZE} AND b_n_cards = {DECK_SIZE}"
        " AND coalesce(a_crowns <> b_crowns, false) AS is_clean_1v1",
    )


def season_essentials() -> list[str]:
    """Source columns without which a season row is dropped."""
    return ["battleTime", "game_mode", "arena"] + [
        f"{side}_{f}" for side in ("winner", "loser") for f in SEASON_FIELDS if f not in ("king_hp", "clan")
    ]


def canonicalise_season(source: DataFrame) -> DataFrame:
    """Winner/loser source rows to canonical battles (side A = smaller tag).

    Source columns: ``battleTime``, ``game_mode``, ``arena`` and ``winner_*`` / ``loser_*`` for every
    season field. Rows with a missing essential field are dropped (a deck with a missing card or level
    is a NULL array); destroyed towers and absent clans get their documented values.
    """
    # Plain null tests, so Catalyst reduces each one to the scan column behind it.
    kept = source.filter(" AND ".join(f"{column} IS NOT NULL" for column in season_essentials()))
    columns = []
    for field in SEASON_FIELDS:
        winner, loser = f"winner_{field}", f"loser_{field}"
        if field in _DOCUMENTED_NULLS:
            default = _DOCUMENTED_NULLS[field]
            winner, loser = f"coalesce({winner}, {default})", f"coalesce({loser}, {default})"
        columns += _routed("winner_tag < loser_tag", field, winner, loser)
    carried = [c for c in ("day",) if c in source.columns]
    return kept.selectExpr(
        *carried,
        "try_cast(battleTime AS timestamp) AS battle_time",
        "game_mode",
        "arena",
        "cast(winner_tag < loser_tag AS int) AS a_won",
        *columns,
    )


def coin_for(seed: int | str) -> Column:
    """The coin of a canonical season battle: keyed by instant and both tags."""
    return fair_coin(seed, F.unix_micros("battle_time"), "a_tag", "b_tag")


def neutral_sides(battles: DataFrame, seed: int | str = 0) -> DataFrame:
    """Swap sides of each battle by a reproducible fair coin."""
    swapped = [f for f in SEASON_FIELDS if f"a_{f}" in battles.columns and f"b_{f}" in battles.columns]
    others = [c for c in battles.columns if c != "a_won" and c[2:] not in swapped]
    columns = [text for f in swapped for text in _routed("NOT __flip", f, f"a_{f}", f"b_{f}")]
    return battles.withColumn("__flip", coin_for(seed)).selectExpr(
        *others, "CASE WHEN __flip THEN 1 - a_won ELSE a_won END AS a_won", *columns
    )


def ladder_only(battles: DataFrame, modes: Sequence[int] = LADDER_MODES) -> DataFrame:
    return battles.filter(F.col("game_mode").isin(*modes))


def melt_sides(battles: DataFrame) -> DataFrame:
    """Season battles to one row per participant; one scan, no union, no shuffle."""

    def view(side: str, won: str) -> str:
        return (
            f"named_struct('tag', {side}_tag, 'deck', sort_array({side}_cards), "
            f"'total_level', {deck_total(f'{side}_levels')}, 'trophies', {side}_trophies, 'won', {won})"
        )

    # The opponent pair makes the order of a participant's battles total.
    return battles.select(
        "battle_time",
        minute_of("battle_time").alias("minute"),
        F.concat_ws("|", "a_tag", "b_tag").alias("pairing"),
        F.expr(f"inline(array({view('a', 'a_won')}, {view('b', '1 - a_won')}))"),
    )


#: Columns of parsed contests behind focal rows and the choice of a contest's first clean copy.
FOCAL_SOURCE = (
    "battle_key", "battle_time", "collected_at", "run_id", "is_clean_1v1", "label_a_win",
    *(f"{side}_{field}" for side in "ab" for field in ("tag", "card_ids", "card_levels", "crowns", "trophies")),
)


def focal_rows(parsed: DataFrame) -> DataFrame:
    """Clean, labelled contests to one row per participant, seen from that participant.

    Input must hold each ``battle_key`` once. Decks come sorted with levels aligned; a missing trophy
    count stays NULL. A side whose deck is not eight distinct items is left out, its opponent's row stays;
    ``focal_violations`` names what is left out.
    """
    return _focal_sides(parsed).filter(is_full_deck("deck"))


def focal_violations(parsed: DataFrame) -> DataFrame:
    """Sides of clean, labelled contests without a focal row: battle_key, player_tag, problem."""
    return _focal_sides(parsed).filter(~is_full_deck("deck")).selectExpr("battle_key", "player_tag", "'incomplete deck' AS problem")


def _focal_sides(parsed: DataFrame) -> DataFrame:
    """Both sides of every clean, labelled contest."""

    def view(own: str, other: str, won: int) -> str:
        return (
            f"named_struct('player_tag', {own}_tag, 'pairs', sort_array(transform({own}_card_ids, "
            f"(c, i) -> named_struct('card', c, 'level', {own}_card_levels[i]))), "
            f"'result', CASE WHEN label_a_win = {won} THEN 1 ELSE -1 END, "
            f"'crown_difference', {own}_crowns - {other}_crowns, 'trophies', cast({own}_trophies AS double))"
        )

    usable = parsed.filter("is_clean_1v1 AND label_a_win IS NOT NULL")
    return usable.selectExpr(
        "battle_key", "battle_time", "collected_at", f"inline(array({view('a', 'b', 1)}, {view('b', 'a', 0)}))"
    ).selectExpr(
        "battle_key", "battle_time", "collected_at", "player_tag", "pairs.card AS deck", "pairs.level AS levels",
        "result", "crown_difference", "trophies",
    )
