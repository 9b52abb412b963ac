"""Registered queries: every operator of the library on the contest tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contest_panel.functions import decks, scalars
from contest_panel.operators import (
    assign,
    cohort,
    curves,
    dedup,
    dimension,
    itemspace,
    metrics,
    orient,
    paired,
    panel,
    quality,
    ranking,
    scaling,
    sequences,
)
from contest_panel.plans import dataset, fixtures as fx, matchup, models
from contest_panel.session import checkpoint_folder, materialise, stored
from contest_panel.sources import season, season_scan as season_scan_files
from contest_panel.sources.buckets import store_by
from contest_panel.sources.keystore import KeyStore
from contest_panel.sources.live import LIVE_COLUMNS, parse_json_log
from contest_panel.sources.season import conversion_report as season_report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_MATCHUPS: dict[tuple[str, str], DataFrame] = {}

# Thresholds of the source study scaled to the contest tables.
MIN_BATTLES = 20
MIN_CELL = 5


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def text(values: str | Column) -> Column:
    return F.array_join(scalars.as_column(values), ",")


def micros(ts: str | Column) -> Column:
    return F.unix_micros(scalars.as_column(ts))


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double so sums in different orders compare equal."""
    return frame.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes]
    )


def counted(spark: SparkSession, folder: str) -> DataFrame:
    return curves.level_counts(fx.season(spark, folder))


# --- scans and orientation -------------------------------------------------------------------


@query
def season_scan(spark, folder):
    """The needed source columns, nothing else."""
    source = fx.season_source(spark, folder)
    return source.select(
        "battleTime", "game_mode", "winner_tag", "loser_tag", "winner_trophies", "loser_trophies",
        "winner_king_hp", "loser_clan", text("winner_cards").alias("winner_cards"), text("loser_levels").alias("loser_levels"),
    )


def _last_day(battles: DataFrame) -> Column:
    """The final day: one bounded value read ahead, so the filter prunes days at the scan."""
    return F.lit(battles.agg(F.max("day")).first()[0])


@query
def day_exclusion(spark, folder):
    battles = fx.season(spark, folder)
    kept = battles.filter(F.col("day") != _last_day(fx.battles(spark, folder)))
    return kept.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("battles"))


@query
def season_files(spark, folder):
    """CSV files to Parquet, converted twice, read back without the 1st, 11th, 21st and 31st."""
    base = f"{checkpoint_folder(spark)}/season-{uuid.uuid4().hex}"
    fx.season_csv(spark, folder, f"{base}/csv")
    for _ in range(2):
        source = season.read_source(spark, f"{base}/csv", r"day=\d{8}/[^/]+\.csv$", r"day=(\d{8})/")
        season.convert(source, f"{base}/parquet")
    days = season.read_days(spark, f"{base}/parquet", exclude=["1012024"])
    return days.groupBy("day").agg(
        F.count(F.lit(1)).alias("battles"), F.sum("a_won").cast("long").alias("a_wins"), F.sum(decks.total_of("b_levels")).alias("b_levels")
    )


@query
def season_csv_scan(spark, folder):
    """CSV files of two column orders through the data source that reads headers in its tasks."""
    base = f"{checkpoint_folder(spark)}/season-{uuid.uuid4().hex}"
    fx.season_csv(spark, folder, f"{base}/csv")
    source = season_scan_files.scan_source(spark, f"{base}/csv", r"day=\d{8}/[^/]+\.csv$", r"day=(\d{8})/")
    return orient.canonicalise_season(source).groupBy("day").agg(
        F.count(F.lit(1)).alias("battles"), F.sum("a_won").cast("long").alias("a_wins"), F.sum(decks.total_of("b_levels")).alias("b_levels"),
        F.count_if(F.col("b_clan") != "").alias("b_clans"),
    )


@query
def season_neutral(spark, folder):
    battles = fx.season(spark, folder)
    kept = battles.filter(F.col("day") != _last_day(fx.battles(spark, folder)))
    return orient.neutral_sides(kept, seed=0).select(micros("battle_time").alias("at"), "a_tag", "b_tag", "a_won", "a_trophies")


@query
def conversion_report(spark, folder):
    """Rows read and written and side-A win rate per day, in one pass over the source."""
    source = fx.season_source(spark, folder)
    return rounded(season_report(source).withColumn("day", F.date_format("day", "yyyy-MM-dd")))


@query
def key_store(spark, folder):
    """The live log in three batches through a key store: new contests by day, whatever batch brought them first."""
    log = materialise(fx.parsed_log(spark, folder).select("battle_key", "date", "run_id", "collected_at"))
    base = f"{checkpoint_folder(spark)}/keys-{uuid.uuid4().hex}"
    store, kept = KeyStore(spark, base, prefixes=8), None
    for number in range(3):
        batch = log.filter(F.crc32(F.concat("battle_key", "run_id").cast("binary")) % 3 == number)
        fresh = stored(store.new_rows(dedup.first_per_key(batch), "battle_key"))
        store.add(str(number), fresh, "battle_key")
        kept = fresh if kept is None else kept.unionByName(fresh)
    return kept.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("contests"))


@query
def live_scan(spark, folder):
    rows = fx.parsed_log(spark, folder).select(*LIVE_COLUMNS, "date")
    return rows.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("is_clean_1v1").alias("clean"),
        F.sum(decks.total_of("a_card_levels")).alias("a_levels"),
        F.count("b_trophies").alias("b_trophies_known"),
    )


@query
def live_load(spark, folder):
    """First row per key, clean rows only, in that order."""
    kept = dedup.dedup_then_clean(fx.parsed_log(spark, folder), clean_only=True)
    return kept.select("battle_key", "run_id", "winner", "label_a_win", "a_crowns", "b_crowns")


@query
def parse_battle(spark, folder):
    parsed = parse_json_log(fx.raw_json(spark, folder))
    return parsed.select(
        "battle_key", micros("battle_time").alias("at"), "run_id", "type", "game_mode", "arena", "deck_selection",
        "winner", "label_a_win", F.col("is_clean_1v1").cast("int").alias("clean"),
        "a_tag", "a_name", "a_clan", "a_crowns", "a_king_hp", "a_trophies", "a_trophy_change", "a_elixir_leaked",
        "b_tag", "b_clan", "b_king_hp", "a_team_size", "b_n_cards",
        text("a_card_ids").alias("a_card_ids"), text("b_card_levels").alias("b_card_levels"),
        text("a_card_evo").alias("a_card_evo"), text("b_support_ids").alias("b_support_ids"),
        text("a_princess_hp").alias("a_princess_hp"),
    )


@query
def battle_key(spark, folder):
    """Both copies of a contest share one key."""
    log = fx.raw_log(spark, folder)
    keyed = log.select(scalars.contest_key("battleTime", F.col("team"), F.col("opponent")).alias("battle_key"), "run_id")
    return keyed.groupBy("battle_key").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("run_id").alias("runs"))


@query
def parse_time(spark, folder):
    """Raw times, some damaged, to instants; damaged ones become NULL."""
    raw = fx.events(spark, folder).select(
        "event_id",
        F.when(F.col("k") % 9 == 0, F.concat(F.lit("x"), F.date_format("ts", "yyyyMMdd")))
        .when(F.col("k") % 11 == 0, F.lit(None))
        .otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss.SSS'Z'"))
        .alias("raw"),
    )
    return raw.select("event_id", micros(scalars.battle_timestamp("raw")).alias("at"))


@query
def canonical_live(spark, folder):
    """Orientation of the live log: the smaller tag is side A whatever page a contest came from."""
    return fx.parsed_log(spark, folder).groupBy("a_tag", "b_tag").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("label_a_win") == 1).alias("a_wins"),
        F.count_if(F.col("winner") == "tie").alias("ties"),
    )


@query
def canonical_season(spark, folder):
    battles = fx.season(spark, folder)
    return battles.select(
        micros("battle_time").alias("at"), "game_mode", "arena", "a_won", "a_tag", "b_tag", "a_trophies", "b_trophies",
        "a_crowns", "b_crowns", "a_king_hp", "b_king_hp", "a_clan", "b_clan",
        text("a_cards").alias("a_cards"), text("b_levels").alias("b_levels"),
    )


@query
def neutral_sides(spark, folder):
    swapped = orient.neutral_sides(fx.season(spark, folder), seed=7)
    return swapped.select(
        micros("battle_time").alias("at"), "a_won", "a_tag", "b_tag", "a_trophies", "b_king_hp", text("a_cards").alias("a_cards")
    )


@query
def melt_sides(spark, folder):
    rows = orient.melt_sides(orient.ladder_only(fx.season(spark, folder)))
    return rows.select("tag", "minute", "pairing", "total_level", "trophies", "won", text("deck").alias("deck"))


def clean_focal(spark: SparkSession, folder: str) -> DataFrame:
    """Focal rows of every clean contest of the live log."""
    return orient.focal_rows(dedup.clean_first(fx.parsed_log(spark, folder)))


@query
def focal_rows(spark, folder):
    return clean_focal(spark, folder).select(
        "battle_key", "player_tag", "result", "crown_difference", "trophies", micros("collected_at").alias("collected"),
        text("deck").alias("deck"), text("levels").alias("levels"),
    )


def planted_decks(spark: SparkSession, folder: str) -> DataFrame:
    """Clean contests where every fifth king tower value of side A comes with a repeated card."""
    rows = dedup.clean_first(fx.parsed_log(spark, folder))
    repeated = F.concat(F.slice("a_card_ids", 1, 7), F.slice("a_card_ids", 1, 1))
    return rows.withColumn("a_card_ids", F.when(F.col("a_king_hp") % 5 == 0, repeated).otherwise(F.col("a_card_ids")))


@query
def focal_rows_planted(spark, folder):
    """A bad deck costs its own side's row only."""
    return orient.focal_rows(planted_decks(spark, folder)).select("battle_key", "player_tag", "result")


@query
def focal_violations(spark, folder):
    return orient.focal_violations(planted_decks(spark, folder))


@query
def norm_tag(spark, folder):
    raw = fx.events(spark, folder).select(
        "event_id",
        F.concat(
            F.lit("  "), F.when(F.col("k") % 2 == 0, F.lit("#")).otherwise(F.lit("")),
            F.lower(fx.user_tag(F.col("user_id"))), F.lit(" "),
        ).alias("raw"),
    )
    return raw.select("event_id", scalars.normalised_tag("raw").alias("tag"))


# --- dedup and maintenance joins --------------------------------------------------------------


def _narrow(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The parsed log with what dedup orders by and the columns asked for."""
    return fx.parsed_log(spark, folder).select("battle_key", "collected_at", "run_id", *columns)


@query
def dedup_first(spark, folder):
    return dedup.first_per_key(_narrow(spark, folder, "a_tag", "b_tag", "winner")).drop("collected_at")


@query
def dedup_clean(spark, folder):
    rows = dedup.clean_first(_narrow(spark, folder, "label_a_win", "is_clean_1v1"))
    return rows.select("battle_key", "run_id", "label_a_win")


@query
def dedup_last(spark, folder):
    return dedup.last_per_key(_narrow(spark, folder, "winner")).drop("collected_at")


@query
def dedup_entity(spark, folder):
    members = fx.events(spark, folder).select(
        fx.user_tag(F.col("user_id")).alias("tag"), "ts", "event_id", "event_type"
    )
    return dedup.first_per_key(members, ["tag"], ["ts", "event_id"]).select("tag", "event_id", "event_type")


@query
def incremental_new(spark, folder):
    """The later run's rows that the earlier contests do not already hold."""
    log = _narrow(spark, folder, "a_crowns")
    stored = log.filter(F.col("run_id").endswith("-a") & (F.col("a_crowns") % 2 == 0))
    batch = log.filter(F.col("run_id").endswith("-b"))
    return dedup.new_rows(batch, stored).select("battle_key", "run_id", "a_crowns")


@query
def eligible_players(spark, folder):
    return dedup.eligible_entities(_clean_sides(spark, folder))


def _clean_sides(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.clean_first(_narrow(spark, folder, "a_tag", "b_tag", "label_a_win", "is_clean_1v1"))


@query
def eligible_rows(spark, folder):
    clean = dedup.clean_first(fx.parsed_log(spark, folder))
    kept = dedup.rows_of_eligible(orient.focal_rows(clean), dedup.eligible_entities(clean, 60))
    return kept.select("player_tag", "battle_key", "result")


def _members(spark, folder):
    customer = fx.table(spark, folder, "customer")
    return customer.select(
        F.concat(F.lit("M"), F.col("c_custkey").cast("string")).alias("tag"),
        F.col("c_name").alias("name"),
        F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0))).cast("bigint").alias("trophies"),
        F.col("c_mktsegment").alias("segment"),
    )


@query
def cohort_merge(spark, folder):
    """New members join the cohort; those present keep their row."""
    everyone = _members(spark, folder)
    existing = everyone.filter("segment = 'BUILDING'").select("tag", "name", "trophies")
    incoming = everyone.select("tag", F.upper("name").alias("name"), (F.col("trophies") + 1).alias("trophies"))
    return dedup.merge_new_members(existing, incoming)


@query
def cohort_upsert_repeated(spark, folder):
    """Several polls of a member in one pass, some failed, are combined."""
    cohort = fx.cohort_state(spark, folder)
    polls = fx.events(spark, folder).filter("event_type <> 'signup' AND user_id % 3 <> 0").select(
        fx.user_tag(F.col("user_id")).alias("tag"),
        F.when(F.col("event_type") != "error", F.col("ts")).alias("polled_at"),
        F.col("k").cast("long").alias("kept"),
    )
    return dedup.upsert_poll_state(cohort, polls).withColumn("last_polled", micros("last_polled"))


@query
def cohort_upsert(spark, folder):
    cohort = fx.cohort_state(spark, folder)
    polls = fx.events(spark, folder).filter("event_type <> 'signup'").groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("polled_at"), F.count(F.lit(1)).alias("kept")
    ).filter("user_id % 3 <> 0").select(fx.user_tag(F.col("user_id")).alias("tag"), "polled_at", "kept")
    updated = dedup.upsert_poll_state(cohort, polls)
    return updated.withColumn("last_polled", micros("last_polled"))


# --- curves and profiles ----------------------------------------------------------------------


@query
def level_counts(spark, folder):
    return counted(spark, folder)


@query
def raw_curve(spark, folder):
    return rounded(curves.raw_curve(counted(spark, folder), MIN_BATTLES))


@query
def standardised_curve(spark, folder):
    return rounded(curves.standardised_curve(counted(spark, folder), MIN_BATTLES, MIN_CELL))


@query
def curve_report(spark, folder):
    return rounded(curves.curve_report(counted(spark, folder), MIN_BATTLES, MIN_CELL))


@query
def level_histogram(spark, folder):
    return curves.level_histogram(fx.season(spark, folder), fx.card_dimension(spark))


@query
def conditioning_cells(spark, folder):
    return curves.conditioning_cells(fx.season(spark, folder))


@query
def difference_histogram(spark, folder):
    return curves.difference_histogram(fx.season(spark, folder))


# --- panel and audits -------------------------------------------------------------------------


def melted_ladder(spark: SparkSession, folder: str) -> DataFrame:
    return orient.melt_sides(orient.ladder_only(fx.season(spark, folder)))


@query
def transitions(spark, folder):
    rows = panel.transitions(melted_ladder(spark, folder))
    return rounded(rows.select("tag", micros("battle_time").alias("at"), "pairing", "follows", "switched", "previous_won", "drift"))


@query
def switch_drift(spark, folder):
    """Cards shared with the previous deck and the drift of each switch."""
    rows = panel.transitions(melted_ladder(spark, folder)).filter("switched")
    shared = decks.shared_items("deck", "previous_deck").alias("shared")
    return rounded(rows.select("tag", micros("battle_time").alias("at"), "pairing", shared, "drift"))


@query
def player_panel(spark, folder):
    return rounded(panel.player_panel(melted_ladder(spark, folder)))


@query
def bucketed_panel(spark, folder):
    """The panel and the eligible participants from one table stored by participant: neither shuffles, their join doesn't either."""
    rows = store_by(melted_ladder(spark, folder), ["tag"], ["battle_time", "pairing"], buckets=8)
    eligible = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= MIN_BATTLES)
    found = panel.player_panel(rows).hint("merge").join(eligible, "tag")
    return rounded(found.select("tag", "battles", "win_rate", "distinct_decks", "switch_rate", "level_gain", "rows"))


@query
def panel_summary(spark, folder):
    return rounded(panel.panel_summary(materialise(panel.player_panel(melted_ladder(spark, folder)))))


@query
def day_summary(spark, folder):
    days = panel.day_summary(fx.season(spark, folder))
    return days.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "battles",
        micros("first_battle").alias("first_battle"), micros("last_battle").alias("last_battle"),
    )


@query
def duplicate_audit(spark, folder):
    """Every third contest of the season is planted twice."""
    season = fx.season(spark, folder)
    return panel.duplicate_audit(season.unionByName(season.filter("a_trophies % 3 = 0")))


@query
def activity_thresholds(spark, folder):
    return rounded(panel.activity_thresholds(fx.season(spark, folder)))


@query
def period_compare(spark, folder):
    last = _last_day(fx.battles(spark, folder))
    return rounded(panel.period_compare(fx.season(spark, folder), F.col("day") == last))


# --- items ------------------------------------------------------------------------------------


@query
def displayed_levels(spark, folder):
    rows = dimension.displayed_levels(clean_focal(spark, folder), fx.card_dimension(spark))
    return rows.select("battle_key", "player_tag", text("displayed").alias("displayed"))


@query
def displayed_levels_incomplete(spark, folder):
    """Two cards are missing from the dimension: their places are NULL and counted, never made up."""
    rows = dimension.displayed_levels(clean_focal(spark, folder), fx.card_dimension(spark, complete=False))
    shown = F.array_join("displayed", ",", "?").alias("displayed")
    return rows.select("battle_key", "player_tag", shown, F.expr("size(filter(displayed, x -> x IS NULL))").alias("unknown"))


@query
def vocab_encode(spark, folder):
    """Indices against the incomplete dimension: unseen cards become 0."""
    words = dimension.vocabulary(fx.card_dimension(spark, complete=False))
    rows = dimension.encode(clean_focal(spark, folder), "deck", words, "idx")
    return rows.select("battle_key", "player_tag", text("idx").alias("idx"))


@query
def entity_index(spark, folder):
    """Contiguous 0-based index of every participant by sorted tag."""
    tags = fx.season(spark, folder).selectExpr("explode(array(a_tag, b_tag)) AS tag").distinct()
    return ranking.global_rank(tags, ["tag"], "idx").selectExpr("tag", "idx - 1 AS idx")


@query
def deck_key(spark, folder):
    """Distinct packed deck keys with their use."""
    words = dimension.vocabulary(fx.card_dimension(spark))
    decks_seen = melted_ladder(spark, folder).groupBy("deck").agg(F.count(F.lit(1)).alias("uses"))
    packed = dimension.encode(decks_seen, "deck", words, "idx")
    return packed.select(decks.packed_deck("idx").alias("deck_key"), text("deck").alias("deck"), "uses")


@query
def jaccard(spark, folder):
    """Distance between the two decks of every contest."""
    rows = fx.season(spark, folder)
    return rounded(
        rows.select(micros("battle_time").alias("at"), "a_tag", "b_tag", decks.jaccard_distance("a_cards", "b_cards").alias("distance"))
    )


@query
def item_universe(spark, folder):
    return itemspace.item_universe(fx.season(spark, folder))


@query
def cooccurrence(spark, folder):
    return itemspace.cooccurrence(fx.season(spark, folder))


@query
def pmi(spark, folder):
    return rounded(itemspace.pmi(itemspace.cooccurrence(fx.season(spark, folder))))


@query
def sign_checks(spark, folder):
    """Pre-stated signs: neighbours on the card circle attract, cards far apart repel or never meet."""
    card = fx.card_dimension(spark).selectExpr("id AS card_i")
    near = card.selectExpr("card_i", f"{fx.FIRST_CARD} + (card_i - {fx.FIRST_CARD} + 1) % 102 AS card_j", "'positive' AS sign")
    far = card.selectExpr("card_i", f"{fx.FIRST_CARD} + (card_i - {fx.FIRST_CARD} + 13) % 102 AS card_j", "'negative' AS sign")
    table = itemspace.pmi(itemspace.cooccurrence(fx.season(spark, folder)))
    return rounded(itemspace.sign_checks(table, near.unionByName(far)))


@query
def item_vectors(spark, folder):
    vectors, _ = itemspace.card_space(fx.season(spark, folder), 16)
    return rounded(vectors.selectExpr("card", "size(vector) AS dimensions", "aggregate(vector, 0D, (a, x) -> a + x * x) AS energy"))


@query
def item_vectors_gram(spark, folder):
    """PMI of every observed pair, rebuilt from all dimensions of the two items' vectors."""
    battles = fx.season(spark, folder)
    table = materialise(itemspace.pmi(itemspace.cooccurrence(battles)))
    vectors, values = itemspace.factorise(spark, table, itemspace.item_universe(battles), fx.CARD_COUNT)
    signs = F.array(*[F.lit(r["sign"]) for r in values.orderBy("k").collect()])
    one, other = (vectors.select(F.col("card").alias(f"card_{x}"), F.col("vector").alias(x)) for x in "ij")
    products = F.aggregate(F.zip_with(F.zip_with("i", "j", lambda a, b: a * b), signs, lambda p, s: p * s), F.lit(0.0), lambda a, x: a + x)
    return table.join(one, "card_i").join(other, "card_j").select("card_i", "card_j", (F.round(products, 6) + 0.0).alias("pmi"))


@query
def spectrum(spark, folder):
    _, values = itemspace.card_space(fx.season(spark, folder), fx.CARD_COUNT)
    return rounded(itemspace.spectrum_report(values))


@query
def deck_vectors(spark, folder):
    """Deck vectors from the stored embeddings (card c uses vector c − first card), every dimension in millionths;
    every tenth card has no vector, so its decks have none."""
    stored = fx.table(spark, folder, "embeddings").filter("vec_id % 10 <> 9")
    stored = stored.selectExpr(f"cast(vec_id + {fx.FIRST_CARD} AS int) AS card", "embedding AS vector")
    found = itemspace.deck_vectors(melted_ladder(spark, folder), stored, 64)
    whole = F.array_join(F.transform("vector", lambda x: F.round(x * 1e6).cast("long")), ",")
    return found.select(text("deck").alias("deck"), whole.alias("vector"), "missing")


@query
def difference_long(spark, folder):
    return itemspace.difference_long(fx.season(spark, folder).withColumn("at", micros("battle_time")), ["at", "a_tag"])


@query
def nearest_items(spark, folder):
    """Neighbours of the first vector of each label among all stored vectors."""
    stored = fx.table(spark, folder, "embeddings")
    named = stored.groupBy("label").agg(F.min("vec_id").alias("item"))
    vectors = stored.selectExpr("vec_id AS item", "embedding AS vector")
    return rounded(itemspace.nearest_items(vectors, named, 6))


@query
def nearest_items_named(spark, folder):
    """Text ids, more items than travel at once, and vectors without a direction."""
    stored = fx.table(spark, folder, "embeddings").selectExpr(
        "concat('v', vec_id) AS item", "vec_id", "CASE WHEN vec_id % 7 = 3 THEN transform(embedding, x -> 0F) ELSE embedding END AS vector"
    )
    named = stored.filter("vec_id % 40 = 0 OR vec_id = 3").select("item")
    return rounded(itemspace.nearest_items(stored.select("item", "vector"), named, 3, at_once=10))


# --- sequences --------------------------------------------------------------------------------


def stored_focal(spark: SparkSession, folder: str) -> DataFrame:
    """Focal rows written once: the look for hot participants and the windows both read them."""
    return materialise(clean_focal(spark, folder))


@query
def sequence_windows(spark, folder):
    """Every window of ten contests and a target."""
    examples = sequences.sequence_examples(stored_focal(spark, folder))
    return examples.selectExpr(
        "example_id", "window_start", "size(history) AS length", "unix_micros(history[0].battle_time) AS starts",
        "unix_micros(target_time) AS target_at", "array_join(history[9].deck, ',') AS last_deck",
    )


@query
def windows_continuous(spark, folder):
    examples = sequences.sequence_examples(stored_focal(spark, folder), continuity="same_collection")
    return examples.select("example_id", "window_start", "next_switch", "next_win")


@query
def window_counts(spark, folder):
    focal = stored_focal(spark, folder)
    both = sequences.window_counts(focal).join(
        sequences.window_counts(focal, continuity="same_collection").withColumnRenamed("windows", "continuous"), "player_tag"
    )
    return both


@query
def sequence_features(spark, folder):
    """The six features of each history contest; zero transitions at the start of a window."""
    lines = sequences.example_long(sequences.sequence_examples(stored_focal(spark, folder), continuity="same_collection"))
    return rounded(lines.select("example_id", "position", *sequences.BATTLE_FEATURES))


@query
def prefix_summary(spark, folder):
    examples = sequences.sequence_examples(stored_focal(spark, folder))
    return rounded(examples.select("example_id", *sequences.BASE_SUMMARY))


@query
def deck_tenure(spark, folder):
    """Contests in a row with the current deck."""
    rows = sequences.annotated(stored_focal(spark, folder)).result()
    return rows.select("player_tag", "battle_key", "tenure")


@query
def deck_lifetime(spark, folder):
    """All uses of the current deck so far."""
    rows = sequences.annotated(stored_focal(spark, folder)).result()
    return rows.select("player_tag", "battle_key", "deck_n")


@query
def sequence_targets(spark, folder):
    examples = sequences.sequence_examples(stored_focal(spark, folder))
    return examples.select("example_id", text("target_deck").alias("target_deck"), "next_switch", "next_win")


@query
def window_at(spark, folder):
    """The window starting at offset 3 of every participant."""
    examples = sequences.sequence_examples(stored_focal(spark, folder))
    return sequences.example_at(examples, 3).select("example_id", "player_tag", "next_switch", "next_win")


@query
def prebattle_context(spark, folder):
    contexts = sequences.prebattle_contexts(stored_focal(spark, folder), continuity="all")
    return rounded(
        contexts.selectExpr(
            "player_tag", "unix_micros(latest_time) AS latest", "array_join(history[9].deck, ',') AS last_deck",
            "history[0].changed_deck AS first_changed", "history[9].changed_deck AS last_changed",
            *sequences.SUMMARY_SETS["current_deck_count"],
        )
    )


@query
def example_long(spark, folder):
    """Listing of the first window of every participant, one line per contest."""
    first = sequences.example_at(sequences.sequence_examples(stored_focal(spark, folder)), 0)
    lines = sequences.example_long(first)
    return rounded(
        lines.select(
            "example_id", "position", micros("battle_time").alias("at"), text("deck").alias("deck"),
            text("levels").alias("levels"), *sequences.BATTLE_FEATURES,
        )
    )


# --- splits, samples and orders ---------------------------------------------------------------


@query
def global_rank(spark, folder):
    """Rank of every event by (value, id) over the whole table."""
    return ranking.global_rank(fx.events(spark, folder).select("event_id", "value"), ["value", "event_id"]).select("event_id", "rank")


@query
def time_split(spark, folder):
    battles = fx.season(spark, folder).select("battle_time", "a_tag", "b_tag", "a_won")
    parts = assign.time_split(battles, ["battle_time", "a_tag", "b_tag"])
    return parts.select(micros("battle_time").alias("at"), "a_tag", "position", "part")


@query
def player_split(spark, folder):
    eligible = dedup.eligible_entities(_clean_sides(spark, folder))
    return assign.player_split(eligible).select("tag", "split")


def _examples_per_player(spark: SparkSession, folder: str) -> DataFrame:
    clean = materialise(dedup.clean_first(fx.parsed_log(spark, folder)))
    split = assign.player_split(dedup.eligible_entities(clean))
    sizes = sequences.window_counts(orient.focal_rows(clean)).selectExpr("player_tag AS tag", "windows AS examples")
    return split.join(sizes.filter("examples > 0"), "tag").select("tag", "split", "examples")


@query
def player_folds(spark, folder):
    return assign.player_folds(_examples_per_player(spark, folder))


@query
def stratified_cohort(spark, folder):
    sample = assign.stratified_sample(_members(spark, folder), target=500, seed=11)
    return sample.select("tag", "trophies", "band")


@query
def band_supply(spark, folder):
    return cohort.band_supply(_members(spark, folder), target=500)


@query
def poll_order(spark, folder):
    first = assign.poll_order(fx.cohort_state(spark, folder), limit=40)
    return first.select("tag", micros("last_polled").alias("last_polled"), "n_polls")


@query
def hash_sample(spark, folder):
    return assign.hash_sample(_members(spark, folder), "tag", 100, seed=5).select("tag", "trophies")


@query
def run_stats(spark, folder):
    """Statistics of both runs of every week, some contests unusable, some types filtered."""
    needed = ("run_id", "type", "battle_key", "is_clean_1v1", "collected_at", "a_crowns", "b_crowns")
    parsed = materialise(fx.parsed_log(spark, folder).select(*needed))
    log = parsed.withColumn("battle_key", F.expr("CASE WHEN a_crowns + b_crowns < 6 THEN battle_key END"))
    stored = parsed.filter("a_crowns = 0").select("battle_key").distinct()
    return cohort.run_stats(log, stored, ["click", "view", "purchase", "error"])


@query
def poll_coverage(spark, folder):
    """Pages of each event type's run: full, partial, first and failed polls."""
    polls = fx.events(spark, folder).selectExpr(
        "event_type AS run_id", "CASE WHEN user_id % 5 = 0 THEN 0 ELSE 1 END AS n_polls",
        "CASE WHEN k % 13 = 0 THEN NULL WHEN k < 80 THEN k % 30 ELSE 30 END AS returned",
    )
    return cohort.poll_coverage(polls)


# --- example table, scaling, audits -----------------------------------------------------------


def example_table(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.sequence_dataset(dataset.stored_focal(fx.parsed_log(spark, folder), fx.card_dimension(spark)))


NINE = sequences.SUMMARY_SETS["current_deck_count"]


@query
def example_audit(spark, folder):
    return rounded(dataset.example_audit(example_table(spark, folder)))


@query
def cell_sample(spark, folder):
    picked = assign.cell_sample(example_table(spark, folder), per_cell=5, seed=3)
    return picked.select("example_id", "next_switch", "next_win")


@query
def level_scaling(spark, folder):
    return rounded(scaling.fit(example_table(spark, folder), "level"))


@query
def battle_scaling(spark, folder):
    return rounded(scaling.fit(example_table(spark, folder), "battle"))


@query
def summary_scaling(spark, folder):
    return rounded(scaling.fit(example_table(spark, folder), "summary", NINE))


@query
def fold_scaling(spark, folder):
    return rounded(scaling.fit_per_fold(example_table(spark, folder), "battle"))


@query
def scaled_examples(spark, folder):
    """Summary columns standardised by the constants of the row's own fold."""
    training = materialise(example_table(spark, folder).filter("split = 0"))
    fitted = {kind: scaling.fit_per_fold(training, kind, NINE) for kind in ("level", "battle", "summary")}
    scaled = scaling.transform(training, fitted, NINE, fold=True)
    return rounded(
        scaled.selectExpr(
            "example_id", "historical_switch_rate", "log1p_prior_battle_count", "history[3].trophies AS trophies",
            "history[3].trophies_missing AS missing", "history[9].levels[0] AS level",
        ),
        5,
    )


@query
def split_leaks(spark, folder):
    """A planted leak: participants whose number ends in 7 appear in two splits."""
    rows = fx.events(spark, folder).selectExpr(
        "concat('U', user_id) AS player_tag",
        "cast(CASE WHEN user_id % 10 = 7 THEN k % 2 ELSE user_id % 3 END AS int) AS split",
        "cast(CASE WHEN user_id % 10 = 3 THEN k % 2 ELSE user_id % 5 END AS int) AS fold",
    )
    return quality.split_leaks(rows)


@query
def unknown_items(spark, folder):
    return quality.unknown_items(melted_ladder(spark, folder), fx.card_dimension(spark, complete=False))


@query
def fold_rules(spark, folder):
    """Rules on a table with planted faults."""
    rows = fx.events(spark, folder).selectExpr(
        "cast(user_id % 3 AS int) AS split",
        "cast(CASE WHEN user_id % 3 <> 0 AND k <> 7 THEN 255 ELSE k % 6 END AS int) AS fold",
        "CASE WHEN user_id % 3 = 0 AND k > 2 OR k = 50 THEN 0.5D END AS score",
    )
    return quality.fold_rules(rows, 5, "score")


@query
def history_violations(spark, folder):
    """Both copies of every contest kept, some decks cut short, some results damaged."""
    rows = orient.focal_rows(fx.parsed_log(spark, folder)).selectExpr(
        "player_tag", "battle_key", "battle_time", "CASE WHEN crown_difference = 3 THEN 0 ELSE result END AS result",
        "CASE WHEN trophies % 50 = 0 THEN slice(deck, 1, 7) ELSE deck END AS deck", "levels",
    )
    return quality.history_violations(rows)


# --- metrics ----------------------------------------------------------------------------------


@query
def sigmoid(spark, folder):
    logits = fx.events(spark, folder).selectExpr("event_id", "(k - 50) * 0.8D AS logit")
    return rounded(logits.select("event_id", scalars.sigmoid("logit").alias("probability")))


@query
def binary_metrics(spark, folder):
    return rounded(metrics.binary_metrics(fx.scored_rows(spark, folder), ["run"]))


@query
def roc_auc(spark, folder):
    return rounded(metrics.ranking_metrics(fx.scored_rows(spark, folder), ["run"]).select("run", "roc_auc"))


@query
def one_class_metrics(spark, folder):
    """A group with a single class has no ranking: NULL, and the others keep theirs."""
    rows = fx.scored_rows(spark, folder).withColumn("label", F.expr("CASE WHEN run = 1 THEN 1 ELSE label END"))
    return rounded(metrics.ranking_metrics(rows, ["run"]).select("run", "roc_auc"))


@query
def average_precision(spark, folder):
    return rounded(metrics.ranking_metrics(fx.scored_rows(spark, folder)).select("average_precision"))


@query
def calibration(spark, folder):
    return rounded(metrics.calibration_table(fx.scored_rows(spark, folder)))


@query
def calibration_error(spark, folder):
    return rounded(metrics.calibration_error(fx.scored_rows(spark, folder), ["run"]))


@query
def factual_metrics(spark, folder):
    return rounded(metrics.factual_metrics(fx.scored_rows(spark, folder)))


@query
def propensity_coverage(spark, folder):
    return rounded(metrics.propensity_coverage(fx.scored_rows(spark, folder)))


@query
def overlap_ess(spark, folder):
    return rounded(metrics.overlap_diagnostics(fx.scored_rows(spark, folder)), 5)


def _run_lines(spark: SparkSession, folder: str, action: int) -> DataFrame:
    rows = fx.scored_rows(spark, folder).filter(F.col("action") == action)
    wide = metrics.binary_metrics(rows, ["run"])
    return metrics.long_metrics(wide, ["run"], ["log_loss", "brier_score", "accuracy"])


@query
def run_aggregate(spark, folder):
    return rounded(metrics.run_aggregate(_run_lines(spark, folder, 0)))


@query
def run_compare(spark, folder):
    left, right = (metrics.run_aggregate(_run_lines(spark, folder, a)) for a in (0, 1))
    return rounded(metrics.run_compare(left, right))


@query
def variance_shares(spark, folder):
    components = fx.events(spark, folder).selectExpr(
        "cast(user_id % 17 AS double) AS skill", "k / 10D AS investment", "value / 7D AS deck", "sin(k) AS counters"
    )
    return rounded(metrics.variance_shares(components, ["skill", "investment", "deck", "counters"], "deck", "counters"))


# --- models -----------------------------------------------------------------------------------


@query
def switch_scores(spark, folder):
    """Switch propensity of every held-out example."""
    examples = models.compact(example_table(spark, folder), NINE)
    fitted = models.fit_model(examples, NINE, models.item_words(fx.card_dimension(spark)))
    return fitted.score(examples.filter("split <> 0")).select("example_id", "split", "next_switch", "score")


@query
def oof_scores(spark, folder):
    """Headline metrics of the cross-fitted propensity."""
    examples = models.compact(example_table(spark, folder), NINE)
    scores = models.cross_fitted_scores(examples, NINE, models.item_words(fx.card_dimension(spark)))
    return metrics.full_metrics(materialise(scores), ["fold"])


@query
def oof_cover(spark, folder):
    """Every training row scored exactly once, no other row."""
    examples = models.compact(example_table(spark, folder), NINE)
    scores = models.cross_fitted_scores(examples, NINE, models.item_words(fx.card_dimension(spark)))
    return models.oof_cover(examples, scores)


@query
def uplift(spark, folder):
    """Win probability of each current context under stay and under switch."""
    cards = fx.card_dimension(spark)
    focal = dataset.stored_focal(fx.parsed_log(spark, folder), cards)
    examples = models.compact(dataset.sequence_dataset(focal), NINE)
    fitted = models.fit_outcome(examples, NINE, models.item_words(cards))
    contexts = sequences.prebattle_contexts(focal, continuity="all")
    return models.compare_actions(fitted, contexts)


@query
def head_ablation(spark, folder):
    examples = models.compact(example_table(spark, folder), NINE)
    return models.ablation(examples, NINE, models.item_words(fx.card_dimension(spark)))


@query
def capacity_ablation(spark, folder):
    """Heads of growing capacity against the linear one."""
    examples = models.compact(example_table(spark, folder), NINE)
    return models.capacity_ablation(examples, NINE, models.item_words(fx.card_dimension(spark)))


@query
def capacity_ablation_check(spark, folder):
    """Every head is compared on the same held-out rows, and differences follow from the means."""
    found = capacity_ablation(spark, folder)
    sound = F.abs(F.col("candidate") - F.col("baseline") - F.col("difference")) < 1e-12
    return found.select("head", "metric", "examples", sound.cast("int").alias("sound"))


@query
def permutation_importance(spark, folder):
    examples = models.compact(example_table(spark, folder), NINE)
    fitted = models.fit_model(examples, NINE, models.item_words(fx.card_dimension(spark)))
    return models.permutation_importance(fitted, examples, NINE)


@query
def matchup_scores(spark, folder):
    """Antisymmetric matchup probabilities with the logit of each block."""
    return _scored_matchups(spark, folder)


def _scored_matchups(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the season's contests; three queries of a session share one fit."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _MATCHUPS:
        _MATCHUPS.clear()
        _MATCHUPS[key] = stored(_fitted_matchups(spark, folder))
    return _MATCHUPS[key]


def _fitted_matchups(spark: SparkSession, folder: str) -> DataFrame:
    sides = [f"{side}_{name}" for side in "ab" for name in ("tag", "cards", "levels")]
    scored, _ = matchup.matchup_scores(fx.season(spark, folder).select("battle_time", *sides, "a_won"))
    return scored.select(micros("battle_time").alias("at"), "a_tag", "b_tag", "part", "a_won", "score", *matchup.BLOCKS)


@query
def skill_ratings(spark, folder):
    """One rating per participant of the season."""
    return paired.skill_ratings(paired.pair_counts(fx.season(spark, folder))).table


@query
def skill_balance(spark, folder):
    """At the maximum, every participant's wins equal what the ratings expect, up to the prior's share."""
    pairs = stored(paired.pair_counts(fx.season(spark, folder)))
    rated = stored(paired.skill_ratings(pairs, prior=1.0, tolerance=1e-6).table)
    own, other = (rated.select(F.col("player").alias(name), F.col("rating").alias(f"r_{name}")) for name in ("player", "other"))
    chance = 1 / (1 + F.exp(F.col("r_other") - F.col("r_player")))
    sums = pairs.join(own, "player").join(other, "other").groupBy("player").agg(
        F.sum("n").alias("games"), F.sum("wins").alias("wins"), F.sum(F.col("n") * chance).alias("expected"), F.first("r_player").alias("r")
    )
    short = F.col("wins") + 1.0 - F.col("expected") - 2.0 / (1 + F.exp(-F.col("r")))
    return sums.select("player", "games", "wins", (F.round(short, 3) + 0.0).alias("short"))


@query
def investment_curve(spark, folder):
    """Odd, monotone rate of winning by size of the level difference, pooled where it would fall."""
    return rounded(matchup.investment_curve(fx.season(spark, folder)))


@query
def facing_items(spark, folder):
    """Left-over of an even chance for every two items that face each other."""
    rows = fx.season(spark, folder).withColumn("r", F.col("a_won") - 0.5).withColumn("w", F.lit(0.25))
    return rounded(paired.facing_counts(rows, "r", "w"))


@query
def counter_check(spark, folder):
    """Factors of facing items: one row per item, the squared error falls in every round and below that of no factors."""
    rows = fx.season(spark, folder).withColumn("r", F.col("a_won") - 0.5).withColumn("w", F.lit(0.25))
    facing = stored(paired.facing_counts(rows, "r", "w"))
    found = paired.counter_factors(facing, max_rounds=6)
    none = facing.filter("i < j").agg(F.sum(F.col("n") * F.col("r") * F.col("r")) / 2).head()[0]
    falls = all(b <= a for a, b in zip(found.history, found.history[1:]))
    size = (F.size("blade") == 8) & (F.size("chest") == 8)
    return found.table.select(F.col("item").alias("card"), (size & F.lit(falls and found.history[-1] < none)).cast("int").alias("sound"))


# --- what holds for the models' results whatever was fitted --------------------------------------


@query
def spectrum_energy(spark, folder):
    """All singular values together hold the energy of the PMI matrix."""
    _, values = itemspace.card_space(fx.season(spark, folder), fx.CARD_COUNT)
    return values.agg(F.round(F.sum(F.col("singular_value") * F.col("singular_value")), 3).alias("energy"))


@query
def switch_score_check(spark, folder):
    """Held-out examples scored once each, inside (0, 1)."""
    scores = switch_scores(spark, folder)
    return scores.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("example_id").alias("examples"), F.sum("next_switch").cast("long").alias("switches"),
        F.count_if(~F.coalesce((F.col("score") > 0) & (F.col("score") < 1), F.lit(False))).alias("out_of_range"),
    )


@query
def oof_score_check(spark, folder):
    """Every training example in its own fold, and metrics inside their ranges."""
    found = oof_scores(spark, folder)
    sound = "log_loss > 0 AND brier_score BETWEEN 0 AND 1 AND accuracy BETWEEN 0 AND 1 AND roc_auc BETWEEN 0 AND 1 AND calibration_error BETWEEN 0 AND 1"
    return found.select("fold", "examples", F.round("positive_rate", 6).alias("positive_rate"), F.expr(f"cast({sound} AS int) AS sound"))


@query
def head_ablation_check(spark, folder):
    """Three heads on the same held-out rows; their base rates agree with the table, metrics lie in their ranges."""
    found = head_ablation(spark, folder)
    sound = (F.col("log_loss") > 0) & F.col("roc_auc").between(0, 1)
    return found.select("head", "split", "examples", F.round("positive_rate", 6).alias("positive_rate"), sound.cast("int").alias("sound"))


@query
def permutation_check(spark, folder):
    """Importance of a planted signal, a rule on one feature: every feature has a finite one."""
    rule = F.col("historical_switch_rate") > 0.55
    examples = models.compact(example_table(spark, folder).withColumn("next_switch", rule.cast("int")), NINE)
    fitted = models.fit_model(examples, NINE, models.item_words(fx.card_dimension(spark)), feature_set="summary")
    found = stored(models.permutation_importance(fitted, examples, NINE))
    return found.select("feature", (F.abs("increase") < 1e6).cast("int").alias("known"))


@query
def dimension_file(spark, folder):
    """The card dimension written as CSV and as Parquet and read back: the same cards by rarity."""
    base = f"{checkpoint_folder(spark)}/cards-{uuid.uuid4().hex}"
    cards = fx.card_dimension(spark)
    cards.write.option("header", True).csv(f"{base}/cards.csv")
    cards.withColumn("name", F.concat(F.lit("card "), "id")).write.parquet(f"{base}/cards.parquet")
    both = [dimension.read_dimension(spark, f"{base}/{file}").withColumn("file", F.lit(file)) for file in ("cards.csv", "cards.parquet")]
    return both[0].unionByName(both[1]).groupBy("file", "rarity").agg(F.count(F.lit(1)).alias("cards"), F.count("name").alias("named"), F.min("id").alias("first"))


@query
def uplift_check(spark, folder):
    """One row per participant with a context; the difference is that of the two probabilities."""
    found = uplift(spark, folder)
    adds_up = "abs(switch_win_probability - stay_win_probability - switch_minus_stay) < 1e-12"
    inside = "stay_win_probability BETWEEN 0 AND 1 AND switch_win_probability BETWEEN 0 AND 1"
    return found.select("player_tag", F.expr(f"cast({adds_up} AND {inside} AS int) AS sound"))


@query
def matchup_variance(spark, folder):
    """Variance of each block of the fitted matchup model, and its share."""
    return metrics.variance_shares(matchup_scores(spark, folder), matchup.BLOCKS, "deck", "counters")


@query
def matchup_variance_check(spark, folder):
    """Shares of all blocks, and of the deck effect's two parts, add up to one."""
    return matchup_variance(spark, folder).agg(
        F.count(F.lit(1)).alias("components"), F.round(F.sum("share"), 9).alias("shares"), F.round(F.sum("deck_share"), 9).alias("deck_shares")
    )


@query
def matchup_check(spark, folder):
    """Every contest scored once; the blocks' logits add up to the score's; the loss is no worse than an even chance's."""
    found = matchup_scores(spark, folder)
    logit = " + ".join(matchup.BLOCKS)
    loss = F.avg(-F.log(F.when(F.col("a_won") == 1, F.col("score")).otherwise(1 - F.col("score"))))
    return found.groupBy("part").agg(
        F.count(F.lit(1)).alias("contests"), F.count_distinct("at", "a_tag", "b_tag").alias("distinct_contests"),
        F.count_if(F.abs(F.expr(f"1 / (1 + exp(-({logit})))") - F.col("score")) > 1e-9).alias("not_additive"),
        (loss < 0.6931 + 0.05).cast("int").alias("loss_in_bound"),
    )
