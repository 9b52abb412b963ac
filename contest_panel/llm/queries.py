"""Registered queries of the text operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from contest_panel.llm import fptree, jaccard, language, licenses, merkle, packing, quality, search, secrets, sentencepieces, sketches, warc, wavelet
from contest_panel.llm.common import documents, id_part

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str) -> Callable:
    def register(function: Callable) -> Callable:
        QUERIES[name] = function
        return function

    return register


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs.filter(id_part("doc_id", 4) != 2))
    found = language.identify(docs, model)
    return found.select("doc_id", F.coalesce(id_part("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(id_part("doc_id", 3) != 1)
    model = quality.fit(docs, labels)
    return quality.classify(docs, model).select("doc_id", F.coalesce(id_part("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        of("novel").alias("n_novel"),
    )


@query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(documents(spark, sf_dir))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query("op5_sentencepiece")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(documents(spark, sf_dir))


@query("op6_token_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_documents(wavelet.write_shards(documents(spark, sf_dir)), "doc_id", "bigint")


@query("op8_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_pairs(documents(spark, sf_dir))


@query("op10_top_k_search")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(documents(spark, sf_dir), F.col("doc_id") % 100 == 0)
    return found.withColumn("score", F.round("score", 6))


@query("op11_ranked_search")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fptree.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op12_warc_archives")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = pages.schema["page_id"].dataType.simpleString()
    found = warc.read_archives(spark, warc.write_archives(pages)).filter(F.col("record_type").isin("response", "revisit"))
    return found.select(
        warc.key_of("record_id", kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.key_of("refers_to", kind).alias("refers_to")
    )


@query("op13_merkle_manifest")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.coalesce(id_part("doc_id", 3) == 0, F.lit(False))
    claimed = merkle.leaf_digest(*fields, F.when(changed, merkle.ascii_lower(F.col("text"))).otherwise(F.col("text")))
    manifest = merkle.build(documents(spark, sf_dir), "doc_id", "lang", merkle.leaf_digest(*fields, F.col("text")), claimed)
    text = lambda name: F.lower(F.hex(name)).alias(name)
    return merkle.prove(spark, manifest).select(
        F.col("key").alias("doc_id"),
        text("leaf"),
        text("subroot"),
        text("root"),
        F.sha2(F.lower(F.hex("siblings")).cast("binary"), 256).alias("proof_sha256"),
        text("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op9_jaccard_join"] = rf"""
WITH RECURSIVE word AS (
  SELECT doc_id, [x FOR x IN string_split_regex({_LOWER}, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), shingle AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM word
), item AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM shingle
), link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM item a JOIN item b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM shingle LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) ON x = doc_id"""

ORACLES["op10_top_k_search"] = rf"""
WITH word AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')) AS t FROM documents
), tf AS (
  SELECT doc_id, t, count(*) AS n FROM word GROUP BY ALL
), size AS (
  SELECT d.doc_id, coalesce(sum(n), 0) AS length FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY 1
), idf AS (
  SELECT t, ln(1 + ((SELECT count(*) FROM size) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS weight FROM tf GROUP BY t
), mean AS (SELECT avg(length)::DOUBLE AS m FROM size), hit AS (
  SELECT q.doc_id AS query, d.doc_id,
    round(sum(weight * d.n * 2.2::DOUBLE / (d.n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / m))), 9) AS score
  FROM tf q JOIN tf d ON q.t = d.t AND q.doc_id % 100 = 0 JOIN idf ON idf.t = q.t JOIN size ON size.doc_id = d.doc_id, mean GROUP BY 1, 2
)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, round(score, 6) AS score
FROM hit QUALIFY rank <= 10"""


# crc32 of the id's decimal text: eight steps for each byte, the byte taken in with the first.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten([[ascii(substr(doc_id::VARCHAR, i::INT, 1))::UBIGINT, 0, 0, 0, 0, 0, 0, 0]
    FOR i IN range(1, length(doc_id::VARCHAR) + 1)])),
  lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::UBIGINT ELSE 0 END)), 4294967295::UBIGINT)"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


_NEXT = "level + 1 AS level, pos // 8 AS pos, (any_value(n) + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h"
_FOLD = """(n + 7) // 8 AS n, sha256(array_to_string(hs[1:pos % 8], '') || f || array_to_string(hs[pos % 8 + 2:], '')) AS f,
    proof || array_to_string(hs[1:pos % 8], '') || array_to_string(hs[pos % 8 + 2:], '') AS proof"""

ORACLES["op13_merkle_manifest"] = rf"""
WITH RECURSIVE leaf AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM (
    SELECT doc_id, coalesce('+' || lang, '') AS g, sha256(head || {_field("text")}) AS leaf,
      sha256(head || CASE WHEN {_CRC} % 3 = 0 THEN {_field(_LOWER.replace("coalesce(text, '')", "text"))} ELSE {_field("text")} END) AS claimed
    FROM (SELECT *, {" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head FROM documents))
), tree AS (
  SELECT g, 0 AS level, pos, n, leaf AS h FROM leaf
  UNION ALL SELECT g, {_NEXT} FROM tree WHERE n > 1 GROUP BY g, level, pos // 8
), sub AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS count FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, place AS pos, count AS n, subroot AS h FROM sub
  UNION ALL SELECT {_NEXT} FROM top WHERE n > 1 GROUP BY level, pos // 8
), run AS (
  SELECT g, level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM tree WHERE n > 1 GROUP BY ALL
), top_run AS (
  SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM top WHERE n > 1 GROUP BY ALL
), low AS (
  SELECT doc_id, leaf, g, 0 AS level, pos, n, claimed AS f, '' AS proof FROM leaf
  UNION ALL SELECT doc_id, leaf, g, level + 1, pos // 8, {_FOLD} FROM low JOIN run r USING (g, level) WHERE r.run = low.pos // 8 AND n > 1
), high AS (
  SELECT doc_id, leaf, subroot, 0 AS level, place AS pos, count AS n, f, proof FROM low JOIN sub USING (g) WHERE n = 1
  UNION ALL SELECT doc_id, leaf, subroot, level + 1, pos // 8, {_FOLD} FROM high JOIN top_run r USING (level) WHERE r.run = high.pos // 8 AND n > 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM high, (SELECT h AS root FROM top WHERE n = 1) WHERE n = 1"""

ORACLES["op12_warc_archives"] = """
WITH page AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
seen AS (SELECT *, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM page)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (5 * (i // 4) + 1)::INT, 5))::INT >> (5 * (3 - i % 4))::INT) & 31) + 1)::INT, 1)
    FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM seen"""

_TERMS = rf"""regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLES["op11_ranked_search"] = f"""
WITH word AS (
  SELECT doc_id, unnest({_TERMS}) AS t FROM documents
), tf AS (
  SELECT doc_id, t, count(*) AS tf FROM word GROUP BY ALL
), size AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), total AS (
  SELECT count(*) AS count, sum(n)::BIGINT AS l FROM size
), norm AS (
  SELECT doc_id, 100 - 25 + (25 * n * count) // l AS m FROM size, total
), weight AS (
  SELECT t, floor(1000 * ln((2 * any_value(count) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t
), ask AS (
  SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL
), hit AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM ask JOIN tf USING (t) JOIN weight USING (t) JOIN norm USING (doc_id) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM hit WHERE score > 0 QUALIFY rank <= 20"""
