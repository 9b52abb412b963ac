"""Fingerprints, the Jaccard join, search and the pipeline against brute force."""

import hashlib
import math
import random
import re
import struct
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from contest_panel.llm import graph, jaccard, membership, queries, search, sketches

from .conftest import rows_of


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def chained(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def sketch(text, k=128):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split("[ \t-\r]+", text) if w]
    shingles = {chained(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({chained(words)} if words else set())
    return sorted(shingles)[:k]


def likeness(a, b, k=128):
    union = sorted({*a, *b})[:k]
    return len({*union} & {*a} & {*b}) / len(union) if a and b else float(not a and not b)


def test_fingerprints_of_all_documents(spark, folder, texts):
    found = {r["doc_id"]: r for r in queries.QUERIES["op8_fingerprints"](spark, folder).collect()}
    keys = sorted(texts)
    assert sorted(found) == keys
    for n, key in enumerate(keys):
        text, after, r = texts[key], texts[keys[(n + 1) % len(keys)]], found[key]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other = sketch(text), sketch(edited)
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == ".".join(f"{h % 2**64:x}" for h in own) and r["edited_fingerprint"] == ".".join(f"{h % 2**64:x}" for h in other)
        assert r["near_edited"] == pytest.approx(likeness(own, other)) and r["near_next"] == pytest.approx(likeness(own, sketch(after)))


def test_sketch_estimates_and_merge(spark):
    words = [str(i) for i in range(5000)]
    texts = {"a": " ".join(words[:3000]), "b": " ".join(words[1000:4000]), "both": " ".join(words[:4000])}
    frame = sketches.with_sketch(spark.createDataFrame([("a", texts["a"]), ("b", texts["b"])], "name string, text string"), "text", "sketch")
    one = frame.filter("name = 'a'").select(F.col("sketch").alias("x")).crossJoin(frame.filter("name = 'b'").select(F.col("sketch").alias("y")))
    r = one.select(sketches.resemblance(F.col("x"), F.col("y")).alias("j"), sketches.containment(F.col("x"), F.col("y")).alias("c"), sketches.distinct_shingles(F.col("x")).alias("n")).head()
    assert abs(r["j"] - 0.5) < 0.15 and abs(r["c"] - 2 / 3) < 0.15 and abs(r["n"] - 2996) < 900
    (merged,) = sketches.merge(frame.withColumn("g", F.lit(1)), "g").collect()
    assert merged["sketch"] == sorted({*sketch(texts["a"]), *sketch(texts["b"])})[:128]


def test_fingerprint_odd_input(spark, odd, none, odd_rows):
    found = sketches.edited_pairs(odd).collect()
    assert len(found) == len(odd_rows)
    assert {r["fingerprint"] for r in found if r["doc_id"] in (0, 1, 2)} == {""}
    assert len({r["fingerprint"] for r in found if r["doc_id"] in (6, 7)}) == 1
    assert sketches.edited_pairs(none).count() == 0
    (alone,) = sketches.edited_pairs(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")).collect()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"a b c a b c").hexdigest()


def shingle_set(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def plain_components(texts, width, percent):
    sets = {i: shingle_set(t, width) for i, t in texts.items()}
    name = {i: i for i in sets}
    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and name[a] != name[b] and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                if 100 * len(x & y) >= percent * len(x | y):
                    low, high = sorted((name[a], name[b]))
                    name = {k: low if v == high else v for k, v in name.items()}
    return {i: (len(sets[i]), name[i]) for i in sets}


def copies(seed, groups, size, words=60, edits=3):
    """Texts in groups of near copies, some of them chained, with a passage that all share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base = own
            texts.append(" ".join(own[: words // 2] + passage * (rng.random() < 0.3) + own[words // 2 :]))
    return texts


@pytest.mark.parametrize("width,threshold", [(3, 0.9), (5, 0.8), (1, 0.5)])
def test_components(spark, folder, texts, frame, width, threshold):
    some = texts if width == 3 else dict(enumerate([*copies(width, 12, 12), "", "one", "one two", "ONE two"]))
    found = jaccard.join_components(frame([(i, t, *[None] * 9) for i, t in some.items()]), width=width, threshold=threshold).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == plain_components(some, width, round(threshold * 100))


def test_large_clusters_and_keys(frame, monkeypatch):
    """Clusters over a tile and keys over a key tile take other ways to the same result."""
    some = dict(enumerate(copies(4, 3, 60)))
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    found = jaccard.join_components(frame([(i, t, *[None] * 9) for i, t in some.items()]), width=3, threshold=0.9, tile=16, key_tile=5).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == plain_components(some, 3, 90)


def test_tile_keys_never_miss_a_link():
    rng = np.random.default_rng(2)
    for threshold in (0.9, 0.8):
        for size in (1, 2, 5, 9, 10, 18, 40, 121, 400, 1500):
            for _ in range(5):
                a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
                drop = int(size * (1 - threshold))
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, 0).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if both and both >= threshold * len(np.union1d(a, b)):
                    assert len(np.intersect1d(jaccard.tile_keys(a, threshold), jaccard.tile_keys(b, threshold)))


def test_many_ids_move_no_texts(spark, frame, monkeypatch):
    """Rows chosen by more ids than are broadcast: the same rows, and no join deals out texts."""
    some = copies(5, 12, 12)
    rows = rows_of([*some, *some, "", None, "one", "one"])
    rows = frame([*rows, rows[0], rows[3]])
    few = sorted(r["doc_id"] for r in jaccard.keep_one(rows).collect())
    assert jaccard.join_components(rows).filter("doc_id <> component_id").count() > len(some)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.keep_one(rows)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in kept.collect()) == few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftAnti" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_bits_of_keys(spark):
    """No key is missed, few others pass, and ids that pass by chance are put right."""
    every = spark.range(60_000).selectExpr("id", "named_struct('none', false, 'id', id, 'text', id * 7) as k")
    keys = every.filter("id % 3 = 0").select("k")
    bits = membership.KeyBits(keys, "k", 20_000)
    found = {r["id"] for r in bits.within(every, "k").collect()}
    assert {*range(0, 60_000, 3)} <= found and 0 < len(found) - 20_000 < 400
    left = membership.leave_out(every, "k", keys, every.filter("id % 3 <> 0"), 10)
    assert left.columns == ["id", "k"] and sorted(r["id"] for r in left.collect()) == [i for i in range(60_000) if i % 3]


def test_keys_travel_packed():
    """Six bytes a key before compression, and exactly the groups of sets that share a key."""
    rng = np.random.default_rng(4)
    parts, rows, held, size = 7, {}, {}, 0
    common = rng.integers(-(2**63), 2**63 - 1, 300)
    for _ in range(3):
        chunk = jaccard.KeyChunk(parts)
        sets = [np.unique(np.r_[rng.integers(-(2**63), 2**63 - 1, 400), rng.choice(common, 5)]) for _ in range(40)]
        for i, keys in enumerate(sets):
            chunk.add(int(rng.integers(2**62)), keys)
        made = chunk.rows()
        for part, name, keys, numbers in zip(*(made[n] for n in ("part", "chunk", "keys", "sets"))):
            if part < parts:
                rows.setdefault(part, []).append((name, keys, numbers))
                size += len(keys) + len(numbers)
            else:
                assert np.frombuffer(keys, np.int64).tolist() == chunk.nodes
        for i, keys in enumerate(sets):
            for k in keys.tolist():
                held.setdefault(k, set()).add((made["chunk"][0], i))
    assert size == 6 * sum(len(x) for x in held.values())
    found = {}
    for own in rows.values():
        for k, name, number in zip(*(x.tolist() for x in jaccard.shared_keys(own))):
            found.setdefault(k, set()).add((name, number))
    assert {frozenset(x) for x in found.values()} == {frozenset(x) for x in held.values() if len(x) > 1}


def test_join_odd_input(odd, none, odd_rows):
    found = jaccard.join_components(odd).collect()
    assert len(found) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in found}
    assert (by_id[0]["n_shingles"], by_id[0]["component_id"]) == (0, 0) == (by_id[1]["n_shingles"], by_id[1]["component_id"] - 1)
    assert by_id[7]["component_id"] == 6 and by_id[None]["component_id"] is None
    assert jaccard.join_components(none).count() == 0
    kept = jaccard.keep_one(odd)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == odd.columns and ids[3] == 1 and ids[None] == 1 and ids[6] == 1 and ids[7] == 0 and ids[5] == 2
    assert jaccard.keep_one(none).count() == 0


def test_components_of_graph(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7)]
    found = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(51)} | {100: 100, 200: 100, 300: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_hubs(spark):
    """Hubs in the middle, at the smallest and at the largest node of their component."""
    stars = [(500, i) for i in range(400, 600) if i != 500] + [(1000, i) for i in range(1001, 1200)] + [(2300, i) for i in range(2100, 2300)]
    stars += [(599, 3000), (3000, 3001), (1199, 2299)]
    found = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(stars, "a long, b long"), hub_edges=20).collect()}
    nodes = {n for edge in stars for n in edge}
    assert found == {n: 400 if n < 1000 or n >= 3000 else 1000 for n in nodes}


def plain_search(texts, queries_, k):
    words = {i: Counter(re.findall("[A-Za-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))) for i, t in texts.items()}
    n, lengths = len(texts), {i: sum(w.values()) for i, w in words.items()}
    mean = sum(lengths.values()) / n
    df = Counter(t for w in words.values() for t in w)
    out = {}
    for q in queries_:
        scores = []
        for i, own in words.items():
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * own[t] * 2.2 / (own[t] + 1.2 * (0.25 + 0.75 * lengths[i] / mean)) for t in words[q] if t in own)
            if s > 0:
                scores.append((-s, i))
        out[q] = sorted(scores)[:k]
    return out


def test_search_is_exact(docs, texts):
    found = search.search(docs, F.col("doc_id") % 20 == 0, k=7, shard_terms=5_000, block_docs=8, query_bytes=20_000).collect()
    expected = plain_search(texts, [i for i in texts if i % 20 == 0], 7)
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query"], []).append((r["doc_id"], r["score"]))
    assert got.keys() == {q for q, hits in expected.items() if hits}
    for q, hits in got.items():
        assert [s for _, s in hits] == pytest.approx([-s for s, _ in expected[q]])
        assert [i for i, _ in hits] == [i for _, i in expected[q]]


def test_block_max_wand_skips():
    """Blocks under the floor are never scored, and what is found equals scoring every posting."""
    rng = np.random.default_rng(3)
    docs, terms = 4_000, np.sort(rng.integers(-(2**62), 2**62, 300))
    lists = [np.sort(rng.choice(docs, max(1, docs // (3 + 2 * i)), replace=False)) for i in range(len(terms))]
    lists[250] = np.arange(640, 700)  # a rare term of neighbours
    first = np.cumsum([0, *map(len, lists[:-1])])
    posting = np.concatenate(lists)
    tf = rng.integers(1, 4, len(posting))
    length = np.maximum(1, np.bincount(posting, weights=tf, minlength=docs))
    row = {"term": terms, "first": first, "posting": posting, "tf": tf, "length": length}
    shard = search.Shard(row, list(range(docs)), float(length.mean()), 64)
    for at in (np.array([0, 250]), np.array([0, 1, 2, 250]), np.array([0, 250, 299]), np.arange(0, 300, 7), np.array([5])):
        factor = np.log(1 + docs / np.array([len(lists[i]) for i in at]))
        every = np.zeros(docs)
        for i, f in zip(at, factor):
            part = slice(first[i], first[i] + len(lists[i]))
            every[posting[part]] += shard.score[part] * f
        expected = sorted((-round(s, 9), d) for d, s in enumerate(every) if s > 0)[:10]
        for floor in (0.0, -expected[-1][0]):
            before = shard.scored
            found = shard.top(at, factor, 10, floor)
            assert [d for _, d in found] == [d for _, d in expected]
            assert [s for s, _ in found] == pytest.approx([-s for s, _ in expected])
            share = (shard.scored - before) / sum(len(lists[i]) for i in at)
            assert share < 0.2 if list(at) == [0, 250] else share <= 1  # the rare term alone decides
    assert shard.top(np.array([5]), np.array([1.0]), 10, 100.0) == []


def test_groups_of_queries_are_searched_at_once():
    """A group gives what its queries give one by one; most postings are summed by products of matrices, not one by one."""
    rng = np.random.default_rng(4)
    docs, count = 3_000, 2_000
    terms = np.sort(rng.integers(-(2**62), 2**62, count))
    lists = [np.sort(rng.choice(docs, max(1, int(docs / (1 + i) ** 0.9)), replace=False)) for i in rng.permutation(count)]
    for i, run in ((100, np.arange(320, 384)), (101, np.arange(448, 500)), (102, np.arange(500, 505))):
        lists[i] = run  # pieces of one list next to those of another one, in ascending blocks
    first, posting = np.cumsum([0, *map(len, lists[:-1])]), np.concatenate(lists)
    tf = rng.integers(1, 4, len(posting))
    length = np.maximum(1, np.bincount(posting, weights=tf, minlength=docs))
    row = {"term": terms, "first": first, "posting": posting, "tf": tf, "length": length}
    shard = search.Shard(row, list(range(docs)), float(length.mean()), 64)
    factor = np.log(1 + docs / np.array([len(x) for x in lists]))
    sizes = np.array([len(x) for x in lists])
    asked = [np.sort(rng.choice(count, 150, replace=False, p=sizes / sizes.sum())) for _ in range(40)]
    asked += [np.array([100, 101, 102]), np.array([101, 102]), np.zeros(0, int), np.arange(count)]
    expected = []
    for at in asked:
        every = np.zeros(docs)
        for i in at:
            part = slice(first[i], first[i] + len(lists[i]))
            every[posting[part]] += shard.score[part] * factor[i]
        expected.append(sorted((-round(s, 9), d) for d, s in enumerate(every) if s > 0)[:10])
    at, query = np.concatenate(asked), np.repeat(np.arange(len(asked)), [len(a) for a in asked])
    floors = np.array([0.0 if i % 2 or len(e) < 10 else -e[rng.integers(10)][0] for i, e in enumerate(expected)])
    for floor in (np.zeros(len(asked)), floors, floors + 1e3):
        found = shard.top_of_each(query, at, factor[at], 10, floor)
        for own, want, least in zip(found, expected, floor):
            want = [(-s, d) for s, d in want if -s >= least - search.SLACK]
            assert [d for _, d in own] == [d for _, d in want]
            assert [s for s, _ in own] == pytest.approx([s for s, _ in want])
    assert 0 < shard.gathered < shard.scored / 2
    before = shard.scored
    shard.top_of_each(query, at, factor[at], 10, np.array([-e[0][0] if e else 0.0 for e in expected]))
    assert shard.scored - before < 0.8 * sizes[at].sum()  # long lists that are set apart are read in few blocks
    assert shard.rows.size <= search.CELLS * len(posting)


def test_shards_take_little_memory(docs, texts):
    """Stored postings take under four bytes each, a file has few shards, and one is opened and searched in under 90 bytes a posting."""
    rows = search.build_shards(docs.coalesce(1), "doc_id", "text", 5_000).collect()
    counts = Counter(w for t in texts.values() for w in set(search._terms(t)[0].tolist()))
    found, size, postings = Counter(), 0, 0
    for r in rows:
        posting, tf = (search.unpacked(pa.py_buffer(r[n])) for n in ("posting", "tf"))
        assert len(posting) == len(tf) == r["postings"] and int(tf.sum(dtype=int)) == sum(r["length"])
        found.update(dict(zip(r["term"], np.diff([*r["first"], r["postings"]]).tolist())))
        size, postings = size + len(r["posting"]) + len(r["tf"]), postings + r["postings"]
    assert len(rows) > 3 and found == counts and size < 4 * postings
    files = Counter(r[0] for r in graph.stored(search.build_shards(docs.coalesce(1), "doc_id", "text", 5_000), 2).select(F.input_file_name()).collect())
    assert sum(files.values()) == len(rows) and max(files.values()) <= 2
    for values in ([], [0, 255], [256, 3], [70_000]):
        assert search.unpacked(pa.py_buffer(search.packed(np.array(values, int)))).tolist() == values

    rng = np.random.default_rng(6)
    docs, sizes = 6_000, np.maximum(1, (3_000 / (1 + np.arange(60_000)) ** 0.6).astype(int))
    posting = np.concatenate([np.sort(rng.choice(docs, n, replace=False)) for n in sizes]).astype(np.int32)
    first = np.cumsum([0, *sizes[:-1]]).astype(np.int32)
    tf = rng.integers(1, 4, len(posting)).astype(np.int32)
    row = {"term": np.arange(len(sizes)), "first": first, "posting": posting, "tf": tf, "length": np.maximum(1, np.bincount(posting, weights=tf, minlength=docs)).astype(np.int32)}
    asked = [np.sort(rng.choice(len(sizes), 300, replace=False, p=sizes / sizes.sum())) for _ in range(64)]
    query, at = np.repeat(np.arange(64), 300), np.concatenate(asked)
    tracemalloc.start()
    try:
        shard = search.Shard(row, list(range(docs)), float(row["length"].mean()))
        opened = tracemalloc.get_traced_memory()[1]
        assert all(shard.top_of_each(query, at, np.log(1 + docs / sizes)[at], 10, np.zeros(64)))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert opened < 46 * len(posting) and most < 90 * len(posting), (opened / len(posting), most / len(posting))


def test_groups_of_queries_are_bounded():
    ends = np.r_[0, np.cumsum(np.r_[np.full(200, 300), 90_000, 0, 0, 20_000, 20_000, 20_000])]
    for most in (0, 1, 7, 10_000):
        groups = list(search._groups(ends, most))
        assert [i for g in groups for i in range(*g)] == list(range(len(ends) - 1))
        for first, last in groups:
            assert last == first + 1 or (last - first <= min(search.TOGETHER, most) and ends[last] - ends[first] <= search.GROUP_TERMS)
    assert len(groups) < 10
    assert list(search._groups(np.zeros(1, int), 5)) == []


def test_search_odd_input(odd, none):
    found = search.search(odd, F.col("doc_id") >= 0).collect()
    assert not {0, 1, 2} & {r["query"] for r in found} and {r["doc_id"] for r in found if r["query"] == 4} >= {3, 4, 5}
    lost = [r for r in found if r["doc_id"] is None]
    assert lost and {r["query"] for r in search.search(odd, F.col("doc_id").isNull()).collect()} == {None}
    assert search.search(none, F.lit(True)).count() == 0
    assert search.search(odd, F.lit(False)).count() == 0


def test_pipeline(spark, folder, texts):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    named = dict(pipeline.STAGES)
    known = named["language_id"](spark, docs, folder)
    assert known.columns == docs.columns
    kept = {r["doc_id"] for r in named["quality_classifier"](spark, known, folder).collect()}
    bad = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 0").collect()}
    assert len(kept & bad) <= 0.1 * len(bad) and len(kept) > 0.7 * len(texts)
    good = docs.filter(F.col("doc_id").isin(list(kept)))
    once = named["jaccard_join"](spark, good, folder)
    groups = plain_components({i: texts[i] for i in kept}, 5, 80)
    left = {r["doc_id"]: r["text"] for r in once.collect()}
    assert left.keys() == {name for _, name in groups.values()} and once.columns == docs.columns
    clean = {r["doc_id"]: r for r in named["secret_scan"](spark, once, folder).collect()}
    assert clean.keys() == left.keys() and all(r["n_chars"] == len(r["text"]) for r in clean.values())
    from contest_panel.llm.secrets import base_spans

    assert not any(base_spans(r["text"]) for r in clean.values())
    final = pipeline.run(spark, folder)
    assert {r["doc_id"] for r in final.select("doc_id").distinct().collect()} == {r["doc_id"] for r in final.filter("piece = 0").collect()}


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert rows_of([None]) != []
