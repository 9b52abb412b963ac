"""Ranked search over FP-trees, WARC archives, Merkle manifests."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contest_panel.llm import fptree, merkle, queries, warc


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- ranked search ---------------------------------------------------------------------------------


def plain_ranking(docs, items, k):
    """docs, items: (id, text). Scores straight from the definition."""
    terms = lambda t: Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t)))
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = {}
    for i, q in asked.items():
        scored = []
        for d, b in bags:
            m = 100 - 25 + 25 * b.total() * n // total
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, c in q.items() if t in b)
            if s > 0:
                scored.append((-s, d is None, d))
        if scored:
            out[i] = [(d, -s) for s, _, d in sorted(scored)[:k]]
    return out


def ranking_of(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
    return out


@pytest.mark.parametrize("leaf,shard,block", [(32, 1_500_000, 8_000_000), (2, 3_000, 8_000_000), (8, 20_000, 2_000), (1, 1, 400)])
def test_ranking_is_exact(spark, docs, texts, folder, leaf, shard, block):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    if shard == 1:
        docs, texts = docs.filter("doc_id < 30"), {i: t for i, t in texts.items() if i < 30}
    found = fptree.rank_documents(docs, items, shard_entries=shard, leaf=leaf, block_bytes=block)
    assert ranking_of(found) == plain_ranking(texts.items(), [(r["item_id"], r["text"]) for r in items.collect()], 20)


def test_ranking_odd_input(spark, odd, none, odd_rows):
    asked = [(1, "one the token"), (1, "ONE one"), (2, None), (3, ""), (4, "nowhere"), (None, "règle 42 der"), (5, "text of the same id"), (6, "one " * 3000)]
    items = spark.createDataFrame([(*a, "x") for a in asked], "item_id int, text string, doc_id string")
    expected = plain_ranking([(r[0], r[1]) for r in odd_rows], asked, 5)
    assert ranking_of(fptree.rank_documents(odd, items, k=5)) == expected and 4 not in expected and None in expected
    assert fptree.rank_documents(none, items).count() == 0 == fptree.rank_documents(odd, items.limit(0)).count()
    assert fptree.rank_documents(odd, items.filter("item_id IN (2, 3)")).count() == 0


def test_ties_and_copies(spark):
    rng = random.Random(1)
    rows = [(i, "alpha beta gamma") for i in range(300)] + [(i, " ".join(rng.choices("alpha beta gamma delta".split(), k=5))) for i in range(300, 500)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([("a", "alpha"), ("b", "beta delta")], "item_id string, text string")
    for leaf in (1, 4, 64):
        assert ranking_of(fptree.rank_documents(docs, items, leaf=leaf, shard_entries=200)) == plain_ranking(rows, [("a", "alpha"), ("b", "beta delta")], 20)


def test_bounds_hold_and_prune():
    """Every node's bound is at least any score below it, and the search leaves most documents out."""
    rng = np.random.default_rng(3)
    size = rng.integers(1, 30, 3000)
    rank = np.concatenate([np.sort(rng.choice(60, n, replace=False, p=(w := 1 / np.arange(1, 61)) / w.sum())) for n in size])
    tf, m = rng.integers(1, 9, len(rank)), rng.integers(80, 300, 3000)
    trie = fptree.Trie(size, rank, tf, m, 8)
    asked, weights = np.array([2, 7, 30, 55]), np.array([100, 900, 2500, 4000])
    doc = np.repeat(np.arange(3000), size)
    hit = np.isin(rank, asked)
    value = np.zeros(len(rank), np.int64)
    value[hit] = weights[np.searchsorted(asked, rank[hit])] * fptree.parts(tf[hit], m[doc[hit]])
    exact = np.bincount(doc, weights=value, minlength=3000).astype(np.int64)
    seen, best, search = 0, np.zeros(0, np.int64), trie.search(asked, weights, 10, 0)
    found = next(search)
    while found is not None:
        docs, scores = found
        assert (exact[docs] == scores).all()
        seen += len(docs)
        best = np.sort(np.r_[best, scores])[-10:]
        try:
            found = search.send(int(best[0]) if len(best) == 10 else 0)
        except StopIteration:
            found = None
    assert (best == np.sort(exact)[-10:]).all() and seen < 600
    for node, (low, high) in trie.children.items():
        assert trie.m[node] == trie.m[low:high].min()


def test_long_texts_in_pieces(monkeypatch):
    text = "Alpha béta; x1\n" * 500
    whole = fptree.term_counts(text)
    monkeypatch.setattr(fptree, "_PIECE", 7)
    assert fptree.term_counts(text) == whole == Counter({b"alpha": 500, "béta".encode(): 500, b"x1": 500})


def test_exact_sums_of_large_values():
    value = np.array([2**55 + 3, 2**55 + 5, 7], np.int64)
    assert fptree._sums(np.array([0, 0, 1]), value, 2).tolist() == [2**56 + 8, 7]


# --- archives --------------------------------------------------------------------------------------


PAGES = "page_id long, url string, html string, key string, hash string, first int"


def page_rows(rows):
    return [(*r, "x", "y", 3) for r in rows]


def plain_pages(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = (h or "") in first and i != first[h or ""]
        out.append((i, len(raw), warc.base32_sha1(raw), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


def read_back(spark, folder, kind="long"):
    found = warc.read_archives(spark, folder).filter("record_type <> 'warcinfo'")
    rows = found.select(warc.key_of("record_id", kind), "payload_bytes", "payload_digest", "record_type", warc.key_of("refers_to", kind)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(2)
    rows = [(i, f"http://a/{i}?q=ü b", " ".join(rng.choices("<p> the a of zwölf </p>".split(), k=rng.randint(0, 200)))) for i in range(400)]
    rows += [(1000 + i, None, "same page") for i in range(50)] + [(2000, "u", None), (2001, "u\n v", ""), (2002, "u", ""), (3, "u", rows[5][2])]
    rows += [(None, "u", "same page"), (None, "u", "of nobody"), (None, "u", "of nobody"), (999, "u", "same page"), (999, "u", "same page"), (5000, "u", "long " * 400_000)]
    return rows, spark.createDataFrame(page_rows(rows), PAGES).repartition(3)


@pytest.mark.parametrize("size,limit", [(32_000_000, 1_000_000), (40_000, 0)])
def test_archives_round_trip(spark, pages, size, limit):
    rows, frame = pages
    folder = warc.write_archives(frame, archive_bytes=size, broadcast_keys=limit)
    assert read_back(spark, folder) == plain_pages(rows)
    payloads = warc.read_archives(spark, folder, payloads=True).filter("record_type = 'response'")
    assert {r["payload"].decode() for r in payloads.collect()} == {h or "" for _, _, h in rows}
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(folder).collect() if len(r["content"])]
    assert all(f.startswith(struct.pack("<I", warc.DICTIONARY)) for f in files if len(f) > 8_000) and (len(files) > 8) == (size < 1_000_000)


def test_least_size_for_revisits_and_text_keys(spark):
    rows = [("a/ b", "u", "xx"), ("c:null", "u", "xx"), (":null", "u", "long enough"), ("z", "u", "long enough"), ("", "u", "other"), (None, "u", "xx")]
    frame = spark.createDataFrame(rows, "page_id string, url string, html string")
    found = {r[0]: r[3:] for r in read_back(spark, warc.write_archives(frame, least=5), "string")}
    assert found == {"a/ b": ("response", None), "c:null": ("response", None), ":null": ("response", None), "z": ("revisit", ":null"), "": ("response", None), None: ("response", None)}


def test_no_pages(spark, pages):
    _, frame = pages
    assert warc.read_archives(spark, warc.write_archives(frame.limit(0))).count() == 0


def some_records(n=40):
    return [warc.page_record(str(i), f"http://x/{i}", b"<html> some shared words of page %d </html>" % i * 30, None, warc.DATE) for i in range(n)]


def test_dictionary_is_loaded_from_the_first_frame():
    import zstandard

    records = some_records()
    made = warc.archive(records, dictionary_bytes=2_000)
    assert [raw for _, _, raw in warc.read_frames(made)] == records
    magic, size = struct.unpack_from("<II", made)
    assert magic == warc.DICTIONARY
    plain = zstandard.ZstdDecompressor().decompressobj().decompress(made[8 : 8 + size])
    unpacked = struct.pack("<II", warc.DICTIONARY, len(plain)) + plain + made[8 + size :]
    assert [raw for _, _, raw in warc.read_frames(unpacked)] == records  # a dictionary that is not compressed
    with pytest.raises(ValueError, match="dictionary"):
        list(warc.read_frames(made[8 + size :]))
    alone = warc.archive(records[:2])
    assert [raw for _, _, raw in warc.read_frames(alone)] == records[:2] and not alone.startswith(made[:4])


@pytest.mark.parametrize("broken", [lambda a: a[:-5], lambda a: a[:-1], lambda a: a + b"junk and more", lambda a: a + b"abc", lambda a: a[: len(a) // 2] + b"\0\0\0\0" + a[len(a) // 2 + 4 :]])
def test_broken_archives_are_found(broken):
    with pytest.raises(ValueError):
        list(warc.read_frames(broken(warc.archive(some_records(), dictionary_bytes=2_000))))


def test_headers_and_lengths_are_checked():
    good = warc.page_record("1", None, b"payload", None, warc.DATE)
    assert warc.parse_record(good)["payload"] == b"payload"
    assert warc.parse_record(good.replace(b"WARC-Date: ", b"WARC-Date:\r\n  "))["fields"]["warc-date"] == warc.DATE
    changes = [
        (b"WARC/1.1", b"WARC/9"), (b"WARC-Date", b"X-Date"), (b"\r\nWARC-Type: response", b""), (b"payload", b"PAYLOAD"), (b"payload", b"payloads"),
        (b"WARC-Record-ID:", b"WARC-Record-ID"), (b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: revisit"), (b"\r\n\r\n", b"\r\n"),
    ]
    for old, new in changes:
        with pytest.raises(ValueError):
            warc.parse_record(good.replace(old, new, 1) if old != b"\r\n\r\n" else good[:-2])
    with pytest.raises(ValueError, match="no number"):
        warc.parse_record(re.sub(rb"Content-Length: \d+\r\n\r\n", b"Content-Length: -7\r\n\r\n", good, count=1))
    revisit = warc.page_record("2", None, b"payload", warc.record_id("1"), warc.DATE)
    assert warc.parse_record(revisit)["payload_bytes"] == 7 and not warc.parse_record(revisit)["payload"]
    with pytest.raises(ValueError, match="revisit"):
        warc.parse_record(revisit.replace(b"WARC-Profile", b"X-Profile"))


def test_problems_are_rows_if_wanted(spark, tmp_path):
    bad = some_records(3)
    bad[1] = bad[1].replace(b"WARC-Date", b"X-Date")
    (tmp_path / "a.warc.zst").write_bytes(warc.archive(bad)[:-3])
    rows = sorted(warc.read_archives(spark, str(tmp_path), strict=False).collect(), key=lambda r: r["number"])
    assert [bool(r["problem"]) for r in rows] == [False, True, True] and "warc-date" in rows[1]["problem"]
    with pytest.raises(Exception, match="record 1"):
        warc.read_archives(spark, str(tmp_path)).collect()


# --- manifests -------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(leaves):
    """Root and, for each leaf, the runs on its way up as (run, place)."""
    ways, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, p in enumerate(at):
            ways[i].append((nodes[p // 8 * 8 : p // 8 * 8 + 8], p % 8))
            at[i] = p // 8
        nodes = [digest(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], ways


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for i, t, lang, s, n in rows:
        changed = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        claimed = leaf_of((i, s, lang, n, lower(t) if changed and t is not None else t))
        groups.setdefault(lang, []).append((i, leaf_of((i, s, lang, n, t)), claimed))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        made.append((own, *plain_tree([r[1] for r in own])))
    root, tops = plain_tree([m[1] for m in made])
    out = []
    for (own, subroot, ways), top in zip(made, tops):
        for (i, leaf, claimed), way in zip(own, ways):
            siblings, folded = [], claimed
            for run, place in [*way, *top]:
                siblings += run[:place] + run[place + 1 :]
                folded = digest(*run[:place], folded, *run[place + 1 :])
            out.append((i, leaf, subroot, root, digest(*siblings), folded, folded == root))
    return sorted(out, key=repr)


def manifest_rows(spark, frame):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    claimed = merkle.leaf_digest(*fields, F.when(changed, merkle.ascii_lower(F.col("text"))).otherwise(F.col("text")))
    made = merkle.build(frame, "doc_id", "lang", merkle.leaf_digest(*fields, F.col("text")), claimed)
    hexed = lambda c: F.lower(F.hex(c))
    found = merkle.prove(spark, made).select("key", hexed("leaf"), hexed("subroot"), hexed("root"), F.sha2(hexed("siblings").cast("binary"), 256), hexed("folded_root"), F.expr("folded_root = root"))
    return sorted((tuple(r) for r in found.collect()), key=repr), made


def test_manifest(spark, frame, odd_rows):
    rng = random.Random(4)
    rows = [(i, rng.choice(["Text A", "text b", "Ünï CODE", "", None]), lang, rng.choice([None, "s", ""]), rng.choice([None, 0, 7]), "x", "y", 1, "z", "w", 2)
            for i, lang in enumerate(["en"] * 300 + [None] * 8 + [""] * 9 + ["de"] + ["fr"] * 64 + ["es"] * 65 + ["ü", "zh", "a", "b", "c"])]
    mixed = [*rows, *odd_rows]
    rng.shuffle(mixed)
    found, made = manifest_rows(spark, frame(mixed))
    expected = plain_manifest([r[:5] for r in mixed])
    assert Counter(found) == Counter(expected)
    assert made.root().hex() == expected[0][3]
    assert any(not r[6] for r in found) and any(r[6] for r in found)


@pytest.mark.parametrize("n", [1, 2, 8, 9])
def test_small_manifests(spark, frame, n):
    rows = [(i, "Some Text", "en", "s", 9, None, None, None, None, None, None) for i in range(n)]
    found, _ = manifest_rows(spark, frame(rows))
    assert found == plain_manifest([r[:5] for r in rows])


def test_no_manifest(spark, none):
    found, made = manifest_rows(spark, none)
    assert found == [] and made.root() is None


def test_recursion_limit_is_put_back(spark, frame):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "77")
    try:
        manifest_rows(spark, frame([(1, "a", "b", "c", 1, *[None] * 6)]))
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "77"
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_queries_are_registered():
    assert {"op11_ranked_search", "op12_warc_archives", "op13_merkle_manifest"} <= queries.QUERIES.keys() & queries.ORACLES.keys()
