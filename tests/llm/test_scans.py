"""Secret and licence scans against plain rules."""

import hashlib
import random
import re
import string

import pytest

from contest_panel.llm import licenses, queries, secrets
from contest_panel.llm.words import alnum_words, runs


def plain_base(text):
    found = []
    rule = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(rule, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans_of_all_documents(spark, folder, texts):
    found = {r["doc_id"]: r for r in queries.QUERIES["op2_secret_scan"](spark, folder).collect()}
    assert found.keys() == texts.keys()
    for key, text in texts.items():
        spans = plain_base(text)
        assert [found[key][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        digest = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        assert found[key]["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest()
        assert set(digest.split(",")) <= set(found[key]["spans"].split(","))


def test_base_rules():
    cases = {
        "secret=token :abcdefgh": [], "PassWord = 'hunter22'": [(0, 0, 20)], "passwd:short": [], "api-key=abcdefgh": [],
        "ſecret=abcdefgh toKen=abcdef1": [(16, 0, 29)], "AKIA" + "A" * 15: [], "AKIA" + "A" * 16: [(0, 1, 20)], "é" + "a" * 24: [(1, 2, 25)],
    }
    for text, spans in cases.items():
        assert secrets.base_spans(text) == spans == plain_base(text), text


def test_novelty_tells_keys_from_words():
    key, words = "q8Zr0Lx7VbN3tYpW5sKd", "client_secret_version_2"
    assert secrets.novelty("authorization bearer ", key, "") > 0.9 > 0.7 > secrets.novelty("client_secret version_2 ", words, " client_secret_version_2")
    found = secrets.novel_spans(f"the bearer is {key} and more", [], 64, 0.7)
    assert found == [(14, 3, 34)]
    assert not secrets.novel_spans(f"nothing near {key}", [], 64, 0.7)
    assert not secrets.novel_spans("a bearer of 4785380592391139 notes", [], 64, 0.7)


@pytest.mark.parametrize("length", [16, 20, 512, 513, 5000, 40_000])
@pytest.mark.parametrize("letters", [False, True])
def test_keys_of_any_length(length, letters):
    rng = random.Random(length)
    key = "".join(rng.choices(string.ascii_letters if letters else string.ascii_letters + string.digits + "+/", k=length))
    if not letters:
        key = "a1" + key[2:]
    text = f"ends. The bearer is {key} and more"
    assert secrets.novel_spans(text, [], 64, 0.7) == [(20, 3, 20 + length)]
    assert not secrets.novel_spans(text, [(18, 2, 22)], 64, 0.7)


def test_long_runs_that_are_no_keys():
    for run in ("x1" * 3000, "abcdefghijklmnop0123456789" * 200, "GetTheUserNameAndPasswordFromRequest", "antidisestablishmentarianism", "Donaudampfschifffahrtsgesellschaft"):
        assert not secrets.novel_spans(f"token {run} end", [], 64, 0.7), run


def test_covered_and_distant_candidates_by_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        parts = [rng.choice(["token", "secret", "word", "q8Zr0Lx7VbN3tYpW5sKd", "key=abcdef99", "password: abcdefg1", " " * 70, "a" * 5, "f0" * 14]) for _ in range(12)]
        text = " ".join(parts)
        known = secrets.base_spans(text)
        words = [m.span() for m in secrets.SENSITIVE.finditer(text)]
        free = [m.span() for m in secrets.CANDIDATE.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e in known)]
        near = [(a, 3, b) for a, b in free if any(e >= a - 20 and s <= b + 20 for s, e in words) and not text[a:b].isalpha()]
        assert secrets.novel_spans(text, known, 20, -1.0) == near


def test_secret_odd_input(odd, none, odd_rows):
    found = secrets.scan(odd).collect()
    assert len(found) == len(odd_rows) and all(not r["spans"] for r in found if r["doc_id"] in (0, 1, 2))
    assert secrets.scan(none).count() == 0
    kept = secrets.redact(odd)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)


def test_redaction(frame):
    text = "é password=abcdef99 and AKIA" + "B" * 16 + "."
    (row,) = secrets.redact(frame([(1, text, *[None] * 9)])).collect()
    assert row["text"] == "é [SECRET] and [SECRET]."


def test_licences_of_all_documents(spark, folder, texts):
    found = queries.QUERIES["op1_license_scan"](spark, folder).collect()
    short = {n: t for n, t in licenses.TEMPLATES.items() if n.endswith("notice") or n == "all-rights-reserved"}
    for name, notice in short.items():
        spots = sorted((i, m.start(), m.end()) for i, t in texts.items() for m in re.finditer(re.escape(notice), t))
        assert spots == sorted((r["doc_id"], r["start"], r["end"]) for r in found if r["template"] == name and r["coverage"] == 1.0), name


def test_alignment_with_edits():
    words = licenses.TEMPLATES["mit"].split()
    index = licenses.Index.of(licenses.TEMPLATES, 3, 3)
    edited = [w for i, w in enumerate(words) if i % 23] + ["tail"]
    edited[50:50] = ["inserted", "words"]
    text = "prose é before. " + " ".join(edited) + " and after"
    (got,) = licenses.matches(text, index, 3, 8, 0.8)
    assert got[0] == "mit" and got[2] == len(alnum_words(" ".join(w for i, w in enumerate(words) if i % 23))[0])
    assert text[got[3] : got[4]].startswith(edited[0]) and text[got[3] : got[4]].endswith(edited[-2])


def test_alignment_is_the_longest_in_the_band():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(40):
        a, b = rng.integers(0, 4, 9), rng.integers(0, 4, 12)
        table = np.zeros((10, 13), int)
        for i in range(9):
            for j in range(12):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + (a[i] == b[j]))
        got = licenses.align(a, b, 0, 20)
        assert (got[0] if got else 0) == table[-1, -1]


def test_winnowing_keeps_one_of_each_window():
    found = runs(alnum_words(licenses.TEMPLATES["mit"])[0], 3)
    places = licenses.winnow(found, 3)
    assert all(any(i <= p < i + 3 for p in places) for i in range(len(found) - 2))


def test_licence_odd_input(odd, none):
    assert licenses.scan(none).count() == 0
    assert licenses.scan(odd).columns == ["doc_id", "template", "coverage", "n_matched", "start", "end"]
    assert licenses.scan(odd).count() == 0
