"""Operator 2, secret scan: base patterns plus dictionary-primed zstandard novelty.

Base spans are the matches of three patterns (assign, access, hex), leftmost and non-overlapping for each
kind. The method adds spans of kind ``novel``: a candidate is a run of 16 or more value characters with letters and
digits, or of letters with about as many capitals as small ones (words and names have fewer);
its novelty is the number of compressed bytes it adds to its surrounding text when zstandard is primed with
that text and a dictionary of identifiers. Words, identifiers, repeats and counters add next to nothing; a
random key cannot be compressed. Candidates that stay incompressible near a sensitive word are reported. Long candidates
are measured in pieces, each against what surrounds it, so their length has no limit.

Every text is judged by itself inside the task that reads it: no shuffle, and memory for one slice of texts.

Defined results: NULL and empty texts have no spans; equal texts have equal spans; NULL ids stay. Offsets are
code points, end exclusive. A candidate that overlaps a base span is not reported again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import zstandard
from pyspark.sql import DataFrame

from contest_panel.llm.common import map_texts

KINDS = ("assign", "access", "hex", "novel")
# Patterns of the contract. Longer runs in place of "+" where a run can only match whole.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN = 6

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}|(?<![A-Za-z0-9+/_=-])[A-Za-z]{16,}(?![A-Za-z0-9+/_=-])")
#: Share of capitals in a candidate without digits: names of joined words have fewer, constants more.
CAPITALS = (0.3, 0.7)
#: Characters of a candidate that are measured at a time, and of the text on either side of them.
PIECE = 512
CONTEXT = 512
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)?\b|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|auth", re.IGNORECASE | re.ASCII)
#: Words and identifiers of code and configuration, with which the compressor is primed.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 12345678 2020-01-01T00:00:00Z "
    "import from return class function const static public private protected void string boolean integer float double "
    "self this true false null None undefined async await yield lambda def for while else elif try except finally raise "
    "password passwd secret token api_key apikey access_key private_key client_id client_secret authorization bearer basic "
    "username user_id session cookie header request response config settings environment production development staging "
    "http:// https:// www. .com .org .net /api/v1/ /usr/local/bin /home/user localhost 127.0.0.1 index.html application/json "
    "content-type utf-8 base64 sha256 sha1 md5 uuid version timestamp created_at updated_at description example placeholder "
    "changeme your_token_here xxxxxxxx AKIA ssh-rsa BEGIN PRIVATE KEY END CERTIFICATE licensed under license version copyright"
)


def novelty(before: str, candidate: str, after: str) -> float:
    """Compressed bytes that ``candidate`` adds to its surroundings, as a share of its length."""
    primed = zstandard.ZstdCompressionDict(f"{IDENTIFIERS} {before} {after} ".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    start = before[-16:]
    return (len(press.compress(f"{start}{candidate}".encode())) - len(press.compress(start.encode()))) / len(candidate.encode())


def span_novelty(text: str, a: int, b: int, context: int = CONTEXT, piece: int = PIECE) -> float:
    """Novelty of ``text[a:b]`` in the text, long ones as the mean over their pieces by length."""
    added = sum(
        novelty(text[max(0, at - context) : at], text[at : min(b, at + piece)], text[min(b, at + piece) : at + piece + context]) * (min(b, at + piece) - at)
        for at in range(a, b, piece)
    )
    return added / (b - a)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, known: list[tuple[int, int, int]], around: int, least: float, context: int = CONTEXT) -> list[tuple[int, int, int]]:
    """Candidates near a sensitive word that no base span covers and that stay incompressible. ``known`` is in order of starts."""
    words = [(m.start(), m.end()) for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    starts, ends = zip(*words)
    known_starts, reach = [s for s, _, _ in known], list(accumulate((e for _, _, e in known), max))
    found = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        covered, near = bisect_left(known_starts, b) - 1, bisect_right(starts, b + around) - 1
        if covered >= 0 and reach[covered] > a or near < 0 or ends[near] < a - around:
            continue
        if m[0].isalpha() and not CAPITALS[0] <= sum(map(str.isupper, m[0])) / (b - a) <= CAPITALS[1]:
            continue
        if span_novelty(text, a, b, context) >= least:
            found.append((a, 3, b))
    return found


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(frame: DataFrame, key: str = "doc_id", text: str = "text", around: int = 64, least: float = 0.7, context: int = CONTEXT) -> DataFrame:
    """One row per row of ``frame``: key and ``spans``, an array of (kind, start, end) in order of start and kind.

    ``around``: characters between a candidate and a sensitive word at most; ``least``: compressed bytes added
    for each byte of a reported candidate at least; ``context``: characters on either side that a candidate is measured against.
    """

    def work(slices: Iterator) -> Iterator[dict]:
        for batch, texts in slices:
            rows = []
            for t in texts:
                known = base_spans(t)
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(known + novel_spans(t, known, around, least, context))])
            yield {"key": batch.column(0), "spans": rows}

    kind = frame.schema[key].dataType.simpleString()
    return map_texts(frame, {"key": key}, text, f"key {kind}, spans array<struct<kind:string,start:int,end:int>>", work).withColumnRenamed("key", key)


def redact(frame: DataFrame, text: str = "text", mark: str = "[SECRET]", around: int = 64, least: float = 0.7) -> DataFrame:
    """``frame`` with every span of every text replaced by ``mark`` (overlapping spans by one)."""
    from contest_panel.llm.common import filter_texts

    import numpy as np

    def clean(t: str) -> str:
        known = base_spans(t)
        parts, done = [], 0
        for a, _, b in sorted(known + novel_spans(t, known, around, least)):
            if a >= done:
                parts += [t[done:a], mark]
            done = max(done, b)
        return "".join([*parts, t[done:]]) if parts else t

    return filter_texts(frame, text, lambda texts: (np.ones(len(texts), bool), {text: [clean(t) for t in texts]}))
