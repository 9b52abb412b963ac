"""Operator 5, encoding and decoding with a merge-type SentencePiece model.

The table of a text holds, for each of its prefixes, the last token of the prefix's encoding. That token is
unique: of the pieces that end there (matches of an automaton over all pieces) it is the one that is compatible
with the last token of the prefix before it. Two tokens are compatible if merging their joined text gives just
these two back; tests are remembered. Ids are then recovered backwards from the end of the table. A character
that is no piece is a token of its own, written as byte pieces.

No piece holds a blank after another character, so merges never pass from one word into the next: a text's
words are encoded one by one, and repeated words once. Models without that property are encoded whole.

Defined results: NULL and empty texts have no ids and decode to the empty text; equal texts have equal results.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from contest_panel.llm.common import map_texts
from contest_panel.llm.tokens import ENCODE_CHARS, token_file

SPACE = "▁"
_MARKS = ".,;:!?*%$#&|)]}\""
_KEPT = 250_000
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(len(self.names))]
        self.score = {name: model.get_score(i) for i, name in enumerate(self.names) if not special[i]}
        self.ids = {name: i for i, name in enumerate(self.names) if not special[i]}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.silent = {i for i in range(len(self.names)) if model.is_control(i)}
        byte_of = {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.raw = [byte_of.get(i, b"" if i in self.silent else name.replace(SPACE, " ").encode()) for i, name in enumerate(self.names)]
        self.raw[model.unk_id()] = " ⁇ ".encode()
        self.by_word = not any(SPACE in name.lstrip(SPACE) for name in self.ids)
        self.by_mark = not any(name[i - 1].isalpha() and name[i] in _MARKS for name in self.ids for i in range(1, len(name)))
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            if len(name) == 1 or len(self.merged(name)) == 1:  # pieces that merging never makes are left out
                self.automaton.add_word(name, (len(name), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[bytes, bytes, int]] = {}
        self.older: dict[str, tuple[bytes, bytes, int]] = {}

    def merged(self, text: str) -> list[str]:
        """The text's characters after all merges, best score first and leftmost among equals."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        score, queue = self.score, []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(parts) and (made := score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-made, i, j, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, left, right = heapq.heappop(queue)
            if parts[i] == left and parts[j] == right and after[i] == j:
                parts[i], parts[j], after[i] = left + right, None, after[j]
                if after[i] < len(parts):
                    before[after[i]] = i
                offer(before[i], i)
                offer(i, after[i])
        return [p for p in parts if p is not None]

    def name(self, token: int) -> str:
        return self.names[token] if token >= 0 else chr(-1 - token)

    def compatible(self, left: int, right: int) -> bool:
        answer = self.pairs.get((left, right))
        if answer is None:
            if len(self.pairs) > 4 * _KEPT:
                self.pairs.clear()
            a, b = self.name(left), self.name(right)
            answer = self.pairs[left, right] = self.merged(a + b) == [a, b]
        return answer

    def encode_part(self, text: str) -> list[int]:
        """Ids of a text whose blanks are already marked, by its table of last tokens."""
        last: list[int | None] = [None] * len(text)
        size = [1] * len(text)
        pairs, filled = self.pairs, 0
        for end, (length, token) in self.automaton.iter(text):
            while filled < end:
                if last[filled] is None:
                    last[filled] = -1 - ord(text[filled])
                filled += 1
            if last[end] is None:
                start = end - length
                if start < 0 or ((ok := pairs.get((last[start], token))) if (last[start], token) in pairs else self.compatible(last[start], token)):
                    last[end], size[end] = token, length
        ids: list[int] = []
        at = len(text) - 1
        while at >= 0:
            token = last[at]
            if token is None or token < 0:
                ids += [self.bytes[b] for b in reversed(text[at].encode())]
                at -= 1
            else:
                ids.append(token)
                at -= size[at]
        return ids[::-1]

    def segments(self, text: str) -> list[str]:
        """Parts of a text between which no merge passes, with blanks marked and the leading blank added."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return _SEGMENT.findall(marked) if self.by_word else [marked]

    def encode(self, text: str) -> list[int]:
        return [i for part in self.segments(text) for i in self.encode_part(part)]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the blank added in front goes, bytes are joined to characters."""
        text = b"".join(self.raw[i] for i in ids).decode("utf-8", "replace")
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.names[first].startswith(SPACE) else text

    def results(self, parts: list[str]) -> list[tuple[bytes, bytes, int]]:
        """For each marked part: decimal ids joined by commas, decoded bytes, number of ids; repeated parts once."""
        if len(self.known) > _KEPT:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = list(map(known.get, parts))
        for i, part in enumerate(parts):
            if out[i] is None:
                if part not in known:
                    known[part] = older.get(part) or self._result(part)
                out[i] = known[part]
        return out

    def _result(self, part: str) -> tuple[bytes, bytes, int]:
        stem = part.rstrip(_MARKS)
        if self.by_mark and stem != part and stem[-1:].isalpha():
            a, b = self.results([stem, part[len(stem) :]])
            return a[0] + b"," + b[0], a[1] + b[1], a[2] + b[2]
        ids = self.encode_part(part)
        return ",".join(map(str, ids)).encode(), b"".join([self.raw[i] for i in ids]), len(ids)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The worker's encoder of a file, made once."""
    return Pieces(path)


def encode(frame: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of ``frame``: key and ``ids``, an array of int."""
    path = path or token_file("piece_bpe_32k.model")

    def work(slices: Iterator) -> Iterator[dict]:
        for batch, texts in slices:
            made = pieces(path)
            ids = [b",".join(r[0] for r in made.results(made.segments(t))) for t in texts]
            yield {"key": batch.column(0), "ids": [np.array(i.split(b","), np.int32) if i else [] for i in ids]}

    kind = frame.schema[key].dataType.simpleString()
    return map_texts(frame, {"key": key}, text, f"key {kind}, ids array<int>", work).withColumnRenamed("key", key)


def digests(frame: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of ``frame``: key, ``n_tokens``, and SHA-256 of the decimal ids and of the decoded text."""
    path = path or token_file("piece_bpe_32k.model")
    sha = lambda raw: hashlib.sha256(raw).hexdigest()

    def work(slices: Iterator) -> Iterator[dict]:
        made = pieces(path)
        for batch, texts in slices:
            cuts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
            coded = cuts.flatten().dictionary_encode()
            words, use, ends = coded.dictionary.to_pylist(), coded.indices.to_numpy(), cuts.offsets.to_numpy()
            # Texts with several blanks in a row or marked ones are cut by hand.
            odd = np.array([not w or SPACE in w for w in words], bool)[use]
            hand = [not made.by_word or bool(odd[a:b].any()) for a, b in zip(ends, ends[1:])]
            ids, decoded, n = zip(*made.results([SPACE + w for w in words])) if words and made.by_word else ((), (), ())
            counts = np.array(n, np.int64)
            rows = []
            for t, by_hand, a, b in zip(texts, hand, ends, ends[1:]):
                if by_hand:
                    found = made.results(made.segments(t))
                    one, two, total = [f[0] for f in found], [f[1] for f in found], sum(f[2] for f in found)
                else:
                    at = use[a:b].tolist()
                    one, two, total = map(ids.__getitem__, at), map(decoded.__getitem__, at), int(counts[use[a:b]].sum())
                rows.append((total, sha(b",".join(one)), sha(b"".join(two)[1:])))
            total, first, second = zip(*rows)
            yield {"key": batch.column(0), "n_tokens": total, "ids_sha256": first, "decoded_sha256": second}

    kind = frame.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(frame, {"key": key}, text, schema, work, ENCODE_CHARS).withColumnRenamed("key", key)
