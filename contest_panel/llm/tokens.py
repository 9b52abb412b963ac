"""Token ids of whole texts by public tokenizer files."""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that a word encoder takes at a time: the more, the rarer a word is looked up twice.
ENCODE_CHARS = 6_000_000
DTYPE = "<u4"
_KEPT = 700_000
_MARKS = ".,;:!?*%$#&|)]}\""
#: Anything beyond blocks that have been complete since early versions of Unicode.
_NEWER = re.compile("[^\x00-\u024f\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20a0-\u20b1\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")


def token_file(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The worker's tokenizer of a file, made once; special strings in a text are ordinary text."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


@lru_cache(maxsize=4)
def rank_encoding(path: str):
    """The encoding of a file with lines of base64 token and rank."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_ids(texts: list[str], path: str, ranks: str | None) -> list[list[int]]:
    """Ids of texts by the byte-level tokenizer file ``path``.

    ``ranks`` is the same vocabulary as a file of ranks, which gives the same ids in a quarter of the time; texts
    with characters that versions of Unicode may class differently go through the tokenizer itself.
    """
    out: list[list[int]] = [[]] * len(texts)
    rest = []
    for i, text in enumerate(texts):
        if ranks and not _NEWER.search(text):
            out[i] = rank_encoding(ranks).encode_ordinary(text)
        else:
            rest.append(i)
    for i, e in zip(rest, tokenizer(path).encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if rest else []):
        out[i] = e.ids
    return out


class WordEncoder:
    """Ids by a file whose pre-tokenizer drops blanks: texts are cut at spaces and every cut is encoded once.

    Two generations of cuts are remembered: when the younger is full it becomes the older, from which what is
    used again moves back. New cuts are encoded many at a time, with a separator between them whose id a cut
    without its character cannot have. A cut that ends in marks after a letter is encoded as two, since letters
    and marks never join.
    """

    def __init__(self, path: str, separator: str = "1"):
        self.tokenizer = tokenizer(path)
        self.separator = separator
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        (self.split_id,) = self._ids([separator])[0]
        try:
            with open(path, encoding="utf-8") as file:
                self.words = RankedWords(json.load(file)["model"])
        except ValueError:
            self.words = None

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the ends of the texts in them (first 0)."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        cuts = pc.split_pattern(texts.cast(pa.large_string()), " ")
        coded = cuts.flatten().dictionary_encode()
        use = coded.indices.to_numpy()  # 32 bits wide, as are the places below: a step has far fewer tokens
        pool = self._known(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, pool), np.int32, len(pool)) // 4
        begin = np.cumsum(size, dtype=np.int32) - size
        joined = np.frombuffer(b"".join(pool), DTYPE)
        length = size[use]
        ends = np.r_[np.int32(0), np.cumsum(length, dtype=np.int32)]
        ids = joined[np.repeat(begin[use] - ends[:-1], length) + np.arange(ends[-1], dtype=np.int32)]
        return ids, ends[cuts.offsets.to_numpy()]

    def _known(self, words: list[str]) -> list[bytes]:
        if len(self.known) > _KEPT:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, words))
        missing = [w for w, ids in zip(words, found) if ids is None]
        if missing:
            back = [w for w in missing if w in self.older]
            self.known.update((w, self.older[w]) for w in back)
            self._learn(set(missing).difference(back))
            found = list(map(self.known.__getitem__, words))
        return found

    def _learn(self, new: set[str]) -> None:
        whole, split = [], []
        for word in new:
            if word.isalpha():
                whole.append(word)
                continue
            stem = word.rstrip(_MARKS)
            if stem and stem != word and stem[-1].isalpha() and stem[-1] < "\u0250":
                split.append((word, stem))
            else:
                whole.append(word)
        whole += {stem for _, stem in split if stem not in self.known}.difference(whole)
        if len(self.marks) > _KEPT // 10:
            self.marks.clear()
        tails = {word[len(stem) :] for word, stem in split}.difference(self.marks)
        self.known.update(zip(whole, self._plain(whole)))
        self.marks.update(zip(tails, self._plain(list(tails))))
        for word, stem in split:
            self.known[word] = self.known[stem] + self.marks[word[len(stem) :]]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, DTYPE) for e in found]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Words go by ranks; other texts without the separator go in long strings, cut again where its id stands."""
        out: list[bytes] = [b""] * len(texts)
        plain, rest = [], []
        for i, text in enumerate(texts):
            if self.words and (ids := self.words.ids(text)) is not None:
                out[i] = array("I", ids).tobytes()
            else:
                (rest if self.separator in text else plain).append(i)
        for i, ids in zip(rest, self._ids([texts[i] for i in rest])):
            out[i] = ids.tobytes()
        chunks = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        for chunk, ids in zip(chunks, self._ids([f" {self.separator} ".join(texts[i] for i in chunk) for chunk in chunks])):
            raw, size, at = ids.tobytes(), ids.itemsize, 0
            for i, stop in zip(chunk, [*np.flatnonzero(ids == self.split_id).tolist(), len(ids)]):
                out[i] = raw[at * size : stop * size]
                at = stop + 1
        return out


class RankedWords:
    """Ids of single Latin words by the ranks of a byte-level file with word ends: the file's ids in a quarter of the time.

    Words end in the byte 0xFF, which UTF-8 never has. Merging by ranks joins any two tokens that make a token,
    the file only the pairs it lists. If every token of a result is made of listed pairs, each step was also the
    file's next one, and the result is the file's; ``ids`` gives None otherwise, or if the text is no such word.
    """

    END = b"\xff"

    def __init__(self, model: dict):
        import tiktoken

        names = self._characters()
        end = model.get("end_of_word_suffix") or ""
        raw = lambda token: bytes(names[c] for c in token.removesuffix(end)) + self.END * token.endswith(end)
        if not end or any(c not in names for token in model["vocab"] for c in token.removesuffix(end)[:1]):
            raise ValueError("not a byte-level file with word ends")
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        first = len(model["vocab"]) - len(pairs)
        self.ranks = {}
        for token, rank in model["vocab"].items():
            if all(c in names for c in token.removesuffix(end)) and names["\u00ff"] not in raw(token).removesuffix(self.END):
                self.ranks[raw(token)] = rank
        self.ranks.setdefault(self.END, model["vocab"]["\u00ff"])
        if any(model["vocab"][a + b] != first + i for i, (a, b) in enumerate(pairs)):
            raise ValueError("ranks are not in order of merges")
        self.listed = {(raw(a), raw(b)) for a, b in pairs}
        self.first = first
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.piece = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece
        self.sound: set[int] = set()

    @staticmethod
    def _characters() -> dict[str, int]:
        """The byte of each character that stands for one in byte-level files: printable Latin-1 for itself, others from 256 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}

    def ids(self, text: str) -> list[int] | None:
        low = text.lower()
        if not low.isalpha() or not (low.isascii() or max(low) < "\u0250"):
            return None
        found = self.piece(low.encode() + self.END)
        return found if self.sound.issuperset(found) or all(map(self._check, found)) else None

    def _check(self, token: int) -> bool:
        """Whether merging the token's bytes by ranks takes listed pairs only."""
        raw = self.bytes[token]
        body = raw.removesuffix(self.END)
        parts = [body[i : i + 1] for i in range(len(body))]
        if raw != body and parts:
            parts[-1] += self.END
        good = bool(parts)
        while good and len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            good = rank < 1 << 30 and (parts[i], parts[i + 1]) in self.listed
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if good:
            self.sound.add(token)
        return good


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder of a file, made once."""
    return WordEncoder(path)
