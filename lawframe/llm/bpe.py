"""BPE encoding and decoding with a pair occurrence index.

All distinct words of a batch lie behind one another in one array of symbols. The index maps each adjacent pair that the
vocabulary can merge to all its places in the batch. The active rank that is smallest is applied to all its places at
once, left to right without overlap; the pairs that vanish beside them are left to be seen as stale, the pairs that arise
are appended to the lists of their ranks. A merge only makes pairs of larger ranks (checked when the vocabulary is
read), so ranks are taken in ascending order and each once.

The vocabulary is a file of the `tokenizers` library: normaliser NFC, white space to one blank, lower case; words by the
file's pattern; bytes as visible characters; a mark at word ends. Special tokens in a text are cut out first.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re as plain
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

#: White space as the vocabulary's pattern language has it (Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
KNOWN_WORDS = 400_000  # words kept from batch to batch in a task


def byte_letters() -> list[str]:
    """The visible character of each byte: printable Latin-1 stands for itself, the rest for 256 and on, in order."""
    plain_ones = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain_ones) else chr(next(spare)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(*self.ids.values(), *self.special.values()) + 1
        self.tokens = [""] * size
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made: dict[int, int] = {}
        left, right, result = [], [], []
        for rank, (a, b) in enumerate(merges):
            left.append(self.ids[a]), right.append(self.ids[b]), result.append(self.ids[a + b])
            if max(made.get(left[-1], -1), made.get(right[-1], -1)) >= rank or made.setdefault(result[-1], rank) != rank:
                raise ValueError("a merge uses a token that a later merge makes; ranks can't be applied in ascending order")
        self.size, self.result = size, np.array(result, np.int64)
        codes = np.array(left, np.int64) * size + np.array(right, np.int64)
        self.rank_order = np.argsort(codes)
        self.codes = codes[self.rank_order]
        letters = byte_letters()
        self.byte_ids = np.array([self.ids[c] for c in letters], np.int64)
        self.last_ids = np.array([self.ids[c + self.end] for c in letters], np.int64)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^{SPACE}\\p{{L}}\\p{{N}}]"))
        self.space = plain.compile(f"[{SPACE}]+")
        self.cut = plain.compile("(" + "|".join(plain.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the vocabulary has none."""
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.rank_order[at], -1)

    def normalised(self, text: str) -> str:
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        return text.replace("Σ", "σ").lower()  # each letter by itself: no final sigma


class PairIndex:
    """The symbols of many words, and for each active rank the places where its pair may stand."""

    def __init__(self, vocabulary: Vocabulary, words: list[bytes]):
        self.v = vocabulary
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        n = len(flat)
        self.symbol = vocabulary.byte_ids[flat]
        ends = self.starts[1:] - 1
        self.symbol[ends] = vocabulary.last_ids[flat[ends]]
        # -1 ends a word on either side
        self.next = np.arange(1, n + 1)
        self.next[ends] = -1
        self.before = np.arange(-1, n - 1)
        self.before[self.starts[:-1]] = -1
        self.alive = np.ones(n, bool)
        self.places: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self._enter(np.flatnonzero(self.next >= 0))

    def _enter(self, at: np.ndarray) -> None:
        """Puts the pairs that begin at these places into the lists of their ranks."""
        ranks = self.v.ranks_of(self.symbol[at], self.symbol[self.next[at]])
        known = ranks >= 0
        at, ranks = at[known], ranks[known]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
            if rank not in self.places:
                self.places[rank] = []
                heapq.heappush(self.heap, rank)
            self.places[rank].append(part)

    def run(self) -> None:
        codes = np.empty(len(self.v.codes), np.int64)
        codes[self.v.rank_order] = self.v.codes
        while self.heap:
            rank = heapq.heappop(self.heap)
            lists = self.places.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = divmod(int(codes[rank]), self.v.size)
            nxt = self.next[at]
            at = at[self.alive[at] & (nxt >= 0) & (self.symbol[at] == a) & (self.symbol[nxt] == b)]
            if a == b and len(at) > 1:
                at = self._apart(np.unique(at))
            if not len(at):
                continue
            gone = self.next[at]
            after = self.next[gone]
            self.symbol[at] = self.v.result[rank]
            self.alive[gone] = False
            self.next[at] = after
            inner = after >= 0
            self.before[after[inner]] = at[inner]
            lead = self.before[at]
            lead = lead[lead >= 0]
            self._enter(np.unique(np.concatenate([lead, at[inner]])))

    def _apart(self, at: np.ndarray) -> np.ndarray:
        """Of the places of a pair of two like symbols, those that stand when taken from the left: every other one of a run."""
        joined = np.concatenate([[False], self.next[at[:-1]] == at[1:]])
        first = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
        return at[(np.arange(len(at)) - first) % 2 == 0]

    def results(self) -> list[np.ndarray]:
        ids = self.symbol[self.alive].astype("<u4")
        counts = np.add.reduceat(self.alive.astype(np.int64), self.starts[:-1])
        return np.split(ids, np.cumsum(counts)[:-1])


class Coder:
    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        fresh = [w for w in words if w not in self.known]
        if fresh:
            index = PairIndex(self.v, [w.encode("utf-8") for w in fresh])
            index.run()
            self.known.update(zip(fresh, map(np.ndarray.tobytes, index.results()), strict=True))

    def _pieces(self, text: str | None) -> list:
        """Words of a text; a special token is its id as bytes."""
        if not text:
            return []
        if self.v.cut is None or "<|" not in text:
            return self.v.word.findall(self.v.normalised(text))
        out: list = []
        for part in self.v.cut.split(text):
            if part in self.v.special:
                out.append(np.uint32(self.v.special[part]).tobytes())
            elif part:
                out += self.v.word.findall(self.v.normalised(part))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for start in range(0, len(texts), 1000):
            cut = [self._pieces(t) for t in texts[start : start + 1000]]
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            self._learn({w for c in cut for w in c if type(w) is str})
            known = self.known
            out += [b"".join([known[w] if type(w) is str else w for w in c]) for c in cut]
        return out

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids with blanks between, as the file names no decoder; ids without a token give none."""
        tokens = self.v.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist() if i < len(tokens)])


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def encoded(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) or, with digests, (doc_id, n_tokens, ids_sha256, decoded_sha256), a row per row of docs.

    Null or empty text: no tokens. doc_id of any type. Each executor reads the vocabulary from `path`.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path)
        for b in batches:
            ids = c.encode([t if isinstance(t, str) else None for t in b["text"]])
            out = {"doc_id": b["doc_id"], "n_tokens": [len(x) // 4 for x in ids]}
            if digests:
                out["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in ids]
                out["decoded_sha256"] = [hashlib.sha256(c.decode(x).encode("utf-8")).hexdigest() for x in ids]
            else:
                out["ids"] = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
            yield pd.DataFrame(out)

    more = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return docs.select("doc_id", "text").mapInPandas(code, f"doc_id {key}, n_tokens long, {more}")


def decoded(encodings: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids). Null ids: an empty text."""
    key = encodings.schema["doc_id"].dataType.simpleString()

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [c.decode(np.asarray([] if x is None else x, "<u4").tobytes()) for x in b["ids"]]})

    return encodings.select("doc_id", "ids").mapInPandas(code, f"doc_id {key}, text string")
