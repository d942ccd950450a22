"""Byte-level BPE encoding and decoding of whole texts by prefix-sharing trie traversal.

The pretokens of a batch are distinct words of a trie. A depth-first walk keeps, for every prefix on
the path, the last token of that prefix's encoding; the token that ends a longer prefix is the one
vocabulary suffix whose predecessor state tolerates it (undoing merges across the seam never finds an
earlier merge). A prefix that many words share is therefore encoded once, and a word's ids are read off
by following last tokens backwards.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrforge.llm.runtime import chunks, small_batches

#: White space as the tokenizer's pattern sees it (the Unicode property).
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A space inside a run of white space may not be cut at; texts with such runs take the careful split.
UNSAFE = re.compile(rf"[{SPACE}] (?:[{SPACE}]|\Z)")
CAREFUL = re.compile(rf" (?=[^{SPACE}])|(?<=[^{SPACE}]) ")
#: Distinct pieces and words that a worker remembers; beyond it, it forgets and encodes anew.
REMEMBERED = 1_200_000


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encoder and decoder over a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.cut_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        n = 1 + max([*self.ids.values(), *self.special.values()])
        self.text = [b""] * n
        for s, i in self.ids.items():
            self.text[i] = s
        self.merged: dict[tuple[int, int], int] = {}
        self.rank = [-1] * n  # of the merge that makes a token
        self.parts: list[tuple[int, int] | None] = [None] * n
        for k, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self.ids[raw(left)], self.ids[raw(right)]
            whole = self.ids[raw(left) + raw(right)]
            self.merged[a, b] = whole
            if self.parts[whole] is None:
                self.parts[whole], self.rank[whole] = (a, b), k
        for s, i in self.special.items():
            self.text[i] = s.encode()
        self._automaton()
        self.fits: dict[int, bool] = {}
        self.width = np.array([len(s) for s in self.text])
        self.first = np.concatenate(([0], np.cumsum(self.width)[:-1]))
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.four = [i.to_bytes(4, "little") for i in range(n)]
        self.moves: dict[int, int] = {}
        self.words: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _tolerates(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' joined bytes is just those two tokens.

        Merges are undone from the latest to the earliest on the two sides of the seam; if the parts that
        then meet there have a merge that comes before the one undone, it would have joined them.
        """
        merged, rank, parts = self.merged, self.rank, self.parts
        before = len(self.merged)  # merges from this rank on had not happened yet
        while True:
            whole = merged.get((left, right))
            if whole is not None and rank[whole] < before:
                return False
            if parts[left] is None and parts[right] is None:
                return True
            if rank[left] > rank[right]:
                before = rank[left]
                left = parts[left][1]
            else:  # on a tie, the merge across the seam stands further left and goes first
                before = rank[right] + 1
                right = parts[right][0]

    def _automaton(self) -> None:
        """States are the prefixes of vocabulary entries; each lists the entries that end there, longest first."""
        self.step: dict[int, int] = {}  # state << 8 | byte -> state
        self.fall = [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for raw, token in self.ids.items():
            state = 0
            for k, byte in enumerate(raw):
                key = state << 8 | byte
                state = self.step.get(key, -1)
                if state < 0:
                    state = self.step[key] = len(self.fall)
                    self.fall.append(0)
                    self.ends.append([])
                    by_size.setdefault(k, []).append((key >> 8, byte, state))
            self.ends[state].append((len(raw), token))
        for k in sorted(by_size):  # shorter states first: their falls are known
            for parent, byte, state in by_size[k]:
                if parent:
                    self.fall[state] = self._next(self.fall[parent], byte)
                self.ends[state] += self.ends[self.fall[state]]

    def _next(self, state: int, byte: int) -> int:
        at = state
        while (found := self.step.get(at << 8 | byte)) is None and at:
            at = self.fall[at]
        return found or 0

    def _walk(self, words: list[str]) -> None:
        """Encode distinct words in depth-first order of their trie (sorted order, kept path)."""
        fits, ends, step, four = self.fits, self.ends, self.moves, self.four
        start = len(self.text)  # stands for the beginning of a word
        last, coded, states, path = [start], [b""], [0], b""
        out = self.words
        for word in sorted(words):
            raw = word.encode()
            shared, most = 0, min(len(raw), len(path))
            while shared < most and raw[shared] == path[shared]:
                shared += 1
            del last[shared + 1 :], coded[shared + 1 :], states[shared + 1 :]
            path = raw
            state = states[-1]
            for d in range(shared + 1, len(raw) + 1):
                key = state << 8 | raw[d - 1]
                state = step.get(key)
                if state is None:
                    state = step[key] = self._next(key >> 8, key & 255)
                for n, token in ends[state]:
                    key = last[d - n] << 20 | token
                    ok = fits.get(key)
                    if ok is None:
                        before = last[d - n]
                        ok = fits[key] = self._own(token) if before == start else self._tolerates(before, token)
                    if ok:
                        break
                last.append(token)
                coded.append(coded[d - n] + four[token])
                states.append(state)
            out[word] = coded[-1]

    def _own(self, token: int) -> bool:
        pair = self.parts[token]
        return pair is None or self._own(pair[0]) and self._own(pair[1]) and self._reached(pair)

    def _reached(self, pair: tuple[int, int]) -> bool:
        """Whether the parts stay apart until the merge that joins them."""
        left, right = pair
        before = self.rank[self.merged[pair]]
        return max(self.rank[left], self.rank[right]) < before and self._until(left, right, before)

    def _until(self, left: int, right: int, before: int) -> bool:
        parts, rank, merged = self.parts, self.rank, self.merged
        while parts[left] is not None or parts[right] is not None:
            if rank[left] > rank[right]:
                before = rank[left]
                left = parts[left][1]
            else:
                before = rank[right] + 1
                right = parts[right][0]
            whole = merged.get((left, right))
            if whole is not None and rank[whole] < before:
                return False
        return True

    def _pieces(self, text: str) -> list[str]:
        """Cuts before single spaces at which pretokens always end; all but the first piece had a space before them."""
        return CAREFUL.split(text) if UNSAFE.search(text) else text.split(" ")

    def _learn(self, pieces: set[str], known: dict[str, bytes], lead: str) -> None:
        found = PRETOKEN.findall
        cut = {p: found(lead + p) for p in pieces}
        words = self.words
        new = {w for ws in cut.values() for w in ws if w not in words}
        self._walk(list(new))
        get = words.__getitem__
        for p, ws in cut.items():
            known[p] = b"".join(map(get, ws))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        cut = self.cut_special
        plan = []
        for text in texts:
            marks = [m.group() for m in cut.finditer(text)] if "<|" in text else []
            plan.append(([self._pieces(s) for s in cut.split(text)] if marks else [self._pieces(text)], marks))
        if len(self.spaced) > REMEMBERED:
            self.spaced.clear()
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.bare) > REMEMBERED // 10:
            self.bare.clear()
        if len(self.fits) > 4 * REMEMBERED:
            self.fits.clear()
        if len(self.moves) > 4 * REMEMBERED:
            self.moves.clear()
        spaced: set[str] = set()
        bare: set[str] = set()
        for segments, _ in plan:
            for s in segments:
                spaced.update(s[1:])
                bare.add(s[0])
        self._learn(spaced.difference(self.spaced), self.spaced, " ")
        self._learn(bare.difference(self.bare), self.bare, "")
        get = self.spaced.__getitem__
        out = []
        for segments, marks in plan:
            coded = [self.bare[s[0]] + b"".join(map(get, s[1:])) for s in segments]
            for k, mark in enumerate(marks):
                coded[k] += self.special[mark].to_bytes(4, "little")
            out.append(b"".join(coded))
        return out

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        token = np.frombuffer(ids, "<u4").astype(np.int64)
        width = self.width[token]
        total = int(width.sum())
        at = np.arange(total) + np.repeat(self.first[token] - (np.cumsum(width) - width), width)
        return self.flat[at].tobytes().decode("utf-8", "replace")


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def _encode(path: str):
    def run(batches):
        trie = encoder(path)
        for part, text in chunks(batches, "text", 8 << 20):
            coded = trie.encode_batch(text.to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(coded, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_tokens, ids (little-endian unsigned 32-bit), one row per input row.

    A null text is empty (no ids); other columns are ignored; rows repeat as they come. Texts are encoded
    whole, whatever their length. The strings of special tokens become those tokens.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_encode(path), "doc_id long, n_tokens long, ids binary")


def _decode(path: str):
    def run(batches):
        trie = encoder(path)
        for batch in batches:
            keep = [n for n in batch.schema.names if n != "ids"]
            text = [None if x is None else trie.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(text, pa.string())], [*keep, "text"])

    return run


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, ...) -> doc_id, text; null ids give a null text, no ids the empty text."""
    return coded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")


def _digests(path: str):
    def run(batches):
        trie = encoder(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for part, text in chunks(batches, "text", 8 << 20):
            coded = trie.encode_batch(text.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(map(sha, coded)), pa.array(sha(trie.decode(x).encode()) for x in coded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def op4_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of each document's ids and of their decoding, both made where the text is (ids never travel)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
