"""Licence scans by ordered signature rules.

A text is its words, lower-cased and joined by single spaces. An Aho-Corasick pass over all rules'
keywords decides which expressions run at all. Detections then compete: in order of priority and
length, one that lies inside a detection already kept is suppressed. The phrases that every scan must report
(the base) are rules of the same scan that suppression does not touch.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrforge.llm import hashing
from addrforge.llm.license_rules import rules
from addrforge.llm.runtime import small_batches

#: Phrases that are always reported, all places of each, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Labels that claim rights but name no licence, and what they score.
CLAIMS, CLAIM = frozenset(("reserved", "copyright", "proprietary")), 0.3
_TO_SPACE = bytes(int(hashing.LOWER[b]) if hashing.WORD[b] else 32 for b in range(256))


class Scanner:
    def __init__(self, signature_rules=None):
        import ahocorasick

        listed = rules() if signature_rules is None else signature_rules
        self.rules = [(label, priority, re.compile(rf"(?<![^ ]){expression}(?![^ ])")) for label, priority, _, expression in listed]
        by_keyword: dict[str, list[int]] = {}
        for k, (_, _, keyword, _) in enumerate(listed):
            by_keyword.setdefault(keyword, []).append(k)
        for phrase in BASE:
            by_keyword.setdefault(phrase, [])
        self.gate = ahocorasick.Automaton()
        for keyword, found in by_keyword.items():
            self.gate.add_word(keyword, (keyword, found))
        self.gate.make_automaton()
        # a text without the first word of any keyword needs no automaton
        self.quick = re.compile(b"|".join(sorted({re.escape(max(k.split(), key=len).encode()) for k in by_keyword}, key=len)))

    def words(self, text: str) -> bytes:
        return b" ".join(text.encode("utf-8", "surrogatepass").translate(_TO_SPACE).split())

    def scan(self, text: str):
        """Number of words, base places [(first word, phrase)], kept detections [(first word, words, label, priority)]."""
        raw = text.encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()
        joined = b" ".join(raw)
        if not raw or not self.quick.search(joined):
            return len(raw), [], []
        flat = joined.decode("utf-8", "surrogatepass")
        keywords: set[str] = set()
        runs: set[int] = set()
        for _, (keyword, found) in self.gate.iter(flat):
            keywords.add(keyword)
            runs.update(found)
        if not keywords:
            return len(raw), [], []
        spaces = np.flatnonzero(np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        word_at = lambda i: int(np.searchsorted(spaces, i))
        base = []
        padded = f" {flat} "
        for phrase in BASE:
            at = padded.find(f" {phrase} ") if phrase in keywords else -1
            while at >= 0:
                base.append((word_at(at), phrase))
                at = padded.find(f" {phrase} ", at + 1)
        found = []
        for k in runs:
            label, priority, expression = self.rules[k]
            found += [(-priority, -(m.end() - m.start()), m.start(), m.end(), label) for m in expression.finditer(flat)]
        kept: list[tuple[int, int, int, int, str]] = []
        over: dict[int, list[tuple[int, int]]] = {}  # kept stretches by the blocks of 256 letters that they touch
        for f in sorted(found):
            if not any(a <= f[2] and f[3] <= b for a, b in over.get(f[2] >> 8, ())):
                kept.append(f)
                for block in range(f[2] >> 8, (f[3] >> 8) + 1):
                    over.setdefault(block, []).append((f[2], f[3]))
        kept.sort(key=lambda f: f[2])
        return len(raw), sorted(base), [(word_at(a), flat.count(" ", a, b) + 1, label, -p) for p, _, a, b, label in kept]


_SCANNER: list[Scanner] = []
_DETECTION = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))


def _scan(batches):
    if not _SCANNER:
        _SCANNER.append(Scanner())
    for batch in batches:
        rows = [_SCANNER[0].scan(x or "") for x in batch.column("text").to_pylist()]
        places = [[at for at, _ in base] for _, base, _ in rows]
        base_labels = [{BASE[p] for _, p in base} for _, base, _ in rows]
        labels = [b | {d[2] for d in found} for b, (_, _, found) in zip(base_labels, rows, strict=True)]
        # the surest detection counts, by its kind: an identifier, a name or a sentence of the body
        score = [max([0.0, *(CLAIM if x in CLAIMS else 0.9 for x in b), *(CLAIM if d[2] in CLAIMS else min(1.0, d[3] / 300 * 0.5 + 0.5) for d in found)]) for b, (_, _, found) in zip(base_labels, rows, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([len(p) for p in places], pa.int64()),
                pa.array([min(p, default=None) for p in places], pa.int64()), pa.array([max(p, default=None) for p in places], pa.int64()),
                pa.array([",".join(sorted(x)) for x in base_labels], pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score, pa.float64()),
                pa.array([[{"first_word": a, "n_words": n, "label": x, "priority": p} for a, n, x, p in found] for _, _, found in rows], _DETECTION),
            ],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id long, text, ...) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    A null text is empty: no words, no labels, null places. Rows repeat as they come; texts are read whole;
    other columns are ignored; an empty table gives an empty one. Labels are distinct, sorted and comma-joined.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "detections array<struct<first_word: long, n_words: long, label: string, priority: int>>",
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumn("detections", F.to_json("detections"))
