"""Toxicity by Levenshtein automata over a learned lexicon trie, with context windows.

Terms (whole words, and stems written with a closing *) are learned from labelled documents by their
log-odds. The terms form a trie; the Levenshtein automaton of a word (its row of edit distances, cut
off at the allowed distance) is intersected with it, so misspelled terms are found without listing
them; a stem may be misspelled like a word, and words that clean training texts use are no misspellings.
Each hit is weighed by its distance and by its context: inside quotation marks, or near a word of
reported speech, in its own sentence, it counts as quotation and weighs less than abuse. A logistic curve over the summed
evidence gives the score.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrforge.llm.minhash_dedup import _weighted
from addrforge.llm.runtime import chunks, first_by_hash, small_batches

#: Labelled documents of each label that the model is fitted on (the first by hash of doc_id), whole texts.
TRAIN_DOCS = 3000
#: A term stands in this many toxic training documents at least; of as many toxic and clean ones, this share of
#: those it stands in is toxic, and its association with the label is this strong (a log-likelihood ratio).
LEAST_DOCS, LEAST_SHARE, STRENGTH = 8, 0.9, 20.0
#: A word in so many clean training documents that fails LEAST_SHARE is an ordinary word, no misspelling.
ORDINARY_DOCS = 2
STEM_LENGTHS = range(3, 10)
#: Words on either side of a hit that are read as its context, and what a quoted or misspelled hit weighs.
WINDOW, QUOTED, MISSPELLED = 6, 0.25, 0.6
REPORTING = frozenset("said says wrote writes quote quoted quotes cited cites called reported reports word term article sagte schrieb zitat zitiert dit écrit citation dijo escribió cita palabra".split())
OPENING, CLOSING = "“«‹„‘", "”»›“’"
WORDS, SENTENCE_ENDS = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?\n]")
REMEMBERED = 1_000_000


def allowed(n: int) -> int:
    """Edits that a term of n letters tolerates."""
    return 0 if n < 5 else 1 if n < 9 else 2


class Lexicon:
    """Terms with weights in a trie; find() gives the best term of a word with its distance. Ordinary words match only unchanged."""

    def __init__(self, terms: dict[str, float], ordinary: frozenset[str] = frozenset()):
        self.weights = dict(terms)
        self.ordinary = ordinary
        self.root: dict = {}
        for term in terms:
            node, body = self.root, term.rstrip("*")
            for c in body:
                node["edits"] = max(node.get("edits", 0), allowed(len(body)))  # the most that a term below tolerates
                node = node.setdefault(c, {})
            node["edits"] = max(node.get("edits", 0), allowed(len(body)))
            node["stem" if term.endswith("*") else "word"] = term
        # an edit spoils one part of a term cut into (edits + 1): another stands in the word as it is, moved by so many places at most
        parts: dict[tuple[int, int], set[str]] = {}
        for term in terms:
            t = term.rstrip("*")
            k = allowed(len(t))
            step = -(-len(t) // (k + 1))
            for i in range(0, len(t), step):
                parts.setdefault((max(0, i - k), i + k), set()).add(t[i : i + step])
        places = (f".{{{a},{b}}}(?:{'|'.join(map(re.escape, sorted(held)))})" for (a, b), held in sorted(parts.items()))
        self.gate = re.compile("|".join(places) if parts else r"(?!)", re.DOTALL)
        self.known: dict[str, tuple[str, int] | None] = {}
        self.clean: set[str] = set()

    def find(self, word: str) -> tuple[str, int] | None:
        found = self.known.get(word, self)
        if found is self:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = self._intersect(word) if self.gate.match(word) else None
            found = self.known[word] = None if found and found[1] and word in self.ordinary else found
        return found

    def suspects(self, text: str) -> set[str]:
        """Words of the text that are hits; space-separated strings without any are remembered."""
        if len(self.clean) > REMEMBERED:
            self.clean.clear()
        found = set()
        for piece in set(text.split()).difference(self.clean):
            hits = [w for w in WORDS.findall(piece.lower()) if self.find(w)]
            if hits:
                found.update(hits)
            else:
                self.clean.add(piece)
        return found

    def _intersect(self, word: str) -> tuple[str, int] | None:
        """The trie walked together with the word's Levenshtein automaton; fewest edits first, then heavier terms."""
        best = None
        stack = [(self.root, list(range(len(word) + 1)), 0)]
        while stack:
            node, row, depth = stack.pop()
            term = node.get("word")
            if term is not None and row[-1] <= allowed(depth):
                rank = (row[-1], -self.weights[term], term)
                best = min(best, rank) if best else rank
            term = node.get("stem")
            if term is not None and min(row) <= allowed(depth):  # a stem is like some opening of the word
                rank = (min(row), -self.weights[term], term)
                best = min(best, rank) if best else rank
            for c, below in node.items():
                if len(c) > 1:
                    continue
                # cells further from the diagonal than the edits allowed below are over them
                k, new = below["edits"], [len(word) + depth] * (len(word) + 1)
                new[0] = depth + 1
                for i in range(max(0, depth - k), min(len(word), depth + 1 + k)):
                    new[i + 1] = min(new[i] + 1, row[i + 1] + 1, row[i] + (word[i] != c))
                if min(new) <= k:
                    stack.append((below, new, depth + 1))
        return (best[2], best[0]) if best else None


def evidence(text: str, lexicon: Lexicon) -> tuple[float, list[tuple[str, str, bool]]]:
    """Summed weight of the hits in a text, and the hits: (word, term, quoted)."""
    suspects = lexicon.suspects(text)
    if not suspects:
        return 0.0, []
    lowered = text.lower()
    words = [(m.group(), m.start(), m.end()) for m in WORDS.finditer(lowered)]
    ends = [m.start() for m in SENTENCE_ENDS.finditer(lowered)]
    total, hits = 0.0, []
    for i, (word, a, b) in enumerate(words):
        if word not in suspects:
            continue
        term, edits = lexicon.find(word)
        # the hit's sentence, with the mark that closes it
        at = bisect_left(ends, a)
        left, right = ends[at - 1] + 1 if at else 0, ends[at] + 2 if at < len(ends) else len(lowered)
        near = [w for w in words[max(0, i - WINDOW) : i + WINDOW + 1] if left <= w[1] < right]
        before, after = lowered[left:a], lowered[b:right]
        quoted = (
            any(w in REPORTING for w, _, _ in near)
            or (before.count('"') % 2 == 1 and '"' in after)
            or any(o in before and c in after for o, c in zip(OPENING, CLOSING, strict=True))
        )
        total += lexicon.weights[term] * MISSPELLED**edits * (QUOTED if quoted else 1)
        hits.append((word, term, quoted))
    return total, hits


def _terms_of(text: str) -> set[str]:
    words = set(WORDS.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) >= n}  # a stem is met by the word that it is, too


def _count_terms(batches):
    total: Counter[tuple[int, str]] = Counter()
    for batch in batches:
        for toxic, x in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            total.update((toxic, t) for t in _terms_of(x))
        if len(total) > REMEMBERED:
            yield _counted(total)
            total.clear()
    yield _counted(total)


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([t for _, t in total], pa.string()), pa.array([n * x for (x, _), n in total.items()], pa.int64()), pa.array([n * (1 - x) for (x, _), n in total.items()], pa.int64())], ["term", "a", "c"])


def _associated(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """Terms (term, a toxic and c clean documents) that stand for the label; tested where the counts are."""
    a, c, n = F.col("a").cast("double"), F.col("c").cast("double"), float(n_toxic + n_clean)
    cells = [(a, n_toxic, a + c), (n_toxic - a, n_toxic, n - a - c), (c, n_clean, a + c), (n_clean - c, n_clean, n - a - c)]
    strength = sum((F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0) for seen, row, column in cells), F.lit(0.0)) * 2
    often = counts.filter(F.col("a") >= LEAST_DOCS).filter(a / n_toxic >= LEAST_SHARE * (a / n_toxic + c / n_clean))
    return often.withColumn("strength", strength).filter(F.col("strength") >= STRENGTH)


def _sketches(batches):
    """A document's smallest shingle hash: near copies mostly share it, and count once."""
    for part, text in chunks(batches, "text"):
        s, _, at, whole, _ = _weighted(text)
        least = [int(s[a:b].min().view(np.int64)) if b > a else int(w.view(np.int64)) for a, b, w in zip(at[:-1], at[1:], whole, strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), part.column("toxic"), pa.array(least, pa.int64())], ["doc_id", "text", "toxic", "sketch"])


def _misspelled(terms: dict[str, float]):
    """Words (term) that the lexicon takes for a misspelled term."""

    def run(batches):
        lexicon = Lexicon(terms)
        for batch in batches:
            found = map(lexicon.find, batch.column("term").to_pylist())
            yield batch.filter(pa.array([f is not None and f[1] > 0 for f in found], pa.bool_()))

    return run


def _evidences(model: dict):
    def run(batches):
        lexicon = Lexicon(model["terms"], model["ordinary"])
        for batch in batches:
            total = [evidence(x or "", lexicon)[0] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(total, pa.float64())], ["toxic", "evidence"])

    return run


def _choose(rows: list[tuple[str, int, int, float]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms with their log-odds; of nested ones (stems and words that open alike) the strongest association stays.

    Whole words that a chosen term opens stay, too, with its log-odds, as their misspellings may not be the term's.
    """
    scored = [(strength, term, float(np.log((a + 0.5) / (n_toxic - a + 0.5)) - np.log((c + 0.5) / (n_clean - c + 0.5)))) for term, a, c, strength in rows]
    chosen: dict[str, float] = {}
    for _, term, odds in sorted(scored, key=lambda s: (-round(s[0], 6), -len(s[1].rstrip("*")), s[1])):
        body = term.rstrip("*")
        if not any(body.startswith(t.rstrip("*")) or t.startswith(body) for t in chosen):
            chosen[term] = odds
    covered = {}
    for _, term, _ in scored:
        openings = [t for t in chosen if term not in chosen and not term.endswith("*") and term.startswith(t.rstrip("*"))]
        if openings:
            covered[term] = max(chosen[t] for t in openings)
    return chosen | covered


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> dict:
    """(doc_id, text) and (doc_id, toxic) -> model: terms with weights, and the curve's two numbers.

    The sample is bounded by train_docs for each label; near copies count once. Only ids, term counts of the
    bounded sample, its ordinary words that are like a term and one (label, evidence) pair per sampled document are gathered.
    """
    small_batches(docs.sparkSession)
    marked = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = first_by_hash(marked, "toxic", train_docs)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = texts.mapInArrow(_sketches, "doc_id long, text string, toxic int, sketch long").cache()
    once = sample.groupBy("sketch", "toxic").agg(F.min("doc_id").alias("doc_id"))
    once = sample.join(F.broadcast(once.select("doc_id")), "doc_id", "left_semi").select("toxic", "text")
    sizes = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    model = {"terms": {}, "ordinary": frozenset(), "bias": -2.0, "slope": 1.0}
    if sizes.get(0) and sizes.get(1):
        counts = once.repartition(16).mapInArrow(_count_terms, "term string, a long, c long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("c").alias("c")).cache()
        found = _associated(counts, sizes[1], sizes[0]).collect()
        model["terms"] = _choose([(r["term"], r["a"], r["c"], r["strength"]) for r in found], sizes[1], sizes[0])
        clean_words = counts.filter((F.col("c") >= ORDINARY_DOCS) & (F.col("a") / sizes[1] < LEAST_SHARE * (F.col("a") / sizes[1] + F.col("c") / sizes[0])) & ~F.col("term").endswith("*")).select("term")
        model["ordinary"] = frozenset(r["term"] for r in clean_words.mapInArrow(_misspelled(model["terms"]), "term string").collect())
        counts.unpersist()
        got = sample.select("toxic", "text").mapInArrow(_evidences(model), "toxic int, evidence double").toArrow()
        x, y = np.log1p(got["evidence"].to_numpy()), got["toxic"].to_numpy()
        w = np.zeros(2)
        design = np.stack([np.ones(len(x)), x], 1)
        for _ in range(50):  # Newton's steps with a small ridge
            p = 1 / (1 + np.exp(-design @ w))
            step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        model |= {"bias": float(w[0]), "slope": float(w[1])}
    sample.unpersist()
    return model


def _score(model: dict):
    def run(batches):
        lexicon = Lexicon(model["terms"], model["ordinary"])
        for batch in batches:
            found = [evidence(x or "", lexicon) for x in batch.column("text").to_pylist()]
            z = model["bias"] + model["slope"] * np.log1p(np.array([f[0] for f in found], float))
            p = 1 / (1 + np.exp(-z))
            hits = [[{"word": w, "term": t, "quoted": q} for w, t, q in f[1]] for f in found]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, keep), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array(hits, pa.list_(pa.struct([("word", pa.string()), ("term", pa.string()), ("quoted", pa.bool_())])))],
                [*keep, "score", "predicted", "hits"],
            )

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id long, text, ...) -> doc_id, score (0 to 1), predicted (1 if score >= 0.5), hits (word, term, quoted).

    Null and empty texts have no hits and the curve's lowest score. Rows repeat as they come; texts are read
    whole; other columns are never looked at. Without both labels to learn from, the lexicon is empty.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double, predicted int, hits array<struct<word: string, term: string, quoted: boolean>>")


def keep_clean(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, all columns, whose text is not predicted toxic."""

    def run(batches):
        lexicon = Lexicon(model["terms"], model["ordinary"])
        for batch in batches:
            z = [model["bias"] + model["slope"] * np.log1p(evidence(x or "", lexicon)[0]) for x in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([v < 0 for v in z], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("hits").cast("long").alias("n_hits"))
