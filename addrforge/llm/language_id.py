"""Language identification by mixture inference.

A language is a table of byte 4-gram log-likelihoods, learned from labelled documents. A document is a
mixture of languages: each word was written in one of them, and expectation-maximisation over the words
estimates the proportions. The set of languages is chosen by penalised likelihood: the nested sets of
the most probable one, two, ... languages compete under a penalty of half a logarithm of the word count
for each language, and grow until it falls.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrforge.llm import hashing
from addrforge.llm.runtime import chunks, first_by_hash, small_batches

#: Labelled documents of each language that the classifier is fitted on (the first by hash of doc_id), whole texts.
TRAIN_DOCS = 1500
#: The model has 2**GRAM_BITS entries for each language that has a label.
GRAM_BITS, SMOOTHING = 16, 0.5
ROUNDS, PENALTY = 8, 0.5


def _grams(text: pa.Array):
    """Hashed 4-grams that start one byte before each byte of a word, with word starts and each text's words."""
    data, offsets = hashing.buffers(pc.utf8_lower(text))
    start, end, bounds = hashing.words(data, offsets)
    inside = hashing.WORD[data]
    inside &= ~((data >= 48) & (data <= 57))
    flat = np.full(len(data) + 4, 32, np.uint32)
    flat[1 : len(data) + 1] = np.where(inside, data, 32)
    packed = flat[: len(data)] | flat[1 : len(data) + 1] << np.uint32(8) | flat[2 : len(data) + 2] << np.uint32(16) | flat[3 : len(data) + 3] << np.uint32(24)
    at = np.flatnonzero(inside)
    gram = ((packed[at] * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)
    lettered = np.searchsorted(at, end) > np.searchsorted(at, start)
    start, words_before = start[lettered], np.concatenate(([0], np.cumsum(lettered)))
    return gram, np.searchsorted(at, start), words_before[bounds]


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for part, text in chunks(batches, "text"):
        langs = part.column("lang").to_pylist()
        for lang in set(langs):
            rows = pa.array([x == lang for x in langs])
            gram, _, _ = _grams(text.filter(rows))
            total[lang] = total.get(lang, 0) + np.bincount(gram, minlength=1 << GRAM_BITS)
    for lang, counts in total.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(counts[used])], ["lang", "gram", "n"])


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(doc_id, text, lang) -> languages and their (2**GRAM_BITS, languages) log-likelihoods.

    The sample is bounded by train_docs for each language; only its ids travel to the scan of texts.
    """
    small_batches(docs.sparkSession)
    known = docs.filter("lang is not null and doc_id is not null and text is not null")
    chosen = first_by_hash(known.select("doc_id", "lang"), "lang", train_docs).distinct()
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    got = texts.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros((1 << GRAM_BITS, len(langs)))
    if langs:
        column = {x: k for k, x in enumerate(langs)}
        counts[got["gram"].to_numpy(), [column[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
    return langs, np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * len(counts))).astype(np.float32)


def _mixtures(likelihood: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(words, languages) log-likelihoods and each text's words -> (texts, languages) proportions, zero outside the chosen set."""
    n_docs, n_langs = len(at) - 1, likelihood.shape[1]
    counts = np.diff(at)
    full = np.flatnonzero(counts)
    out = np.full((n_docs, n_langs), 1 / max(1, n_langs))
    if not len(full) or not n_langs:
        return out
    begins, sizes = at[full], counts[full]
    doc = np.repeat(np.arange(len(full)), sizes)
    top = likelihood.max(1, keepdims=True)
    p = np.exp(likelihood - top) + np.float32(1e-30)
    base = np.add.reduceat(top[:, 0].astype(np.float64), begins)

    def settle(shares: np.ndarray, rounds: int):
        for _ in range(rounds):
            joint = p * shares[doc]
            joint /= joint.sum(1, keepdims=True)
            shares = (np.add.reduceat(joint, begins) / sizes[:, None]).astype(np.float32)
        return shares, np.add.reduceat(np.log((p * shares[doc]).sum(1) + 1e-38), begins, dtype=np.float64) + base

    shares, _ = settle(np.full((len(full), n_langs), 1 / n_langs, np.float32), ROUNDS)
    order = np.argsort(-shares, axis=1, kind="stable")
    best, chosen = np.full(len(full), -np.inf), shares.copy()
    going = np.arange(len(full))  # texts whose likelihood the last language raised
    for k in range(1, n_langs + 1):
        nested = np.zeros_like(shares)
        np.put_along_axis(nested, order[:, :k], np.take_along_axis(shares, order[:, :k], 1) + np.float32(1e-6), 1)
        nested /= nested.sum(1, keepdims=True)
        nested, score = settle(nested, 0 if k == 1 else 3)
        score = score - PENALTY * k * np.log(sizes)
        better = score > best[going]
        best[going[better]] = score[better]
        chosen[going[better]] = nested[better]
        if not better.any():
            break
        if not better.all():  # the sets of the others grow no more
            words = better[doc]
            going, p, base, sizes, shares, order = going[better], p[words], base[better], sizes[better], shares[better], order[better]
            begins, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    out[full] = chosen
    return out


def _predict(langs: list[str], table: np.ndarray):
    def run(batches):
        for part, text in chunks(batches, "text"):
            gram, start, at = _grams(text)
            # a document's score needs no letter of the model's languages, but any letter at all
            ascii_letters = np.diff(at) > 0
            lettered = [bool(a) and any(map(str.isalpha, t)) for a, t in zip(ascii_letters, text.to_pylist(), strict=True)]
            words = np.add.reduceat(table[gram], start) if len(start) else np.zeros((0, len(langs)), np.float32)
            shares = _mixtures(words, at)
            if langs:
                best = shares.argmax(1)
                pred = [langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                score = np.where(lettered, np.clip(shares.max(1), 0, 1), 0.0)
                mixes = [[{"lang": langs[k], "share": float(row[k])} for k in np.argsort(-row, kind="stable") if row[k] > 0] if ok else [] for row, ok in zip(shares, lettered, strict=True)]
            else:
                pred, score, mixes = ["und"] * len(text), np.zeros(len(text)), [[]] * len(text)
            keep = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(part.column, keep), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixes, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], [*keep, "lang_pred", "score", "languages"])

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id long, text, ...) -> doc_id, lang_pred, score (its share), languages (the chosen set with shares).

    lang_pred is "und" with score 0 if the text is null, empty or without a letter, or nothing was
    learned. Rows repeat as they come; texts are read whole; other columns are never looked at.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_predict(*model), "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>")


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, with a language that has at least this share of the words."""
    predict = _predict(*model)

    def run(batches):
        for batch in batches:
            for found in predict(iter([batch.select(["text"]).append_column("row", pa.array(np.arange(batch.num_rows)))])):
                ok = pc.and_(pc.not_equal(found.column("lang_pred"), "und"), pc.greater_equal(found.column("score"), least))
                yield batch.take(found.column("row").filter(ok))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.to_json("languages").alias("languages"))
