"""The sparse suffix array: its sort, its buckets' boundaries and its pieces of long texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from addrforge.llm import suffix_dedup


def sequences(rng, n):
    lead = [bytes(rng.choice(b"ab") for _ in range(suffix_dedup.GRAM)) for _ in range(5)]
    return [(bytes(rng.choice(b"xy\x00") for _ in range(rng.randrange(0, 4))), rng.choice(lead) + bytes(rng.choice(b"c\x00") for _ in range(rng.randrange(0, 20)))) for _ in range(n)]


@pytest.mark.parametrize("short", [4096, 3])
def test_multikey_quicksort_orders_by_leading_bytes_and_tells_equals(monkeypatch, short):
    monkeypatch.setattr(suffix_dedup, "SHORT", short)
    listed = sequences(random.Random(3), 2000)
    held = suffix_dedup.Suffixes(pa.array([x for x, _ in listed], pa.binary()), pa.array([x for _, x in listed], pa.binary()))
    order, new = suffix_dedup.multikey_quicksort(len(listed), held.word, held.n_words)
    assert sorted(order.tolist()) == list(range(len(listed)))
    leads = [listed[i][1][: suffix_dedup.GRAM] for i in order]
    assert leads == sorted(leads)
    assert new.sum() == len(set(listed)) and [listed[a] == listed[b] for a, b in zip(order[:-1], order[1:], strict=True)] == (~new[1:]).tolist()


@pytest.mark.parametrize("bucket, piece", [(60_000, 2 << 20), (25, 2 << 20), (25, 700)])
def test_boundaries_and_pieces_change_nothing(spark, monkeypatch, bucket, piece):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", piece)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5)))
    shared = [" ".join(word() for _ in range(n)) for n in (60, 90, 150)]
    texts = [" ".join([*(word() for _ in range(rng.randrange(40))), rng.choice(shared), *(word() for _ in range(rng.randrange(40)))]) for _ in range(60)]
    texts += [texts[0]] * 20 + ["z" * 199, "z" * 200, "y" * 3000, "", None, shared[2] + shared[2], "q" * 200]
    docs = spark.createDataFrame([(i % 70, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs, bucket)).collect())
    assert got == sorted((i % 70, *w) for i, w in enumerate(suffix_dedup.brute_force(texts)))


def test_digests_do_not_depend_on_the_place():
    data = np.frombuffer(b"k" + bytes(range(250)) + b"zz" + bytes(range(250)), np.uint8)
    one, two = suffix_dedup._digests(data, np.array([1, 253, 2]))
    assert one[0] == one[1] != one[2] and two[0] == two[1] != two[2]
