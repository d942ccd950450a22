"""MinHash candidates: similarities of whole blocks, and groups that share bands without linking."""

import random

import numpy as np
import pyarrow as pa

from addrforge.llm import minhash_dedup


def similar(a, b, idf):
    held = []
    for t in (a, b):
        s, tf, _, _, _ = minhash_dedup._weighted(pa.array([t]))
        held.append(dict(zip(s.tolist(), minhash_dedup._weights(s, tf, idf).astype(float).tolist(), strict=True)))
    both = sum(min(w, held[1][s]) for s, w in held[0].items() if s in held[1])
    return both / max(sum(held[0].values()) + sum(held[1].values()) - both, 1e-12)


def test_block_similarities_equal_those_of_pairs(monkeypatch):
    monkeypatch.setattr(minhash_dedup, "COLUMNS", 7)
    rng = random.Random(2)
    idf = np.linspace(1, 1.1, 1 << minhash_dedup.SKETCH_BITS).astype(np.float32)
    line = "a b c d e f g h i j".split()
    texts = ["", "a", "a b c d e f"] + [" ".join(rng.choice(line[:4]) for _ in range(40)) for _ in range(6)] + [" ".join(line * k) for k in (1, 3, 9)]
    got = minhash_dedup.block_similarities(pa.array(texts), idf)
    want = np.array([[similar(a, b, idf) for b in texts] for a in texts])
    apart = ~np.eye(len(texts), dtype=bool)
    assert np.allclose(got[apart], want[apart], atol=1e-5)


def test_groups_under_the_threshold_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(150)]
    texts = [" ".join([*shared, *(word() for _ in range(rng.randrange(25, 45)))]) for _ in range(70)]
    texts += [t.replace(t.split()[-3], "changed") for t in texts[::5]]
    rng.shuffle(texts)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(table).collect()}
    assert got == minhash_dedup.brute_force(dict(enumerate(texts)), minhash_dedup.idf_table(table))
