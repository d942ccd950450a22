"""Vector operators against brute force: by dimension, with repeated, null and clashing rows, and by table size."""

import numpy as np
import pytest

from addrforge.llm import embedding_dedup, nearest

SCHEMA = "vec_id long, embedding array<double>, label string, node long, caps string"


def pairs_at(rng, n, d, cosine=0.93):
    x, y = rng.standard_normal((2, n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(1 - cosine**2) * y


@pytest.mark.parametrize("words", [16, 32, 64, 256])
@pytest.mark.parametrize("d", [2, 3, 4, 6, 8, 16, 64, 768])
def test_pairs_at_the_threshold_share_a_filter(d, words):
    x, y = pairs_at(np.random.default_rng(d), 1000 if d < 100 else 200, d)
    held = {}
    shared = [bool(set(a) & set(b)) for a, b in zip(embedding_dedup.filters(x, words, held), embedding_dedup.filters(y, words, held), strict=True)]
    assert np.mean(shared) >= 0.998


def test_decoding_lists_every_cap_a_vector_lies_in():
    x = np.random.default_rng(4).standard_normal((50, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = embedding_dedup.Code(24, 32, 0)
    one, two = code._inner(x)
    for a, b, got in zip(one, two, code.decode(x), strict=True):
        sums = (a[:, None] + b[None, :]).ravel()
        bar = min(code.height, np.sort(sums)[-code.least])
        assert sorted(got.tolist()) == np.flatnonzero(sums >= bar).tolist()


def test_filters_grow_with_the_rows():
    # expected pairs compared a vector stay bounded while vectors grow
    for n in (10**3, 10**5, 10**7):
        words = embedding_dedup.words_for(n)
        assert embedding_dedup.TABLES * embedding_dedup.least_caps(words) ** 2 * n / words**2 <= 2 * embedding_dedup.BUCKET * embedding_dedup.least_caps(words)


def brute(rows, threshold=0.93):
    """n_links and component of each row, by all pairs; rows are (vec_id, vector, label)."""
    ok = [r[0] is not None and r[2] is not None and bool(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted((repr(r[0]), links[i], least.get(root(i)) if ok[i] else r[0]) for i, r in enumerate(rows))


def test_links_with_repeated_null_and_clashing_rows(spark):
    rows = [
        (1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (3, [-0.0, 1.0], "a"), (4, [0.0, 1.0], "a"), (4, None, "a"), (1, [0.5, 0.5], None), (1, [0.0, -1.0], "a"), (2, [0.0, -2.0], "a"),
        (5, [1.0, 0.0], "b"), (6, [1e300, 0.0], "b"), (7, [5e-324, 0.0], "b"), (8, [0.0, 0.0], "b"), (9, [float("inf"), 1.0], "b"), (None, [1.0, 0.0], "b"), (10, [1.0], "b"), (11, [2.0], "b"), (12, [-1.0], "b"), (13, [], "b"),
        (14, [1.0, 0.0, 0.0], "b"), (14, [1.0, 0.0, 0.0], "b"), (15, [None, 1.0], "b"),
    ]
    got = embedding_dedup.link_vectors(spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)).collect()
    assert sorted((repr(r["vec_id"]), r["n_links"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in got)


def test_nearest_recall_ties_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 32))
    x = (centres[rng.integers(0, 20, 3000)] + 0.5 * rng.standard_normal((3000, 32))).tolist()
    rows = [(i, v, "l", 1, "c") for i, v in enumerate(x)]
    rows += [(5000 + i, x[0], "l", 1, "c") for i in range(15)] + [(7, x[7], "l", 1, "c"), (6000, None, "l", 1, "c"), (6020, [0.0] * 32, "l", 1, "c"), (None, x[1], "l", 1, "c"), (6040, [1.0], "l", 1, "c"), (6060, [float("nan")] * 32, "l", 1, "c")]
    table = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in nearest.nearest_neighbours(table, table.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, y = np.array([*range(3000), *range(5000, 5015)]), np.array(x + [x[0]] * 15)
    hits = 0
    for q, found in got.items():
        found.sort()
        d = ((y - y[ids == q][0]) ** 2).sum(1)
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        hits += len({v for _, v, _ in found} & set(want.tolist()))
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(abs(s - np.sqrt(d[ids == v][0])) < 1e-9 for _, v, s in found)
    assert sorted(got) == sorted(ids[ids % 20 == 0].tolist()) and hits >= 0.9 * 10 * len(got)
    assert [v for _, v, _ in got[0]] == list(range(5000, 5010))


def test_cells_and_open_cells_agree_with_boxes():
    rng = np.random.default_rng(8)
    p = rng.standard_normal((500, 4))
    cuts = nearest.Cuts(p[:200], 13)
    leaf = np.flatnonzero(cuts.cell >= 0)
    low, high = cuts.low[leaf][np.argsort(cuts.cell[leaf])], cuts.high[leaf][np.argsort(cuts.cell[leaf])]
    home = cuts.home(p)
    assert ((p >= low[home]) & (p < high[home])).all()
    point, cell = cuts.open(p, np.full(500, 0.3))
    want = {(i, c) for i in range(500) for c in np.flatnonzero(nearest.box_distance(p[i], low, high) <= 0.3).tolist()}
    assert set(zip(point.tolist(), cell.tolist(), strict=True)) == want
