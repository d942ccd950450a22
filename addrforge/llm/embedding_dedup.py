"""Embedding near-duplicates by spherical-cap filters.

Unit vectors are turned by each of TABLES fixed random rotations and cut into two blocks. Each block has a code of
random unit directions; every pair of a first and a second code word is a filter direction (a product
code), and a vector is list-decoded to all filters whose cap it lies in. Equal-label vectors that share a
filter are compared, in blocks, and linked if their cosine reaches the threshold.

The code grows with the rows: a label of n vectors has so many words that a filter holds about BUCKET of them,
so the pairs compared grow with n, not with its square. Vectors of few dimensions are turned inside a space of
LEAST_DIMENSIONS, where random caps cover every pair alike.

Equal vectors are one node from the start. A pair that shares several filters counts in the first one
only, and a filter's bucket gives back a number of links for each vector and spanning links of each
group, never its pairs. A large bucket is dealt out in pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrforge.llm.components import connected_components
from addrforge.llm.runtime import cut, join_spread, small_batches
from addrforge.llm.vectors import is_usable, matrix

THRESHOLD = 0.93
#: Independent rotations and codes, whose filters are united.
TABLES = 2
#: Vectors that a filter should hold, and the bounds of a block's code words (a power of two).
BUCKET, FEWEST_WORDS, MOST_WORDS = 128, 16, 1 << 14
#: Dimensions that shorter vectors are padded to before they are turned.
LEAST_DIMENSIONS = 16
#: Vectors of a bucket that are compared with as many others at once.
BLOCK = 1500
#: Codes that a worker holds at a time.
_HELD = 2


def least_caps(words: int) -> int:
    """Filters that every vector is put in at least, of each table.

    Simulated random pairs at the threshold without a common filter: of 20,000 each at 2, 3, 6, 16 and 64 dimensions
    (6,000 at 384) 0 or 1 at 16 and 32 words, 0 at 64, 0 to 2 at 256; see the tests.
    """
    return 4 * (int(words).bit_length() - 3)


def words_for(n: int) -> int:
    """Code words of a block for a label of n different vectors."""
    words = FEWEST_WORDS
    while words < MOST_WORDS and n * least_caps(words) > BUCKET * words * words:
        words *= 2
    return words


class Code:
    """Rotation, code words of the two blocks and cap height of one table: the same for the same three numbers."""

    def __init__(self, dimensions: int, words: int, table: int):
        self.padded, self.words, self.least = max(dimensions, LEAST_DIMENSIONS), words, least_caps(words)
        rng = np.random.default_rng(5 + 1000 * table + self.padded)
        self.rotation, _ = np.linalg.qr(rng.standard_normal((self.padded, self.padded)))
        self.half = self.padded - self.padded // 2
        self.books = []
        for size in (self.half, self.padded // 2):
            book = rng.standard_normal((words, size))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True))
        x = np.random.default_rng(99).standard_normal((200, self.padded))
        # one random unit vector in ten lies in more caps than it is put in at least
        self.height = float(np.quantile(self._best(*self._inner(x / np.linalg.norm(x, axis=1, keepdims=True)))[2], 0.9))

    def _inner(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = np.pad(x, ((0, 0), (0, self.padded - x.shape[1]))) @ self.rotation
        return turned[:, : self.half] @ self.books[0].T, turned[:, self.half :] @ self.books[1].T

    def _best(self, one: np.ndarray, two: np.ndarray):
        """The least + 1 best words of either block in falling order, and each vector's least-best sum of two words."""
        width = min(self.least + 1, self.words)
        tops = []
        for inner in (one, two):
            some = np.argpartition(-inner, width - 1, axis=1)[:, :width]
            order = np.argsort(-np.take_along_axis(inner, some, 1), axis=1, kind="stable")
            tops.append(np.take_along_axis(some, order, 1))
        sums = np.take_along_axis(one, tops[0], 1)[:, :, None] + np.take_along_axis(two, tops[1], 1)[:, None, :]
        flat = sums.reshape(len(one), -1)
        return tops, sums, -np.partition(-flat, self.least - 1, axis=1)[:, self.least - 1]

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """All filters whose cap each unit vector lies in, and its least best ones: filter numbers."""
        one, two = self._inner(x)
        tops, sums, best = self._best(one, two)
        bar = np.minimum(best, self.height)
        inside = sums >= bar[:, None, None]
        number = tops[0][:, :, None] * self.words + tops[1][:, None, :]
        # words beyond those listed can only matter if the last one listed still reaches the cap
        more = (inside[:, -1, 0] | inside[:, 0, -1]) if sums.shape[1] < self.words else np.zeros(len(x), bool)
        return [self._falling(one[i], two[i], bar[i]) if more[i] else number[i][inside[i]] for i in range(len(x))]

    def _falling(self, one: np.ndarray, two: np.ndarray, bar: float) -> np.ndarray:
        """First words in falling order, and for each only the second ones that still reach the bar."""
        by_one, by_two = np.argsort(-one), np.argsort(-two)
        falling, out = two[by_two], []
        for i in by_one:
            n = int(np.searchsorted(-falling, one[i] - bar, side="right"))
            if not n:
                break
            out.append(i * self.words + by_two[:n])
        return np.concatenate(out)


def filters(x: np.ndarray, words: int, codes: dict | None = None) -> list[np.ndarray]:
    """Sorted filter numbers of each unit vector, over all tables."""
    codes = {} if codes is None else codes
    key = (x.shape[1], words)
    if key not in codes:
        while len(codes) >= _HELD:
            codes.pop(next(iter(codes)))
        codes[key] = [Code(*key, table) for table in range(TABLES)]
    each = [[f + table * words * words for f in code.decode(x)] for table, code in enumerate(codes[key])]
    return [np.sort(np.concatenate(f)).astype(np.uint32) for f in zip(*each, strict=True)]


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first: squares of very large or small numbers would leave the range of doubles
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decode(batches):
    codes: dict = {}
    for batch in batches:
        kinds = np.stack([batch.column("d").to_numpy(), [words_for(n) for n in batch.column("n_label").to_pylist()]], 1)
        for d, words in np.unique(kinds, axis=0).tolist():
            of = np.flatnonzero((kinds[:, 0] == d) & (kinds[:, 1] == words))
            for some in np.array_split(of, -(-len(of) // 512)):
                part = batch.take(pa.array(some))
                found = filters(_unit(matrix(part.column("embedding"))), words, codes)
                columns = [*(part.column(c) for c in ("node", "label", "embedding", "n", "d")), pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64())), pa.array([f.tobytes() for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "label", "embedding", "n", "d", "caps", "all_caps"])


def _roots(parent: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = of
    while (parent[at] != at).any():
        at = parent[at]
    return at


def _members(listed: list[bytes], cap: int) -> np.ndarray:
    """0/1 matrix: which vector lies in which filter before this one."""
    owner, value = np.repeat(np.arange(len(listed)), [len(c) // 4 for c in listed]), np.frombuffer(b"".join(listed), np.uint32)
    earlier = value < cap
    names, column = np.unique(value[earlier], return_inverse=True)
    out = np.zeros((len(listed), max(1, len(names))), np.float32)
    out[owner[earlier], column] = 1
    return out


def compare_bucket(x: np.ndarray, n: np.ndarray, listed: list[bytes], cap: int, in_first: np.ndarray, in_second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of one filter -> links that count here of each, and the first vector of its group.

    Rows of in_first meet those of in_second; each unordered pair once.
    """
    a, b = np.flatnonzero(in_first), np.flatnonzero(in_second)
    same = len(a) == len(b) and (a == b).all()
    links, parent = np.zeros(len(n)), np.arange(len(n))
    for i in range(0, len(a), 512):
        rows = a[i : i + 512]
        linked = x[rows] @ x[b].T >= threshold
        if same:
            linked &= rows[:, None] < b[None, :]
        touched = linked.any(1)
        if not touched.any():
            continue
        rows, linked = rows[touched], linked[touched]
        columns = linked.any(0)
        others, linked = b[columns], linked[:, columns]
        for r, cells in zip(rows, linked, strict=True):  # one tree for each group found here
            roots = np.unique(_roots(parent, np.append(others[cells], r)))
            parent[roots] = roots.min()
        both = np.append(rows, others)
        member = _members([listed[k] for k in both], cap)
        counted = linked & ~(member[: len(rows)] @ member[len(rows) :].T > 0)  # the rest counted in an earlier filter
        links[rows] += counted @ n[others]
        links[others] += counted.T @ n[rows]
    return links, _roots(parent, np.arange(len(n)))


_KEY = ["label", "d", "cap", "first", "second"]


def _compare(threshold: float):
    """Rows sorted by bucket and pair of blocks -> (node, links counted here, another node of its group or null)."""

    def settle(table: pa.Table):
        table = table.combine_chunks()
        n_rows = table.num_rows
        new = np.zeros(n_rows, bool)
        new[:1] = True
        for c in _KEY:
            column = table[c].combine_chunks()
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n_rows - 1)).to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], n_rows)
        cap, first, second, block = (table[c].to_numpy() for c in ("cap", "first", "second", "block"))
        node, n = table["node"].to_numpy(), table["n"].to_numpy().astype(np.float64)
        vectors, listed = table["embedding"].combine_chunks(), table["all_caps"].to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        for i, j in zip(begins, ends, strict=True):
            if j - i < 2:
                continue
            links, root = compare_bucket(_unit(matrix(vectors.slice(i, j - i))), n[i:j], listed[i:j], cap[i], block[i:j] == first[i], block[i:j] == second[i], threshold)
            keep = np.flatnonzero((links > 0) | (root != np.arange(j - i)))
            out[0].extend(node[i + keep].tolist())
            out[1].extend(links[keep].astype(np.int64).tolist())
            out[2].extend(int(node[i + r]) if r != k else None for k, r in zip(keep, root[keep], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["node", "links", "other"])

    def run(batches):
        held = None  # rows of the last bucket seen: more may follow
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            last = pa.array(np.ones(table.num_rows, bool))
            for c in _KEY:
                last = pc.and_(last, pc.equal(table[c], table[c][-1]))
            whole = int(pc.sum(pc.invert(last)).as_py())
            if whole:
                yield settle(table.slice(0, whole))
            held = table.slice(whole)
        if held is not None:
            yield settle(held)

    return run


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id long, embedding array<float>, label, ...) -> vec_id, n_links, component_id, kept, one row per input row.

    Vectors that are null, empty, zero or hold null or non-finite numbers, rows without a label and vectors of
    another length than their partner link with nothing. Equal vectors of one label link with each other.
    Rows that repeat a vec_id are separate vectors, each with its own links and component. A null vec_id links with
    nothing and comes back with a null component. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kind = dict(vectors.dtypes)["embedding"]
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    rows = rows.withColumn("usable", is_usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # -0.0 and 0.0 are one value to the comparison, so to the key
    good = rows.filter("usable").withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0).cast(kind[6:-1])))
    keyed = cut(good.select("vec_id", "label", "embedding", F.size("embedding").alias("d"), F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding", "label").alias("h2")))
    nodes = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("d").alias("d"), F.first("embedding").alias("embedding"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    sizes = nodes.groupBy("label", "d").agg(F.count("*").alias("n_label"))
    sized = join_spread(nodes.select("node", "label", "embedding", "n", "d"), sizes, ["label", "d"], F.col("node"))
    found = cut(sized.mapInArrow(_decode, f"node long, label string, embedding {kind}, n long, d int, caps array<long>, all_caps binary"))
    # only buckets over a block are dealt out, so only they need to be known; written, they are broadcast only if small enough
    large = cut(found.select("label", "d", F.explode("caps").alias("cap")).groupBy("label", "d", "cap").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK))
    placed = found.withColumn("cap", F.explode("caps")).drop("caps").join(large, ["label", "d", "cap"], "left")
    placed = placed.withColumn("blocks", F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1).cast("long"))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "label", "d", "cap", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "node", "n", "embedding", "all_caps"
    )
    counted = cut(dealt.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_compare(threshold), "node long, links long, other long"))
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(counted.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "node")
    named = cut(nodes.select("h1", "h2", "node", "n", "least").join(links, "node", "left").join(parts, "node", "left"))
    least = named.filter("component is not null").groupBy("component").agg(F.min("least").alias("component_id"))
    named = join_spread(named, least, ["component"], F.col("node"), "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    classed = join_spread(keyed.select("vec_id", "h1", "h2"), named, ["h1", "h2"], F.col("vec_id")).select("vec_id", "n_links", "component_id")
    rest = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return classed.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM good UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
part AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(p.c, e.vec_id) AS component_id, coalesce(p.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN part p ON p.a = e.vec_id LEFT JOIN counts n ON n.a = e.vec_id
"""
