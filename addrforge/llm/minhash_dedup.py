"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF word shingles.

Each document is the weighted set of its five-word shingles: weight (1 + ln tf) * idf. Document
frequencies come from all documents, counted in a hashed sketch of fixed width (so the table that every
task holds is SKETCH numbers however large the corpus is); the idf is damped to [1, 1 + IDF_SPAN], so
that a weighted similarity stays within a few percent of the plain one while passages that very many
documents share draw fewer samples. SAMPLES consistent weighted samples are banded; documents that
share a band are candidates, and a candidate counts only after its weighted Jaccard similarity, computed
from the whole texts, reaches the threshold.

Equal word sequences are one node from the start (a partial aggregate). A band's documents meet one
anchor first, the one with the most company over all its bands. Bands that then still hold several
components are dealt out in pairs of blocks, and every two of their documents of different components are
compared by their samples, once, in the first band they share. Those of a block that agree often enough with another are
sent there with their texts, and verified at once as products of the block's weighted shingle matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from addrforge.llm import hashing
from addrforge.llm.components import connected_components
from addrforge.llm.runtime import chunks, cut, groups, join_spread, small_batches

N_WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS, IDF_SPAN = 16, 0.1
#: Candidates under this share of equal samples are not verified (at 0.8 it is over four deviations off).
LEAST_ESTIMATE = 0.55
#: Documents of a block, and words (a longer document is a block of its own size).
BLOCK, BLOCK_WORDS = 2048, 600_000
#: Shingles of a block that one product takes.
COLUMNS = 4096
#: Resolution of the tabulated Gamma(2, 1) and uniform variates.
_TABLE_BITS = 14


def _tables():
    u = (np.arange(1 << _TABLE_BITS) + 0.5) / (1 << _TABLE_BITS)
    rng = np.random.default_rng(20240229)
    r = -np.log(rng.permutation(u) * rng.permutation(u))
    log_c = np.log(-np.log(rng.permutation(u) * rng.permutation(u)))
    seeds = rng.integers(1, 2**63, SAMPLES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return r.astype(np.float32), (1 / r).astype(np.float32), log_c.astype(np.float32), u.astype(np.float32), seeds


_CACHE: dict = {}


def _weighted(text: pa.Array):
    """Distinct shingles of each text: shingle hash, sublinear term frequency, text offsets, word-sequence hash."""
    data, offsets = hashing.buffers(text)
    start, end, bounds = hashing.words(data, offsets)
    hashes = hashing.word_hashes(data, start, end)
    shingle, at = hashing.shingles(hashes, bounds, N_WORDS)
    doc = np.repeat(np.arange(len(text)), np.diff(at))
    order = np.lexsort((shingle, doc))
    s, d = shingle[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(s)))
    s, d = s[first], d[first]
    up, _ = hashing.powers(len(hashes) + 1)
    sums = np.concatenate(([0], np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64))).astype(np.uint64)
    _, down = hashing.powers(len(hashes) + 1)
    whole = hashing.mix((sums[bounds[1:]] - sums[bounds[:-1]]) * down[bounds[:-1]] + np.diff(bounds).astype(np.uint64))
    return s, (1 + np.log(tf)).astype(np.float32), np.searchsorted(d, np.arange(len(text) + 1)), whole, np.diff(bounds)


def _count_sketch(batches):
    total, n = np.zeros(1 << SKETCH_BITS, np.int64), 0
    for _, text in chunks(batches, "text"):
        s, _, _, _, _ = _weighted(text)
        total += np.bincount((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        n += len(text)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], ["bucket", "n"])


def idf_table(docs: DataFrame) -> np.ndarray:
    """Damped idf of each sketch bucket over all documents: SKETCH entries, whatever the corpus holds."""
    counted = docs.select("text").mapInArrow(_count_sketch, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    bucket, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    table = np.zeros(1 << SKETCH_BITS)
    table[bucket[bucket >= 0]] = n[bucket >= 0]
    docs_n = max(2.0, float(n[bucket < 0].sum()))
    frequency = np.clip(table - np.median(table) + 1, 1, docs_n)  # the median is what rare shingles share a bucket with
    return (1 + IDF_SPAN * (1 - np.log(frequency) / np.log(docs_n))).astype(np.float32)


def _weights(shingle: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return tf * idf[(shingle >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]


def signatures(shingle: np.ndarray, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, SAMPLES) 32-bit samples; equal with the probability of the weighted Jaccard similarity."""
    if "tables" not in _CACHE:
        _CACHE["tables"] = _tables()
    r, inv_r, log_c, beta, seeds = _CACHE["tables"]
    mask = np.uint64((1 << _TABLE_BITS) - 1)
    shift = np.uint64(_TABLE_BITS)
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, SAMPLES), np.uint32)
    if not len(full):
        return out
    begins = at[full]
    sizes = np.diff(np.append(begins, len(shingle)))
    log_w = np.log(weight).astype(np.float32)
    low = (shingle ^ (shingle >> np.uint64(32))) & np.uint64(0xFFFFFFFF)
    index = np.arange(len(shingle))
    for k in range(SAMPLES):
        h = shingle * seeds[k]
        h ^= h >> np.uint64(29)
        i = (h & mask).astype(np.int32)
        j = ((h >> shift) & mask).astype(np.int32)
        m = ((h >> np.uint64(2 * _TABLE_BITS)) & mask).astype(np.int32)
        step = np.floor(log_w * inv_r[i] + beta[j])
        log_a = log_c[m] - r[i] * (step - beta[j] + np.float32(1))
        least = np.minimum.reduceat(log_a, begins)
        where = np.flatnonzero(log_a == np.repeat(least, sizes))
        first = where[np.searchsorted(where, begins)]
        out[full, k] = (hashing.mix(low[first] + (step[first].astype(np.int64).view(np.uint64) << np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    del index
    return out


def _profile(idf: np.ndarray):
    def run(batches):
        for part, text in chunks(batches, "text", 1 << 20):
            s, tf, at, whole, n_words = _weighted(text)
            sig = signatures(s, _weights(s, tf, idf), at)
            bands = [hashing.mix(np.ascontiguousarray(sig[:, b * ROWS : (b + 1) * ROWS]).view(np.uint64).astype(np.uint64) @ np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64) + np.uint64(b)) for b in range(BANDS)]
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1) * BANDS, pa.int32()), pa.array(np.stack(bands, 1).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(whole.view(np.int64)), pa.array(n_words), keys, pa.array([x.tobytes() for x in (sig & np.uint32(0xFFFF)).astype(np.uint16)], pa.binary())],
                ["doc_id", "whole", "n_words", "bands", "sig"],
            )

    return run


def _estimates(batches):
    for b in batches:
        x = np.frombuffer(b"".join(b.column("sig_a").to_pylist()), np.uint16).reshape(-1, SAMPLES)
        y = np.frombuffer(b"".join(b.column("sig_b").to_pylist()), np.uint16).reshape(-1, SAMPLES)
        ok = pa.array((x == y).mean(1) >= LEAST_ESTIMATE)
        yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])


_BLOCK = ["band", "first", "second"]


def _pairs_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one pair of blocks -> the pairs of rows to be verified here: of different components, with samples that agree
    often enough, and without an earlier band in common."""
    band, first, second = (group[c][0].as_py() for c in _BLOCK)
    block, component = group["block"].to_numpy(), group["component"].to_numpy()
    sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint16).reshape(-1, SAMPLES)
    bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
    found = []
    for i in range(0, len(a), 64):
        rows = a[i : i + 64]
        near = component[rows][:, None] != component[b][None, :]
        if first == second:
            near &= rows[:, None] < b[None, :]
        x, y = np.nonzero(near)
        x, y = rows[x], b[y]
        ok = (sig[x] == sig[y]).mean(1) >= LEAST_ESTIMATE
        found.append(np.stack([x[ok], y[ok]]))
    x, y = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    shared = bands[x] == bands[y]
    here = bands[x, shared.argmax(1)] == band if len(x) else np.zeros(0, bool)
    return x[here], y[here]


def _sift(batches):
    """Blocks by samples alone -> the documents of each block that have a pair to be verified there."""
    for group in groups(batches, _BLOCK):
        x, y = _pairs_of(group)
        if len(x):
            some = pa.array(np.unique(np.concatenate((x, y))))
            yield from group.take(some).combine_chunks().to_batches()


def block_similarities(text: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of every two different texts (the diagonal means nothing): the smaller of two weights is a sum over the levels that both counts reach."""
    s, tf, at, _, _ = _weighted(text)
    n = len(text)
    doc = np.repeat(np.arange(n), np.diff(at))
    counts = np.rint(np.exp(tf.astype(np.float64) - 1)).astype(np.int64)
    total = np.bincount(doc, _weights(s, tf, idf).astype(np.float64), n)
    _, column, held_by = np.unique(s, return_inverse=True, return_counts=True)
    both = held_by[column] > 1
    s, doc, counts, column = s[both], doc[both], counts[both], column[both]
    level = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    step = np.where(level > 1, np.log(level) - np.log(np.maximum(level - 1, 1)), 1.0)
    doc, column, s = np.repeat(doc, counts), np.repeat(column, counts), np.repeat(s, counts)
    name, place = np.unique(np.stack([column, level]), axis=1, return_inverse=True)
    weight = np.sqrt(step * idf[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)])
    order = np.argsort(place, kind="stable")
    doc, place, weight = doc[order], place[order], weight[order]
    shared = np.zeros((n, n))
    for begin in range(0, name.shape[1], COLUMNS):
        i, j = np.searchsorted(place, [begin, begin + COLUMNS])
        x = np.zeros((n, min(COLUMNS, name.shape[1] - begin)))
        x[doc[i:j], place[i:j] - begin] = weight[i:j]
        shared += x @ x.T
    return shared / np.maximum(total[:, None] + total[None, :] - shared, 1e-12)


def _verify_blocks(idf: np.ndarray, threshold: float):
    def run(batches):
        for group in groups(batches, _BLOCK):
            x, y = _pairs_of(group)
            near = block_similarities(group["text"].combine_chunks(), idf)[x, y] >= threshold
            parent = np.arange(group.num_rows)
            links = []
            for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
                while parent[i] != i:
                    i = parent[i]
                while parent[j] != j:
                    j = parent[j]
                if i != j:  # links that join what is joined already say nothing
                    parent[max(i, j)] = min(i, j)
                    links.append((i, j))
            node = group["node"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[[x for x, _ in links]], pa.int64()), pa.array(node[[y for _, y in links]], pa.int64())], ["a", "b"])

    return run


def _stars(idf: np.ndarray, threshold: float):
    """Rows sorted by anchor and share, the anchor itself first -> the pairs of an anchor and a document that reach the threshold."""

    def run(batches):
        held = None  # the anchor whose documents may go on in the next slice
        for part, text in chunks(batches, "text", 1 << 20):
            node, own = part.column("node").to_numpy(), part.column("own").to_numpy(zero_copy_only=False)
            if held is not None:
                node, own, text = np.append(held[0], node), np.append(True, own), pa.concat_arrays([held[1], text])
            last = np.flatnonzero(own)[-1]
            held = node[last], text.slice(last, 1)
            s, tf, at, _, _ = _weighted(text)
            weight, sizes = _weights(s, tf, idf).astype(np.float64), np.diff(at)
            docs = np.flatnonzero(~own)
            anchor = np.maximum.accumulate(np.where(own, np.arange(len(own)), 0))[docs]
            rows = np.concatenate((docs, anchor))
            pair = np.repeat(np.tile(np.arange(len(docs)), 2), sizes[rows])
            at_entry = np.arange(sizes[rows].sum()) + np.repeat(at[rows] - (np.cumsum(sizes[rows]) - sizes[rows]), sizes[rows])
            key, value = s[at_entry], weight[at_entry]
            order = np.lexsort((key, pair))
            pair, key, value = pair[order], key[order], value[order]
            twin = np.flatnonzero((pair[1:] == pair[:-1]) & (key[1:] == key[:-1]))
            shared = np.bincount(pair[twin], np.minimum(value[twin], value[twin + 1]), len(docs))
            total = np.bincount(pair, value, len(docs))
            near = shared / np.maximum(total - shared, 1e-12) >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(node[anchor[near]]), pa.array(node[docs[near]])], ["a", "b"])

    return run


def _verified(likely: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Pairs (a, b) of node ids whose whole texts reach the threshold.

    The documents of an anchor a are dealt out in shares; its text is sent once a share, not once a pair.
    """
    shares = likely.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("shares"))
    stars = shares.select(F.col("a").alias("anchor"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.col("a").alias("node"), F.lit(True).alias("own"))
    docs = join_spread(likely, shares, ["a"], F.col("b")).select(F.col("a").alias("anchor"), F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"), F.col("b").alias("node"), F.lit(False).alias("own"))
    rows = stars.unionByName(docs).join(texts.withColumnRenamed("doc_id", "node"), "node").select("anchor", "share", "own", "node", "text")
    return rows.repartition("anchor", "share").sortWithinPartitions("anchor", "share", F.desc("own")).mapInArrow(_stars(idf, threshold), "a long, b long")


def _linked(nodes: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(a, b) links that join the nodes of each component of all verified band pairs.

    First each band's documents meet its anchor, which joins most copies; then, in the bands that still hold several
    components, all pairs of different components, in blocks.
    """
    banded = nodes.select("node", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    # a hub stands in the large bands of its copies, each of which leaves some of them
    left = cut(banded.join(sizes, "band").select("band", "node", (-F.sum("size").over(W.partitionBy("node"))).alias("rank")))
    chosen = left.groupBy("band").agg(F.min(F.struct("rank", "node")).alias("p")).select("band", F.col("p.node").alias("anchor"))
    pairs = join_spread(left, chosen, ["band"], F.col("node")).filter("node <> anchor").select(F.col("anchor").alias("a"), F.col("node").alias("b")).distinct()
    sig = lambda s: nodes.select(F.col("node").alias(s), F.col("sig").alias(f"sig_{s}"))
    likely = cut(pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_estimates, "a long, b long"))
    first = cut(_verified(likely, texts, idf, threshold))
    parts = connected_components(first).withColumnRenamed("id", "node")
    placed = cut(left.select("band", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")))
    weights = nodes.select("node", "n_words", "bands", "sig")
    mixed = placed.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("band")
    apart = placed.join(mixed, "band").join(weights, "node")
    apart = cut(apart)
    blocks = apart.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_words") / BLOCK_WORDS)).alias("blocks"))
    dealt = apart.join(blocks, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "node", "component", "bands", "sig")
    sifted = cut(dealt.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(_sift, dealt.schema))
    many = sifted.join(texts.withColumnRenamed("doc_id", "node"), "node")
    more = many.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(_verify_blocks(idf, threshold), "a long, b long")
    known = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return known.unionByName(more)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id long, text string, ...) -> doc_id, class_id (smallest id of its group), n_class, kept (doc_id = class_id).

    One row per distinct doc_id; rows that share an id are one node. Documents without any word (null and
    empty texts) are in a class of their own, as are rows with a null id, which come back with a null
    class and kept true. Very long texts are sampled whole. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = docs.filter("doc_id is not null")
    idf = idf_table(docs)
    profiles = cut(texts.mapInArrow(_profile(idf), "doc_id long, whole long, n_words long, bands array<long>, sig binary"))
    wordy = profiles.filter("n_words > 0")
    nodes = wordy.groupBy("whole").agg(F.min(F.struct("doc_id", "bands", "sig", "n_words")).alias("s")).select(F.col("s.doc_id").alias("node"), "s.bands", "s.sig", "s.n_words")
    copies = wordy.select("doc_id", "whole").join(wordy.groupBy("whole").agg(F.min("doc_id").alias("node")), "whole").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    nodes = cut(nodes)
    classes = connected_components(_linked(nodes, texts, idf, threshold).unionByName(copies))
    ids = texts.select("doc_id").distinct()
    found = ids.join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
    sizes = found.groupBy("class_id").agg(F.count("*").alias("n_class"))
    out = found.join(sizes, "class_id").select("doc_id", "class_id", "n_class", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    nulls = docs.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("n_class"), F.lit(True).alias("kept"))
    return out.unionByName(nulls)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, with one row of each group of near copies: that of its smallest doc_id.

    Rows with a null doc_id stay; of rows that repeat a doc_id one stays.
    """
    kept = near_duplicates(docs, threshold).filter("kept and doc_id is not null").select("doc_id")
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter("doc_id is null"))


def op3_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def brute_force(texts: dict[int, str], idf: np.ndarray, threshold: float = THRESHOLD) -> dict[int, int]:
    """Class of every text by comparing all pairs: for small tables."""
    ids = sorted(texts)
    held = {}
    for i in ids:
        s, tf, _, _, _ = _weighted(pa.array([texts[i] or ""]))
        held[i] = dict(zip(s.tolist(), _weights(s, tf, idf).astype(float).tolist(), strict=True))
    by = {}
    for i in ids:
        for s in held[i]:
            by.setdefault(s, []).append(i)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        near: dict[int, float] = {}
        for s, w in held[i].items():
            for j in by[s]:
                if j < i:
                    near[j] = near.get(j, 0.0) + min(w, held[j][s])
        for j, both in near.items():
            if both / (sum(held[i].values()) + sum(held[j].values()) - both) >= threshold:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
