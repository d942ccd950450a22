"""Exact substring removal by a range-partitioned, sparsely sampled suffix array.

A byte goes if a LENGTH-byte string that covers it also starts anywhere else in the corpus.

1. Suffixes. Only content-defined positions start a suffix: in every LENGTH-byte window the leftmost
   smallest GRAM-byte hash marks its anchor, so equal windows mark equal places. All windows of one
   anchor form one run of starts. An anchor whose hash is unique in the corpus repeats nothing and is left out.
2. Range partitions. What is left is dealt out, with its bytes, by sampled splitters over the suffixes' leading bytes (then text
   and place, so that a passage that a third of all texts share is spread over many buckets). Equal texts are one text.
3. Buckets. Each sorts its suffixes by multikey quicksort, eight bytes a key, and compares neighbours byte by byte:
   suffixes with equal leading GRAM bytes form a group, those with equal bytes around the anchor repeat in all windows,
   and the windows of the different ones are sorted and compared with their neighbours in turn.
4. Boundaries. A group at a bucket's edge may go on in the next one: its windows that met no equal are handed
   on as digests of 128 bits and counted across buckets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrforge.llm import hashing
from addrforge.llm.runtime import CHUNK_BYTES, SALTS, chunks, cut, small_batches

#: Bytes of a repeated string, and of the leading tokens that a group of suffixes shares (a multiple of eight).
LENGTH, GRAM = 200, 64
#: Suffixes of a bucket (a bucket is sorted in one worker: some 300 bytes each).
BUCKET = 60_000
#: Suffixes whose windows are compared at a time (some 70 windows each, held as a dozen numbers).
STEP = 5_000
#: Leading bytes that make up more than this part of all repeated ones are dealt to many tasks.
HOT = 1000
#: Segments that quicksort leaves to the pass over all short segments at once.
SHORT = 4096
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_SUFFIX = "k1 long, k2 long, lo int, hi int, left binary, right binary"


def _sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Leftmost place of the smallest key in every run of width keys: block-wise running minima from both ends."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:n], left[width - 1 : width - 1 + n])
    # the leftmost place: smallest i >= s with keys[i] == least[s]
    place = np.empty(n, np.int64)
    at_block = np.arange(n)
    # places of the running minima from the right (leftmost of equals) and from the left (first that reached it)
    idx = np.arange(blocks * width).reshape(blocks, width)
    new = np.ones((blocks, width), bool)
    new[:, 1:] = grid[:, 1:] < np.minimum.accumulate(grid, axis=1)[:, :-1]
    from_left = np.maximum.accumulate(np.where(new, idx, -1), axis=1).ravel()
    back = np.ones((blocks, width), bool)
    back[:, :-1] = grid[:, :-1] <= np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1][:, 1:]
    from_right = np.minimum.accumulate(np.where(back, idx, blocks * width)[:, ::-1], axis=1)[:, ::-1].ravel()
    use_right = right[at_block] == least
    place = np.where(use_right, from_right[at_block], from_left[at_block + width - 1])
    return place


def _anchors(data: np.ndarray):
    """For each anchor of one piece of text: first and last window start, its place, and the hash of its leading bytes."""
    if len(data) < LENGTH:
        return None
    sums = hashing.prefix_sums(data)
    _, down = hashing.powers(len(data) + 1)
    grams = len(data) - GRAM + 1
    keys = hashing.mix((sums[GRAM:] - sums[:-GRAM]) * down[:grams])
    place = _sliding_argmin(keys, LENGTH - GRAM + 1)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(place)) - 1
    at = place[first]
    return first, last, at, keys[at]


def _pieces(batches):
    """(rows, their bytes, piece offsets in them, row and start of each piece): long texts are cut into overlapping pieces."""
    for part, text in chunks(batches, "text"):
        data, offsets = hashing.buffers(text)
        for i in range(len(text)):
            a, b = int(offsets[i]), int(offsets[i + 1])
            for start in range(a, max(a + 1, b - LENGTH + 1), CHUNK_BYTES):
                yield part, i, start - a, data[start : min(b, start + CHUNK_BYTES + LENGTH - 1)]


def _marks(batches):
    """Texts -> one row for each anchor. A run of windows cut between two pieces is two runs, which changes no window."""
    held: list[tuple] = []
    rows = 0

    def flush():
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "k1", "k2", "lo", "hi", "p"])

    for part, i, start, data in _pieces(batches):
        found = _anchors(data)
        if found is None:
            continue
        lo, hi, at, key = found
        held.append((key.view(np.int64), np.full(len(lo), part.column("k1")[i].as_py()), np.full(len(lo), part.column("k2")[i].as_py()), *((c + start).astype(np.int32) for c in (lo, hi, at))))
        rows += len(lo)
        if rows > 50_000:
            yield flush()
            held, rows = [], 0
    if held:
        yield flush()


def _with_bytes(batches):
    """Texts with their anchors -> one suffix for each: the bytes of all its windows before and from the anchor."""
    for part, text in chunks(batches, "text"):
        raws = [x.encode() for x in text.to_pylist()]
        marks = part.column("marks")
        per = np.diff(marks.offsets.to_numpy())
        flat = marks.flatten()
        lo, hi, p = (flat.field(c).to_numpy() for c in ("lo", "hi", "p"))
        doc = np.repeat(np.arange(len(per)), per)
        for begin in range(0, len(doc), 10_000):
            some = slice(begin, begin + 10_000)
            listed = list(zip(doc[some].tolist(), lo[some].tolist(), p[some].tolist(), hi[some].tolist(), strict=True))
            rows = pa.array(doc[some])
            yield pa.RecordBatch.from_arrays(
                [part.column("k1").take(rows), part.column("k2").take(rows), pa.array(lo[some]), pa.array(hi[some]), pa.array([raws[d][a:x] for d, a, x, _ in listed], pa.binary()), pa.array([raws[d][x : b + LENGTH] for d, _, x, b in listed], pa.binary())],
                ["k1", "k2", "lo", "hi", "left", "right"],
            )


class _Bytes:
    """A column of byte strings, read eight bytes at a time as numbers that sort as the bytes do; zeros follow its end."""

    _MASK = np.array([0] + [(0xFFFFFFFFFFFFFFFF << (64 - 8 * n)) & 0xFFFFFFFFFFFFFFFF for n in range(1, 9)], np.uint64)

    def __init__(self, column: pa.Array):
        data, self.offsets = hashing.buffers(column.cast(pa.large_binary()).view(pa.large_string()))
        self.data = np.append(data, np.zeros(16, np.uint8))
        self.sizes = np.diff(self.offsets)
        self._eight = np.ndarray((len(self.data) - 7,), ">u8", self.data, 0, (1,))

    def word(self, rows: np.ndarray, k: np.ndarray) -> np.ndarray:
        rest = np.clip(self.sizes[rows] - 8 * k, 0, 8)
        return self._eight[np.where(rest > 0, self.offsets[rows] + 8 * k, 0)].astype(np.uint64) & self._MASK[rest]


class Suffixes:
    """Suffixes of a bucket as sequences of words: leading bytes, both lengths, the other bytes from the anchor, those before it."""

    LEAD = GRAM // 8

    def __init__(self, left: pa.Array, right: pa.Array):
        self.left, self.right = _Bytes(left), _Bytes(right)
        self.of_right = -(-(self.right.sizes - GRAM) // 8)
        self.n_words = self.LEAD + 1 + self.of_right + -(-self.left.sizes // 8)

    def word(self, rows: np.ndarray, depth: np.ndarray) -> np.ndarray:
        beyond = depth - self.LEAD - 1
        in_left = beyond >= self.of_right[rows]
        out = self.right.word(rows, np.where(beyond < 0, depth, depth - 1))
        if in_left.any():
            out[in_left] = self.left.word(rows[in_left], (beyond - self.of_right[rows])[in_left])
        sizes = beyond == -1
        if sizes.any():
            out[sizes] = (self.right.sizes[rows[sizes]] << 32 | self.left.sizes[rows[sizes]]).astype(np.uint64)
        return out


def multikey_quicksort(n: int, word, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of n sequences of words, and which of them (in that order) differ from the one before.

    A segment of sequences that agree so far is parted around a pivot word into smaller, equal and larger ones, the equal
    ones going on with the next word. Short segments are finished together, one word a pass. n_words may differ only
    between sequences that differ before their ends.
    """
    order = np.arange(n)
    starts, depths = [], []
    stack = [(0, n, 0)] if n else []
    while stack:
        a, b, depth = stack.pop()
        rows = order[a:b]
        if b - a <= SHORT or depth >= n_words[rows[0]]:
            starts.append(a)
            depths.append(depth)
            continue
        w = word(rows, np.full(b - a, depth))
        pivot = np.sort(w[[0, (b - a) // 4, (b - a) // 2, 3 * (b - a) // 4, b - a - 1]])[2]
        less, more = w < pivot, w > pivot
        order[a:b] = np.concatenate((rows[less], rows[~(less | more)], rows[more]))
        one, two = a + int(less.sum()), b - int(more.sum())
        stack += [s for s in ((a, one, depth), (one, two, depth + 1), (two, b, depth)) if s[0] < s[1]]
    new = np.zeros(n, bool)
    by_start = np.argsort(starts)
    starts, depths = np.array(starts, np.int64)[by_start], np.array(depths, np.int64)[by_start]
    new[starts] = True
    sizes = np.diff(np.append(starts, n))
    segment, depth = np.repeat(np.arange(len(starts)), sizes), np.repeat(depths, sizes)
    places = np.flatnonzero((np.repeat(sizes, sizes) > 1) & (depth < n_words[order]))
    segment, depth = segment[places], depth[places]
    while len(places):
        rows = order[places]
        w = word(rows, depth)
        by = np.lexsort((w, segment))
        order[places], w = rows[by], w[by]  # a segment's places are neighbours, and so are its rows after the sort
        first = np.append(True, (segment[1:] != segment[:-1]) | (w[1:] != w[:-1]))
        new[places[first]] = True
        segment = np.cumsum(first) - 1
        depth = depth + 1
        on = (np.bincount(segment)[segment] > 1) & (depth < n_words[order[places]])
        places, segment, depth = places[on], segment[on], depth[on]
    return order, new


def _runs_of(row: np.ndarray, start: np.ndarray):
    """Sorted (row, window start) pairs -> first and last place of each run of neighbouring starts."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))
    begins = np.flatnonzero(first)
    return begins, np.append(begins[1:], len(row)) - 1


_FOUND = "k1 long, k2 long, lo int, hi int, w1 long, w2 long, kind tinyint"
REPEATED, OPEN, WITNESS = 0, 1, 2


def settle_bucket(table: pa.Table) -> list[pa.RecordBatch]:
    """Suffixes of one bucket -> runs of repeated windows, and what its edges hand on: open windows and witnesses of repeated ones."""
    table = table.combine_chunks()
    left, right = table["left"].combine_chunks(), table["right"].combine_chunks()
    k1, k2, lo, hi = (table[c].to_numpy() for c in ("k1", "k2", "lo", "hi"))
    held = Suffixes(left, right)
    order, new = multikey_quicksort(len(lo), held.word, held.n_words)
    n = len(order)
    new_group = np.append(True, np.zeros(n - 1, bool))
    for depth in range(held.LEAD):
        w = held.word(order, np.full(n, depth))
        new_group[1:] |= w[1:] != w[:-1]
    group, same = np.cumsum(new_group) - 1, np.cumsum(new) - 1
    many = np.bincount(same) > 1  # equal bytes around the anchor: repeated in all windows
    full = order[many[same]]
    lead = np.flatnonzero(new)
    of_group = group[lead]
    edge = (of_group == 0) | (of_group == group[-1])
    compared = np.flatnonzero((np.bincount(of_group)[of_group] > 1) | edge)
    out = [_found(k1[full], k2[full], lo[full], hi[full])]
    # the windows of one suffix of each kind, sorted; some thousands of suffixes of whole groups at a time
    begin = 0
    while begin < len(compared):
        end = min(len(compared), begin + STEP)
        while end < len(compared) and of_group[compared[end]] == of_group[compared[end - 1]]:
            end += 1
        some = compared[begin:end]
        begin = end
        rows = order[lead[some]]
        data = np.frombuffer(b"".join(left[r].as_py() + right[r].as_py() for r in rows.tolist()), np.uint8)
        base = np.concatenate(([0], np.cumsum(held.left.sizes[rows] + held.right.sizes[rows])[:-1]))
        per = (hi - lo)[rows] + 1
        owner = np.repeat(np.arange(len(rows)), per)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        w1, w2 = _digests(data, base[owner] + step)
        by = np.argsort(w1, kind="stable")
        here = (base[owner] + step)[by]
        equal = (w1[by][1:] == w1[by][:-1]) & (w2[by][1:] == w2[by][:-1])
        equal[equal] = _same_bytes(data, here[:-1][equal], here[1:][equal])
        twin = np.zeros(len(by), bool)
        twin[1:] |= equal
        twin[:-1] |= equal
        repeated = np.zeros(len(by), bool)
        repeated[by] = twin
        again = np.zeros(len(by), bool)
        again[by[1:]] = equal
        single = ~many[same[lead[some]]]
        a, b = _runs_of(owner[repeated & single[owner]], step[repeated & single[owner]])
        r, t = rows[owner[repeated & single[owner]]], step[repeated & single[owner]]
        out.append(_found(k1[r[a]], k2[r[a]], lo[r[a]] + t[a], lo[r[a]] + t[b]))
        at_edge = edge[some][owner] & ~again
        r, s = rows[owner[at_edge]], step[at_edge]
        seen = (repeated | ~single[owner])[at_edge]
        out.append(_found(k1[r], k2[r], lo[r] + s, lo[r] + s, w1[at_edge].view(np.int64), w2[at_edge].view(np.int64), np.where(seen, WITNESS, OPEN)))
    return out


def _found(k1, k2, lo, hi, w1=None, w2=None, kind=REPEATED) -> pa.RecordBatch:
    n = len(k1)
    w1, w2 = (np.zeros(n, np.int64) if w is None else w for w in (w1, w2))
    columns = [pa.array(k1), pa.array(k2), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(w1), pa.array(w2), pa.array(np.broadcast_to(kind, n).astype(np.int8))]
    return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "lo", "hi", "w1", "w2", "kind"])


def _digests(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = hashing.prefix_sums(data)
    _, down = hashing.powers(len(data) + 1)
    half = LENGTH // 2
    one = hashing.mix((sums[at + half] - sums[at]) * down[at])
    two = hashing.mix((sums[at + LENGTH] - sums[at + half]) * down[at + half])
    return hashing.mix(one * _SECOND + two), one ^ (two * _SECOND)


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    eight = np.ndarray((len(data) - 7,), np.uint64, data, 0, (1,))
    out = np.ones(len(a), bool)
    for k in range(0, LENGTH, 8):
        out &= eight[a + k] == eight[b + k]
    return out


def _buckets(batches):
    held = [b for b in batches if b.num_rows]  # one bucket: about BUCKET suffixes, whatever the corpus holds
    if held:
        yield from settle_bucket(pa.Table.from_batches(held))


def _merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:], len(lo)) - 1]


def _strip(batches):
    for batch in batches:
        texts, runs, whole = batch.column("text"), batch.column("runs"), batch.column("whole").to_pylist()
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "spans", "kept")}
        for i in range(batch.num_rows):
            raw = (texts[i].as_py() or "").encode()
            listed = runs[i].values if runs[i].is_valid else None
            kept, spans = raw, []
            if whole[i]:
                kept, spans = b"", [{"start": 0, "end": len(raw)}]
            elif listed is not None and len(listed):
                lo, hi = _merge(listed.field("lo").to_numpy().astype(np.int64), listed.field("hi").to_numpy().astype(np.int64) + LENGTH)
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(lo, hi, strict=True)]
                kept = b"".join(raw[a:b] for a, b in zip(np.append(0, hi), np.append(lo, len(raw)), strict=True))
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(kept))
            out["n_spans"].append(len(spans))
            out["spans"].append(spans)
            out["kept"].append(kept)
        carried = [n for n in batch.schema.names if n not in ("text", "runs", "whole")]
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, carried), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()),
             pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out["kept"], pa.binary())],
            [*carried, "n_bytes", "n_removed", "n_spans", "spans", "kept"],
        )


def repeated_runs(keyed: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(k1, k2, text) of texts of LENGTH bytes or more -> k1, k2, runs of window starts that also start in another place of a different text or of the same."""
    # computed anew for the count and for the join: cheaper than keeping all of them on disk
    marks = keyed.select("k1", "k2", "text").mapInArrow(_marks, "gram long, k1 long, k2 long, lo int, hi int, p int")
    common = cut(marks.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"))
    total = common.agg(F.sum("n")).first()[0] or 0
    hot = common.filter(F.col("n") > total / HOT).select("gram", F.lit(True).alias("hot"))  # under HOT rows, as their counts add up to the total
    share = F.when(F.col("hot"), F.pmod(F.xxhash64("k1"), F.lit(SALTS))).otherwise(0)
    met = marks.join(F.broadcast(hot), "gram", "left").withColumn("share", share)
    shares = common.withColumn("share", F.explode(F.when(F.col("n") > total / HOT, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    listed = met.join(shares.select("gram", "share"), ["gram", "share"], "left_semi").groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi", "p")).alias("marks"))
    listed = cut(listed)
    n_suffixes = listed.agg(F.sum(F.size("marks"))).first()[0] or 0
    one_each = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"))  # dealt by text, as the join wants it
    suffixes = one_each.join(listed, ["k1", "k2"]).mapInArrow(_with_bytes, _SUFFIX)
    dealt = suffixes.repartitionByRange(max(1, -(-n_suffixes // bucket)), "right", "k1", "k2", "lo")
    found = cut(dealt.mapInArrow(_buckets, _FOUND))
    handed = found.filter(f"kind <> {REPEATED}")
    met = handed.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2")
    settled = handed.filter(f"kind = {OPEN}").join(met, ["w1", "w2"])
    flags = found.filter(f"kind = {REPEATED}").select("k1", "k2", "lo", "hi").unionByName(settled.select("k1", "k2", "lo", "hi"))
    return flags.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))


def remove_repeats(docs: DataFrame, bucket: int = BUCKET, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id long, text string, ...) -> doc_id, the columns named in carry, n_bytes, n_removed, n_spans, spans, kept (the remaining bytes).

    A null text is empty; texts under 200 bytes lose nothing; repeated rows (same id and text) repeat
    each other; rows that share an id keep separate texts; a null id is an id of its own. Columns not named
    in carry are ignored. An empty table gives an empty one. Spans are byte ranges [start, end); a cut
    inside a character is possible, hence kept is binary (see as_text).
    """
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    keyed = keyed.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text"), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))})
    long = keyed.filter(F.octet_length("text") >= LENGTH).select("k1", "k2", "salt", "text")
    copies = long.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("salt").alias("salt"))
    # a text with copies goes as a whole, wherever its rows are dealt to; any other has one row, and is met there
    every = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    where = copies.select("k1", "k2", (F.col("n") > 1).alias("whole"), F.explode(F.when(F.col("n") > 1, every).otherwise(F.array("salt"))).alias("salt"))
    runs = repeated_runs(long, bucket)
    fate = where.filter("whole").select("k1", "k2", "salt", "whole", F.lit(None).cast("array<struct<lo: int, hi: int>>").alias("runs"))
    fate = fate.unionByName(where.filter("not whole").join(runs, ["k1", "k2"]).select("k1", "k2", "salt", "whole", "runs"))
    joined = keyed.join(fate, ["k1", "k2", "salt"], "left").select("doc_id", *(["carried"] if carry else []), "text", "runs", F.coalesce("whole", F.lit(False)).alias("whole"))
    types = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    head = ", ".join(f"{c} {types[c]}" for c in joined.columns[:-3])
    out = joined.mapInArrow(_strip, f"{head}, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary")
    return out.select("doc_id", *(F.col("carried")[c].alias(c) for c in carry), "n_bytes", "n_removed", "n_spans", "spans", "kept")


def as_text(kept):
    """Remaining bytes as text; what a cut left of a character is dropped."""
    return F.replace(F.make_valid_utf8(kept.cast("string")), F.lit("\ufffd"), F.lit(""))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


ORACLE = f"""
WITH bytes AS (SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS raw FROM documents),
hexed AS (SELECT row, doc_id, octet_length(raw) AS n, lower(hex(raw)) AS h FROM bytes),
starts AS (SELECT row, s, substr(h, 2 * s + 1, {2 * LENGTH}) AS w FROM (SELECT row, h, unnest(range(0, greatest(0, n - {LENGTH} + 1))) AS s FROM hexed)),
again AS (SELECT row, s FROM (SELECT row, s, count(*) OVER (PARTITION BY hash(w), w) AS c FROM starts) WHERE c > 1),
runs AS (SELECT row, s, CASE WHEN s <= lag(s) OVER (PARTITION BY row ORDER BY s) + {LENGTH} THEN 0 ELSE 1 END AS new FROM again),
spans AS (SELECT row, min(s) AS a, max(s) + {LENGTH} AS b FROM (SELECT row, s, sum(new) OVER (PARTITION BY row ORDER BY s) AS span FROM runs) GROUP BY row, span),
gaps AS (SELECT h.row, coalesce(s.b, 0) AS a, coalesce(lead(s.a) OVER (PARTITION BY h.row ORDER BY s.b), h.n) AS b FROM hexed h JOIN (SELECT row, a, b FROM spans UNION ALL SELECT row, 0, 0 FROM hexed) s ON s.row = h.row),
kept AS (SELECT h.row, string_agg(substr(h.h, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.a) AS k FROM hexed h JOIN gaps g ON g.row = h.row GROUP BY h.row),
counted AS (SELECT row, sum(b - a) AS removed, count(*) AS n_spans FROM spans GROUP BY row)
SELECT h.doc_id, h.n::BIGINT AS n_bytes, coalesce(c.removed, 0)::BIGINT AS n_removed, coalesce(c.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k.k)) AS kept_sha256
FROM hexed h JOIN kept k ON k.row = h.row LEFT JOIN counted c ON c.row = h.row
"""


def brute_force(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans and kept_sha256 of every text by counting all windows: for small tables."""
    raws = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for raw in raws:
        for s in range(len(raw) - LENGTH + 1):
            seen[raw[s : s + LENGTH]] = seen.get(raw[s : s + LENGTH], 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - LENGTH + 1):
            if seen[raw[s : s + LENGTH]] > 1:
                gone[s : s + LENGTH] = True
        kept = np.frombuffer(raw, np.uint8)[~gone[:-1]].tobytes()
        out.append((len(raw), len(raw) - len(kept), int((gone[:-1] & ~gone[1:]).sum()), hashlib.sha256(kept).hexdigest()))
    return out
