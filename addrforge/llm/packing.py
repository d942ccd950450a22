"""Best-two-fit packing of tokenised documents into sequences.

Greedy filling and the two-for-one exchange are planned on the histogram of piece lengths alone: at most
CAPACITY counts reach the driver, however many documents there are. A plan is a list of patterns (the
lengths in one sequence) with a multiplicity; every pattern uses up some length, so there are about as
many patterns as lengths. Pieces then take their places by rank within their length: ranks come from
counts by (length, salt), so that a length that very many documents share is never one group.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from addrforge.llm.bpe import SPACE, byte_letters
from addrforge.llm.runtime import chunks, cut, small_batches

CAPACITY, END_ID = 4096, 1
#: Pieces of one length and salt that one task ranks, about.
RANKED_TOGETHER = 100_000
#: Distinct space-separated strings that a worker remembers; beyond it, it forgets and encodes anew.
REMEMBERED = 800_000


class _Words(dict):
    """Pretoken -> its ids by the file's BPE model, each found when first asked for."""

    def __init__(self, model):
        letters = {b: c for c, b in byte_letters().items()}
        self.letters = {n: "".join(letters[b] for b in chr(n).encode()) for n in range(256)}
        self.model = model

    def __missing__(self, word: str) -> bytes:
        out = self[word] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word.translate(self.letters))])
        return out


class _Strings(dict):
    """Space-separated string -> its ids, each found when first asked for.

    Strings of printable Latin-1 are lower-cased and cut into pretokens here, and each distinct pretoken goes to the
    BPE model once: canonical composition leaves them as they are, and their lower case does not depend on
    neighbours. All others, and those that may hold a special token, go through the library's whole chain.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            pattern = self._pattern(json.load(file))
        self.pretokens = regex.compile(pattern or r"(?!)").findall
        self.plain = re.compile("[!-;=-~\xa1-\xff]+" if pattern else r"(?!)").fullmatch
        self.words = _Words(self.tokenizer.model)

    @staticmethod
    def _pattern(spec: dict) -> str | None:
        """The pretokens' pattern, if the file lower-cases and keeps just what the pattern finds."""
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split, *then = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        kept = split.get("behavior") == "Removed" and split.get("invert") and [x["type"] for x in then] == ["ByteLevel"]
        bare = kept and not then[0]["add_prefix_space"] and not then[0]["use_regex"]
        special = all("<" in t["content"] for t in spec["added_tokens"])
        return split["pattern"]["Regex"] if steps == ["NFC", "Replace", "Lowercase"] and bare and special else None

    def __missing__(self, s: str) -> bytes:
        if self.plain(s):
            low = s.lower()
            out = self.words[low] if low.isalpha() else b"".join([self.words[w] for w in self.pretokens(low)])
        else:
            out = np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        self[s] = out
        return out


class SpacedEncoder:
    """A tokenizers file whose pretokens never span white space: ids of a text are those of its space-separated strings."""

    def __init__(self, path: str):
        self.known = _Strings(path)
        # str.split() also cuts at U+001C to U+001F, which are no white space to the tokenizer
        self.odd = re.compile("[\x1c-\x1f]").search
        self.cut = re.compile(f"[^{SPACE}]+").findall

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.known.words) > REMEMBERED // 2:
            self.known.words.clear()
        get = self.known.__getitem__
        return [b"".join(map(get, self.cut(t) if self.odd(t) else t.split())) for t in texts]


_ENCODERS: dict[str, SpacedEncoder] = {}


def _pieces(path: str, capacity: int):
    def run(batches):
        if path not in _ENCODERS:
            _ENCODERS[path] = SpacedEncoder(path)
        end = END_ID.to_bytes(4, "little")
        for part, text in chunks(batches, "text", 8 << 20):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i, coded in enumerate(_ENCODERS[path].encode_batch(text.to_pylist())):
                coded += end
                for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                    piece = coded[at : at + 4 * capacity]
                    for column, value in zip(rows, (i, k, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, piece, start, length, ids_crc32: ids of the whole text, then END_ID, cut only beyond capacity."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_pieces(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-two-fit on a histogram: [(((length, uses), ...) of one sequence, number of such sequences)].

    Each pattern starts with the longest length left and takes the longest that still fits, again and again.
    Then its smallest member gives way to the two unpacked lengths that fill the gap, widened by that
    member, most tightly, if they fill it better. The pattern is repeated as long as all its lengths last.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    sizes = sorted(left)
    out = []

    def largest(most: int, taken: dict[int, int]) -> int:
        k = bisect_right(sizes, most) - 1
        while k >= 0 and left[sizes[k]] - taken.get(sizes[k], 0) <= 0:
            k -= 1
        return sizes[k] if k >= 0 else 0

    while sizes:
        taken: dict[int, int] = {}
        gap = capacity
        while gap and (n := largest(gap, taken)):
            uses = min(gap // n, left[n] - taken.get(n, 0))
            taken[n] = taken.get(n, 0) + uses
            gap -= uses * n
        while gap:
            least = min(taken)
            room = gap + least
            best = (0, 0, 0)
            # the larger of the two runs down from the longest that fits; the smaller is then the longest that still fits
            k = bisect_right(sizes, room - 1) - 1
            while k >= 0 and 2 * sizes[k] >= best[0]:
                a = sizes[k]
                k -= 1
                if left[a] - taken.get(a, 0) <= 0:
                    continue
                b = largest(min(a, room - a), {**taken, a: taken.get(a, 0) + 1})
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
            if best[0] <= least:
                break
            taken[least] -= 1
            if not taken[least]:
                del taken[least]
            for n in best[1:]:
                taken[n] = taken.get(n, 0) + 1
            gap = room - best[0]
        times = min(left[n] // uses for n, uses in taken.items())
        out.append((tuple(sorted(taken.items(), reverse=True)), times))
        for n, uses in taken.items():
            left[n] -= uses * times
            if not left[n]:
                del left[n]
                sizes.remove(n)
    return out


def _slots(planned) -> list[tuple[int, ...]]:
    """Rows (length, from_rank, to_rank, uses, first_sequence, offset): what the ranks of each length are dealt out to."""
    rows, rank, sequence = [], {}, 0
    for members, times in planned:
        offset = 0
        for length, uses in members:
            at = rank.get(length, 0)
            rows.append((length, at, at + uses * times, uses, sequence, offset))
            rank[length] = at + uses * times
            offset += uses * length
        sequence += times
    return rows


def _place(rows):
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    length_at = {int(n): (int(a), int(b)) for n, a, b in zip(*np.unique(table[:, 0], return_index=True), np.append(np.unique(table[:, 0], return_index=True)[1][1:], len(table)), strict=True)} if len(table) else {}

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            found = np.empty(len(length), np.int64)
            for n in np.unique(length):
                a, b = length_at[int(n)]
                mine = length == n
                found[mine] = a + np.searchsorted(table[a:b, 1], rank[mine], side="right") - 1
            at = table[found]
            local = rank - at[:, 1]
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(at[:, 4] + local // at[:, 3]), pa.array(at[:, 5] + local % at[:, 3] * length)], [*keep, "sequence_id", "offset"])

    return run


def pack(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) -> the same rows with sequence_id and offset.

    Equal lengths are interchangeable, so ties need no order; repeated rows are packed as often as they
    come. An empty table gives an empty one.
    """
    spark = cuts.sparkSession
    cuts = cut(cuts)
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    rows = _slots(plan(counts, capacity))
    salts = max(1, -(-max(counts.values(), default=0) // RANKED_TOGETHER))
    salted = cuts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    if salts > 1:
        totals = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        before = totals.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
        salted = salted.join(before, ["length", "salt"])
    else:
        salted = salted.withColumn("before", F.lit(0).cast("long"))
    ranked = salted.withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")) - 1)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return ranked.select(*kept, F.col("rank").cast("long")).mapInArrow(_place(rows), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents -> packed pieces. A null text is empty (its only id is END_ID); other columns are ignored."""
    return pack(pieces(docs, path, capacity), capacity)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer_path())
