"""Operator 10: best-fit packing with large-item matching.

Documents become token ids with an end id; those over the sequence length are cut into full sequences and one first piece that may be
shorter. Packing works on a histogram, how many pieces there are of each length, so its plan depends on the sequence length and not on
the number of documents: large pieces (over a third of a sequence) are matched in greedy pairs, the largest with the largest that fits
beside it, and smaller ones go best-fit into the gaps. The plan says how many bins of each make-up to build; pieces of one length are
interchangeable, so the n-th piece of a length takes the n-th slot of that length. Ranks and slots are split into bounded ranges.

Defined results: null or empty texts are one piece of the end id alone; repeated rows are packed one by one; very long texts are cut whole,
nothing is dropped; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Kept, table
from .tokens import Encoder

LENGTH = 2048
END = 0
PIECES = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long, salt long"
ROWS_PER_RANGE = 1_000_000  # pieces of one length are ranked in ranges of at most about this many


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Token pieces of every text. Only texts over the length are cut; the remainder comes first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.array([*encoder.ids(text), END], "<u4") if text else np.array([END], "<u4")
                n, at, k = len(ids), 0, 0
                while at < n:
                    end = at + (n - at if n <= length else ((n - 1) % length + 1 if k == 0 else length))
                    out.append((doc, key, k, at, end - at, zlib.crc32(ids[at:end].tobytes()), (key ^ k * 0x9E3779B1) & 0x7FFFFFFF))
                    at, k = end, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), KINDS, strict=True)], NAMES)

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(run, PIECES)


NAMES = [x.split(" ")[0] for x in PIECES.split(", ")]
KINDS = [{"long": pa.int64(), "int": pa.int32()}[x.split(" ")[1]] for x in PIECES.split(", ")]


def plan_bins(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """From the number of pieces of each length: (how many bins, the lengths in each), fewest bins that the method finds.

    Large pieces: taking the largest left, the largest other that still fits joins it; as many such pairs are made at once as both
    lengths allow. At most two large pieces share a bin. Then every smaller length, longest first, goes to the fullest bins that take it.
    """
    third = length // 3
    large = sorted(n for n, c in counts.items() if n > third and c)
    left = dict(counts)
    open_bins: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    gaps: list[int] = []
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(many: int, lengths: tuple[int, ...]) -> None:
        gap = length - sum(lengths)
        if gap == 0:
            done.append((many, lengths))
            return
        if gap not in open_bins:
            bisect.insort(gaps, gap)
            open_bins[gap] = []
        open_bins[gap].append((many, lengths))

    while large:
        big = large[-1]
        at = bisect.bisect_right(large, length - big) - 1
        if at < 0:
            put(left[big], (big,))
            large.pop()
            continue
        mate = large[at]
        if mate == big:
            put(left[big] // 2, (big, big)) if left[big] > 1 else None
            odd = left[big] % 2
            large.pop()
            left[big] = odd
            if odd:
                other = large[bisect.bisect_right(large, length - big) - 1] if large else 0
                put(1, (big, other) if other else (big,))
                if other:
                    left[other] -= 1
                    if not left[other]:
                        large.remove(other)
            continue
        many = min(left[big], left[mate])
        put(many, (big, mate))
        for n in (big, mate):
            left[n] -= many
            if not left[n]:
                large.remove(n)
    for small in sorted((n for n, c in counts.items() if n <= third and c), reverse=True):
        rest = counts[small]
        while rest:
            at = bisect.bisect_left(gaps, small)
            if at == len(gaps):
                each = length // small
                full = rest // each
                if full:
                    put(full, (small,) * each)
                if rest % each:
                    put(1, (small,) * (rest % each))
                break
            gap = gaps[at]
            many, lengths = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap], gaps[at]
            each = gap // small
            used = min(many, rest // each)
            if used:
                put(used, lengths + (small,) * each)
                rest -= used * each
            if used < many:
                if rest and rest < each:
                    put(1, lengths + (small,) * rest)
                    rest, used = 0, used + 1
                if used < many:
                    put(many - used, lengths)
    return [x for x in done + [b for bins in open_bins.values() for b in bins] if x[0]]


def slots(plan: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """The plan as runs (length, first rank, count, first bin, offset): ranks of a length in a run lie in consecutive bins."""
    runs, taken, first = [], {}, 0
    for many, lengths in plan:
        at = 0
        for n in lengths:
            runs.append((n, taken.get(n, 0), many, first, at))
            taken[n] = taken.get(n, 0) + many
            at += n
        first += many
    return runs


def pack(parts: DataFrame, kept: Kept, length: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to pieces. The driver sees the histogram, one row per length; the broadcast plan has one row per length."""
    parts = kept.put(parts)
    spark = parts.sparkSession
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most one row per length
    ranges = max(64, -(-sum(counts.values()) // ROWS_PER_RANGE))
    parts = parts.withColumn("range", F.col("salt") % ranges)
    held = parts.groupBy("length", "range").agg(F.count("*").alias("n"))
    bases = held.select("length", "range", (F.sum("n").over(W.partitionBy("length").orderBy("range")) - F.col("n")).alias("base"))
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for n, first, many, bin_, at in slots(plan_bins(counts, length)):
        by_length.setdefault(n, []).append((first, many, bin_, at))
    runs = spark.createDataFrame(list(by_length.items()), "length long, runs array<struct<first:long,many:long,bin:long,at:long>>")
    inside = W.partitionBy("length", "range").orderBy("salt", "row_key", "doc_id", "piece", "start", "ids_crc32")
    ranked = parts.join(bases, ["length", "range"]).join(F.broadcast(runs), "length").withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
    rank = F.col("rank")
    run = F.element_at(F.filter("runs", lambda r: (r["first"] <= rank) & (rank < r["first"] + r["many"])), 1)
    return ranked.withColumn("run", run).select(
        "doc_id", "row_key", "piece", "start", "length", "ids_crc32",
        (F.col("run.bin") + rank - F.col("run.first")).alias("sequence_id"), F.col("run.at").alias("offset"))


def op10_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")), Kept(spark, "pack")).drop("row_key")
