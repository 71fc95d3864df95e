"""Operator 12: alignment of two tokenizers' tokens of the same text.

Tokens of A (byte-level, of a space and the text) and B (pieces of the text, which put a space before it) tile the same bytes. Every token points to its
farthest-right overlapping token of the other side; doubling successors, vectorised over many documents at once, ends at each component's terminal token,
whose place labels the group. Groups, and links between the tokens that end together, are found inside a document's row. What the corpus says of a pair of ids
is a count by pair: two tokens that end together are one the end of the other, so pairs are bounded by the two vocabularies (324,300 for the given ones,
``pair_bound``), however many documents there are, and their counts may be broadcast.

Defined results: null and empty texts, and texts that a tokenizer changes (its tokens' bytes are not a space and the text), have no tokens; special strings are plain
text; ties for the highest count are all best; repeated rows and null doc_ids are aligned one by one; very long texts are read whole; empty tables
give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import ForcedEncoder, Vocabulary
from .common import Kept, table
from .tokens import RUNS, Encoder

#: Bytes of text that are aligned in one go (a longer document by itself), and what an id of A is multiplied by in a pair's number.
GO, PAIR = 1 << 20, 1 << 16


class Pieces:
    """Ids of a sentencepiece model, and the bytes that each id stands for."""

    def __init__(self, name: str = "piece_bpe_32k", folder: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}.model" if folder else public_tokenizers.path(f"{name}.model"))
        piece = self.model.id_to_piece
        self.bytes_of = [bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.model.piece_size())]

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def doubled(successor: np.ndarray) -> np.ndarray:
    """The terminal of every node: successors of successors until nothing moves."""
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            return successor
        successor = further


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The group of each token of A and of B, and the last tokens of A and B of every group, of two tilings of the same bytes."""
    starts_a, starts_b = np.concatenate([[0], ends_a[:-1]]), np.concatenate([[0], ends_b[:-1]])
    n = len(ends_a)
    to_b = np.searchsorted(starts_b, ends_a, "left") - 1  # the last token of B that overlaps a token of A ends no earlier than it
    to_a = np.searchsorted(starts_a, ends_b, "left") - 1
    last = ends_a[to_a] == ends_b  # both end: the token of B is the terminal
    terminal = doubled(np.concatenate([to_b + n, np.where(last, np.arange(n, n + len(ends_b)), to_a)])) - n
    number = np.cumsum(last) - 1
    return number[terminal[:n]], number[terminal[n:]], to_a[last], np.flatnonzero(last)


class Aligner:
    """Ids, groups and links of texts under two vocabularies."""

    def __init__(self, a: str = "byte_bpe_50k", b: str = "piece_bpe_32k", folder: str | None = None):
        self.vocabulary, self.pieces = Vocabulary(a, folder), Pieces(b, folder)
        self.encoder, self.plain = ForcedEncoder(self.vocabulary), Encoder(a, folder).plain
        size_a = max(self.vocabulary.bytes_of) + 1
        if size_a > PAIR or len(self.pieces.bytes_of) > PAIR:
            raise ValueError("pairs of ids are numbered for vocabularies of up to 65536 tokens")
        self.length_a = np.array([len(self.vocabulary.bytes_of.get(i, b"")) for i in range(size_a)])
        self.length_b = np.array([len(x) for x in self.pieces.bytes_of])
        # an id and what follows it: , inside its side's part of the group, | between A's part and B's, ; between groups
        self.written = [f"{i}{end}" for size, two in ((size_a, ",|"), (len(self.length_b), ",;")) for end in two for i in range(size)]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B; none where a side's bytes are not a space and the text."""
        none = np.zeros(0, np.int32)
        if not text:
            return none, none
        whole, b = " " + text, self.pieces.ids(text)
        if b"".join([self.pieces.bytes_of[i] for i in b]) != whole.encode():
            return none, none
        # texts with long runs go through forced boundaries, others through tiktoken: the ids are the same. A spells every text byte by byte, so its bytes never differ
        a = self.encoder.ids(whole, special=False) if RUNS.search(text) else np.array(self.plain(whole), np.int32)
        return a, np.array(b, np.int32)

    def align(self, texts: list[str | None]) -> list[tuple]:
        """(ids of A, ids of B, groups of A's tokens, groups of B's tokens, links) per text; a link is id of A * 65536 + id of B."""
        found = [self.tokens(t) for t in texts]
        a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        if not len(a):
            return [(*x, *x, np.zeros(0, np.int64)) for x in found]
        group_a, group_b, last_a, last_b = groups(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))
        links = a[last_a].astype(np.int64) * PAIR + b[last_b]
        out, i, j, g = [], 0, 0, 0
        for x, y in found:  # documents follow each other, so that each begins a group
            m, n = i + len(x), j + len(y)
            h = int(group_a[m - 1]) + 1 if len(x) else g
            out.append((x, y, group_a[i:m] - g, group_b[j:n] - g, links[g:h]))
            i, j, g = m, n, h
        return out

    def text(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
        """The groups as a1,a2|b1;a3|b2,b3 with decimal ids in order."""
        if not len(a):
            return ""
        size_a, size_b = len(self.length_a), len(self.length_b)
        n = int(group_a[-1]) + 1
        ends_a, ends_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        before_a = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n))[:-1]])
        placed = np.empty(len(a) + len(b), np.int64)
        placed[np.arange(len(a)) + before_a[group_a]] = a + size_a * ends_a
        placed[np.arange(len(b)) + np.cumsum(np.bincount(group_a, minlength=n))[group_b]] = b + 2 * size_a + size_b * ends_b
        written = self.written
        return "".join([written[k] for k in placed.tolist()])[:-1]


def _goes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """doc_ids and texts in goes of ``GO`` bytes or one document."""
    for batch in batches:
        docs, texts, held = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if texts and held + len(text or "") > GO:
                yield docs, texts
                docs, texts, held = [], [], 0
            docs.append(doc)
            texts.append(text)
            held += len(text or "")
        if docs:
            yield docs, texts


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), pa.array(np.concatenate(arrays), kind))


def align(docs: DataFrame, a: str = "byte_bpe_50k", b: str = "piece_bpe_32k", folder: str | None = None) -> DataFrame:
    """doc_id, a_ids, b_ids, and the groups (from 0) of their tokens, of every text."""
    names = ["a_ids", "b_ids", "a_groups", "b_groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        aligner = Aligner(a, b, folder)
        for docs, texts in _goes(batches):
            found = aligner.align(texts)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *(_lists([x[k] for x in found], pa.int32()) for k in range(4))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} array<int>" for n in names))


def align_links(docs: DataFrame, a: str = "byte_bpe_50k", b: str = "piece_bpe_32k", folder: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and links (pairs of ids as numbers) of every text: the alignment without its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        aligner = Aligner(a, b, folder)
        for docs, texts in _goes(batches):
            found = aligner.align(texts)
            digests = [hashlib.sha256(aligner.text(*x[:4]).encode()).hexdigest() if len(x[0]) else "" for x in found]
            counts = [pa.array([len(x[k]) for x in found], pa.int64()) for k in (0, 1, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *counts, pa.array(digests, pa.string()), _lists([x[4] for x in found], pa.int64())], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>")


def pair_bound(aligner: Aligner) -> int:
    """How many pairs of ids can end together at all: one token's bytes are the end of the other's."""
    of_b: dict[bytes, int] = {}
    for x in aligner.pieces.bytes_of:
        of_b[x] = of_b.get(x, 0) + 1
    of_a = set(aligner.vocabulary.bytes_of.values())
    return sum(of_b.get(x[k:], 0) for x in of_a for k in range(len(x))) + sum(n * (x[k:] in of_a) for x, n in of_b.items() for k in range(1, len(x)))


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair, its links in the corpus, and whether no other pair of its id of B has more. At most ``pair_bound`` rows, from any number of documents."""
    counts = linked.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy(F.pmod("pair", F.lit(PAIR)))))


def score_links(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """linked without links, but with n_links, n_best and count_sum. Links of one document meet in the task that reads them; one row each is shuffled."""
    names = [c for c in linked.columns if c != "links"]
    each = linked.select(*names, F.explode_outer("links").alias("pair")).join(F.broadcast(counts), "pair", "left")
    sums = [F.count("pair").alias("n_links"), F.count(F.when(F.col("best"), 1)).alias("n_best"), F.coalesce(F.sum("count"), F.lit(0)).alias("count_sum")]
    return each.groupBy(*names).agg(*sums)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Kept(spark, "op12")
    linked = kept.put(align_links(table(spark, sf_dir, "documents")).withColumn("row", F.monotonically_increasing_id()))
    return score_links(linked, kept.put(pair_counts(linked))).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
