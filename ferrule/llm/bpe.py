"""Operator 13: byte-pair encoding and decoding by forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary is a certain border of tokens wherever it stands, so a text is cut there and its fragments
are encoded one by one, each distinct one once while it stays in a cache of bounded size. Inside a fragment, pre-tokens are cut at such pairs
again before their merges. Each document is worked on inside its row: nothing is shuffled.

Defined results: null texts count as empty and have no tokens; texts are read whole, whatever runs they hold, in time that grows as n log n at most;
the special string is its own id, or plain text where ``special`` is false; repeated rows and null doc_ids are encoded one by one; empty tables give no rows; other
columns, whatever their names, are ignored. Ids out of the vocabulary decode to nothing; bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fragments that a task remembers, and the bytes that one has at most. The cache is emptied when it is full.
REMEMBERED, FRAGMENT = 300_000, 64
#: Bytes up to which a piece is merged by scanning it, and a pre-token is not cut first; the ids are the same.
SHORT = 64
#: Ids that one Arrow batch of results holds, unless a single document has more.
BATCH_IDS = 2_000_000
PLAIN = re.compile(rb" ?[A-Za-z]+")
#: Fixed values of Unicode: white space beyond ASCII.
WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
HAS_WIDE_SPACE = re.compile(f"[{WIDE_SPACES}]")


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on, in order."""
    shown = {b: chr(b) for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)}
    others = [b for b in range(256) if b not in shown]
    return {c: b for b, c in shown.items()} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """A byte-level vocabulary: merges by rank, bytes of every id, and which pairs of bytes occur inside a token."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str | None = None):
        import public_tokenizers
        from tokenizers import pre_tokenizers

        with open(f"{folder}/{name}.json" if folder else public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
            held = json.load(f)
        of = byte_characters()
        ids, merges = held["model"]["vocab"], held["model"]["merges"]
        self.bytes_of: dict[int, bytes] = {i: bytes(of[c] for c in t) for t, i in ids.items()}
        self.byte_ids = [ids[c] for c, _ in sorted(of.items(), key=lambda x: x[1])]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.decoded = self.bytes_of | {i: t.encode() for t, i in self.special.items()}
        self.words = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        never = np.ones((256, 256), bool)
        for t in self.bytes_of.values():
            never[list(t[:-1]), list(t[1:])] = False
        self.never = never.ravel()
        # Before the pre-tokens are known a text is cut at those certain borders only over which no pre-token looks: not behind white space, not
        # before an apostrophe, and not inside a character. Where a text has wide white space, not behind a byte that may end it either.
        never[[*range(9, 14), *range(28, 33)], :] = False
        never[:, [ord("'"), *range(0x80, 0xC0)]] = False
        self.cut = never.ravel().copy()
        never[sorted({x.encode()[-1] for x in WIDE_SPACES}), :] = False
        self.narrow_cut = never.ravel()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of bytes of one pre-token: the pair of least rank merges first, the leftmost of equal ones."""
        ids = [self.byte_ids[b] for b in piece]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        get, made, none = self.ranks.get, self.made, len(self.made)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) < none:
            k = ranks.index(rank)
            ids[k] = made[rank]
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), none)
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same over a heap of pairs and a chain of neighbours, for long pieces."""
        ranks, made, n = self.ranks, self.made, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(ranks[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            right = after[k]
            if right < 0 or ranks.get((ids[k], ids[right])) != rank:
                continue
            ids[k], ids[right], after[k] = made[rank], -1, after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] >= 0 and (rank := ranks.get((ids[left], ids[after[left]]))) is not None:
                    heapq.heappush(heap, (rank, left))
        return [i for i in ids if i >= 0]

    def fragment(self, data: bytes) -> list[int]:
        """Ids of a fragment: its pre-tokens, each cut at pairs of bytes that no token holds, merged piece by piece."""
        if PLAIN.fullmatch(data):
            words = [data]
        else:
            text = data.decode()
            words = [text[a:b].encode() for _, (a, b) in self.words.pre_tokenize_str(text)]
        out = []
        for word in words:
            if len(word) > SHORT:
                b = np.frombuffer(word, np.uint8).astype(np.int32)
                ends = [*(np.flatnonzero(self.never[b[:-1] * 256 + b[1:]]) + 1).tolist(), len(word)]
            else:
                ends = [len(word)]
            at = 0
            for end in ends:
                out += self.merge(word[at:end])
                at = end
        return out


class ForcedEncoder:
    """Ids of whole texts through fragments between certain borders, and back."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self._known = vocabulary, {}
        self.spelled = [vocabulary.decoded.get(i, b"") for i in range(max(vocabulary.decoded) + 2)]  # the last one is empty

    def ids(self, text: str, special: bool = True) -> np.ndarray:
        if not special or not any(s in text for s in self.vocabulary.special):
            return np.frombuffer(self._plain(text), np.int32)
        split = re.split("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")", text)
        return np.frombuffer(b"".join([np.int32(self.vocabulary.special[part]).tobytes() if k % 2 else self._plain(part) for k, part in enumerate(split)]), np.int32)

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special strings, four bytes each."""
        if not text:
            return b""
        data = text.encode()
        b = np.frombuffer(data, np.uint8)
        cut = self.vocabulary.narrow_cut if HAS_WIDE_SPACE.search(text) else self.vocabulary.cut
        ends = [*(np.flatnonzero(cut[b[:-1].astype(np.uint16) * 256 + b[1:]]) + 1).tolist(), len(data)]
        parts = [data[i:j] for i, j in zip([0, *ends], ends)]
        found = list(map(self._known.get, parts))
        if None in found:
            found = [self._fragment(p) if f is None else f for p, f in zip(parts, found)]
        return b"".join(found)

    def _fragment(self, part: bytes) -> bytes:
        ids = self._known.get(part)
        if ids is None:
            ids = np.array(self.vocabulary.fragment(part), np.int32).tobytes()
            if len(part) <= FRAGMENT:
                if len(self._known) >= REMEMBERED:
                    self._known.clear()
                self._known[part] = ids
        return ids

    def text(self, ids: np.ndarray) -> str:
        most, spelled = len(self.spelled) - 1, self.spelled
        known = np.where((ids >= 0) & (ids < most), ids, most)
        return b"".join([spelled[i] for i in known.tolist()]).decode("utf-8", "replace")


def encode(docs: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None, special: bool = True) -> DataFrame:
    """doc_id and ids (an array) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the cache is many small objects without cycles, which collections would walk again and again
        encoder = ForcedEncoder(Vocabulary(name, folder))

        def packed(docs, ids):
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate([*ids, np.zeros(0, np.int32)]))], ["doc_id", "ids"])

        for batch in batches:
            docs, ids, held = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = encoder.ids(text.as_py() or "", special)
                if docs and held + len(found) > BATCH_IDS:
                    yield packed(docs, ids)
                    docs, ids, held = [], [], 0
                docs.append(doc)
                ids.append(found)
                held += len(found)
            yield packed(docs, ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """doc_id, ids and the text of the ids, special strings kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ForcedEncoder(Vocabulary(name, folder))
        for batch in batches:
            lists = batch.column(1)
            ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            texts = pa.array([encoder.text(ids[a:b]) for a, b in zip(ends, ends[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], ["doc_id", "ids", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def op13_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(table(spark, sf_dir, "documents")))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
