"""Token counts: the shared encoder, and operator 3, edit-aware counting.

``count_edits`` keeps a segment tree over each document's pre-tokens (and, in long ones, over runs of tokens), applies the document's edits in order, and re-encodes only the leaves
they touch. Each document is worked on inside its row: nothing is shuffled.

Defined results: null texts count as empty; null or empty edit lists change nothing; places past the end are moved to the end and
negative ones to the start; null inserted strings are empty; edits of one document apply by seq, ties by place, length and string; repeated
rows and null doc_ids are counted one by one (edits with a null doc_id meet none); very long texts, and runs of one character, are encoded
whole; empty tables give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ForcedEncoder, Vocabulary
from .common import table

#: Runs on which ``tiktoken`` slows down.
RUNS = re.compile(r"\s{100}|\S{1000}")


class Encoder:
    """Ids of the byte-level vocabulary as the ``tokenizers`` library gives them (add_special_tokens=False).

    ``tiktoken`` gives the same ids from the same vocabulary several times faster than ``tokenizers``, so it encodes all but texts that hold the
    special string or ``RUNS``, on which it slows down with the square of a run; forced boundaries encode those in n log n at most.
    ``folder`` is where the vocabulary files lie, by default the installed package's.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self, name: str = "byte_bpe_50k", folder: str | None = None):
        import public_tokenizers
        import tiktoken

        self._path = (lambda f: f"{folder}/{f}") if folder else public_tokenizers.path
        self._name = name
        with open(self._path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {n: b for b, n in ranks.items()}
        coding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._fast = self.plain = coding.encode_ordinary  # special strings as plain text
        self._piece = coding.encode_single_piece if hasattr(coding, "encode_single_piece") else coding._encode_single_piece
        self._folder, self._forced = folder, None

    def ids(self, text: str) -> list[int]:
        if self.SPECIAL not in text and not RUNS.search(text):
            return self._fast(text)
        if self._forced is None:
            self._forced = ForcedEncoder(Vocabulary(self._name, self._folder))
        return self._forced.ids(text).tolist()

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether two tokens of one pre-token can follow each other. Tokens whose neighbours all can are the encoding of their bytes."""
        if a not in self.bytes_of or b not in self.bytes_of:
            return True  # texts are cut about a special string first
        return list(self._piece(self.bytes_of[a] + self.bytes_of[b])) == [a, b]


#: Characters that a leaf aims at, and that a slot of the tree holds at most before the tree is built anew.
LEAF, SLOT_MOST = 128, 512
#: Places where pre-tokens end whatever lies further away: before white space, and where letters, digits and other characters meet, but for a
#: letter behind an apostrophe, which may be a contraction.
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")
#: Places inside a run of one kind, where only the tokens say whether they may be parted.
INSIDE = regex.compile(r"(?<=\p{L})(?=\p{L})|(?<=\p{N})(?=\p{N})|(?<=[^\s\p{L}\p{N}])(?=[^\s\p{L}\p{N}'])|(?<=\s)(?=\s\s)")


class Leaf:
    """A stretch of text with its number of tokens and its outer tokens."""

    __slots__ = ("text", "tokens", "first", "last")

    def __init__(self, text: str, ids: list[int]):
        self.text, self.tokens = text, len(ids)
        self.first, self.last = (ids[0], ids[-1]) if ids else (None, None)


class TokenTree:
    """Token counts of a text in a segment tree whose leaves are runs of pre-tokens, or of tokens where a pre-token is long.

    Every inner node holds the tokens and characters below it, and texts lie in the leaves alone. An edit finds its leaves by descending on
    characters, re-encodes only them and one leaf of context on either side (more where the tokens at a border could merge), and updates
    the sums on the paths to the root. A slot may hold a few leaves; only a slot that grew over ``SLOT_MOST`` rebuilds the sums, from
    counts already held.
    """

    def __init__(self, text: str, encoder: Encoder):
        self.encoder, self.encoded_chars = encoder, 0
        self._build([[x] for x in self._leaves(text)] or [[]])

    def _leaves(self, text: str) -> list[Leaf]:
        self.encoded_chars += len(text)
        special = self.encoder.SPECIAL
        borders = [x for m in re.finditer(re.escape(special), text) for x in m.span()]  # texts are cut there before all else
        out, at = [], 0
        while at < len(text):
            m = SAFE.search(text, min(at + LEAF, len(text) - 1))
            end = (self._special_over(text, m.start()) or m.start()) if m and m.start() > at else len(text)
            if end - at > 2 * LEAF and (k := bisect.bisect_right(borders, at)) < len(borders):
                end = min(end, borders[k])
            part = text[at:end]
            ids = self.encoder.ids(part)
            out += [Leaf(part, ids)] if len(part) <= 2 * LEAF else self._split(part, ids)
            at = end
        return out

    def _special_over(self, text: str, at: int) -> int:
        """Where a special string that covers a place ends; 0 where there is none."""
        n = len(self.encoder.SPECIAL)
        begin = text.find(self.encoder.SPECIAL, max(0, at - n + 1), at + n - 1)
        return begin + n if begin >= 0 and begin < at < begin + n else 0

    def _split(self, text: str, ids: list[int]) -> list[Leaf]:
        """A long stretch without a safe place, cut between tokens that lie inside one run."""
        out, at, chars, began = [], 0, 0, 0
        for k, i in enumerate(ids):
            piece = self.encoder.bytes_of[i]
            if chars - at >= LEAF and piece[0] & 0xC0 != 0x80 and chars < len(text) and INSIDE.match(text, chars):
                out.append(Leaf(text[at:chars], ids[began:k]))
                at, began = chars, k
            chars += sum(b & 0xC0 != 0x80 for b in piece)
        return [*out, Leaf(text[at:], ids[began:])]

    def _build(self, slots: list[list[Leaf]]) -> None:
        self.slots = slots
        self.width = 1 << max(0, len(slots) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, slot in enumerate(slots, self.width):
            self.chars[i], self.tokens[i] = sum(len(x.text) for x in slot), sum(x.tokens for x in slot)
        for i in range(self.width - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def size(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(x.text for slot in self.slots for x in slot)

    def slot_at(self, at: int) -> tuple[int, int]:
        """The slot that holds a character, and where the slot begins."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return min(node - self.width, len(self.slots) - 1), start

    def _context(self, slot: int, step: int) -> str:
        """Text beyond a border, as much as a special string could reach over."""
        out = ""
        while 0 <= slot < len(self.slots) and len(out) < len(self.encoder.SPECIAL):
            here = "".join(x.text for x in self.slots[slot])
            out, slot = (here + out if step < 0 else out + here), slot + step
        return out

    def _fits(self, left: Leaf | None, right: Leaf | None, before: str, after: str) -> bool:
        """Whether two neighbouring leaves, with the texts on either side of their border, encode alone as they do together."""
        if left is None or right is None:
            return True
        if self._special_over(before + after, len(before)):
            return False
        if before.endswith(self.encoder.SPECIAL) or after.startswith(self.encoder.SPECIAL):
            return True
        around = left.text[-1:] + right.text[:2]
        if SAFE.match(around, 1):
            return True
        return bool(INSIDE.match(around, 1)) and self.encoder.side_by_side(left.last, right.first)

    def _beside(self, slot: int, step: int) -> Leaf | None:
        """The nearest leaf with text in a direction."""
        while 0 <= slot < len(self.slots):
            if self.slots[slot]:
                return self.slots[slot][-1 if step < 0 else 0]
            slot += step
        return None

    def edit(self, at: int, drop: int, put: str) -> None:
        """Replace ``drop`` characters at a place by a string."""
        at = max(0, min(at, self.size))
        drop = max(0, min(drop, self.size - at))
        (a, start), (b, _) = self.slot_at(at), self.slot_at(at + max(0, drop - 1))
        start -= self.chars[self.width + a - 1] if a else 0
        a, b, reach = max(0, a - 1), min(b + 1, len(self.slots) - 1), 1
        while True:
            held = "".join(x.text for slot in self.slots[a : b + 1] for x in slot)
            region = held[: at - start] + put + held[at - start + drop :]
            fresh = self._leaves(region)
            n = len(self.encoder.SPECIAL)
            outer_left, outer_right = self._context(a - 1, -1)[-n:], self._context(b + 1, 1)[:n]
            left, right = self._beside(a - 1, -1), self._beside(b + 1, 1)
            head, tail = (fresh[0], fresh[-1]) if fresh else (right, left)
            fits_left = self._fits(left, head, outer_left, (region + outer_right)[:n])
            fits_right = self._fits(tail, right, (outer_left + region)[-n:], outer_right)
            if fits_left and fits_right:
                break
            if not fits_left:  # twice as far each time, so that all tries together stay within a few times the last
                start -= sum(self.chars[self.width + max(0, a - reach) : self.width + a])
                a = max(0, a - reach)
            if not fits_right:
                b = min(b + reach, len(self.slots) - 1)
            reach *= 2
        n = b + 1 - a
        if len(fresh) > n and sum(len(x.text) for x in fresh) > SLOT_MOST * n // 2:
            self._build(self.slots[:a] + [[x] for x in fresh] + self.slots[b + 1 :])
            return
        for k in range(n):
            slot, i = fresh[k * len(fresh) // n : (k + 1) * len(fresh) // n], self.width + a + k
            self.slots[a + k] = slot
            dc, dt = sum(len(x.text) for x in slot) - self.chars[i], sum(x.tokens for x in slot) - self.tokens[i]
            while i and (dc or dt):
                self.chars[i] += dc
                self.tokens[i] += dt
                i //= 2


COUNTED = "doc_id long, tokens_before long, tokens_after long, chars_after long, leaves long, edits long, reencoded_chars long"
EDIT = "array<struct<at:long,drop:long,put:string>>"


def attach_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the edits (doc_id, seq, at, drop, put) of each document as one ordered array."""
    lists = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "drop", "put"))).alias("_e"))
    lists = lists.select("doc_id", F.transform("_e", lambda e: F.struct(e["at"], e["drop"], e["put"])).cast(EDIT).alias("edits"))
    return docs.join(lists, "doc_id", "left")


def count_edits(docs: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Counts before and after the edits of each row's ``edits`` array, and how many characters the edits made it encode again."""
    names = [x.split(" ")[0] for x in COUNTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            out = []
            for doc, text, edits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = TokenTree(text or "", encoder)
                before, whole = tree.total, tree.encoded_chars
                for e in edits or ():
                    tree.edit(e["at"] or 0, e["drop"] or 0, e["put"] or "")
                out.append((doc, before, tree.total, tree.size, sum(map(len, tree.slots)), len(edits or ()), tree.encoded_chars - whole))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return docs.select("doc_id", "text", "edits").mapInArrow(run, COUNTED)


def sample_edits(docs: DataFrame, n: int = 4) -> DataFrame:
    """docs with n edits each that the doc_id fixes: a replaced, an inserted, a deleted and a doubled stretch in turn."""
    size = F.coalesce(F.length("text"), F.lit(0))
    at = lambda k: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(k)), (size + 1).cast("long"))
    puts = [F.lit("a revised phrase"), F.lit(" inserted"), F.lit(""), F.substr(F.coalesce("text", F.lit("")), F.lit(1), F.lit(40))]
    edits = [F.struct(at(k).alias("at"), F.pmod(F.xxhash64(F.lit(k), F.col("doc_id")), F.lit(24)).alias("drop"), puts[k % len(puts)].alias("put")) for k in range(n)]
    return docs.withColumn("edits", F.array(*edits).cast(EDIT))


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edits(sample_edits(table(spark, sf_dir, "documents").select("doc_id", "text")))
