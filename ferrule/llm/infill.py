"""Operator 11: fill-in-middle transformation.

A text's units are runs of letters A-Z and a-z, and every other character alone. A Fenwick tree over blocks of the text's bytes holds how many units and
code points begin in each block; binary lifting descends to the block where a cut unit begins, and the place inside is found in that block
alone. Each document is worked on inside its row: nothing is shuffled.

Defined results: null and empty texts are plain and have no units; a null doc_id hashes as an empty string; texts that hold a mark are plain, so that marks
are unambiguous; repeated rows are transformed alike, one by one; texts are read whole, in slabs, whatever their length; empty tables give no rows; other
columns, whatever their names, are ignored. Where both cuts fall on one place the middle is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a block, and blocks that are counted in one go.
BLOCK, SLAB = 1024, 1024


class BlockTree:
    """Fenwick tree of units and code points over blocks of UTF-8 bytes."""

    def __init__(self, data: bytes, block: int = BLOCK):
        self.data, self.block = data, block
        self.size = -(-len(data) // block)
        counts = np.zeros((self.size + 1, 2), np.int64)
        for first in range(0, self.size, SLAB):
            starts, points = self._begins(first * block, min(len(data), (first + SLAB) * block))
            edges = np.arange(0, len(starts), block)
            counts[first + 1 : first + 1 + len(edges), 0] = np.add.reduceat(starts, edges, dtype=np.int64)
            counts[first + 1 : first + 1 + len(edges), 1] = np.add.reduceat(points, edges, dtype=np.int64)
        sums, at = np.cumsum(counts, axis=0), np.arange(self.size + 1)
        self.tree = (sums - sums[at & (at - 1)]).tolist()  # node i sums the i & -i blocks that end with block i
        self.units, self.chars = sums[-1].tolist()

    def _begins(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of a range whether a unit, and whether a code point, begins there."""
        held = np.frombuffer(self.data, np.uint8, b - max(0, a - 1), max(0, a - 1))
        points, letters = (held & 0xC0) != 0x80, ((held | 0x20) - np.uint8(97)) < 26
        starts = points.copy()
        starts[1:] &= ~(letters[1:] & letters[:-1])
        return (starts[1:], points[1:]) if a else (starts, points)

    def begin(self, unit: int) -> tuple[int, int]:
        """Bytes and code points before a unit, counted from 0; before the end where the text has no such unit."""
        if unit >= self.units:
            return len(self.data), self.chars
        at, left, chars = 0, unit, 0
        for k in reversed(range(self.size.bit_length())):
            step = at + (1 << k)
            if step <= self.size and self.tree[step][0] <= left:
                at, left, chars = step, left - self.tree[step][0], chars + self.tree[step][1]
        starts, points = self._begins(at * self.block, min(len(self.data), (at + 1) * self.block))
        inside = int(np.flatnonzero(starts)[left])
        return at * self.block + inside, chars + int(points[:inside].sum())


def transform(doc_id: int | None, text: str, seed: int, plain_percent: int, spm_percent: int) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one text."""
    data = text.encode()
    tree = BlockTree(data)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain_percent:
        return tree.units, "plain", None, None, data
    low, high = sorted((h1 % (tree.units + 1), h2 % (tree.units + 1)))
    (a, a_chars), (b, b_chars) = tree.begin(low), tree.begin(high)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < spm_percent:
        return tree.units, "spm", a_chars, b_chars - a_chars, b"".join((s, suffix, p, prefix, m, middle))
    return tree.units, "psm", a_chars, b_chars - a_chars, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null where plain) and output of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = [(doc, *transform(doc, text.as_py() or "", seed, plain_percent, spm_percent)) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            columns[-1] = columns[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
    c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
    p AS (SELECT *, CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
      array_to_string(units[1:a], '') AS prefix, CASE WHEN b > a THEN array_to_string(units[a + 1:b], '') ELSE '' END AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
