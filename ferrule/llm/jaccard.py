"""Operator 6: Jaccard join on word n-grams by T-occurrence search.

1. Each text becomes the sorted set of its 64-bit shingle hashes. Texts with equal sets form one class, so exact copies cost nothing later.
2. Two linked sets differ in at most (a + b) / 19 shingles at 0.9 (in general (a + b)(1 - t) / (1 + t)). The hash space is cut into that
   many parts and a quarter more, so linked sets agree in that many parts entirely; a part's digest is a key. Sets that occur
   in fewer lists with others than that are out; the rest are joined into candidate groups by their lists. This loses no link,
   whatever the texts are.
3. Within a group, T-occurrence search with DivideSkip finds links: of a query's inverted lists the longest are set aside, the
   short ones are merged as sorted runs and counted, and candidates with enough hits are probed for the long lists by binary search. Only links between
   different components matter, so a group that has become one component ends the search.
4. Groups over a size bound are first compared with one pivot. What is linked to it is one component; links of the rest are searched by inverted
   lists over the whole cluster: in one order from rare to common shingles, linked sets meet among the first few of either. Sets of
   the pivot's component are not compared with each other, so a large group of near copies is no square.

Links, not pairs, are the result: a group of m near copies gives m - 1 links, and the links span exactly the components of all pairs.

Defined results: null texts, empty texts and texts without words have an empty set, no link, and are their own component; fewer words
than a shingle form one shingle of the whole sequence; repeated rows share a class; null doc_ids are kept, and lose to any
other as component_id. Other columns are ignored. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Kept, components, join_unique, table

WORDS, PERCENT = 3, 90
#: Shingles of a group that one task holds; larger groups are searched by many tasks.
TASK_SHINGLES = 4_000_000
#: How often sets that occur in too few lists are taken out; each time lists lose members, and more sets may follow.
PEELINGS = 2
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as texts need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 14)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, _U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word, A-Z lower-cased, from prefix sums of a polynomial over the bytes."""
    raw = np.frombuffer(text.lower(), np.uint8)
    if not len(raw):
        return np.empty(0, _U)
    space = _SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = POWERS.upto(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum((raw.astype(_U) + _U(1)) * up[:-1])))
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    w = word_hashes(text or b"")
    if not len(w):
        return w
    size = min(words, len(w))
    acc = np.full(len(w) - size + 1, size * 0x2545F491 if size < words else 0, _U)
    for k in range(size):
        acc = mix(acc * _U(0x9FB21C651E98DF25) + w[k : len(w) - size + 1 + k])
    return np.unique(acc)


@lru_cache(1 << 12)
def size_tags(n: int, percent: int = PERCENT) -> tuple[tuple[int, int, int], ...]:
    """(tag, parts, spare) under which a set of a size gives keys: its size class, and a bridge to a neighbouring class in reach.

    parts - spare - 1 is the largest difference of two linked sets under the tag, so they agree in spare + 1 parts at least.
    """
    out, low, k = [], 1, 0
    while True:
        high = max(low + 1, low * 8 // 5)  # sizes low to high - 1
        reach = -(-high * percent // 100), high * 100 // percent  # sizes that link across the upper bound
        for tag, most, inside in ((2 * k, high - 1, low <= n < high), (2 * k + 1, reach[1], reach[0] <= n <= reach[1])):
            if inside:
                far = 2 * most * (100 - percent) // (100 + percent)
                if far:
                    spare = 1 + far // 4
                    out.append((tag, far + 1 + spare, spare))
        if low > n:
            return tuple(out)
        low, k = high, k + 1


def part_keys(s: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the parts of a set as keys, and for each its tag and how many keys of that tag any linked set shares at least.

    Empty parts give keys only if they outnumber the spare ones. A part that two sets agree in is empty in both, so a set that drops its own
    loses no more keys than those; one that keeps them may meet a set that drops up to the spare ones, and shares one key at least.
    """
    keys, marks = [], []
    for tag, parts, spare in size_tags(len(s), percent):
        bounds = (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(_U)
        cuts = np.concatenate(([0], np.searchsorted(s, bounds), [len(s)]))
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(mix(s + _U(0x51ED270B)))))
        digest = mix((sums[cuts[1:]] - sums[cuts[:-1]]) + mix(np.arange(parts, dtype=_U) + _U(tag * 1_000_003)))
        empty = np.diff(cuts) == 0
        n_empty = int(empty.sum())
        keys.append(digest if n_empty > spare else digest[~empty])
        shared = 1 if n_empty > spare else spare + 1 - n_empty
        marks.append(np.full(len(keys[-1]), tag << 32 | shared, np.int64))
    return (np.concatenate(keys), np.concatenate(marks)) if keys else (np.empty(0, _U), np.empty(0, np.int64))


def class_of(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = np.add.reduce(mix(s ^ _U(0xA0761D6478BD642F))) ^ np.bitwise_xor.reduce(mix(s + _U(0xE7037ED1A0B428DB))) + _U(len(s))
    return int(mix(np.array([x], _U)).view(np.int64)[0])


def row_hash() -> Column:
    return F.xxhash64("doc_id", "text")


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), n and class of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, words) for text in batch.column("text").cast(pa.binary()).to_pylist()]
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(class_of, sets)), pa.int64())]
            yield pa.record_batch(columns, ["doc_id", "row", "n", "class"])

    given = docs.select(F.col("doc_id").cast("long"), row_hash().alias("row"), F.col("text").cast("string"))
    return given.mapInArrow(run, "doc_id long, row long, n long, class long")


def class_keys(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, remembered: int = 1 << 20) -> DataFrame:
    """(key, class, mark) rows of every set. A task gives a class's keys once while it remembers the class, so copies add little."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, classes, marks = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                s = shingles(text, words)
                name = class_of(s)
                if len(s) and name not in seen:
                    if len(seen) == remembered:
                        seen.clear()
                    seen.add(name)
                    k, m = part_keys(s, percent)
                    keys.append(k.view(np.int64))
                    marks.append(m)
                    classes.append(np.full(len(k), name, np.int64))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (keys, classes, marks)], ["key", "class", "mark"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, class long, mark long")


def linked(common: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (a + b - common)


def divide_skip(names: list[int], sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that span the components of a group of sets."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
    by_token = owner[np.argsort(place, kind="stable")]
    counts = np.bincount(place, minlength=len(tokens))
    begin = np.concatenate(([0], np.cumsum(counts)))
    of = np.split(place, np.cumsum(sizes)[:-1])
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links, left = [], m
    for q in range(m):
        if left == 1:
            break
        if q and root(q) == root(0):
            continue  # a link to another component is found from there
        lists = of[q][np.argsort(counts[of[q]], kind="stable")]
        n = len(lists)
        least = -(-percent * (n + -(-percent * n // 100)) // (100 + percent))
        longest = int(counts[lists[-1]])
        aside = min(least - 1, int(least / (0.01 * np.log2(longest + 1) + 1)))
        short, long_ = lists[: n - aside], lists[n - aside :]
        merged = np.sort(np.concatenate([by_token[begin[t] : begin[t + 1]] for t in short]), kind="stable")  # a merge of sorted runs
        edges = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1], [True])))
        runs = np.diff(edges)
        for at_run in np.flatnonzero(runs >= least - aside):
            c, hits = int(merged[edges[at_run]]), int(runs[at_run])
            if c == q or root(c) == root(q):
                continue
            at = np.searchsorted(of[c], long_)
            common = hits + int((of[c][np.minimum(at, len(of[c]) - 1)] == long_).sum())
            if linked(common, n, int(sizes[c]), percent):
                parent[root(c)] = root(q)
                links.append((names[q], names[c]))
                left -= 1
    return links


def group_links(units: DataFrame, percent: int = PERCENT) -> DataFrame:
    """From rows (unit, class, shingles) sorted by unit within partitions: links (a, b) found in each unit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def search() -> pa.RecordBatch:
            found = divide_skip([r[0] for r in rows], [np.frombuffer(r[1], _U) for r in rows], percent) if len(rows) > 1 else []
            return pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for unit, name, held in zip(*(batch.column(k).to_pylist() for k in ("unit", "class", "shingles")), strict=True):
                if unit != now:
                    if rows:
                        yield search()
                    now, rows = unit, []
                rows.append((name, held))
        if rows:
            yield search()

    return units.select("unit", "class", "shingles").mapInArrow(run, "a long, b long")


def member_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """The members (row, class, group) with n and their shingles, from one text of each class."""
    wanted = members.select(F.col("row").alias("_row"), "class", "group")
    joined = docs.select(row_hash().alias("_key"), F.col("text").cast("string").alias("text")).join(wanted, F.col("_key") == F.col("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ok = pa.array([class_of(s) == c for s, c in zip(sets, batch.column("class").to_pylist(), strict=True)], pa.bool_())
            out = [batch.column("class"), batch.column("group"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.record_batch([x.filter(ok) for x in out], ["class", "group", "n", "shingles"])

    return joined.select("text", "class", "group").mapInArrow(run, "class long, group long, n long, shingles binary").dropDuplicates(["class"])


def linked_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """Of rows (a, b, x, y), classes and their shingles: a and b of those that link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for s, p in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                a, b = np.frombuffer(s, _U), np.frombuffer(p, _U)
                hit.append(linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent))
            mask = pa.array(hit, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def search_large(large: DataFrame, kept: Kept, percent: int) -> DataFrame:
    """Links in groups over the bound: to one pivot first, then of all that is not linked to it, by inverted lists of rare shingles."""
    pivots = kept.put(large.groupBy("group").agg(F.min_by("shingles", F.xxhash64("class")).alias("y"), F.min_by("class", F.xxhash64("class")).alias("b"), F.count("*").alias("many")))
    star = kept.put(linked_pairs(join_unique(large.select("group", F.col("class").alias("a"), F.col("shingles").alias("x")), pivots, "group", "many").where("a != b"), percent))
    part = large.join(star.select(F.col("a").alias("class"), F.col("b").alias("hub")), "class", "left").withColumn("hub", F.coalesce("hub", "class"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, name, hub, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = mix(np.frombuffer(held, _U) ^ _U(group & (1 << 64) - 1)).view(np.int64)
                same = lambda x: pa.array(np.full(len(s), x, np.int64))  # noqa: E731,B023
                yield pa.record_batch([pa.array(s), same(name), same(hub), same(len(s))], ["g", "class", "hub", "n"])

    each = kept.put(part.select("group", "class", "hub", "shingles").mapInArrow(tokens, "g long, class long, hub long, n long"))
    often = kept.put(each.groupBy("g").agg(F.count("*").alias("often")).where("often > 1"))
    shared = join_unique(each, often, "g", "often").withColumn("known", F.count("*").over(W.partitionBy("class")))
    # Shingles of one set come first in the order and meet nothing; a set only needs to know how many such it has.
    rank = F.row_number().over(W.partitionBy("class").orderBy("often", "g")) + F.col("n") - F.col("known")
    first = kept.put(shared.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1))
    lists = first.groupBy("g", "hub").agg(F.count("*").alias("c")).groupBy("g").agg(F.max_by("hub", F.struct("c", "hub")).alias("main"), F.count("*").alias("several"), F.sum("c").alias("c"))
    held = kept.put(join_unique(first, kept.put(lists.where("several > 1")), "g", "c").select("g", "main", "hub", "class", "n"))
    x, y = held.where("hub != main").alias("x"), held.alias("y")
    near = (F.col("x.g") == F.col("y.g")) & (F.col("x.hub") != F.col("y.hub")) & (F.col("x.n") * percent <= F.col("y.n") * 100) & (F.col("y.n") * percent <= F.col("x.n") * 100)
    pairs = kept.put(x.join(y, near).select(F.greatest("x.class", "y.class").alias("a"), F.least("x.class", "y.class").alias("b")).distinct())
    sets = lambda id, s: large.select(F.col("class").alias(id), F.col("shingles").alias(s))
    return star.unionByName(linked_pairs(join_unique(join_unique(pairs, sets("a", "x"), "a"), sets("b", "y"), "b"), percent))


def jaccard_classes(docs: DataFrame, kept: Kept, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, row, n_shingles, class (one per distinct set), component (a class of it) and component_id of every row."""
    signed = kept.put(signatures(docs, words))
    classes = kept.put(signed.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row")))
    keyed = class_keys(docs, words, percent)
    by_key = W.partitionBy("key")
    lists = lambda rows: rows.withColumn("low", F.min("class").over(by_key)).withColumn("high", F.max("class").over(by_key)).where("low != high").drop("high")
    met = kept.put(lists(keyed))
    for _ in range(PEELINGS):
        # A set that meets others in fewer lists than any linked set would share with it has no link.
        rich = met.groupBy("class", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("mark").bitwiseAND(0xFFFFFFFF)).select("class", "mark")
        before, met = met, kept.put(lists(met.drop("low").join(rich, ["class", "mark"], "left_semi")))
        kept.drop(before)
    edges = met.where("class != low").select(F.col("class").alias("a"), F.col("low").alias("b")).distinct()
    groups = kept.put(components(kept, edges))
    members = groups.join(classes.select("class", "row"), F.col("node") == F.col("class")).select("class", F.col("component").alias("group"), "row")
    sets = kept.put(member_sets(docs, members, words))
    sizes = kept.put(sets.groupBy("group").agg(F.sum("n").alias("held"), F.count("*").alias("many")))
    sets = join_unique(sets, sizes, "group", "many").drop("many")
    small = sets.where(F.col("held") <= TASK_SHINGLES).select(F.col("group").alias("unit"), "class", "shingles")
    links = group_links(small.repartition("unit").sortWithinPartitions("unit"), percent)
    if not sizes.where(F.col("held") > TASK_SHINGLES).isEmpty():
        large = kept.put(sets.where(F.col("held") > TASK_SHINGLES).drop("held"))
        links = links.unionByName(search_large(large, kept, percent))
    joined = components(kept, kept.put(links))
    named = classes.select("class", "doc_id").join(joined, F.col("class") == F.col("node"), "left").withColumn("component", F.coalesce("component", "class"))
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    final = named.join(lowest, "component").select("class", "component", "component_id")
    narrow = signed.select("doc_id", "row", F.col("n").alias("n_shingles"), "class")
    return narrow.join(final, "class", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def keep_one(docs: DataFrame, kept: Kept, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the first by doc_id (null last) and row hash; documents without words all stay."""
    found = jaccard_classes(docs, kept, words, percent).where("n_shingles > 0")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = found.groupBy("component").agg(F.min(place).alias("first"))
    gone = found.join(first, "component").where(place != F.col("first")).select(F.col("row").alias("_row")).distinct()
    rest = docs.withColumn("_key", F.xxhash64("doc_id", "text")).join(gone, F.col("_key") == F.col("_row"), "left_anti")
    # Rows alike in doc_id and text are one document.
    alike = F.row_number().over(W.partitionBy("_key").orderBy(F.lit(0)))
    return rest.withColumn("_n", alike).where((F.col("_n") == 1) | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), Kept(spark, "jaccard")).select("doc_id", "n_shingles", "component_id")


#: The query in SQL: all pairs that share a shingle are compared, and the smallest doc_id spreads along links.
OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (SELECT a AS doc_id, a AS seen FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.seen)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, min(seen) AS least FROM reach GROUP BY doc_id) c ON c.doc_id = w.doc_id
"""
