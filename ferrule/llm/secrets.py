"""Operator 5: secret scans with built-in functions only.

Three base patterns (assignments, access keys, hex strings) give spans as they stand. The method adds spans of high entropy: candidate
strings of one character class are scored by the Shannon entropy of a sliding window, whose character counts and sum of c*log2(c)
are updated by one character in and one out, and kept if the largest window entropy reaches the class's threshold and no
allow-list pattern matches.

Spans come from splitting at a pattern: running sums of the lengths of pieces and matches give every start and end in code points.
A candidate of n characters takes n steps, a text of m matches m log m additions.

Defined results: null and empty texts have no spans; an empty table gives no rows; positions count code points; of spans that start
together the kind listed first in ``ORDER`` comes first; repeated rows are scanned alike; other columns, whatever their names, are
ignored; texts are scanned whole, whatever their length.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The base patterns. "least" is the length that the group needs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]{32,}", 0, 32))
#: A text without a match of this has no base span, and is not split.
HINT = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
#: class, candidate pattern, alphabet, window, least entropy in bits. An = before a candidate is an assignment and no part of it.
CLASSES = (
    ("hex", r"(?<![A-Za-z0-9+/_-])[0-9A-Fa-f]{24,}(?![A-Za-z0-9+/_=-])", "0123456789abcdefABCDEF", 24, 2.8),
    ("base64", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])",
     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 24, 3.6),
)
#: Kinds of characters that a candidate of a class has, wherever in it they stand.
KINDS = {"hex": (), "base64": ("[0-9]", "[A-Z]", "[a-z]")}
#: Strings that look random and are no secrets: UUIDs, digests of lock files, placeholders, numbers.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^sha(?:1|256|384|512)-",
    r"(?i)example|placeholder|dummy|changeme|your[_-]|xxxx",
    r"^[0-9]+$",
)
ORDER = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
SPAN = "array<struct<start:int,kind:int,end:int>>"


#: Steps of the running sums: an array of up to 2^30 lengths is summed.
STEPS = [1 << k for k in range(31)]


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda's variable is not computed again where it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sums(lengths: Column) -> Column:
    """Running sums of an array by doubled steps: n log n, where a fold that appends copies what it has at each element."""
    def shifted(sums: Column, step: Column) -> Column:
        return F.slice(F.concat(F.array_repeat(F.lit(0), step), sums), F.lit(1), F.size(sums))

    add = lambda sums, step: F.when(F.size(sums) > step, F.zip_with(sums, shifted(sums, step), lambda a, b: a + b)).otherwise(sums)
    return F.aggregate(F.array(*map(F.lit, STEPS)), lengths, add)


def found(text: Column, pattern: str) -> Column:
    """Every match of a pattern, in order, as structs of start, end and text."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def placed(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        ends = running_sums(F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m)))
        return F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: F.when(F.size(matches) == 0, none).otherwise(placed(matches)))


def as_spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Base spans of all kinds, ordered by start, then kind as listed."""
    def spans(k: int, pattern: str, group: int, least: int) -> Column:
        size = (lambda m: F.length(F.regexp_extract(m["match"], pattern, group))) if group else (lambda m: F.length(m["match"]))
        return as_spans(F.filter(found(text, pattern), lambda m: size(m) >= least), k)

    parts = [spans(k, pattern, group, least) for k, (_, pattern, group, least) in enumerate(BASE)]
    return F.when(text.rlike(HINT), F.array_sort(F.concat(*parts))).otherwise(F.array().cast(SPAN))


def window_entropy(candidate: Column, alphabet: str, window: int, enough: float = float("inf")) -> Column:
    """The largest Shannon entropy of a window over a string, in bits, from counts updated one character at a time.

    Each character meets the one that leaves the window with it (0: none yet), so a step looks at nothing but its pair and the counts.
    Once a window has reached ``enough``, its entropy stands and the rest is not counted.
    """
    places = F.transform(F.split(candidate, "(?!^)(?!$)"), lambda c: F.instr(F.lit(alphabet), c))
    pairs = bind(places, lambda at: F.zip_with(at, F.slice(F.concat(F.array_repeat(F.lit(0), window), at), F.lit(1), F.size(at)), lambda x, y: F.struct(x.alias("came"), y.alias("gone"))))
    clog = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(0.0).alias("most"))

    def change(counts: Column, place: Column, by: int) -> Column:
        return F.concat(F.slice(counts, F.lit(1), place - 1), F.array(F.element_at(counts, place) + by), F.slice(counts, place + 1, F.size(counts)))

    def moved(s: Column, place: Column, by: int) -> Column:
        """Counts and sum after a character came or left."""
        n = F.element_at(s["counts"], place)
        return F.struct(change(s["counts"], place, by).alias("counts"), (s["sum"] + clog(n + by) - clog(n)).alias("sum"))

    def step(s: Column, x: Column) -> Column:
        size = F.least(s["i"] + 1, F.lit(window)).cast("double")
        slid = bind(moved(s, x["came"], 1), lambda a: F.when(x["gone"] > 0, moved(a, x["gone"], -1)).otherwise(a))
        return bind(slid, lambda a: F.struct(
            a["counts"].alias("counts"), a["sum"].alias("sum"), (s["i"] + 1).alias("i"),
            F.greatest(s["most"], F.when(s["i"] + 1 >= window, F.log2(size) - a["sum"] / size).otherwise(F.lit(0.0))).alias("most")))

    return F.aggregate(pairs, start, lambda s, x: F.when(s["most"] >= enough, s).otherwise(step(s, x)), lambda s: s["most"])


def entropy_spans(text: Column) -> Column:
    """Spans of candidates whose entropy is high and which the allow-list does not name."""
    named = "|".join(f"(?:{p})" for p in ALLOWED)

    def spans(name: str, pattern: str, alphabet: str, window: int, least: float) -> Column:
        keep = lambda m: reduce(and_, [m["match"].rlike(k) for k in KINDS[name]], ~m["match"].rlike(named)) & (window_entropy(m["match"], alphabet, window, least) >= least)
        return as_spans(F.filter(found(text, pattern), keep), ORDER.index(f"entropy_{name}"))

    parts = [spans(*x) for x in CLASSES]
    return F.when(text.rlike(r"[A-Za-z0-9+/_-]{24}"), F.array_sort(F.concat(*parts))).otherwise(F.array().cast(SPAN))


def shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id with ``base`` and ``extra``, arrays of (start, kind, end), kind a place in ``ORDER``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).select("doc_id", base_spans(F.col("text")).alias("base"), entropy_spans(F.col("text")).alias("extra"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.array_sort(F.concat("base", "extra"))).alias("spans"))
