"""Operator 4: quality rules, a threshold table compiled into one projection.

``RULES`` lists (name, metric, least, most). ``verdicts`` compiles it into one Spark projection over length, symbol, stop-word and
line metrics, without user functions, shuffles or explodes: every metric is computed inside the row.

Defined results: a null or empty text has no words and is rejected; ratios over nothing are 0; a text marked as a language that the stop words
do not cover has no stop-word verdict; repeated rows are judged alike; bounds hold for ties; an empty table gives no rows; added
columns take the names of ``METRICS`` and ``BASE`` and replace columns of the same names; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30  # words; percent of words in repeated windows
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for was with as it on by at from an be this are or not "
    "der die das und ist ein eine von zu den mit nicht auf für im dem des sich als auch "
    "le la les de du un une et est que qui dans pour pas avec sur au ne se "
    "el los las y en una por con del al para como más su lo es"
).split()
#: name, metric, least, most; None: no bound.
RULES = (
    ("word_length", "mean_word_chars", 2.0, 15.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("exclamations", "exclamation_ratio", None, 0.2),
    ("capitals", "capital_ratio", None, 0.4),
    ("stop_words", "stop_ratio", 0.02, None),
    ("stutter", "stutter_ratio", None, 0.2),
    ("repeated_lines", "dup_line_ratio", None, 0.5),
    ("bullets", "bullet_line_ratio", None, 0.9),
    ("ellipses", "ellipsis_line_ratio", None, 0.3),
)
LANGUAGES = ("en", "de", "fr", "es")  # what the stop words cover
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _words(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")


def repeated_words(words: Column) -> Column:
    """Words within windows of 8 that occur twice or more. Hashes of words clear most texts; only where some agree are the windows compared."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashed = F.array(F.transform(words, lambda w: F.xxhash64(w)))
    hashes = F.flatten(F.transform(hashed, lambda h: F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, WINDOW)))))
    placed = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, F.lit(WINDOW)), " ").alias("w"), i.alias("i"))))
    ahead = F.slice(placed, F.lit(2), F.size(placed))
    same = F.zip_with(F.slice(placed, F.lit(1), F.size(placed) - 1), ahead, lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    begins = F.array_sort(F.array_distinct(F.flatten(same)))
    covered = F.aggregate(begins, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, i: F.struct(
        (s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n"), (i + WINDOW).alias("end")), lambda s: s["n"])
    return F.when(F.size(words) <= WINDOW, F.lit(0)).when(F.size(F.array_distinct(hashes)) == F.size(words) - (WINDOW - 1), F.lit(0)).otherwise(covered)


def metrics(docs: DataFrame, lang: Column | None = None) -> DataFrame:
    """Adds the base counts and the metrics of the threshold table. ``lang`` says which language a text is marked as, null where that is unknown."""
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern))
    has_word = r"[^\x20\x09-\x0D]"
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    known = F.lit(True) if lang is None else F.coalesce(F.lower(F.substring(lang.cast("string"), 1, 2)).isin(*LANGUAGES), F.lit(True))
    out = docs.withColumn("_known", known).withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumn("_words", F.when(F.col("_text").rlike(has_word), _words(F.col("_text"))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(has_word)))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": count(f"[{SYMBOLS}]").cast("long"),
        "_n_lines": F.size("_lines"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
        "_stops": count(r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(sorted(set(STOP_WORDS), key=lambda w: (-len(w), w))) + r")(?![\p{L}\p{N}])"),
        "_capitals": count(r"\p{Lu}"),
        "_exclamations": count("!"),
        "_stutters": count(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++\1(?![^\x20\x09-\x0D])"),
        "_bullets": F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09]*(?:[-*•·]|\d+[.)])[\x20\x09]"))),
        "_ellipses": F.size(F.filter("_lines", lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09]*$"))),
    })
    # Texts marked as another language are not judged by stop words.
    return out.withColumns({
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "exclamation_ratio": ratio("_exclamations", "n_words"),
        "capital_ratio": ratio("_capitals", "word_chars"),
        "stop_ratio": F.when(F.col("_known"), ratio("_stops", "n_words")),
        "stutter_ratio": ratio("_stutters", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "_n_lines"),
        "bullet_line_ratio": ratio("_bullets", "_n_lines"),
        "ellipsis_line_ratio": ratio("_ellipses", "_n_lines"),
    })


def compile_rules(rules=RULES) -> dict[str, Column]:
    """The threshold table as one boolean column per rule: true where the text passes."""
    out = {}
    for name, metric, least, most in rules:
        ok = F.lit(True)
        if least is not None:
            ok = ok & (F.col(metric) >= least)
        if most is not None:
            ok = ok & (F.col(metric) <= most)
        out[name] = F.coalesce(ok, F.lit(True))  # no metric, no verdict
    return out


def verdicts(docs: DataFrame, rules=RULES, lang: Column | None = None) -> DataFrame:
    """Adds base counts, base_failed, kept, and failed_rules, the names of the rules that a text fails."""
    passed = compile_rules(rules)
    out = metrics(docs, lang).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    out = out.withColumn("failed_rules", F.concat_ws(",", *[F.when(~ok, F.lit(name)) for name, ok in passed.items()]))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"), lang=F.col("lang")).select("doc_id", *BASE, "base_failed", "kept", "failed_rules")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, in their own columns. Each row travels beside its text, so names may clash.

    The verdict passes through a generator: a plain filter would be pushed below the projection, and compute its metrics many times.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    marked = verdicts(packed, lang=F.col("_row.lang") if "lang" in docs.columns else None).select("_row", F.explode_outer(F.when(F.col("kept"), F.array(F.lit(True)))).alias("_keep"))
    return marked.where("_keep").select("_row.*")


def _verdict_sql(name: str, metric: str, least: float | None, most: float | None) -> str:
    bad = " OR ".join([*([f"{metric} < {least}"] if least is not None else []), *([f"{metric} > {most}"] if most is not None else [])])
    return f"CASE WHEN {bad} THEN '{name}' END"


#: The query in SQL, metric by metric from the rules' own words: windows and runs of words are rows here.
OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1) GROUP BY rid),
pos AS (SELECT rid, x, p, p - row_number() OVER (PARTITION BY rid, x ORDER BY p) AS island FROM (SELECT rid, unnest(ws) AS x, unnest(range(len(ws))) AS p FROM w)),
stut AS (SELECT rid, sum(c // 2) AS n FROM (SELECT rid, count(*) AS c FROM pos GROUP BY rid, x, island) GROUP BY rid),
b AS (SELECT d.rid, doc_id, lang, t, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, coalesce(stut.n, 0) AS stutters, length(t) - length(replace(t, '!', '')) AS shouts, len(regexp_extract_all(t, '\p{{Lu}}')) AS capitals,
  len(list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+'), lambda x: list_contains([{", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}], lower(x)))) AS stops,
  len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*(?:[-*•·]|[0-9]+[.)])[\x20\x09]'))) AS bullets, len(list_filter(ls, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09]*$'))) AS dots
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN stut USING (rid)),
m AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio, CASE WHEN n_words > 0 THEN shouts / n_words ELSE 0 END AS exclamation_ratio,
  CASE WHEN word_chars > 0 THEN capitals / word_chars ELSE 0 END AS capital_ratio, CASE WHEN lang IS NOT NULL AND lower(substring(lang, 1, 2)) NOT IN {LANGUAGES} THEN NULL WHEN n_words > 0 THEN stops / n_words ELSE 0 END AS stop_ratio,
  CASE WHEN n_words > 0 THEN stutters / n_words ELSE 0 END AS stutter_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio, CASE WHEN n_lines > 0 THEN bullets / n_lines ELSE 0 END AS bullet_line_ratio, CASE WHEN n_lines > 0 THEN dots / n_lines ELSE 0 END AS ellipsis_line_ratio FROM b),
v AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, concat_ws(',', {", ".join(_verdict_sql(*r) for r in RULES)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v
"""
