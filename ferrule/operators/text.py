"""Projections over text: link, title and alt-text rules, statistics, time codes, model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions import text as T
from ferrule.plans.registry import operator

_TRIM = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"


def flagged(df: DataFrame, rule) -> DataFrame:
    """id, text and the rule's flag."""
    return df.select("id", "text", F.coalesce(rule(F.col("text")), F.lit(False)).alias("flag"))


@operator("generic_link_text", ["link_texts"], f"""SELECT id, text, regexp_replace(lower({_TRIM}), '[.>»:]+$', '') IN ('click here','here','read more','more','learn more','link','this link','download','see more','details','continue') AS flag FROM link_texts""")
def generic_link_text(df: DataFrame) -> DataFrame:
    return flagged(df, T.is_generic_link)


@operator("raw_url_text", ["link_texts"], f"""SELECT id, text, regexp_matches({_TRIM}, '^(https?://|www\\.)\\S+$', 'i') AND length({_TRIM}) > 30 AS flag FROM link_texts""")
def raw_url_text(df: DataFrame) -> DataFrame:
    return flagged(df, T.is_raw_url)


@operator("placeholder_title", ["titles"], r"""SELECT id, text, (t = '' OR regexp_matches(t, '^(untitled|unspecified|document\d*|presentation\d*|slide\s*show|unknown|title|new document)$') OR regexp_matches(t, '^microsoft (word|powerpoint) - ')
    OR regexp_matches(t, '\.(docx?|pptx?|pdf|pages|key|txt|rtf)$')) OR t = lower(regexp_replace(regexp_extract(file_name, '([^/]*)$', 1), '\.[^.]*$', '')) OR regexp_matches(t, '^(title of your event|your title here|title here|add a title|enter title|flyer\d*)$') AS flag
    FROM (SELECT *, lower(trim(text)) AS t FROM titles)""")
def placeholder_title(df: DataFrame) -> DataFrame:
    """A title that says nothing, or is only the file's name."""
    return df.select("id", "text", (T.is_placeholder_title(F.col("text")) | T.is_template_title(F.col("text"), F.col("file_name"))).alias("flag"))


@operator("weak_alt_text", ["link_texts"], r"""SELECT id, text, length(t) < 3 OR regexp_matches(t, '\.(png|jpe?g|gif|bmp|tiff?|svg|webp|emf|wmf)$')
    OR regexp_matches(t, '^(picture|image|graphic|photo|screenshot|logo|icon|chart|diagram|content placeholder|placeholder)\s*\d*$') OR regexp_matches(t, '^(img|dsc|screen shot|screenshot)[-_ ]?\d+') AS flag FROM (SELECT *, lower(trim(text)) AS t FROM link_texts)""")
def weak_alt_text(df: DataFrame) -> DataFrame:
    return flagged(df, T.is_weak_alt)


@operator("scaffolding_text", ["link_texts"], r"""SELECT id, text, regexp_matches(text, 'this (document|example|file|flyer|template)\s+(is|contains)\s+an?\s+example|intentional(ly)?\s+(accessibility\s+)?errors?|inaccessible\s+(flyer|document|example)|placeholder\s+text|lorem\s+ipsum', 'i') AS flag FROM link_texts""")
def scaffolding_text(df: DataFrame) -> DataFrame:
    return flagged(df, T.is_scaffolding)


@operator("manual_list_markers", ["documents"], r"""SELECT doc_id, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(trim(x, ' ' || chr(9) || chr(13)), '^([-*•·o]\s+|\d+[.)]\s+)'))) AS BIGINT) AS markers FROM documents""")
def manual_list_markers(documents: DataFrame) -> DataFrame:
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: T.strip(x).rlike(T.MANUAL_LIST))
    return documents.select("doc_id", F.size(lines).cast("long").alias("markers"))


@operator("safe_text", ["documents"], r"""SELECT doc_id, clean, CASE WHEN length(clean) > 60 THEN substring(clean, 1, 59) || '…' ELSE clean END AS truncated
    FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g')) AS clean FROM documents)""")
def safe_text(documents: DataFrame, n: int = 60) -> DataFrame:
    return documents.select("doc_id", T.clean(F.col("text")).alias("clean")).withColumn("truncated", T.truncate(F.col("clean"), n))


@operator("text_stats", ["documents"], r"""SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '\S+')) AS BIGINT) AS words, CAST(length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS BIGINT) AS chars,
    length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) = 0 AS is_empty FROM documents""")
def text_stats(documents: DataFrame) -> DataFrame:
    bare = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r"))
    chars = F.length(F.regexp_replace(bare, r"\s", ""))
    return documents.select("doc_id", F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"\s+"))).cast("long").alias("words"), chars.cast("long").alias("chars"), (chars == 0).alias("is_empty"))


@operator("slug_title", ["slugs"], r"""SELECT slug, regexp_replace(array_to_string(list_transform(list_filter(string_split(slug, '-'), lambda w: w <> ''), lambda w, i: CASE WHEN w IN ('aa','ada','ai','html','lms','ocr','pdf','vpat','wcag') THEN upper(w)
    WHEN i = 1 THEN upper(substring(w, 1, 1)) || substring(w, 2) ELSE w END), ' '), '(\d) (\d)', '\1.\2', 'g') AS title FROM slugs""")
def slug_title(slugs: DataFrame) -> DataFrame:
    return slugs.select("slug", T.slug_title(F.col("slug")).alias("title"))


@operator("token_cost", ["jobs"], "SELECT id, round(coalesce(input_tokens, 0) / 1000000.0 * 3 + coalesce(output_tokens, 0) / 1000000.0 * 15, 4) AS cost_usd FROM jobs")
def token_cost(jobs: DataFrame) -> DataFrame:
    return jobs.select("id", F.round(cost(F.col("input_tokens"), F.col("output_tokens")), 4).alias("cost_usd"))


def cost(tokens_in, tokens_out):
    """US dollars at 3 per million tokens in and 15 per million out."""
    return F.coalesce(tokens_in, F.lit(0)) / 1e6 * 3 + F.coalesce(tokens_out, F.lit(0)) / 1e6 * 15


@operator("timecode_format", ["words"], """SELECT media_id, pos, lpad(CAST(CAST(floor(start / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(start) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS mmss,
    lpad(CAST(CAST(floor(start / 3600) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor((start % 3600) / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(start % 60) AS BIGINT) AS VARCHAR), 2, '0') || '.' || lpad(CAST(CAST(floor((start - floor(start)) * 1000 + 0.5) AS BIGINT) AS VARCHAR), 3, '0') AS hhmmss,
    '[' || lpad(CAST(CAST(floor(start / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(start) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '] ' || text AS line FROM words""")
def timecode_format(words: DataFrame) -> DataFrame:
    return words.select("media_id", "pos", T.clock(F.col("start")).alias("mmss"), T.timecode(F.col("start")).alias("hhmmss"),
                        F.concat(F.lit("["), T.clock(F.col("start")), F.lit("] "), F.col("text")).alias("line"))


@operator("email_filter", ["contacts"], r"SELECT id, trim(email) AS email, regexp_matches(trim(email), '^[^@]+@[^@]+\.[^@]+$') AND trim(name) <> '' AS is_valid FROM contacts")
def email_filter(contacts: DataFrame) -> DataFrame:
    email = T.strip(F.col("email"))
    return contacts.select("id", email.alias("email"), (email.rlike(r"^[^@]+@[^@]+\.[^@]+$") & (T.strip(F.col("name")) != "")).alias("is_valid"))


@operator("media_source", ["media_inputs"], r"""SELECT id, CASE WHEN vid <> '' THEN 'url' WHEN ext IN ('.mp4','.mov','.avi','.mkv','.webm') THEN 'video' WHEN ext IN ('.mp3','.wav','.m4a','.ogg') THEN 'audio' ELSE 'unsupported' END AS source_kind, nullif(vid, '') AS video_id
    FROM (SELECT id, regexp_extract(source, '(?:v=|youtu\.be/|embed/)([\w-]{11})', 1) AS vid, lower(regexp_extract(source, '(\.[^./]*)$', 1)) AS ext FROM media_inputs)""")
def media_source(inputs: DataFrame) -> DataFrame:
    video_id = F.nullif(F.regexp_extract("source", r"(?:v=|youtu\.be/|embed/)([\w-]{11})", 1), F.lit(""))
    ext = F.lower(F.regexp_extract("source", r"(\.[^./]*)$", 1))
    kind = (F.when(video_id.isNotNull(), "url").when(ext.isin(".mp4", ".mov", ".avi", ".mkv", ".webm"), "video")
            .when(ext.isin(".mp3", ".wav", ".m4a", ".ogg"), "audio").otherwise("unsupported"))
    return inputs.select("id", kind.alias("source_kind"), video_id.alias("video_id"))


@operator("model_json_parse", ["model_text"], r"""SELECT id, CASE WHEN ok THEN array_to_string(CAST(json_extract(body, '$.fixesMade') AS VARCHAR[]), '|') ELSE '' END AS fixes, CASE WHEN ok THEN array_to_string(CAST(json_extract(body, '$.issues') AS VARCHAR[]), '|') ELSE '' END AS issues, NOT ok AS is_fallback
    FROM (SELECT id, CASE WHEN json_valid(b) THEN b ELSE '{}' END AS body, json_valid(b) AND b LIKE '{%' AND coalesce(json_array_length(CASE WHEN json_valid(b) THEN b ELSE '{}' END, '$.fixesMade'), 0) > 0 AS ok FROM (SELECT id, regexp_extract(response, '\{[\s\S]*\}') AS b FROM model_text))""")
def model_json_parse(model_text: DataFrame, schema: str = "fixesMade array<string>, issues array<string>") -> DataFrame:
    """The object in a model's answer, or the default object where none can be read or it reports no fix."""
    body = F.regexp_extract(T.unfence(F.col("response")), r"(?s)\{.*\}", 0)
    parsed = model_text.select("id", F.from_json(body, schema).alias("p"))
    ok = F.coalesce(F.size("p.fixesMade"), F.lit(0)) > 0
    joined = lambda c: F.when(ok, F.coalesce(F.array_join(c, "|"), F.lit(""))).otherwise("")
    return parsed.select("id", joined("p.fixesMade").alias("fixes"), joined("p.issues").alias("issues"), (~ok).alias("is_fallback"))


@operator("html_cleanup", ["fragments"], r"""SELECT doc_id, '<div lang="en">' || chr(10) || string_agg(CASE WHEN regexp_matches(c, '^<div[^>]*lang=["''][a-zA-Z-]+["''][^>]*>[\s\S]*</div>$', 'i')
    THEN trim(regexp_extract(c, '^<div[^>]*lang=["''][a-zA-Z-]+["''][^>]*>([\s\S]*)</div>$', 1, 'i'), ' ' || chr(10)) ELSE c END, chr(10) ORDER BY seq) || chr(10) || '</div>' AS html
    FROM (SELECT doc_id, seq, trim(regexp_replace(regexp_replace(trim(html, ' ' || chr(10)), '^```(?:html)?\s*', ''), '```\s*$', ''), ' ' || chr(10)) AS c FROM fragments) GROUP BY doc_id""")
def html_cleanup(fragments: DataFrame) -> DataFrame:
    """Fragments without fences and language wrappers, joined in order and wrapped once."""
    c = T.unfence(F.col("html"), "html")
    wrapper = r"""(?is)^<div[^>]*lang=["'][a-z-]+["'][^>]*>(.*)</div>$"""
    bare = F.when(c.rlike(wrapper), T.strip(F.regexp_extract(c, wrapper, 1))).otherwise(c)
    ordered = F.array_sort(F.collect_list(F.struct("seq", bare.alias("c"))))
    body = F.array_join(F.transform(ordered, lambda x: x["c"]), "\n")
    return fragments.groupBy("doc_id").agg(F.concat(F.lit('<div lang="en">\n'), body, F.lit("\n</div>")).alias("html"))


@operator("row_text_clean", ["point_lines"], r"""SELECT doc_id, seq, CASE WHEN regexp_matches(t, '\.{3,}\s*\d+\s*(?:pts|points)') THEN trim(regexp_extract(t, '^(.*?)\s*\.{3,}', 1)) ELSE trim(t) END AS item, nullif(regexp_extract(t, '\.{3,}\s*(\d+)\s*(?:pts|points)', 1), '') AS points
    FROM (SELECT doc_id, seq, replace(line, '**', '') AS t FROM point_lines)""")
def row_text_clean(lines: DataFrame) -> DataFrame:
    """Dot leaders split into item and points; bold marks go."""
    t = F.regexp_replace("line", r"\*\*", "")
    points = F.nullif(F.regexp_extract(t, r"\.{3,}\s*(\d+)\s*(?:pts|points)", 1), F.lit(""))
    item = F.when(points.isNotNull(), F.trim(F.regexp_extract(t, r"^(.*?)\s*\.{3,}", 1))).otherwise(F.trim(t))
    return lines.select("doc_id", "seq", item.alias("item"), points.alias("points"))


@operator("affine_bbox", ["placements"], """SELECT doc_id, elem_id, round(least(e, a + e, c + e, a + c + e), 4) AS x0, round(least(f, b + f, d + f, b + d + f), 4) AS y0, round(greatest(e, a + e, c + e, a + c + e), 4) AS x1, round(greatest(f, b + f, d + f, b + d + f), 4) AS y1 FROM placements""")
def affine_bbox(placements: DataFrame) -> DataFrame:
    """The box of the unit square under a 2x3 matrix."""
    xs = [F.col("e"), F.col("a") + F.col("e"), F.col("c") + F.col("e"), F.col("a") + F.col("c") + F.col("e")]
    ys = [F.col("f"), F.col("b") + F.col("f"), F.col("d") + F.col("f"), F.col("b") + F.col("d") + F.col("f")]
    r = lambda f, v, n: F.round(f(*v), 4).alias(n)
    return placements.select("doc_id", "elem_id", r(F.least, xs, "x0"), r(F.least, ys, "y0"), r(F.greatest, xs, "x1"), r(F.greatest, ys, "y1"))


@operator("text_box_estimate", ["runs"], "SELECT doc_id, elem_id, round(x, 4) AS x0, round(y - 0.25 * size, 4) AS y0, round(x + n_glyphs * avg_glyph * size, 4) AS x1, round(y + 0.75 * size, 4) AS y1 FROM runs")
def text_box_estimate(runs: DataFrame) -> DataFrame:
    """A text run's box from its size and mean glyph width."""
    return runs.select("doc_id", "elem_id", F.round("x", 4).alias("x0"), F.round(F.col("y") - 0.25 * F.col("size"), 4).alias("y0"),
                       F.round(F.col("x") + F.col("n_glyphs") * F.col("avg_glyph") * F.col("size"), 4).alias("x1"), F.round(F.col("y") + 0.75 * F.col("size"), 4).alias("y1"))
