"""Web pages: element rows, typed blocks and head audits, with built-in functions only.

Scripts, styles and comments go first; then every opening tag is an element whose text reaches to its end tag. No tree is repaired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule.plans.registry import operator

REMOVED = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
#: A tag: its slash, name and attributes. Quoted values may hold a >; a tag whose last quote stays open ends at the first >.
TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
ATTRIBUTE = r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?"
#: Fixed values of HTML: elements whose text is that of others, so that only what stands before their first tag is their own.
CONTAINERS = ("html", "head", "body", "main", "article", "section", "nav", "header", "footer", "aside", "div", "form", "fieldset", "table", "thead", "tbody", "tfoot", "tr", "ul", "ol", "dl", "select")
INLINE = ("a", "abbr", "b", "cite", "code", "em", "font", "i", "label", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u", "time", "button", "option", "img")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BREAK = "\x01"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&#160;", " "), ("&amp;", "&"))


def bare(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), REMOVED, "")


def decoded(text: Column) -> Column:
    """Common character references as characters, white space runs as one space, trimmed."""
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def attributes(text: Column) -> Column:
    """Attributes as a map, in double, single or no quotes or without a value (empty); the first of equal names counts."""
    part = lambda k: F.regexp_extract_all(text, F.lit(ATTRIBUTE), F.lit(k))

    def entries(found: Column) -> Column:
        names, pairs = found["k"], F.arrays_zip(found["k"].alias("k"), found["a"].alias("a"), found["b"].alias("b"), found["c"].alias("c"))
        firsts = F.when(F.size(F.array_distinct(names)) == F.size(names), pairs).otherwise(F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1))
        return F.transform(firsts, lambda p: F.struct(p["k"], F.concat(p["a"], p["b"], p["c"])))

    # the lists are bound once as a lambda's variable, for else each attribute would search the tag again
    found = F.struct(F.transform(part(1), F.lower).alias("k"), part(2).alias("a"), part(3).alias("b"), part(4).alias("c"))
    return F.map_from_entries(F.get(F.transform(F.array(found), entries), 0))


def tokens(pages: DataFrame) -> DataFrame:
    """page_id, pos, close, tag, raw of every tag, and piece, the text between it and the next tag.

    A piece behind a line break begins with ``BREAK``, behind other tags that are not inline with a space. A row holds its own piece alone.
    """
    h = F.col("h")
    part = lambda k: F.regexp_extract_all(h, F.lit(TAG), F.lit(k))
    texts = F.split(h, TAG, -1)
    found = pages.select("page_id", bare(F.col("html")).alias("h")).select("page_id", F.arrays_zip(part(1).alias("slash"), F.transform(part(2), F.lower).alias("tag"), part(3).alias("raw"), F.slice(texts, F.lit(2), F.size(texts)).alias("after")).alias("tags"))
    tag = F.col("t.tag")
    before = F.when(tag == "br", BREAK).when(tag.isin(*INLINE), "").otherwise(" ")
    each = found.select("page_id", F.posexplode("tags").alias("pos", "t"))
    return each.select("page_id", "pos", (F.col("t.slash") == "/").alias("close"), tag.alias("tag"), F.col("t.raw").alias("raw"), F.concat(before, F.col("t.after")).alias("piece"))


def spans(pages: DataFrame) -> DataFrame:
    """Every tag with ``end``, the position of its end tag, or the position after its own where it owns no other text, and ``tables``, the number of tables open there.

    The end tag is found by depth: of equal names, an opening tag at depth d ends at the next tag that leaves d. All windows lie in one shuffle by page.
    """
    void = F.col("tag").isin(*VOID)
    t = tokens(pages).repartition("page_id")
    so_far = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("opened", F.sum(F.when(F.col("tag") != "table", 0).when(F.col("close"), -1).otherwise(1)).over(so_far))
    t = t.withColumn("tables", (F.col("opened") - F.least(F.lit(0), F.min("opened").over(so_far))).cast("int"))  # end tags without a table close nothing
    step = F.when(void, 0).when(F.col("close"), -1).otherwise(1)
    named = W.partitionBy("page_id", "tag").orderBy("pos")
    t = t.withColumn("after", F.sum(step).over(named.rowsBetween(W.unboundedPreceding, 0)))
    t = t.withColumn("depth", F.when(F.col("close"), F.col("after") + 1).otherwise(F.col("after")))
    level = W.partitionBy("page_id", "tag", "depth").orderBy("pos")
    end = F.when(F.lead("close").over(level), F.lead("pos").over(level))
    return t.withColumn("end", F.coalesce(F.when(~F.col("close") & ~void & ~F.col("tag").isin(*CONTAINERS), end), F.col("pos") + 1)).drop("after", "depth", "opened")


def elements(pages: DataFrame) -> DataFrame:
    """page_id, seq, tag, attrs map, text, marked (the text before its references are decoded, with line breaks) and tables (how many are open there, itself included) of every element.

    An element's text reaches to its own end tag, over what lies inside; that of containers and of elements without an end tag reaches to the next tag.
    A page's tags meet in one row, in order, and each element slices its own pieces out of it, so memory is that of the page and of its elements' texts.
    """
    page = F.array_sort(F.collect_list(F.struct("pos", "end", "close", "tag", "raw", "piece", "tables")))

    def inside(all_tags: Column, t: Column) -> Column:
        pieces = F.slice(all_tags, t["pos"] + 1, t["end"] - t["pos"])
        return F.when(t["end"] == t["pos"] + 1, t["piece"]).otherwise(F.array_join(F.transform(pieces, lambda x: x["piece"]), ""))

    def opened(all_tags: Column) -> Column:
        return F.transform(F.filter(all_tags, lambda t: ~t["close"]), lambda t, n: F.struct(n.alias("seq"), t["tag"].alias("tag"), t["raw"].alias("raw"), inside(all_tags, t).alias("marked"), t["tables"].alias("tables")))

    # the sorted page is bound once as a lambda's variable, for else each element would sort it again
    bound = F.get(F.transform(F.array(page), opened), 0)
    kept = spans(pages).groupBy("page_id").agg(bound.alias("e")).select("page_id", F.inline("e"))
    return kept.select("page_id", "seq", "tag", attributes(F.col("raw")).alias("attrs"), decoded(F.replace("marked", F.lit(BREAK), F.lit(" "))).alias("text"), "marked", "tables")


_CLEAN = r"regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g')"
_TAG_SQL = r"""'</?[a-zA-Z][a-zA-Z0-9]*(?:[^>"'']|"[^"]*"|''[^'']*'')*>'"""
_NAME_SQL = "lower(regexp_extract(m, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1))"
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_DECODED = "x"
for _name, _value in ENTITIES:
    _DECODED = f"replace({_DECODED}, '{_name}', '{_value.replace(chr(39), chr(39) * 2)}')"
_DECODED = f"trim(regexp_replace({_DECODED}, '\\s+', ' ', 'g'))"


def attribute_sql(name: str) -> str:
    """An attribute of an element's raw tag: null where it is absent, empty where it has no value."""
    value = rf"""(?i)[\s"'']{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''=<>`]+))"""
    return rf"""CASE WHEN regexp_matches(raw, '{value}') THEN concat(regexp_extract(raw, '{value}', 1), regexp_extract(raw, '{value}', 2), regexp_extract(raw, '{value}', 3)) WHEN regexp_matches(raw, '(?i)[\s"'']{name}(?:[\s/]|$)') THEN '' END"""


#: Elements in the oracle's own words: an element ends at the first end tag of its name before which equal names are balanced.
ELEMENTS_SQL = f"""tk AS (SELECT page_id, pos, m, {_NAME_SQL} AS tag, m LIKE '</%' AS closes, concat(CASE WHEN {_NAME_SQL} = 'br' THEN chr(1) WHEN {_NAME_SQL} IN {_IN(INLINE)} THEN '' ELSE ' ' END, texts[pos + 2]) AS after FROM (SELECT page_id, texts, unnest(ms) AS m, unnest(range(len(ms))) AS pos FROM (SELECT page_id, regexp_extract_all(h, {_TAG_SQL}) AS ms, regexp_split_to_array(h, {_TAG_SQL}) AS texts FROM (SELECT page_id, {_CLEAN} AS h FROM pages)))),
    bal AS (SELECT *, sum(CASE WHEN closes THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, tag ORDER BY pos) AS bal FROM tk WHERE tag NOT IN {_IN(VOID)}),
    ends AS (SELECT o.page_id, o.pos, min(c.pos) AS stop FROM bal o JOIN bal c ON c.page_id = o.page_id AND c.tag = o.tag AND c.closes AND c.pos > o.pos AND c.bal = o.bal - 1 WHERE NOT o.closes AND o.tag NOT IN {_IN(CONTAINERS)} GROUP BY 1, 2),
    el AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS seq, tag, concat(' ', regexp_extract(m, '(?s)^<[a-zA-Z][a-zA-Z0-9]*(.*)>$', 1)) AS raw, {_DECODED.replace('(x', "(replace(x, chr(1), ' ')", 1)} AS text, x AS marked
      FROM (SELECT a.page_id, a.pos, a.tag, a.m, (SELECT string_agg(b.after, '' ORDER BY b.pos) FROM tk b WHERE b.page_id = a.page_id AND b.pos >= a.pos AND b.pos < coalesce(e.stop, a.pos + 1)) AS x FROM tk a LEFT JOIN ends e ON e.page_id = a.page_id AND e.pos = a.pos WHERE NOT a.closes))"""


@operator("html_elements", ["pages"], f"WITH {ELEMENTS_SQL} SELECT page_id, seq, tag, text, {attribute_sql('class')} AS class, {attribute_sql('href')} AS href FROM el")
def html_elements(pages: DataFrame) -> DataFrame:
    return elements(pages).select("page_id", F.col("seq").cast("long").alias("seq"), "tag", "text", F.try_element_at("attrs", F.lit("class")).alias("class"), F.try_element_at("attrs", F.lit("href")).alias("href"))


_KIND = "CASE WHEN tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') THEN 'heading' WHEN tag = 'li' AND list = 'ol' THEN 'numbered' WHEN tag = 'li' THEN 'bullet' WHEN tag IN ('td', 'th') THEN 'cell' ELSE 'paragraph' END"


_SKIPPED = ("title", "meta", "head", "html", "link")


@operator("html_blocks", ["pages"], f"""WITH {ELEMENTS_SQL}, l AS (SELECT *, last_value(CASE WHEN tag IN ('ul', 'ol') THEN tag END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY seq) AS list FROM el),
    p AS (SELECT page_id, seq, tag, list, unnest(string_split(marked, chr(1))) AS x, unnest(range(len(string_split(marked, chr(1))))) AS part FROM l WHERE tag NOT IN {_IN(_SKIPPED)} AND tag NOT IN {_IN(INLINE)} AND tag <> 'br')
    SELECT page_id, seq, part, {_KIND} AS block_type, CASE WHEN tag IN ('h1', 'h2', 'h3') THEN CAST(substring(tag, 2, 1) AS BIGINT) WHEN tag IN ('h4', 'h5', 'h6') THEN 4 END AS level, regexp_replace({_DECODED}, '^\\*\\*', '') AS text FROM p WHERE {_DECODED} <> ''""")
def html_blocks(pages: DataFrame) -> DataFrame:
    """Typed blocks: h4 to h6 are level 4, list items follow their list, a line break parts a block. Inline elements belong to the block around them."""
    last_list = F.last(F.when(F.col("tag").isin("ul", "ol"), F.col("tag")), ignorenulls=True).over(W.partitionBy("page_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    e = elements(pages).withColumn("list", last_list).where(~F.col("tag").isin(*_SKIPPED, *INLINE, "br"))
    parts = e.select("page_id", "seq", "tag", "list", F.posexplode(F.split("marked", BREAK)).alias("part", "x")).withColumn("text", decoded(F.col("x"))).where("text != ''")
    level = F.when(F.col("tag").isin("h1", "h2", "h3"), F.substring("tag", 2, 1).cast("long")).when(F.col("tag").isin("h4", "h5", "h6"), 4)
    return parts.select("page_id", F.col("seq").cast("long").alias("seq"), F.col("part").cast("long").alias("part"), F.expr(_KIND).alias("block_type"), level.alias("level"), F.regexp_replace("text", r"^\*\*", "").alias("text"))


def page_meta(pages: DataFrame) -> DataFrame:
    h = F.coalesce("html", F.lit(""))
    title = F.trim(F.regexp_extract(h, r"(?is)<title[^>]*>([^<]*)", 1))
    has = lambda pattern: h.rlike(pattern)
    return pages.select("page_id", title.alias("title"), F.length(title).cast("long").alias("title_len"), has('(?i)<meta[^>]*name="description"').alias("has_description"), has('(?i)<link[^>]*rel="canonical"').alias("has_canonical"),
                        has('(?i)<meta[^>]*name="robots"').alias("has_robots"), F.nullif(F.regexp_extract(h, r'(?i)<html[^>]*lang="([^"]*)"', 1), F.lit("")).alias("lang"))


@operator("page_meta_audit", ["pages"], """SELECT page_id, title, CAST(length(title) AS BIGINT) AS title_len, regexp_matches(h, '<meta[^>]*name="description"', 'i') AS has_description, regexp_matches(h, '<link[^>]*rel="canonical"', 'i') AS has_canonical, regexp_matches(h, '<meta[^>]*name="robots"', 'i') AS has_robots,
    nullif(regexp_extract(h, '(?i)<html[^>]*lang="([^"]*)"', 1), '') AS lang FROM (SELECT page_id, coalesce(html, '') AS h, trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>([^<]*)', 1)) AS title FROM pages)""")
def page_meta_audit(pages: DataFrame) -> DataFrame:
    return page_meta(pages)
