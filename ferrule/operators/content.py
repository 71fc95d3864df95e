"""Knowledge base, sitemap and posts: reconciliation, search, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.plans.registry import operator

FIELDS = ("section", "section_name", "order_num", "title", "summary", "related_ids")


@operator("kb_related", ["kb_articles"], """SELECT a.id, string_agg(b.id || ':' || b.title, '|' ORDER BY r.p) AS related FROM kb_articles a,
    LATERAL (SELECT unnest(CAST(json(a.related_ids) AS VARCHAR[])) AS rid, unnest(range(3)) AS p) r JOIN kb_articles b ON b.id = r.rid GROUP BY a.id""")
def kb_related(articles: DataFrame) -> DataFrame:
    """Related articles in the order given; unknown ids drop out."""
    ids = articles.select("id", F.posexplode(F.from_json("related_ids", "array<string>")).alias("p", "rid"))
    named = articles.select(F.col("id").alias("rid"), "title")
    ordered = F.array_sort(F.collect_list(F.struct("p", F.concat("rid", F.lit(":"), "title").alias("t"))))
    return ids.join(named, "rid").groupBy("id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "|").alias("related"))


@operator("kb_reconcile", ["kb_source", "kb_live"], f"""SELECT coalesce(s.id, l.id) AS id, CASE WHEN l.id IS NULL THEN 'insert' WHEN s.id IS NULL THEN 'delete' WHEN {' OR '.join(f's.{f} IS DISTINCT FROM l.{f}' for f in FIELDS)} THEN 'update' ELSE 'keep' END AS action FROM kb_source s FULL JOIN kb_live l ON l.id = s.id""")
def kb_reconcile(source: DataFrame, live: DataFrame) -> DataFrame:
    """What makes the live articles equal the source; null-safe on every field. Applying it twice changes nothing."""
    s, v = source.alias("s"), live.alias("l")
    differs = F.lit(False)
    for f in FIELDS:
        differs = differs | ~F.col(f"s.{f}").eqNullSafe(F.col(f"l.{f}"))
    action = F.when(F.col("l.id").isNull(), "insert").when(F.col("s.id").isNull(), "delete").when(differs, "update").otherwise("keep")
    return s.join(v, F.col("s.id") == F.col("l.id"), "full").select(F.coalesce("s.id", "l.id").alias("id"), action.alias("action"))


@operator("kb_patch", ["kb_live", "kb_patches"], """SELECT l.id, l.section, CASE WHEN coalesce(p.has_title, false) THEN p.title ELSE l.title END AS title, CASE WHEN coalesce(p.has_summary, false) THEN p.summary ELSE l.summary END AS summary FROM kb_live l LEFT JOIN kb_patches p ON p.id = l.id""")
def kb_patch(live: DataFrame, patches: DataFrame) -> DataFrame:
    """Partial updates: a field that a patch has not keeps its value; one that it has may become null."""
    p = patches.select(F.col("id").alias("pid"), "has_title", F.col("title").alias("pt"), "has_summary", F.col("summary").alias("ps"))
    pick = lambda has, new, old: F.when(F.coalesce(has, F.lit(False)), F.col(new)).otherwise(F.col(old)).alias(old)
    return live.join(p, F.col("id") == F.col("pid"), "left").select("id", "section", pick("has_title", "pt", "title"), pick("has_summary", "ps", "summary"))


@operator("kb_search", ["kb_articles"], "SELECT id, section, title FROM kb_articles WHERE title ILIKE '%th_n%' OR summary ILIKE '%th_n%' OR section_name ILIKE '%th_n%'")
def kb_search(articles: DataFrame, q: str = "th_n") -> DataFrame:
    """Case-insensitive search in title, summary and section; % and _ in the query are wildcards; a blank query finds nothing."""
    if not q.strip():
        return articles.limit(0).select("id", "section", "title")
    hit = F.lit(False)
    for c in ("title", "summary", "section_name"):
        hit = hit | F.coalesce(F.col(c).ilike(f"%{q}%"), F.lit(False))
    return articles.where(hit).orderBy("section", "order_num", "id").select("id", "section", "title")


@operator("kb_list", ["kb_articles"], "SELECT id, section, order_num, array_to_string(CAST(json(related_ids) AS VARCHAR[]), ',') AS related FROM kb_articles WHERE section = 2")
def kb_list(articles: DataFrame, id: str | None = None, section: int | None = 2) -> DataFrame:
    picked = articles if id is None else articles.where(F.col("id") == id)
    picked = picked if section is None else picked.where(F.col("section") == section)
    return picked.orderBy("section", "order_num", "id").select("id", "section", "order_num", F.array_join(F.from_json("related_ids", "array<string>"), ",").alias("related"))


@operator("kb_orphans", ["kb_source", "kb_live"], "SELECT id FROM kb_live EXCEPT SELECT id FROM kb_source")
def kb_orphans(source: DataFrame, live: DataFrame) -> DataFrame:
    return live.select("id").subtract(source.select("id"))


@operator("kb_missing", ["kb_source", "kb_live"], "SELECT id FROM kb_source EXCEPT SELECT id FROM kb_live")
def kb_missing(source: DataFrame, live: DataFrame) -> DataFrame:
    return source.select("id").subtract(live.select("id"))


@operator("kb_shared", ["kb_source", "kb_live"], "SELECT id FROM kb_source INTERSECT SELECT id FROM kb_live")
def kb_shared(source: DataFrame, live: DataFrame) -> DataFrame:
    return source.select("id").intersect(live.select("id"))


@operator("sitemap_union", ["routes", "posts", "kb_articles"], """SELECT path AS loc, coalesce(changefreq, 'monthly') AS changefreq, coalesce(CAST(priority AS DOUBLE), 0.7) AS priority, CAST(NULL AS VARCHAR) AS lastmod FROM routes
    UNION ALL SELECT '/blog/' || slug, 'monthly', 0.7, CAST(coalesce(updated_at, published_at) AS VARCHAR) FROM posts UNION ALL SELECT '/guides/' || id, 'monthly', 0.6, NULL FROM kb_articles""")
def sitemap_union(routes: DataFrame, posts: DataFrame, articles: DataFrame) -> DataFrame:
    r = routes.select(F.col("path").alias("loc"), "changefreq", F.col("priority").cast("double"))
    p = posts.select(F.concat(F.lit("/blog/"), "slug").alias("loc"), F.coalesce("updated_at", "published_at").cast("string").alias("lastmod"))
    a = articles.select(F.concat(F.lit("/guides/"), "id").alias("loc"), F.lit(0.6).alias("priority"))
    out = r.unionByName(p, allowMissingColumns=True).unionByName(a, allowMissingColumns=True)
    return out.select("loc", F.coalesce("changefreq", F.lit("monthly")).alias("changefreq"), F.coalesce("priority", F.lit(0.7)).alias("priority"), "lastmod")


@operator("language_set", ["part_langs"], "SELECT doc_id, string_agg(lang, ',' ORDER BY lang) AS langs FROM (SELECT DISTINCT doc_id, lang FROM part_langs WHERE lang IS NOT NULL) GROUP BY doc_id")
def language_set(part_langs: DataFrame) -> DataFrame:
    return part_langs.groupBy("doc_id").agg(F.array_sort(F.collect_set("lang")).alias("l")).where(F.size("l") > 0).select("doc_id", F.array_join("l", ",").alias("langs"))
