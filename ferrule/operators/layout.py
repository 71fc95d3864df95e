"""Pages, boxes, figures and structure trees."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule.functions import text as T
from ferrule.plans.registry import operator
from ferrule.sources.shared import replaced, written

DEPTH = 4  # levels that a container may lie below the root
CELL = 36  # points of the smallest cell of a page's grid
REACH = 2  # cells that a link's longer side may span
SHORT = 4  # rounds of doubling before the size of documents is looked up
HELD = 2  # rounds of doubling, for trees of four levels, that move no rows
BITS = 1024  # bits that a fold gathers before it puts them aside


@operator("link_text_under_rect", ["annotations", "text_items"], """SELECT doc_id, page, annot_id, visible_text, trim(visible_text) = '' OR lower(trim(visible_text)) IN ('click here','here','read more','more','learn more','link','this link','download','see more','details','continue') AS is_bad FROM (
    SELECT a.doc_id, a.page, a.annot_id, CASE WHEN count(t.str) > 0 THEN string_agg(t.str, ' ' ORDER BY t.x, t.seq) ELSE coalesce(max(a.alt), '') END AS visible_text
    FROM annotations a LEFT JOIN text_items t ON t.doc_id = a.doc_id AND t.page = a.page AND t.x >= a.x1 - 3 AND t.x + t.w <= a.x2 + 4 AND t.y >= a.y1 - 3 AND t.y + t.h <= a.y2 + 3 WHERE a.subtype = 'Link' GROUP BY 1, 2, 3)""")
def link_text_under_rect(annotations: DataFrame, items: DataFrame) -> DataFrame:
    """The text inside each link's rectangle, left to right; the alternative text where there is none.

    A page is a grid: an item lies in the cell of its corner, a link in the few cells that its rectangle reaches, and they meet by cell. A link's
    cells are as large as it needs (36 points times a power of two), so that it reaches three on a side at most; items lie in the grids of their page's links.
    """
    key, cell = ["doc_id", "page"], ["doc_id", "page", "level", "cx", "cy"]
    low, high = {"x": F.col("x1") - 3, "y": F.col("y1") - 3}, {"x": F.col("x2") + 4, "y": F.col("y2") + 3}
    span = F.greatest(high["x"] - low["x"], high["y"] - low["y"], F.lit(1.0))
    size = F.lit(float(CELL)) * F.pow(F.lit(2.0), F.col("level"))
    links = annotations.where("subtype = 'Link'").withColumn("level", F.greatest(F.lit(0), F.coalesce(F.ceil(F.log2(span / (REACH * CELL))).cast("int"), F.lit(0))))
    reached = lambda c: F.sequence(F.floor(low[c] / size), F.greatest(F.floor(low[c] / size), F.floor(high[c] / size)))
    spread = links.withColumn("cx", F.explode_outer(reached("x"))).withColumn("cy", F.explode_outer(reached("y"))).select(*cell, "annot_id", "alt", "x1", "y1", "x2", "y2")
    grids = links.groupBy(*key).agg(F.collect_set("level").alias("levels"))
    t = items.select(*key, "seq", "str", "x", "y", "w", "h").join(grids, key).withColumn("level", F.explode("levels")).drop("levels")
    t = t.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    inside = (F.col("x") >= F.col("x1") - 3) & (F.col("x") + F.col("w") <= F.col("x2") + 4) & (F.col("y") >= F.col("y1") - 3) & (F.col("y") + F.col("h") <= F.col("y2") + 3)
    held = t.select(*[F.col(c).alias(f"{c}_") for c in cell], "seq", "str", "x", "y", "w", "h")
    same = (F.col("doc_id") == F.col("doc_id_")) & (F.col("page") == F.col("page_")) & (F.col("level") == F.col("level_")) & (F.col("cx") == F.col("cx_")) & (F.col("cy") == F.col("cy_"))
    joined = spread.join(held, same & inside, "left")
    words = F.array_sort(F.collect_list(F.when(F.col("str").isNotNull(), F.struct("x", "seq", "str"))))
    seen = joined.groupBy("doc_id", "page", "annot_id").agg(words.alias("w"), F.max("alt").alias("alt"))
    visible = F.when(F.size("w") > 0, F.array_join(F.transform("w", lambda x: x["str"]), " ")).otherwise(F.coalesce("alt", F.lit("")))
    return seen.select("doc_id", "page", "annot_id", visible.alias("visible_text"), T.is_bad_link(visible).alias("is_bad"))


@operator("figure_decisions", ["figures", "decisions"], """SELECT f.doc_id, f.mcid, CASE WHEN d.decorative THEN 'artifact' WHEN d.mcid IS NULL THEN 'keep' ELSE 'set_alt' END AS action, CASE WHEN d.decorative THEN NULL ELSE coalesce(nullif(d.alt_text, ''), nullif(f.existing_alt, ''), 'Image') END AS alt
    FROM figures f LEFT JOIN decisions d ON d.doc_id = f.doc_id AND d.mcid = f.mcid""")
def figure_decisions(figures: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decorative figures go; others take the decided text, else their own, else 'Image'."""
    d = decisions.withColumn("decided", F.lit(True))
    joined = figures.join(d, ["doc_id", "mcid"], "left")
    drop = F.coalesce("decorative", F.lit(False))
    action = F.when(drop, "artifact").when(F.col("decided").isNull(), "keep").otherwise("set_alt")
    alt = F.coalesce(F.nullif("alt_text", F.lit("")), F.nullif("existing_alt", F.lit("")), F.lit("Image"))
    return joined.select("doc_id", "mcid", action.alias("action"), F.when(~drop, alt).alias("alt"))


@operator("image_ref_match", ["html_refs", "ref_images"], """SELECT r.doc_id, r.seq, i.image_id AS src_id, CASE WHEN r.alt <> '' THEN r.alt WHEN r.src IS NULL AND r.caption IS NOT NULL THEN substring(r.caption, 1, 500) ELSE 'Figure' END AS alt, i.image_id IS NULL AS is_placeholder
    FROM html_refs r LEFT JOIN ref_images i ON i.doc_id = r.doc_id AND i.image_id = replace(r.src, 'cid:', '')""")
def image_ref_match(refs: DataFrame, images: DataFrame) -> DataFrame:
    """References to extracted images by id. Unmatched ones get a placeholder; a figure without image takes its caption as text."""
    r = refs.withColumn("image_id", F.regexp_replace("src", "^cid:", ""))
    joined = r.join(images.withColumn("found", F.lit(True)), ["doc_id", "image_id"], "left")
    alt = F.when(F.col("alt") != "", F.col("alt")).when(F.col("src").isNull() & F.col("caption").isNotNull(), F.substring("caption", 1, 500)).otherwise("Figure")
    return joined.select("doc_id", "seq", F.when(F.col("found"), F.col("image_id")).alias("src_id"), alt.alias("alt"), F.col("found").isNull().alias("is_placeholder"))


@operator("orphan_figures", ["marks", "decisions"], """SELECT doc_id, page, mark_id, concat_ws(',', x0, y0, x1, y1) IS NOT NULL AS has_box FROM marks m WHERE tag = 'Figure' AND has_image AND NOT EXISTS (SELECT 1 FROM decisions d WHERE d.doc_id = m.doc_id AND d.mcid = m.mcid)""")
def orphan_figures(marks: DataFrame, entries: DataFrame) -> DataFrame:
    """Figure marks with an image that no structure entry holds."""
    free = marks.where("tag = 'Figure' and has_image").join(entries.select("doc_id", "mcid"), ["doc_id", "mcid"], "left_anti")
    return free.select("doc_id", "page", "mark_id", F.col("x0").isNotNull().alias("has_box"))


@operator("dangling_annots", ["html_refs", "annotations"], """SELECT r.doc_id, r.seq AS node_id, CASE WHEN r.alt = '' THEN 'remove' WHEN r.caption IS NOT NULL THEN 'artifact' ELSE 'to_p' END AS action FROM html_refs r WHERE NOT EXISTS (SELECT 1 FROM annotations a WHERE a.doc_id = r.doc_id AND a.page = r.seq AND a.subtype = 'Link')""")
def dangling_annots(nodes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotation nodes on pages without annotations: empty ones go, template text becomes an artifact, others a paragraph."""
    there = annotations.where("subtype = 'Link'").select("doc_id", F.col("page").alias("seq"))
    loose = nodes.join(there, ["doc_id", "seq"], "left_anti")
    scaffold = F.col("caption").isNotNull() | T.is_scaffolding(F.col("alt"))
    return loose.select("doc_id", F.col("seq").alias("node_id"), F.when(F.col("alt") == "", "remove").when(scaffold, "artifact").otherwise("to_p").alias("action"))


@operator("role_map", ["nodes", "roles"], "SELECT n.doc_id, n.node_id, n.raw_role, coalesce((SELECT max(role) FROM roles r WHERE r.doc_id = n.doc_id AND r.raw_role = n.raw_role), n.raw_role) AS role FROM nodes n")
def role_map(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """Roles by the map of the node's own document."""
    return nodes.join(roles, ["doc_id", "raw_role"], "left").select("doc_id", "node_id", "raw_role", F.coalesce("role", "raw_role").alias("role"))


def rounds(nodes: DataFrame) -> Iterator[int]:
    """Rounds of doubling, as many as the largest document's nodes ask for; it is looked up only where some short ones do not end."""
    yield from range(SHORT)
    most = nodes.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    yield from range(SHORT, most.bit_length())


def climb(nodes: DataFrame, passes: Column) -> DataFrame:
    """nodes with ``top``, the nearest ancestor whose ``passes`` is false (null: none), and ``path``, the seqs of the ancestors passed, outermost first.

    Pointers are doubled by self-joins, so the rounds are the logarithm of the longest way up, whatever the depth; rows that have arrived take no
    further part. Nodes on a cycle have no top: what still moves after as many steps as a document has nodes is on one.
    """
    there = nodes.select(F.col("doc_id").alias("d"), F.col("node_id").alias("n"), passes.alias("passes"), F.col("seq").alias("over"))
    up = (F.col("doc_id") == F.col("d")) & (F.col("at") == F.col("n"))
    went = F.coalesce("passes", F.lit(False))
    own = nodes.columns
    first = nodes.withColumn("at", F.col("parent_id")).join(there, up, "left")
    now = written(first.select(*own, F.when(went, F.col("at")).alias("at"), F.when(~went, F.col("n")).alias("top"), F.when(went, F.array("over")).otherwise(F.array().cast("array<int>")).alias("path")))
    for _ in rounds(nodes):
        moving = now.where("at is not null")
        if moving.isEmpty():
            break
        ahead = now.select(F.col("doc_id").alias("d"), F.col("node_id").alias("n"), F.col("at").alias("next"), F.col("top").alias("found"), F.col("path").alias("before"))
        went = written(moving.join(ahead, up, "left").select(*own, F.col("next").alias("at"), F.col("found").alias("top"), F.concat("before", "path").alias("path")))
        now = now.where("at is null").unionByName(went)
    return now.drop("at")


_UP_SQL = """up AS (SELECT doc_id, node_id, parent_id AS held_by, 1 AS far FROM nodes WHERE parent_id IS NOT NULL UNION ALL SELECT u.doc_id, u.node_id, p.parent_id, far + 1 FROM up u JOIN nodes p ON p.doc_id = u.doc_id AND p.node_id = u.held_by WHERE p.parent_id IS NOT NULL AND far < 200)"""


@operator("orphan_table_parts", ["nodes"], f"""WITH RECURSIVE {_UP_SQL} SELECT n.doc_id, n.node_id, 'no_table' AS issue FROM nodes n WHERE n.raw_role IN ('TR', 'TH', 'TD') AND NOT EXISTS (SELECT 1 FROM up u JOIN nodes a ON a.doc_id = u.doc_id AND a.node_id = u.held_by WHERE u.doc_id = n.doc_id AND u.node_id = n.node_id AND a.raw_role = 'Table')
    UNION ALL SELECT t.doc_id, t.node_id, 'no_rows' FROM nodes t WHERE t.raw_role = 'Table' AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.doc_id = t.doc_id AND c.parent_id = t.node_id AND c.raw_role = 'TR')""")
def orphan_table_parts(nodes: DataFrame) -> DataFrame:
    """Rows and cells outside any table, however deep, and tables without rows."""
    nodes = written(nodes.select("doc_id", "node_id", "parent_id", "seq", "raw_role"))
    role = F.coalesce("raw_role", F.lit(""))
    loose = climb(nodes, role != "Table").where("raw_role in ('TR', 'TH', 'TD') and top is null").select("doc_id", "node_id", F.lit("no_table").alias("issue"))
    rows = nodes.where("raw_role = 'TR'").select("doc_id", F.col("parent_id").alias("node_id"))
    bare = nodes.where("raw_role = 'Table'").join(rows, ["doc_id", "node_id"], "left_anti").select("doc_id", "node_id", F.lit("no_rows").alias("issue"))
    return loose.unionByName(bare)


#: Roles of content that stands in a line of text; other children of a cell are blocks.
INLINE = ("Span", "Link", "Quote", "Note", "Reference", "Code", "Em", "Strong", "Lbl", "Ruby", "Annot")
_INLINE_SQL = "(" + ", ".join(f"'{r}'" for r in INLINE) + ")"


@operator("cell_nest_repair", ["nodes"], f"""WITH RECURSIVE w AS (SELECT doc_id, node_id, parent_id AS held_by, seq, [seq] AS path FROM nodes WHERE raw_role IN ('TH', 'TD') UNION ALL SELECT w.doc_id, w.node_id, p.parent_id, w.seq, list_concat([p.seq], w.path) FROM w JOIN nodes p ON p.doc_id = w.doc_id AND p.node_id = w.held_by WHERE p.raw_role IN ('TH', 'TD')),
    o AS (SELECT doc_id, node_id, arg_max(held_by, len(path)) AS new_parent_id, arg_max(path, len(path)) AS path FROM w GROUP BY 1, 2),
    k AS (SELECT doc_id, parent_id AS node_id, bool_or(raw_role IN {_INLINE_SQL}) AND bool_or(raw_role NOT IN {_INLINE_SQL} AND raw_role NOT IN ('TH', 'TD')) AS mixed FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1, 2)
    SELECT o.doc_id, o.node_id, new_parent_id, row_number() OVER (PARTITION BY o.doc_id, new_parent_id ORDER BY path, o.node_id) AS new_seq, coalesce(k.mixed, false) AS mixed FROM o LEFT JOIN k ON k.doc_id = o.doc_id AND k.node_id = o.node_id""")
def cell_nest_repair(nodes: DataFrame) -> DataFrame:
    """A cell inside cells, however many, moves up to the row, right after the cell that held it; mixed says whether a cell has inline and block children."""
    nodes = written(nodes.select("doc_id", "node_id", "parent_id", "seq", "raw_role"))
    role = F.coalesce("raw_role", F.lit(""))
    cells = climb(nodes, role.isin("TH", "TD")).where("raw_role in ('TH', 'TD')")
    moved = cells.select("doc_id", "node_id", F.col("top").alias("new_parent_id"), F.concat("path", F.array("seq")).alias("p"))
    inline = F.col("raw_role").isin(*INLINE)
    kids = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg((F.bool_or(inline) & F.bool_or(~inline & ~F.col("raw_role").isin("TH", "TD"))).alias("mixed"))
    placed = moved.withColumn("new_seq", F.row_number().over(W.partitionBy("doc_id", "new_parent_id").orderBy("p", "node_id"))).drop("p")
    return placed.join(kids, ["doc_id", "node_id"], "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))


@operator("table_structure", ["nodes"], """WITH j AS (SELECT n.*, p.raw_role AS pr FROM nodes n LEFT JOIN nodes p ON p.doc_id = n.doc_id AND p.node_id = n.parent_id), e AS (SELECT t.doc_id, t.node_id FROM nodes t WHERE t.raw_role = 'Table' AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.doc_id = t.doc_id AND c.parent_id = t.node_id AND c.raw_role = 'TR'))
    SELECT doc_id, count(*) FILTER (WHERE raw_role = 'Table') AS tables, count(*) FILTER (WHERE raw_role = 'TR') AS rows, count(*) FILTER (WHERE raw_role = 'TH') AS th, count(*) FILTER (WHERE raw_role = 'TD') AS td,
      count(*) FILTER (WHERE raw_role IN ('TH', 'TD') AND pr IN ('TH', 'TD')) AS nested_cells, count(*) FILTER (WHERE pr = 'Table' AND raw_role NOT IN ('TR', 'THead', 'TBody', 'TFoot', 'Caption')) AS invalid_table_children, count(*) FILTER (WHERE pr = 'TR' AND raw_role NOT IN ('TH', 'TD')) AS invalid_row_children,
      count(*) FILTER (WHERE raw_role = 'TH' AND scope IS NULL) AS th_without_scope, count(*) FILTER (WHERE raw_role = 'TH' AND scope IS NOT NULL AND scope NOT IN ('Row', 'Column', 'Both')) AS invalid_scopes, count(*) FILTER (WHERE raw_role = 'TH' AND scope IN ('Row', 'Column', 'Both')) AS valid_scopes,
      count(*) FILTER (WHERE raw_role = 'TD' AND has_headers) AS td_with_headers, count(*) FILTER (WHERE raw_role = 'TD' AND NOT has_headers) AS td_without_headers, count(*) FILTER (WHERE raw_role = 'TR' AND coalesce(pr, '') NOT IN ('Table', 'THead', 'TBody', 'TFoot')) AS stray_rows, (SELECT count(*) FROM e WHERE e.doc_id = j.doc_id) AS empty_tables FROM j GROUP BY doc_id""")
def table_structure(nodes: DataFrame) -> DataFrame:
    """Fourteen counters per document over each node and its parent's role.

    Each node is two rows, one under its own id and one under its parent's, and they meet in a window: nodes are read once and move once, by document.
    A node whose id is repeated is a parent as often, as in a join.
    """
    own = F.col("own")
    ids = F.array(F.struct(F.col("node_id").alias("key"), F.lit(True).alias("own")), F.struct(F.col("parent_id").alias("key"), F.lit(False).alias("own")))
    rows = nodes.select("doc_id", "node_id", "parent_id", "raw_role", "scope", "has_headers").repartition("doc_id").select("doc_id", F.explode(ids).alias("i"), "raw_role", "scope", "has_headers")
    parent = F.col("raw_role")
    same = W.partitionBy("doc_id", "key")
    there = own & F.col("doc_id").isNotNull() & F.col("key").isNotNull()
    above = lambda c: F.count_if(there & c).over(same)
    row = ~own & (F.col("raw_role") == "TR")
    met = rows.select("doc_id", "i.key", "i.own", "raw_role", "scope", "has_headers").withColumn("first", F.row_number().over(same.orderBy(F.when(row, 0).otherwise(1))) == 1)
    met = met.withColumns({"np": above(F.lit(True)), "cells": above(parent.isin("TH", "TD")), "tabs": above(parent == "Table"), "trs": above(parent == "TR"), "parts": above(parent.isin("Table", "THead", "TBody", "TFoot"))})
    kids = met.where(~own)
    role, th = F.col("raw_role"), F.col("raw_role") == "TH"
    cell, scoped = role.isin("TH", "TD"), F.col("scope").isin("Row", "Column", "Both")
    times = F.greatest("np", F.lit(1))
    n = lambda c, name, by=times: F.coalesce(F.sum(F.when(c, by)), F.lit(0)).cast("long").alias(name)
    out = kids.groupBy("doc_id").agg(
        n(role == "Table", "tables"), n(role == "TR", "rows"), n(th, "th"), n(role == "TD", "td"), n(cell, "nested_cells", F.col("cells")),
        n(~role.isin("TR", "THead", "TBody", "TFoot", "Caption"), "invalid_table_children", F.col("tabs")), n(~cell, "invalid_row_children", F.col("trs")),
        n(th & F.col("scope").isNull(), "th_without_scope"), n(th & ~scoped, "invalid_scopes"), n(th & scoped, "valid_scopes"),
        n((role == "TD") & F.col("has_headers"), "td_with_headers"), n((role == "TD") & ~F.col("has_headers"), "td_without_headers"),
        n(role == "TR", "stray_rows", times - F.col("parts")), n(F.col("first") & (role == "TR") & (F.col("tabs") > 0), "filled", F.lit(1)))
    return out.withColumn("empty_tables", F.col("tables") - F.col("filled")).drop("filled")


@operator("image_candidates", ["images"], """SELECT doc_id, page, img_idx, coverage, reason, repeated_on_pages FROM (SELECT *, CASE WHEN coverage >= 0.75 AND (bpc <= 1 OR n > 1) THEN 'background' WHEN least(x1 - x0, y1 - y0) < 8 THEN 'sliver' WHEN greatest((x1 - x0) / (y1 - y0), (y1 - y0) / (x1 - x0)) > 12 AND least(x1 - x0, y1 - y0) < 12 THEN 'sliver' ELSE 'candidate' END AS reason
    FROM (SELECT i.doc_id, page, img_idx, bpc, x0, y0, x1, y1, round((x1 - x0) * (y1 - y0) / (page_w * page_h), 4) AS coverage, count(*) OVER (PARTITION BY i.doc_id, page) AS n, h.repeated_on_pages FROM images i JOIN (SELECT doc_id, hash, count(DISTINCT page) AS repeated_on_pages FROM images GROUP BY 1, 2) h ON h.doc_id = i.doc_id AND h.hash = i.hash))""")
def image_candidates(images: DataFrame) -> DataFrame:
    """Why each placed image is or is not content: page backgrounds and slivers are not. One shuffle by document serves all windows."""
    width, height = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    coverage = F.round(width * height / (F.col("page_w") * F.col("page_h")), 4)
    flat = (F.greatest(width / height, height / width) > 12) & (F.least(width, height) < 12)
    sliver = F.coalesce((F.least(width, height) < 8) | flat, F.lit(False))
    # What the windows sort is narrow: sides and depths are judged before.
    judged = images.select("doc_id", "page", "img_idx", "hash", coverage.alias("coverage"), sliver.alias("sliver"), (F.col("bpc") <= 1).alias("flat"))
    n = F.count("*").over(W.partitionBy("doc_id", "page"))
    pages = F.size(F.collect_set("page").over(W.partitionBy("doc_id", "hash"))).cast("long")
    seen = judged.withColumn("n", n).withColumn("repeated_on_pages", pages)
    reason = F.when((F.col("coverage") >= 0.75) & (F.col("flat") | (F.col("n") > 1)), "background").when(F.col("sliver"), "sliver").otherwise("candidate")
    return seen.select("doc_id", "page", "img_idx", "coverage", reason.alias("reason"), "repeated_on_pages")


@operator("page_image_topk", ["images"], "SELECT doc_id, page, img_idx, coverage, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY coverage DESC, img_idx) AS rank FROM (SELECT doc_id, page, img_idx, round((x1 - x0) * (y1 - y0) / (page_w * page_h), 4) AS coverage FROM images)) WHERE rank <= 12")
def page_image_topk(images: DataFrame, k: int = 12) -> DataFrame:
    coverage = F.round((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("page_w") * F.col("page_h")), 4)
    ranked = images.withColumn("coverage", coverage).withColumn("rank", F.row_number().over(W.partitionBy("doc_id", "page").orderBy(F.desc("coverage"), "img_idx")))
    return ranked.where(F.col("rank") <= k).select("doc_id", "page", "img_idx", "coverage", "rank")


@operator("background_images", ["marks"], """SELECT doc_id, page, mark_id, round((x1 - x0) * (y1 - y0) / (page_w * page_h), 4) AS area_share, (x1 - x0) >= 0.9 * page_w AND (y1 - y0) >= 0.9 * page_h AS is_full_bleed FROM marks WHERE tag = 'Artifact' AND has_image AND round((x1 - x0) * (y1 - y0) / (page_w * page_h), 4) >= 0.4""")
def background_images(marks: DataFrame) -> DataFrame:
    """Artifact images on at least 40% of a page, and whether they reach 90% of both sides."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    share = F.round(width * height / (F.col("page_w") * F.col("page_h")), 4)
    large = marks.where("tag = 'Artifact' and has_image").where(share >= 0.4)
    return large.select("doc_id", "page", "mark_id", share.alias("area_share"), ((width >= 0.9 * F.col("page_w")) & (height >= 0.9 * F.col("page_h"))).alias("is_full_bleed"))


_BOXED_SQL = """sub AS (SELECT doc_id, node_id AS elem_id, node_id AS under FROM nodes UNION ALL SELECT s.doc_id, s.elem_id, c.node_id FROM sub s JOIN nodes c ON c.doc_id = s.doc_id AND c.parent_id = s.under)"""


def asked(rows: DataFrame, parent: str) -> DataFrame:
    """Each row twice, under its own id (``own``) and, if it has a parent, under the parent's (``key``), for windows over (doc_id, key)."""
    ids = F.array(F.struct(F.col("node_id").alias("key"), F.lit(True).alias("own")), F.struct(F.col(parent).alias("key"), F.lit(False).alias("own")))
    return rows.select(*rows.columns, F.explode(F.filter(ids, lambda x: x["own"] | x["key"].isNotNull())).alias("i")).select(*rows.columns, "i.key", "i.own")


def under(nodes: DataFrame, own: DataFrame, merges: dict) -> DataFrame:
    """(doc_id, node_id) and each column of ``merges`` over the node and all below it; ``own`` has the nodes' own values, any number of rows a node.

    ``merges`` names an aggregate for each column that may meet a value twice, as min and max. Each node holds the merged values of what lies less than
    2^k below it and points to its ancestor 2^k above; a round hands values to that ancestor and doubles the pointer, so that rows stay those of
    the nodes and rounds the logarithm of the depth. Nodes and values move once, by document, and ``HELD`` rounds are windows and aggregates over that; only deeper
    trees are written and moved again. Cycles end after as many steps as a document has nodes: each node on one has all of it below.
    Rows that repeat a node count as one, with the smaller parent; parents that are no nodes are none.
    """
    merged = [f(c).alias(c) for c, f in merges.items()]
    some = F.size(F.array_compact(F.array(*[F.col(c) for c in merges]))) > 0
    same = W.partitionBy("doc_id", "key")

    def step(now: DataFrame) -> DataFrame:
        met = asked(now, "at").withColumns({"there": F.max("own").over(same), "next": F.max(F.when(F.col("own"), F.col("at"))).over(same)})
        none = F.lit(None).cast(now.schema["at"].dataType).alias("at")
        moved = F.array(F.struct("node_id", F.col("next").alias("at")), F.when(F.col("there") & some, F.struct(F.col("key").alias("node_id"), none)))
        each = F.when(~F.col("own"), F.array_compact(moved)).otherwise(F.when(F.col("at").isNull(), F.array(F.struct("node_id", none))))
        return met.select("doc_id", F.explode(each).alias("x"), *merges).select("doc_id", "x.node_id", "x.at", *merges).groupBy("doc_id", "node_id").agg(F.max("at").alias("at"), *merged)

    rows = nodes.where("doc_id is not null and node_id is not null").select("doc_id", "node_id", F.col("parent_id").alias("at"), F.lit(True).alias("node"))
    both = rows.unionByName(own.select("doc_id", "node_id", *merges), allowMissingColumns=True).repartition("doc_id")
    now = both.groupBy("doc_id", "node_id").agg(F.min("at").alias("at"), F.max("node").alias("node"), *merged).where("node").drop("node")
    for _ in range(HELD):
        now = step(now)
    now = written(now)
    for _ in range(HELD, most_rounds(now)):
        now = replaced(now, step(now.repartition("doc_id")))
        if now.where("at is not null").isEmpty():
            break
    return now.drop("at")


def most_rounds(now: DataFrame) -> int:
    """Rounds of doubling that the largest document asks for; none more where no node moves."""
    if now.where("at is not null").isEmpty():
        return 0
    return (now.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0).bit_length()


@operator("element_bbox", ["nodes", "node_boxes"], f"""WITH RECURSIVE {_BOXED_SQL} SELECT s.doc_id, s.elem_id, round(min(x0), 4) AS x0, round(min(y0), 4) AS y0, round(max(x1), 4) AS x1, round(max(y1), 4) AS y1 FROM sub s JOIN node_boxes b ON b.doc_id = s.doc_id AND b.node_id = s.under WHERE x0 IS NOT NULL GROUP BY 1, 2""")
def element_bbox(nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """The union of the boxes of all content under each element, itself included."""
    union = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    return under(nodes, boxes.where("x0 is not null"), union).where("x0 is not null").select("doc_id", F.col("node_id").alias("elem_id"), *[F.round(c, 4).alias(c) for c in union])


@operator("content_container", ["nodes", "node_boxes"], f"""WITH RECURSIVE {_BOXED_SQL}, lev AS (SELECT doc_id, node_id, 0 AS depth FROM nodes WHERE parent_id IS NULL UNION ALL SELECT l.doc_id, c.node_id, depth + 1 FROM lev l JOIN nodes c ON c.doc_id = l.doc_id AND c.parent_id = l.node_id),
    res AS (SELECT DISTINCT s.doc_id, s.elem_id AS node_id FROM sub s JOIN node_boxes b ON b.doc_id = s.doc_id AND b.node_id = s.under WHERE x0 IS NOT NULL),
    k AS (SELECT n.doc_id, n.parent_id AS node_id, count(*) AS n FROM nodes n JOIN res r ON r.doc_id = n.doc_id AND r.node_id = n.node_id JOIN lev l ON l.doc_id = n.doc_id AND l.node_id = n.parent_id WHERE l.depth <= {DEPTH} GROUP BY 1, 2),
    b AS (SELECT doc_id, node_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, node_id) AS r FROM k WHERE n >= 2)
    SELECT d.doc_id, coalesce(b.node_id, d.root) AS node_id, coalesce(b.n, 0) AS resolvable_children FROM (SELECT doc_id, min(node_id) AS root FROM nodes WHERE parent_id IS NULL GROUP BY 1) d LEFT JOIN b ON b.doc_id = d.doc_id AND b.r = 1""")
def content_container(nodes: DataFrame, boxes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The node, at most ``depth`` levels below the root, with the most children that hold content with a box; two at least, else the root."""
    nodes = written(nodes.select("doc_id", "node_id", "parent_id"))
    boxed = boxes.where("x0 is not null").select("doc_id", "node_id", F.lit(True).alias("holds"))
    holding = under(nodes, boxed, {"holds": F.max}).where("holds").select("doc_id", "node_id", "holds")
    # All below is windows by document: whether a node holds content, whether it lies at most ``depth`` levels below a root, and what its parent counts.
    rows = nodes.withColumn("node", F.lit(True)).unionByName(holding, allowMissingColumns=True).repartition("doc_id")
    holds = F.coalesce(F.max("holds").over(W.partitionBy("doc_id", "node_id")), F.lit(False))
    rows = rows.withColumn("holds", holds).where("node").select("doc_id", "node_id", "parent_id", "holds", F.col("parent_id").isNull().alias("near"))
    above = F.coalesce(F.max(F.when(F.col("own"), F.col("near"))).over(W.partitionBy("doc_id", "key")), F.lit(False))
    for _ in range(depth):
        met = asked(rows, "parent_id").withColumn("above", above).where(~F.col("own") | F.col("parent_id").isNull())
        rows = met.select("doc_id", "node_id", "parent_id", "holds", F.when(F.col("own"), F.col("near")).otherwise(F.col("near") | F.col("above")).alias("near"))
    met = asked(rows, "parent_id").withColumn("above", above)
    counts = met.groupBy("doc_id", "key").agg(F.count_if(~F.col("own") & F.col("holds") & F.col("above")).alias("n"), F.min(F.when(F.col("own") & F.col("parent_id").isNull(), F.col("node_id"))).alias("root"), F.bool_or(F.col("own") & F.col("parent_id").isNull()).alias("rooted"))
    best = F.max_by(F.when(F.col("n") >= 2, F.struct("key", "n")), F.when(F.col("n") >= 2, F.struct("n", -F.col("key"))))
    docs = counts.groupBy("doc_id").agg(F.min("root").alias("root"), F.bool_or("rooted").alias("rooted"), best.alias("b")).where("rooted")
    return docs.select("doc_id", F.coalesce("b.key", "root").alias("node_id"), F.coalesce("b.n", F.lit(0)).alias("resolvable_children"))


@operator("block_order", ["text_blocks"], r"""WITH d AS (SELECT DISTINCT doc_id, page, round(x) AS rx, round(y) AS ry, text, round(y / 20) * 20 AS band, x FROM text_blocks), u AS (SELECT doc_id, page, rx, ry, text, min(band) AS band, min(x) AS x FROM d GROUP BY ALL)
    SELECT doc_id, page, string_agg(trim(regexp_replace(text, '\s+', ' ', 'g')), chr(10) ORDER BY band, x, ry, text) AS text, CAST(sum(length(trim(regexp_replace(text, '\s+', ' ', 'g')))) + count(*) - 1 AS BIGINT) AS text_len FROM u GROUP BY 1, 2""")
def block_order(blocks: DataFrame) -> DataFrame:
    """A page's text from its blocks: repeats at one place count once, bands of 20 points top-down, then left to right."""
    at = ["rx", "ry", "text"]
    placed = blocks.select("doc_id", "page", F.struct(F.round("x").alias("rx"), F.round("y").alias("ry"), "text", (F.round(F.col("y") / 20) * 20).alias("band"), "x").alias("e"))
    pages = placed.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("e")).alias("b"))

    def firsts(b: Column) -> Column:
        """The first block of each place of a sorted array."""
        before = lambda i, c: F.get(b, i - 1)[c]
        return F.filter(b, lambda e, i: (i == 0) | ~(e["rx"].eqNullSafe(before(i, "rx")) & e["ry"].eqNullSafe(before(i, "ry")) & e["text"].eqNullSafe(before(i, "text"))))

    # The first of a place has the least band; the least x is the first by x. Band and x are null where the place is.
    by_x = F.array_sort(F.transform("b", lambda e: F.struct(*[e[c].alias(c) for c in (*at, "x")])))
    xs = F.transform(F.transform(F.array(by_x), firsts)[0], lambda e: e["x"])
    once = pages.withColumn("f", firsts(F.col("b")))
    order = lambda e, x: F.struct(e["band"].alias("band"), x.alias("x"), e["ry"].alias("ry"), e["text"].alias("text"))
    each = F.when(F.size("f") == F.size("b"), F.transform("f", lambda e: order(e, e["x"]))).otherwise(F.zip_with("f", xs, order))
    text = F.array_join(F.filter(F.transform(F.array_sort(each), lambda e: T.clean(e["text"])), lambda c: c != ""), "\n")
    return once.select("doc_id", "page", text.alias("text")).withColumn("text_len", F.length("text").cast("long"))


@operator("reading_order", ["boxes"])
def reading_order(boxes: DataFrame, overlap: float = 0.35) -> DataFrame:
    """Visual order of a page's elements, those without a box last. A row's band shrinks to what its members share, so boxes fold one after another.

    The fold carries the band alone and writes a bit per box, whether a row starts there; rows and places in them are windows over the bits.
    """
    boxed = F.array_sort(F.collect_list(F.struct((-F.col("y1")).alias("top"), F.col("elem_id").alias("id"), "x0", "y0", "y1")))
    pages = boxes.where("y1 is not null").groupBy("doc_id", "page").agg(boxed.alias("boxed"))
    kind = "struct<open:boolean,low:double,high:double,bits:string,full:array<string>>"
    start = F.struct(F.lit(False).alias("open"), F.lit(1.0).alias("low"), F.lit(0.0).alias("high"), F.lit("").alias("bits"), F.array().alias("full")).cast(kind)

    def step(s, b):
        shared = F.least(s["high"], b["y1"]) - F.greatest(s["low"], b["y0"])
        same = F.coalesce(s["open"] & (shared >= overlap * F.greatest(b["y1"] - b["y0"], F.lit(1.0))) & (shared > 0), F.lit(False))
        bits, whole = F.concat(s["bits"], F.when(same, "0").otherwise("1")), F.length(s["bits"]) >= BITS - 1
        return F.struct(F.lit(True).alias("open"), F.when(same, F.greatest(s["low"], b["y0"])).otherwise(b["y0"]).alias("low"), F.when(same, F.least(s["high"], b["y1"])).otherwise(b["y1"]).alias("high"),
                        F.when(whole, "").otherwise(bits).alias("bits"), F.when(whole, F.concat(s["full"], F.array(bits))).otherwise(s["full"]).alias("full"))

    starts = F.aggregate("boxed", start, step, lambda s: F.split(F.concat(F.array_join(s["full"], ""), s["bits"]), ""))
    each = pages.select("doc_id", "page", F.posexplode(F.arrays_zip(F.col("boxed").alias("b"), starts.alias("s"))).alias("nth", "x")).where("x.b is not null")
    rows = F.sum(F.col("x.s").cast("int")).over(W.partitionBy("doc_id", "page").orderBy("nth"))
    placed = each.select("doc_id", "page", F.col("x.b.id").alias("elem_id"), rows.alias("row"), F.col("x.b.x0").alias("x0"), "nth", F.lit(False).alias("loose"))
    loose = boxes.where("y1 is null").select("doc_id", "page", "elem_id", F.lit(True).alias("loose"))
    order = F.row_number().over(W.partitionBy("doc_id", "page").orderBy("loose", "row", "x0", "nth", "elem_id")) - 1
    return placed.unionByName(loose, allowMissingColumns=True).select("doc_id", "page", order.alias("order"), "elem_id")
