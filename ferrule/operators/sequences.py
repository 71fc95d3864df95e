"""Ordered logic: headings, captions, tables, titles and chunks as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule.functions import text as T
from ferrule.plans.registry import operator

UNTIL = (W.unboundedPreceding, W.currentRow)


@operator("heading_skips", ["headings"], """SELECT doc_id, seq, prev_level, level FROM (SELECT doc_id, seq, level, coalesce(lag(level) OVER (PARTITION BY doc_id ORDER BY seq), 0) AS prev_level FROM headings) WHERE level > prev_level + 1""")
def heading_skips(headings: DataFrame) -> DataFrame:
    """Headings more than one level below the one before; a first heading that is not 1 counts (previous level 0)."""
    before = F.coalesce(F.lag("level").over(W.partitionBy("doc_id").orderBy("seq")), F.lit(0))
    return headings.withColumn("prev_level", before).where(F.col("level") > F.col("prev_level") + 1).select("doc_id", "seq", "prev_level", "level")


@operator("heading_normalize", ["headings"], """SELECT doc_id, seq, level, CAST(t + least(1, min(l - t) OVER (PARTITION BY doc_id ORDER BY seq)) AS BIGINT) AS new_level FROM (SELECT doc_id, seq, level, row_number() OVER w - 1 AS t,
    CASE WHEN level = 1 AND sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER w > 1 THEN 2 ELSE level END AS l FROM headings WINDOW w AS (PARTITION BY doc_id ORDER BY seq))""")
def heading_normalize(headings: DataFrame) -> DataFrame:
    """Only the first h1 stays; any other level is at most one more than the rewritten level before it. A running minimum gives it."""
    order = W.partitionBy("doc_id").orderBy("seq")
    ones = F.sum((F.col("level") == 1).cast("int")).over(order.rowsBetween(*UNTIL))
    h = headings.withColumn("t", F.row_number().over(order) - 1).withColumn("l", F.when((F.col("level") == 1) & (ones > 1), 2).otherwise(F.col("level")))
    least = F.min(F.col("l") - F.col("t")).over(order.rowsBetween(*UNTIL))
    return h.select("doc_id", "seq", "level", (F.col("t") + F.least(F.lit(1), least)).cast("long").alias("new_level"))


@operator("caption_lines", ["words"], """WITH g AS (SELECT media_id, pos, text, start, stop, sum(brk) OVER (PARTITION BY media_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY media_id ORDER BY pos) > 1.5 THEN 1 ELSE 0 END AS brk FROM words)),
    n AS (SELECT *, (row_number() OVER (PARTITION BY media_id, run ORDER BY pos) - 1) // 12 AS part FROM g)
    SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY min(pos)) AS BIGINT) AS line_no, round(min(start), 3) AS start, round(max(stop), 3) AS stop, string_agg(text, ' ' ORDER BY pos) AS text FROM n GROUP BY media_id, run, part""")
def caption_lines(words: DataFrame, gap: float = 1.5, most: int = 12) -> DataFrame:
    """Words to lines: a new one after a gap or 12 words. Islands between gaps are cut into twelves."""
    order = W.partitionBy("media_id").orderBy("pos")
    broken = (F.col("start") - F.lag("stop").over(order) > gap).cast("int")
    runs = words.withColumn("brk", F.coalesce(broken, F.lit(0))).withColumn("run", F.sum("brk").over(order.rowsBetween(*UNTIL)))
    part = F.floor((F.row_number().over(W.partitionBy("media_id", "run").orderBy("pos")) - 1) / most)
    said = F.array_sort(F.collect_list(F.struct("pos", "text")))
    lines = runs.withColumn("part", part).groupBy("media_id", "run", "part").agg(F.min("pos").alias("p"), F.round(F.min("start"), 3).alias("start"), F.round(F.max("stop"), 3).alias("stop"), F.array_join(F.transform(said, lambda w: w["text"]), " ").alias("text"))
    return lines.withColumn("line_no", F.row_number().over(W.partitionBy("media_id").orderBy("p")).cast("long")).select("media_id", "line_no", "start", "stop", "text")


@operator("visit_engagement", ["visibility_events"], """WITH s AS (SELECT visitor_id, CAST(ts AS DATE) AS d, state, interacted, date_sub('millisecond', ts, lead(ts) OVER (PARTITION BY visitor_id, CAST(ts AS DATE) ORDER BY ts, event_id)) AS ms FROM visibility_events)
    SELECT visitor_id, CAST(d AS VARCHAR) AS date, CAST(coalesce(sum(ms) FILTER (WHERE state = 'visible'), 0) AS BIGINT) AS engaged_ms, coalesce(sum(ms) FILTER (WHERE state = 'visible'), 0) >= 3000 AND bool_or(interacted) AS qualifies FROM s GROUP BY 1, 2""")
def visit_engagement(events: DataFrame) -> DataFrame:
    """Visible time per visitor and day; 3 seconds and an interaction qualify."""
    day = F.to_date("ts")
    following = F.lead("ts").over(W.partitionBy("visitor_id", "d").orderBy("ts", "event_id"))
    spans = events.withColumn("d", day).withColumn("ms", F.timestamp_diff("MILLISECOND", F.col("ts"), following))
    out = spans.groupBy("visitor_id", F.col("d").cast("string").alias("date")).agg(F.coalesce(F.sum(F.when(F.col("state") == "visible", F.col("ms"))), F.lit(0)).alias("engaged_ms"), F.bool_or("interacted").alias("i"))
    return out.withColumn("qualifies", (F.col("engaged_ms") >= 3000) & F.col("i")).drop("i")


@operator("table_grid_pad", ["cells"], """WITH e AS (SELECT doc_id, table_seq, row, col, k, CASE WHEN k = 0 THEN text ELSE '' END AS text, CASE WHEN k = 0 THEN tag ELSE 'td' END AS tag FROM cells, LATERAL (SELECT unnest(range(colspan)) AS k) r),
    p AS (SELECT doc_id, table_seq, row, row_number() OVER (PARTITION BY doc_id, table_seq, row ORDER BY col, k) - 1 AS col, tag, text FROM e), w AS (SELECT doc_id, table_seq, max(col) AS m FROM p GROUP BY 1, 2), rr AS (SELECT DISTINCT doc_id, table_seq, row FROM p)
    SELECT g.doc_id, g.table_seq, g.row, CAST(g.c AS BIGINT) AS col, coalesce(p.tag, 'td') AS tag, coalesce(p.text, '') AS text FROM (SELECT rr.doc_id, rr.table_seq, rr.row, unnest(range(m + 1)) AS c FROM rr JOIN w ON w.doc_id = rr.doc_id AND w.table_seq = rr.table_seq) g LEFT JOIN p ON p.doc_id = g.doc_id AND p.table_seq = g.table_seq AND p.row = g.row AND p.col = g.c""")
def table_grid_pad(cells: DataFrame) -> DataFrame:
    """Spanning cells get filler cells, and rows are padded to the table's widest. The last cell of a row makes the fillers, so no join is needed."""
    table, row = ["doc_id", "table_seq"], ["doc_id", "table_seq", "row"]
    wide = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("colspan") - 1)))
    first = F.col("k") == 0
    placed = wide.withColumn("c", F.row_number().over(W.partitionBy(*row).orderBy("col", "k")) - 1).withColumn("last", F.count("*").over(W.partitionBy(*row)) - 1).withColumn("widest", F.max("c").over(W.partitionBy(*table)))
    ends = F.when(F.col("c") == F.col("last"), F.sequence(F.col("c").cast("long"), F.col("widest").cast("long"))).otherwise(F.array(F.col("c").cast("long")))
    own = F.col("col2") == F.col("c")
    full = placed.withColumn("own", first).withColumn("col2", F.explode(ends))
    return full.select(*row, F.col("col2").alias("col"), F.when(own & F.col("own"), F.col("tag")).otherwise("td").alias("tag"), F.when(own & F.col("own"), F.col("text")).otherwise("").alias("text"))


@operator("table_header_scope", ["cells"], """WITH t AS (SELECT *, max(CASE WHEN tag = 'th' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, table_seq) AS any_th, min(row) OVER (PARTITION BY doc_id, table_seq) AS r0 FROM cells),
    u AS (SELECT doc_id, table_seq, row, col, r0, CASE WHEN any_th = 0 AND row = r0 THEN 'th' ELSE tag END AS tag FROM t)
    SELECT doc_id, table_seq, row, col, tag, CASE WHEN tag = 'th' AND row > r0 AND row_number() OVER (PARTITION BY doc_id, table_seq, row, tag ORDER BY col) = 1 THEN 'row' WHEN tag = 'th' THEN 'col' END AS scope FROM u""")
def table_header_scope(cells: DataFrame) -> DataFrame:
    """Without header cells the first row becomes one; the first header of a body row is for the row, others for the column."""
    table = W.partitionBy("doc_id", "table_seq")
    t = cells.withColumn("any_th", F.max((F.col("tag") == "th").cast("int")).over(table)).withColumn("r0", F.min("row").over(table))
    t = t.withColumn("tag", F.when((F.col("any_th") == 0) & (F.col("row") == F.col("r0")), "th").otherwise(F.col("tag")))
    nth = F.row_number().over(W.partitionBy("doc_id", "table_seq", "row", "tag").orderBy("col"))
    head = F.col("tag") == "th"
    return t.select("doc_id", "table_seq", "row", "col", "tag", F.when(head & (F.col("row") > F.col("r0")) & (nth == 1), "row").when(head, "col").alias("scope"))


@operator("table_orphan_rows", ["cells"], """WITH r AS (SELECT doc_id, table_seq, row, max(col) AS last, count(*) FILTER (WHERE text <> '') AS filled, arg_max(text, col) AS tail FROM cells GROUP BY 1, 2, 3),
    o AS (SELECT *, CASE WHEN filled = 1 AND tail <> '' AND last > 0 THEN 1 ELSE 0 END AS orphan FROM r), g AS (SELECT *, sum(1 - orphan) OVER (PARTITION BY doc_id, table_seq ORDER BY row) AS real FROM o),
    k AS (SELECT doc_id, table_seq, min(row) AS row, string_agg(tail, ' ' ORDER BY row) AS last_text, count(*) - 1 AS joined, arg_min(last, row) AS last FROM g WHERE real > 0 GROUP BY doc_id, table_seq, real UNION ALL SELECT doc_id, table_seq, row, tail, 0, last FROM g WHERE real = 0)
    SELECT c.doc_id, c.table_seq, c.row, c.col, c.tag, CASE WHEN c.col = k.last THEN k.last_text ELSE c.text END AS text, CASE WHEN c.col = k.last THEN k.joined ELSE 0 END AS joined FROM cells c JOIN k ON k.doc_id = c.doc_id AND k.table_seq = c.table_seq AND k.row = c.row""")
def table_orphan_rows(cells: DataFrame) -> DataFrame:
    """The cells, where a row with only a last cell has joined the last cell of the real row before it; one before any real row stays."""
    rows = cells.groupBy("doc_id", "table_seq", "row").agg(F.max("col").alias("last"), F.count_if(F.col("text") != "").alias("filled"), F.max_by("text", "col").alias("tail"))
    orphan = ((F.col("filled") == 1) & (F.col("tail") != "") & (F.col("last") > 0)).cast("int")
    order = W.partitionBy("doc_id", "table_seq").orderBy("row")
    runs = rows.withColumn("real", F.sum(1 - orphan).over(order.rowsBetween(*UNTIL)))
    runs = runs.withColumn("part", F.when(F.col("real") == 0, F.col("row")).otherwise(-1))
    texts = F.array_sort(F.collect_list(F.struct("row", "tail", "last")))
    kept = runs.groupBy("doc_id", "table_seq", "real", "part").agg(F.min("row").alias("row"), texts.alias("t"))
    kept = kept.select("doc_id", "table_seq", "row", F.array_join(F.transform("t", lambda x: x["tail"]), " ").alias("last_text"), (F.size("t") - 1).cast("long").alias("joined"), F.col("t")[0]["last"].alias("last"))
    at_end = F.col("col") == F.col("last")
    return cells.join(kept, ["doc_id", "table_seq", "row"]).select("doc_id", "table_seq", "row", "col", "tag", F.when(at_end, F.col("last_text")).otherwise(F.col("text")).alias("text"), F.when(at_end, F.col("joined")).otherwise(F.lit(0).cast("long")).alias("joined"))


@operator("table_page_merge", ["cells"], """WITH t AS (SELECT doc_id, table_seq, max(table_tag_id) AS tid, max(col) AS width, max(CASE WHEN tag = 'th' THEN 1 ELSE 0 END) AS header FROM cells GROUP BY 1, 2),
    s AS (SELECT *, CASE WHEN tid = lag(tid) OVER w OR (width = lag(width) OVER w AND header = 0) THEN 0 ELSE 1 END AS start FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY table_seq)),
    m AS (SELECT doc_id, table_seq, CAST(sum(start) OVER (PARTITION BY doc_id ORDER BY table_seq) AS BIGINT) AS merged_table FROM s)
    SELECT c.doc_id, m.merged_table, dense_rank() OVER (PARTITION BY c.doc_id, m.merged_table ORDER BY c.table_seq, c.row) - 1 AS merged_row, c.col, c.tag, c.text FROM cells c JOIN m ON m.doc_id = c.doc_id AND m.table_seq = c.table_seq""")
def table_page_merge(cells: DataFrame) -> DataFrame:
    """The cells with their merged table and row there: neighbouring tables are one if their ids agree, or their widths do and the second has no header."""
    t = cells.groupBy("doc_id", "table_seq").agg(F.max("table_tag_id").alias("tid"), F.max("col").alias("width"), F.bool_or(F.col("tag") == "th").alias("header"))
    w = W.partitionBy("doc_id").orderBy("table_seq")
    goes_on = (F.col("tid") == F.lag("tid").over(w)) | ((F.col("width") == F.lag("width").over(w)) & ~F.col("header"))
    started = t.withColumn("start", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    merged = started.select("doc_id", "table_seq", F.sum("start").over(w.rowsBetween(*UNTIL)).cast("long").alias("merged_table"))
    row = F.dense_rank().over(W.partitionBy("doc_id", "merged_table").orderBy("table_seq", "row")) - 1
    return cells.join(merged, ["doc_id", "table_seq"]).select("doc_id", "merged_table", row.cast("long").alias("merged_row"), "col", "tag", "text")


@operator("header_backfill", ["tagged_cells"], """WITH r AS (SELECT doc_id, row_id, min(seq) AS at FROM tagged_cells GROUP BY 1, 2 HAVING bool_and(role = 'TH') AND count(*) > 1 AND count(id) > 0),
    f AS (SELECT c.*, (SELECT max(r.row_id) FROM r WHERE r.doc_id = c.doc_id AND r.at <= c.seq AND r.row_id <> c.row_id) AS hrow FROM tagged_cells c)
    SELECT f.doc_id, f.seq, f.role, coalesce(f.headers, CASE WHEN f.role = 'TD' THEN h.id END) AS headers, f.role = 'TD' AND f.headers IS NULL AND h.id IS NOT NULL AS is_backfilled FROM f LEFT JOIN tagged_cells h ON h.doc_id = f.doc_id AND h.row_id = f.hrow AND h.col = f.col AND h.id IS NOT NULL""")
def header_backfill(cells: DataFrame) -> DataFrame:
    """Cells without headers take the id above them in the last row of only headers; each such row replaces the whole map."""
    rows = W.partitionBy("doc_id", "row_id")
    whole = F.min((F.col("role") == "TH").cast("int")).over(rows) * (F.count("*").over(rows) > 1).cast("int") * (F.count("id").over(rows) > 0).cast("int")
    c = cells.withColumn("head", whole == 1)
    before = W.partitionBy("doc_id").orderBy("seq").rowsBetween(*UNTIL)
    c = c.withColumn("hrow", F.last(F.when(F.col("head"), F.col("row_id")), ignorenulls=True).over(before)).withColumn("hrow", F.when(F.col("hrow") != F.col("row_id"), F.col("hrow")))
    h = c.where("head and id is not null").select(F.col("doc_id").alias("d"), F.col("row_id").alias("r"), F.col("col").alias("k"), F.col("id").alias("hid"))
    j = c.join(h, (F.col("doc_id") == F.col("d")) & (F.col("hrow") == F.col("r")) & (F.col("col") == F.col("k")), "left")
    data = F.col("role") == "TD"
    return j.select("doc_id", "seq", "role", F.coalesce("headers", F.when(data, F.col("hid"))).alias("headers"), (data & F.col("headers").isNull() & F.col("hid").isNotNull()).alias("is_backfilled"))


@operator("scope_backfill", ["tagged_cells"], """SELECT doc_id, seq, role, CASE WHEN role = 'TH' THEN coalesce(scope, 'Column') ELSE scope END AS scope, role = 'TH' AND scope IS NULL AS is_backfilled, round(avg(CASE WHEN role = 'TH' THEN CASE WHEN scope IS NULL THEN 1.0 ELSE 0.0 END END) OVER (PARTITION BY doc_id), 4) AS share FROM tagged_cells""")
def scope_backfill(cells: DataFrame) -> DataFrame:
    head = F.col("role") == "TH"
    filled = head & F.col("scope").isNull()
    share = F.avg(F.when(head, filled.cast("double"))).over(W.partitionBy("doc_id"))
    return cells.select("doc_id", "seq", "role", F.when(head, F.coalesce("scope", F.lit("Column"))).otherwise(F.col("scope")).alias("scope"), filled.alias("is_backfilled"), F.round(share, 4).alias("share"))


_SCORE = r"CASE WHEN length({0}) <= 40 THEN 2 ELSE 0 END + CASE WHEN NOT regexp_matches({0}, '[.:!?]$') THEN 1 ELSE 0 END + CASE WHEN NOT regexp_matches({0}, '@|rsvp|email|reserve|today', 'i') THEN 2 ELSE 0 END"


@operator("pick_title", ["title_candidates"], rf"""SELECT doc_id, was_placeholder, CASE WHEN NOT was_placeholder THEN title ELSE substring(trim(coalesce(CASE WHEN h1 IS NULL THEN h2 WHEN h2 IS NULL THEN h1 WHEN {_SCORE.format('h2')} > {_SCORE.format('h1')} + 1 THEN h2 ELSE h1 END, line, 'Untitled document')), 1, 120) END AS new_title
    FROM (SELECT *, trim(title) = '' OR regexp_matches(lower(trim(title)), '^(title of your event|your title here|untitled|title here|add a title|enter title|document\d*|flyer\d*|new document)$') OR lower(trim(title)) = lower(regexp_replace(regexp_extract(file_name, '([^/]*)$', 1), '\.[^.]*$', '')) AS was_placeholder,
      list_filter(list_transform(string_split(page_text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 6 AND NOT regexp_matches(x, '^(\d+(\.\d+)*\.?|page \d+|https?://\S+|\d{{1,2}}/\d{{1,2}}/\d{{2,4}})$', 'i'))[1] AS line FROM title_candidates)""")
def pick_title(candidates: DataFrame) -> DataFrame:
    """A title for documents that have none: the better of two headings, else the first substantial line."""
    def score(c):
        points = lambda cond, n: F.when(cond, n).otherwise(0)
        return points(F.length(c) <= 40, 2) + points(~c.rlike(r"[.:!?]$"), 1) + points(~c.rlike("(?i)@|rsvp|email|reserve|today"), 2)

    h1, h2 = F.col("h1"), F.col("h2")
    heading = F.when(h1.isNull(), h2).when(h2.isNull(), h1).when(score(h2) > score(h1) + 1, h2).otherwise(h1)
    skip = r"(?i)^(\d+(\.\d+)*\.?|page \d+|https?://\S+|\d{1,2}/\d{1,2}/\d{2,4})$"
    lines = F.filter(F.transform(F.split("page_text", "\n"), T.strip), lambda x: (F.length(x) >= 6) & ~x.rlike(skip))
    best = F.substring(T.strip(F.coalesce(heading, F.get(lines, F.lit(0)), F.lit("Untitled document"))), 1, 120)
    weak = T.is_template_title(F.col("title"), F.col("file_name"))
    return candidates.select("doc_id", weak.alias("was_placeholder"), F.when(weak, best).otherwise(F.col("title")).alias("new_title"))
