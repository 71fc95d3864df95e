"""Input views of the operators, derived from the given tables.

Each view is one SELECT in the SQL that Spark and DuckDB share, so an operator's oracle starts from the same rows. ``{name}`` stands for a
table or another view. Formulas are free choices that make both branches of every rule occur.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_ARTICLES = """
        SELECT concat('kb', CAST(doc_id AS STRING)) AS id, CAST(doc_id % 6 AS INT) AS section, concat('Section ', CAST(doc_id % 6 AS STRING)) AS section_name, CAST(doc_id AS INT) AS order_num,
          substring(text, 1, 40) AS title, substring(text, 41) AS summary, concat('[\"kb', CAST(doc_id + 2 AS STRING), '\",\"none\",\"kb', CAST(doc_id + 1 AS STRING), '\"]') AS related_ids
        FROM {documents}"""
VIEWS: dict[str, str] = {
    "items": """
        SELECT l_orderkey, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS l_linenumber,
          l_quantity, l_extendedprice, l_discount, l_tax FROM {lineitem}""",
    "jobs": """
        SELECT o_orderkey AS id,
          CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'docs' WHEN '2' THEN 'canvas' WHEN '3' THEN 'alttext' WHEN '4' THEN 'video' ELSE 'flyer' END AS type,
          CASE WHEN o_orderkey % 53 = 0 THEN 'refunded' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'pending' END AS status,
          concat('file', CAST(o_orderkey % 7 AS STRING), '.pdf') AS input_name, CAST(o_orderdate AS TIMESTAMP) AS created_at,
          concat('user_', CAST(o_custkey AS STRING)) AS user_id, CAST(pages AS INT) AS page_count, CAST(pages AS INT) AS credits_used,
          CASE WHEN substring(o_orderpriority, 1, 1) IN ('3', '4') THEN NULL ELSE CAST(quantity * 100 AS BIGINT) END AS input_tokens,
          CASE WHEN substring(o_orderpriority, 1, 1) IN ('3', '4') THEN NULL ELSE CAST(lines * 40 AS BIGINT) END AS output_tokens,
          CASE WHEN o_orderkey % 3 = 0 THEN repeat('stack frame ', 60) ELSE 'timeout' END AS error_message
        FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS pages, sum(l_quantity) AS quantity, sum(l_linenumber) AS lines FROM {items} GROUP BY l_orderkey) items
          ON l_orderkey = o_orderkey""",
    "checker_usage": """
        SELECT d.doc_id AS id, concat('doc', CAST(d.doc_id AS STRING)) AS file_name,
          CASE d.doc_id % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'DOCX' WHEN 2 THEN 'PPTX' ELSE 'UNKNOWN' END AS file_type,
          CASE WHEN l.doc_id IS NULL THEN 'failed' ELSE 'completed' END AS status,
          CASE WHEN l.doc_id IS NULL THEN NULL ELSE CAST(l.quality * 60 + 30 - l.toxic * 20 AS INT) END AS score,
          CAST(CAST('2024-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '3' HOUR * CAST(d.doc_id AS INT) AS TIMESTAMP) AS created_at
        FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "usage_events_raw": """
        SELECT event_id AS id, CASE
          WHEN event_id % 11 = 0 THEN 'not json'
          WHEN event_id % 11 = 1 THEN concat('{{"fileName":"a/b/c', CAST(event_id AS STRING), '.pdf","fileType":"PDF","status":"completed","score":', CAST(event_id % 130 AS STRING), '}}')
          WHEN event_id % 11 = 2 THEN concat('{{"fileName":"d.docx","fileType":"DOC","status":"completed","score":', CAST(event_id % 90 AS STRING), '}}')
          WHEN event_id % 11 = 3 THEN '{{"fileName":"d.docx","fileType":"DOCX","status":"completed","extra":1}}'
          WHEN event_id % 11 = 4 THEN '{{"fileName":"","fileType":"DOCX","status":"failed"}}'
          WHEN event_id % 11 = 5 THEN concat('{{"fileName":"e.pptx","fileType":"PPTX","status":"failed","criticalCount":', CAST(event_id % 9 - 2 AS STRING), '}}')
          ELSE concat('{{"fileName":"dir/f', CAST(event_id AS STRING), '.docx","fileType":"DOCX","status":"completed","score":', CAST(event_id % 101 AS STRING), ',"criticalCount":1,"warningCount":2}}') END AS value
        FROM {events}""",
    "visits_raw": """
        SELECT event_id,
          CASE WHEN user_id % 19 = 0 THEN concat('bad-', CAST(user_id AS STRING)) ELSE concat('00000000-0000-4000-8000-', lpad(CAST(user_id AS STRING), 12, '0')) END AS visitor_id,
          concat(CASE event_type WHEN 'click' THEN '/kb' WHEN 'view' THEN '/blog' WHEN 'purchase' THEN '/admin' ELSE '/tools' END,
            CASE WHEN user_id % 3 = 0 THEN '/admin' ELSE '/a' END, '?k=', CAST(user_id AS STRING)) AS path,
          CAST(floor(abs(value) * 1000) AS BIGINT) AS engaged_ms, event_id % 5 <> 0 AS interaction,
          CASE event_id % 17 WHEN 0 THEN 'Googlebot/2.1' WHEN 1 THEN 'HeadlessChrome' ELSE 'Mozilla/5.0' END AS user_agent, CAST(ts AS TIMESTAMP) AS ts
        FROM {events}""",
    "visibility_events": """
        SELECT event_id, concat('v', CAST(user_id AS STRING)) AS visitor_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_id % 2 = 0 THEN 'visible' ELSE 'hidden' END AS state,
          event_id % 7 < 4 AS interacted FROM {events}""",
    "pageviews": """
        SELECT event_id, concat('v', CAST(user_id AS STRING)) AS user_id, CAST(ts AS TIMESTAMP) AS ts, concat('/p', CAST(event_id % 13 AS STRING)) AS path,
          CASE user_id % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' WHEN 3 THEN 'ES' WHEN 4 THEN 'IN' ELSE 'BR' END AS country,
          CASE WHEN event_id % 5 < 2 THEN '(not set)' WHEN event_id % 5 = 2 THEN 'google / organic' WHEN event_id % 5 = 3 THEN '(direct) / (none)' ELSE concat('ref', CAST(event_id % 11 AS STRING), ' / referral') END AS source_medium
        FROM {events}""",
    "users": """
        SELECT concat('user_', CAST(c_custkey AS STRING)) AS id, CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 10 = 0 THEN NULL ELSE concat(lower(c_name), '@example.org') END AS email,
          CASE c_mktsegment WHEN 'BUILDING' THEN 'team' WHEN 'MACHINERY' THEN NULL ELSE 'individual' END AS plan, c_custkey % 4 <> 0 AS subscribed,
          CASE WHEN c_mktsegment = 'BUILDING' THEN concat('org_', CAST(c_nationkey AS STRING)) ELSE NULL END AS org_id, CAST(c_custkey % 5 AS INT) AS seats,
          CAST(CAST('2024-01-31 10:30:00' AS TIMESTAMP) + INTERVAL '1' DAY * CAST(c_custkey % 400 AS INT) AS TIMESTAMP) AS created_at,
          CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('cus_', CAST(c_custkey AS STRING)) END AS customer_id,
          CAST(c_custkey % 140 AS INT) AS used, CAST(CASE WHEN c_custkey % 8 = 0 THEN c_custkey % 31 ELSE 0 END AS INT) AS purchased
        FROM {customer}""",
    "orgs": """
        SELECT concat('org_', CAST(n_nationkey AS STRING)) AS org_id, CASE WHEN n_nationkey % 3 = 2 THEN 'none' ELSE 'team' END AS plan, CAST(1 + n_nationkey % 20 AS INT) AS seats,
          n_nationkey % 4 = 1 AS billing_restricted, concat('user_', CAST(1 + n_nationkey * 3 AS STRING)) AS billing_owner_id FROM {nation}""",
    "members": """
        SELECT concat('org_', CAST(c_nationkey AS STRING)) AS org_id, concat('user_', CAST(c_custkey AS STRING)) AS user_id,
          CASE WHEN c_custkey % 4 = 1 THEN 'org:admin' ELSE 'org:member' END AS role, CAST(c_custkey AS INT) AS seq FROM {customer} WHERE c_custkey % 5 <> 0""",
    "invites": """
        SELECT concat('org_', CAST(s_nationkey AS STRING)) AS org_id, CASE WHEN s_suppkey % 3 = 0 THEN 'accepted' ELSE 'pending' END AS status FROM {supplier}""",
    "seat_requests": """
        SELECT o_orderkey AS request_id, concat('org_', CAST(o_custkey % 25 AS STRING)) AS org_id, CAST(o_orderkey % 9 - 4 AS INT) AS delta FROM {orders}""",
    "subscriptions": """
        SELECT concat('sub_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS sub_id, concat('user_', CAST(o_custkey AS STRING)) AS user_id,
          CASE l_orderkey % 5 WHEN 0 THEN 'canceled' WHEN 1 THEN 'past_due' WHEN 2 THEN 'trialing' ELSE 'active' END AS status, CASE WHEN l_linenumber % 2 = 0 THEN 'team' ELSE 'individual' END AS plan,
          CASE WHEN l_linenumber % 2 = 0 THEN concat('user_', CAST(1 + o_custkey % 50 AS STRING)) ELSE NULL END AS billing_owner_id, concat('org_', CAST(o_custkey % 25 AS STRING)) AS org_id,
          concat('price_', CAST(l_suppkey % 6 AS STRING)) AS price_id, CAST(floor(l_extendedprice) AS BIGINT) AS unit_amount,
          CASE l_linenumber % 4 WHEN 0 THEN 'month' WHEN 1 THEN 'year' WHEN 2 THEN 'week' ELSE 'day' END AS recur, CAST(1 + l_linenumber % 3 AS INT) AS interval_count,
          CAST(l_quantity AS INT) AS quantity, CAST(o_orderdate AS TIMESTAMP) AS ts
        FROM {items} JOIN {orders} ON o_orderkey = l_orderkey""",
    "prices": "SELECT concat('price_', CAST(r_regionkey AS STRING)) AS price_id, r_name AS plan FROM {region} WHERE r_regionkey < 3",
    "refund_requests": """
        SELECT o_orderkey AS request_id, concat('user_', CAST(o_custkey AS STRING)) AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey WHEN o_orderkey % 3 = 1 THEN o_orderkey + 1 ELSE NULL END AS job_id,
          concat('file', CAST(o_orderkey % 5 AS STRING), '.pdf') AS input_name FROM {orders}""",
    "deleted_users": "SELECT CASE WHEN c_custkey % 14 = 0 THEN concat('x', CAST(c_custkey AS STRING)) ELSE concat('user_', CAST(c_custkey AS STRING)) END AS user_id FROM {customer} WHERE c_custkey % 7 = 0",
    "ledger_events": """
        SELECT concat('user_', CAST(o_custkey AS STRING)) AS user_id, o_orderkey AS seq, CAST(o_orderdate AS TIMESTAMP) AS ts,
          CASE WHEN o_orderkey % 17 = 0 THEN 'plan' WHEN o_orderkey % 13 = 0 THEN 'purchase' WHEN o_orderkey % 11 = 0 THEN 'refund' ELSE 'deduct' END AS kind,
          CAST(CASE WHEN o_orderkey % 17 = 0 THEN 130 + 145 * (o_orderkey % 3) ELSE 1 + o_orderkey % 60 END AS INT) AS amount FROM {orders}""",
    "sub_events": """
        SELECT o_orderkey AS event_id, CAST(o_orderdate AS TIMESTAMP) AS ts, CASE WHEN o_orderkey % 7 = 0 THEN 'deleted' WHEN o_orderkey % 11 = 0 THEN 'credit_pack' WHEN o_orderkey % 3 = 0 THEN 'created' ELSE 'updated' END AS type,
          CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 THEN CAST(50 AS BIGINT) END AS credits,
          concat('cus_', CAST(o_custkey AS STRING)) AS customer_id, CASE WHEN o_custkey % 2 = 0 THEN 'team' ELSE 'individual' END AS plan, CAST(1 + o_orderkey % 12 AS INT) AS seats,
          CASE o_orderkey % 4 WHEN 0 THEN 'past_due' WHEN 1 THEN 'trialing' ELSE 'active' END AS status FROM {orders}""",
    "kb_articles": _ARTICLES,
    "kb_source": _ARTICLES + " WHERE doc_id % 5 < 4",
    "kb_live": """
        SELECT concat('kb', CAST(doc_id AS STRING)) AS id, CAST(doc_id % 6 AS INT) AS section, concat('Section ', CAST(doc_id % 6 AS STRING)) AS section_name, CAST(doc_id AS INT) AS order_num,
          CASE WHEN doc_id % 7 = 0 THEN 'Old title' ELSE substring(text, 1, 40) END AS title, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE substring(text, 41) END AS summary,
          concat('[\"kb', CAST(doc_id + 2 AS STRING), '\",\"none\",\"kb', CAST(doc_id + 1 AS STRING), '\"]') AS related_ids
        FROM {documents} WHERE doc_id % 5 > 0""",
    "kb_patches": """
        SELECT concat('kb', CAST(doc_id AS STRING)) AS id, doc_id % 2 = 0 AS has_title, 'Patched title' AS title, doc_id % 3 = 0 AS has_summary, CAST(NULL AS STRING) AS summary
        FROM {documents} WHERE doc_id % 9 = 1""",
    "posts": """
        SELECT concat('post-', CAST(doc_id AS STRING)) AS slug, text AS title, lang AS category, CAST(CAST('2024-01-01' AS DATE) + CAST(doc_id % 300 AS INT) AS DATE) AS published_at,
          CASE WHEN doc_id % 3 = 0 THEN CAST(CAST('2024-12-01' AS DATE) + CAST(doc_id % 20 AS INT) AS DATE) ELSE NULL END AS updated_at, doc_id % 97 = 0 AS featured FROM {documents}""",
    "routes": """
        SELECT concat('/', lower(n_name)) AS path, CASE WHEN n_nationkey % 2 = 0 THEN 'weekly' ELSE NULL END AS changefreq, CASE WHEN n_nationkey % 3 = 0 THEN 0.9 ELSE NULL END AS priority FROM {nation}""",
    "slugs": "SELECT concat('how-to-', CASE p_partkey % 4 WHEN 0 THEN 'pdf-ocr' WHEN 1 THEN 'wcag-2-1-aa' WHEN 2 THEN 'ai-html' ELSE 'ada-title-2' END, '-', replace(lower(p_name), ' ', '-')) AS slug FROM {part}",
    "lines": """
        SELECT doc_id, CAST(p AS INT) AS seq, line FROM (SELECT doc_id, {EXPLODE_LINES} FROM {documents}) x""",
    "link_texts": """
        SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN 'Click here' WHEN 1 THEN 'click here >' WHEN 2 THEN 'Read more...' WHEN 3 THEN 'https://www.example.com/a/very/long/path/to/some/page.html'
          WHEN 4 THEN 'www.example.com' WHEN 5 THEN 'Details:' WHEN 6 THEN 'IMG_2041' WHEN 7 THEN 'chart 3' WHEN 8 THEN 'ab' WHEN 9 THEN 'photo.JPG'
          WHEN 10 THEN ' this file contains an example ' ELSE p_name END AS text FROM {part}""",
    "titles": """
        SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'Untitled' WHEN 2 THEN 'Document12' WHEN 3 THEN 'Microsoft Word - x' WHEN 4 THEN 'report.docx' WHEN 5 THEN concat('part', CAST(p_partkey AS STRING))
          WHEN 6 THEN 'slide show' ELSE p_name END AS text, concat('/in/part', CAST(p_partkey AS STRING), '.pdf') AS file_name FROM {part}""",
    "manifest": """
        SELECT concat('/in/', replace(p_name, ' ', '_'), CAST(p_partkey AS STRING), CASE p_partkey % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.pptx' WHEN 3 THEN '.doc' ELSE '' END) AS path,
          CASE WHEN p_partkey % 7 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(p_retailprice * 45000) AS BIGINT) END AS length FROM {part}""",
    "contacts": """
        SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN concat(' ', lower(c_name), '@mail.example.org ') WHEN 1 THEN lower(c_name) WHEN 2 THEN concat(lower(c_name), '@example') WHEN 3 THEN 'a@b@c.d' ELSE concat(lower(c_name), '@x.org') END AS email,
          CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE c_name END AS name FROM {customer}""",
    "media_inputs": """
        SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'https://www.youtube.com/watch?v=abcdefghijk&t=1' WHEN 1 THEN 'https://youtu.be/ABCDEFGHI-_' WHEN 2 THEN 'lecture.MP4' WHEN 3 THEN 'talk.mp3'
          WHEN 4 THEN 'notes.txt' WHEN 5 THEN 'https://example.com/video' WHEN 6 THEN 'https://x.org/embed/a1b2c3d4e5f' ELSE concat(p_name, '.webm') END AS source FROM {part}""",
    "model_text": """
        SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN concat('```json', chr(10), '{{"fixesMade":["a","b"],"issues":["k', CAST(user_id AS STRING), '"]}}', chr(10), '```')
          WHEN 1 THEN 'Sure! Here it is: {{"fixesMade":["x"],"issues":[]}} Hope it helps.' WHEN 2 THEN 'no object at all' WHEN 3 THEN '{{"fixesMade":[],"issues":["i"]}}' WHEN 4 THEN '{{broken' ELSE '```
{{"fixesMade":["c","d","e"],"issues":["y","z"]}}
```' END AS response FROM {events}""",
    "element_json": """
        SELECT l_orderkey AS doc_id, concat('[', string_agg(concat('{{"type":"', CASE l_partkey % 6 WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'table' WHEN 3 THEN 'figure' WHEN 4 THEN 'list_item' ELSE 'callout' END, '","level":1,"text":"x"}}'), ','), ']') AS response
        FROM {items} GROUP BY l_orderkey""",
    "fragments": """
        SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS seq, CASE l_linenumber % 4 WHEN 0 THEN concat('```html', chr(10), '<p>a', CAST(l_partkey AS STRING), '</p>', chr(10), '```')
          WHEN 1 THEN concat('<div class="x" lang="en">', chr(10), '<p>b', CAST(l_suppkey AS STRING), '</p></div>') WHEN 2 THEN ' <p>c</p> ' ELSE '<div><p>d</p></div>' END AS html FROM {items}""",
    "point_lines": """
        SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS seq, CASE l_linenumber % 3 WHEN 0 THEN concat('**Quiz ', CAST(l_partkey AS STRING), '**....', CAST(CAST(l_quantity AS INT) AS STRING), ' pts')
          WHEN 1 THEN concat('Essay ', CAST(l_suppkey AS STRING), ' ........ ', CAST(CAST(l_quantity AS INT) AS STRING), ' points') ELSE '** plain line' END AS line FROM {items}""",
    "words": """
        SELECT media_id, pos, text, s AS start, s + 0.35 AS stop FROM (
          SELECT conv_id AS media_id, CAST(pos AS INT) AS pos, text, CAST(pos AS DOUBLE) * 0.4 + floor(pos / 7) * 2.0 + floor(pos / 19) * 1.0 AS s FROM (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p) - 1 AS pos, line AS text FROM (SELECT conv_id, turn, {EXPLODE_WORDS} FROM {conversations}) a) b) c""",
    "headings": "SELECT doc_id, seq, CAST(1 + (length(line) + seq) % 6 AS INT) AS level, line AS text FROM {lines}",
    "cells": """
        SELECT l_orderkey AS doc_id, CAST(floor((l_linenumber - 1) / 4) AS INT) AS table_seq, concat('t', CAST(CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE floor((l_linenumber - 1) / 4) END AS STRING)) AS table_tag_id,
          CAST((l_linenumber - 1) % 4 AS INT) AS row, CAST(c AS INT) AS col,
          CASE WHEN (l_linenumber - 1) % 4 = 0 AND l_orderkey % 2 = 0 THEN 'th' WHEN c = 0 AND l_orderkey % 5 = 0 THEN 'th' ELSE 'td' END AS tag, CAST(CASE WHEN c = 1 AND l_linenumber % 3 = 0 THEN 2 ELSE 1 END AS INT) AS colspan,
          CASE WHEN l_orderkey % 6 = 1 AND c < 2 THEN '' ELSE concat('v', CAST(l_partkey AS STRING), '_', CAST(c AS STRING)) END AS text
        FROM {items} CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2) k WHERE c < 2 + l_partkey % 2""",
    "tagged_cells": """
        SELECT l_orderkey AS doc_id, CAST(l_linenumber * 10 + c AS BIGINT) AS seq, CAST(l_linenumber AS BIGINT) AS row_id, CAST(c AS INT) AS col,
          CASE WHEN l_linenumber % 3 = 1 OR (c = 0 AND l_orderkey % 7 = 0) THEN 'TH' ELSE 'TD' END AS role, CASE WHEN l_linenumber % 3 = 1 AND c <> 2 THEN concat('h', CAST(l_linenumber AS STRING), '_', CAST(c AS STRING)) ELSE NULL END AS id,
          CASE WHEN c = 1 AND l_partkey % 5 = 0 THEN 'given' ELSE NULL END AS headers, CASE WHEN l_partkey % 3 = 0 THEN 'Row' ELSE NULL END AS scope
        FROM {items} CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2) k""",
    "nodes": """
        SELECT l_orderkey AS doc_id, CAST(1 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, 0 AS seq, 'Table' AS raw_role, CAST(NULL AS STRING) AS scope, false AS has_headers FROM {items} WHERE l_linenumber = 1
        UNION ALL SELECT l_orderkey, CAST(l_linenumber * 10 AS BIGINT), CASE WHEN l_partkey % 29 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(1 AS BIGINT) END, l_linenumber, CASE WHEN l_partkey % 31 = 0 THEN 'P' WHEN l_partkey % 37 = 0 THEN 'Zeile' ELSE 'TR' END, NULL, false FROM {items}
        UNION ALL SELECT l_orderkey, CAST(l_linenumber * 10 + c AS BIGINT), CAST(CASE WHEN c = 2 AND l_partkey % 23 = 0 THEN l_linenumber * 10 + 1 ELSE l_linenumber * 10 END AS BIGINT), c,
          CASE WHEN l_linenumber = 1 THEN 'TH' ELSE 'TD' END, CASE WHEN l_linenumber = 1 AND c = 1 THEN 'Column' WHEN l_linenumber = 1 AND l_partkey % 4 = 0 THEN 'Bad' ELSE NULL END, l_suppkey % 2 = 0
          FROM {items} CROSS JOIN (SELECT 1 AS c UNION ALL SELECT 2) k""",
    "roles": "SELECT o_orderkey AS doc_id, 'Zeile' AS raw_role, CASE WHEN o_orderkey % 2 = 0 THEN 'TR' ELSE 'P' END AS role FROM {orders}",
    "node_boxes": """
        SELECT l_orderkey AS doc_id, CAST(l_linenumber * 10 + c AS BIGINT) AS node_id, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_quantity * 8 + c * 100 AS DOUBLE) END AS x0, CAST(l_discount * 5000 AS DOUBLE) AS y0,
          CAST(l_quantity * 8 + c * 100 + 60 AS DOUBLE) AS x1, CAST(l_discount * 5000 + 10 + l_partkey % 40 AS DOUBLE) AS y1 FROM {items} CROSS JOIN (SELECT 1 AS c UNION ALL SELECT 2) k""",
    "boxes": """
        SELECT l_orderkey AS doc_id, CAST(1 + l_suppkey % 2 AS INT) AS page, CAST(l_linenumber AS INT) AS elem_id,
          CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(l_quantity * 8 AS DOUBLE) END AS x0, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(l_discount * 5000 AS DOUBLE) END AS y0,
          CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(l_quantity * 8 + 60 AS DOUBLE) END AS x1, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(l_discount * 5000 + 10 + l_partkey % 40 AS DOUBLE) END AS y1
        FROM {items}""",
    "text_items": """
        SELECT l_orderkey AS doc_id, CAST(1 + l_suppkey % 2 AS INT) AS page, CAST(l_linenumber AS INT) AS seq, concat('w', CAST(l_partkey % 90 AS STRING)) AS str,
          CAST(l_quantity * 8 AS DOUBLE) AS x, CAST(l_tax * 4000 AS DOUBLE) AS y, CAST(20.0 AS DOUBLE) AS w, CAST(10.0 AS DOUBLE) AS h FROM {items}""",
    "annotations": """
        SELECT o_orderkey AS doc_id, CAST(1 + o_custkey % 2 AS INT) AS page, 1 AS annot_id, CASE WHEN o_custkey % 5 = 0 THEN 'Widget' ELSE 'Link' END AS subtype, CAST(40.0 AS DOUBLE) AS x1, CAST(0.0 AS DOUBLE) AS y1,
          CAST(150 + o_orderkey % 200 AS DOUBLE) AS x2, CAST(50 + o_orderkey % 280 AS DOUBLE) AS y2, CASE WHEN o_orderkey % 3 = 0 THEN 'click here' WHEN o_orderkey % 3 = 1 THEN '' ELSE NULL END AS alt FROM {orders}""",
    "images": """
        SELECT l_orderkey AS doc_id, CAST(1 + l_suppkey % 2 AS INT) AS page, CAST(l_linenumber AS INT) AS img_idx, CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 8 END AS bpc, CAST(0.0 AS DOUBLE) AS x0, CAST(0.0 AS DOUBLE) AS y0,
          CAST(CASE WHEN l_partkey % 4 = 0 THEN 600 WHEN l_partkey % 9 = 0 THEN 5 ELSE l_quantity * 10 END AS DOUBLE) AS x1, CAST(CASE WHEN l_partkey % 4 = 0 THEN 780 WHEN l_partkey % 10 = 1 THEN 9 ELSE 200 END AS DOUBLE) AS y1,
          CAST(612.0 AS DOUBLE) AS page_w, CAST(792.0 AS DOUBLE) AS page_h, concat('h', CAST(l_partkey % 50 AS STRING)) AS hash FROM {items}""",
    "marks": """
        SELECT doc_id, page, img_idx AS mark_id, CASE WHEN img_idx % 3 = 0 THEN 'Artifact' ELSE 'Figure' END AS tag, CAST(img_idx AS INT) AS mcid, bpc = 8 AS has_image, x0, y0, x1, y1, page_w, page_h FROM {images}""",
    "decisions": "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS mcid, l_partkey % 3 = 0 AS decorative, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE concat('alt ', CAST(l_partkey AS STRING)) END AS alt_text FROM {items} WHERE l_suppkey % 3 <> 0",
    "figures": "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS mcid, CASE WHEN l_partkey % 2 = 0 THEN concat('old ', CAST(l_partkey AS STRING)) ELSE NULL END AS existing_alt FROM {items}",
    "html_refs": """
        SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS seq, CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE concat('cid:img', CAST(l_linenumber AS STRING)) END AS src, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE concat('alt ', CAST(l_partkey AS STRING)) END AS alt,
          CASE WHEN l_partkey % 5 = 0 THEN repeat('caption ', 80) ELSE NULL END AS caption FROM {items}""",
    "ref_images": "SELECT l_orderkey AS doc_id, concat('img', CAST(l_linenumber AS STRING)) AS image_id FROM {items} WHERE l_suppkey % 4 <> 0",
    "page_signals": """
        SELECT l_orderkey AS doc_id, CASE WHEN l_orderkey % 9 = 0 THEN 'docx' ELSE 'pdf' END AS ext, CAST(l_linenumber AS INT) AS page, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS total_pages, CAST(l_partkey % 120 AS INT) AS text_len,
          CAST(l_suppkey % 6 AS INT) AS max_table_rows, CAST(l_suppkey % 4 AS INT) AS max_table_cols, CAST(l_discount * 10 AS DOUBLE) AS table_coverage, l_partkey % 19 = 0 AS has_content_image,
          CASE l_orderkey % 8 WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' ELSE 'auto' END AS mode FROM {items}""",
    "page_texts": "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS page, CAST(CASE WHEN l_partkey % 2 = 0 THEN l_partkey % 49 ELSE l_partkey END AS INT) AS text_len FROM {items}",
    "text_blocks": """
        SELECT l_orderkey AS doc_id, 1 AS page, CAST(l_linenumber % 3 * 100 AS DOUBLE) AS x, CAST(l_quantity * 3 AS DOUBLE) AS y, concat('  block ', CAST(CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE l_partkey END AS STRING), '   text ') AS text FROM {items}""",
    "title_candidates": """
        SELECT p_partkey AS doc_id, concat('/in/f', CAST(p_partkey AS STRING), '.pdf') AS file_name, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Untitled' WHEN 2 THEN '' ELSE concat('F', CAST(p_partkey AS STRING)) END AS title,
          CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'RSVP today by email.' ELSE concat(p_name, ' ', p_type) END AS h1, CASE WHEN p_partkey % 2 = 0 THEN concat('About ', p_brand) ELSE NULL END AS h2,
          concat('20.4.1', chr(10), 'page 3', chr(10), 'ab', chr(10), p_type, ' guide') AS page_text FROM {part}""",
    "balances": "SELECT id AS user_id, used, purchased, CASE WHEN plan = 'team' THEN greatest(seats, 1) * 145 ELSE 130 END AS monthly_limit FROM {users}",
    "placements": "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS elem_id, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b, CAST(-l_tax AS DOUBLE) AS c, CAST(l_quantity / 2 AS DOUBLE) AS d, CAST(l_suppkey AS DOUBLE) AS e, CAST(l_linenumber AS DOUBLE) AS f FROM {items}",
    "runs": "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS elem_id, CAST(l_partkey % 30 AS INT) AS n_glyphs, CAST(0.5 + l_discount AS DOUBLE) AS avg_glyph, CAST(8 + l_suppkey % 10 AS DOUBLE) AS size, CAST(l_quantity * 10 AS DOUBLE) AS x, CAST(l_tax * 5000 AS DOUBLE) AS y FROM {items}",
    "part_langs": "SELECT doc_id, lang FROM {documents} UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'en-US' ELSE NULL END FROM {documents} UNION ALL SELECT doc_id, lang FROM {documents} WHERE doc_id % 2 = 0",
    "doc_titles": """
        SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Untitled' WHEN doc_id % 5 = 1 THEN '' ELSE substring(text, 1, 30) END AS title, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 1 + CAST(doc_id % 2 AS INT) END AS n_langs FROM {documents}""",
    "doc_parts": """
        SELECT doc_id, CAST(p AS BIGINT) AS seq, CASE (p + doc_id) % 7 WHEN 0 THEN 'link' WHEN 1 THEN 'image' WHEN 2 THEN 'table' ELSE 'paragraph' END AS kind, concat('Picture ', CAST(p AS STRING)) AS name,
          CASE (p + doc_id) % 7 WHEN 0 THEN CASE doc_id % 4 WHEN 0 THEN 'click here' WHEN 1 THEN '' WHEN 2 THEN 'https://example.org/an/address/of/some/length' ELSE substring(line, 1, 80) END
            WHEN 1 THEN CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'image 3' ELSE substring(line, 1, 50) END WHEN 2 THEN '' ELSE CASE WHEN p % 5 = 4 THEN concat('- ', line) ELSE line END END AS text,
          CASE WHEN (p + doc_id) % 7 = 3 THEN CAST(1 + (p + doc_id) % 4 AS INT) END AS level, p % 6 = 5 AS listed, doc_id % 2 = 1 AS headed, p % 4 <> 3 AS judged
        FROM (SELECT doc_id, {EXPLODE_LINES} FROM {documents}) e""",
    "slides": """
        SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS slide, CASE WHEN o_orderkey % 6 = 0 THEN '' WHEN o_orderkey % 6 < 3 THEN 'Agenda' ELSE concat('Slide ', CAST(o_orderkey AS STRING)) END AS title,
          o_orderkey % 10 = 0 AS has_table, CAST(CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE 1 END AS INT) AS n_langs, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 50 END AS INT) AS chars,
          CASE WHEN o_custkey % 3 = 0 THEN 'Presentation1' ELSE 'Course deck' END AS deck_title FROM {orders}""",
    "slide_items": """
        SELECT o.doc_id, o.slide, CAST(i.l_linenumber AS BIGINT) AS item, CASE WHEN i.l_linenumber % 2 = 0 THEN 'link' ELSE 'picture' END AS kind, concat('Picture ', CAST(i.l_linenumber AS STRING)) AS name,
          CASE WHEN i.l_linenumber % 2 = 0 THEN CASE i.l_partkey % 12 WHEN 0 THEN 'click here' WHEN 1 THEN '' WHEN 2 THEN 'https://example.org/an/address/of/some/length' ELSE concat('Order of part ', CAST(i.l_partkey AS STRING)) END
            ELSE CASE i.l_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'image 3' WHEN 2 THEN 'a photo with a name of some length.png' ELSE concat('Drawing of part ', CAST(i.l_partkey AS STRING)) END END AS text, i.l_suppkey % 3 = 0 AS decorative
        FROM {items} i JOIN (SELECT o_orderkey, o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS slide FROM {orders}) o ON o.o_orderkey = i.l_orderkey""",
    "pdf_docs": """
        SELECT o_orderkey AS doc_id, CAST(1 + o_orderkey % 90 AS INT) AS page_count, o_custkey % 3 <> 0 AS marked, CAST(o_custkey % 2 AS INT) AS outline_count, o_custkey % 7 <> 0 AS can_copy, o_custkey % 5 <> 0 AS can_copy_accessibility,
          CASE WHEN o_orderkey % 4 = 0 THEN 'untitled' ELSE 'Syllabus' END AS title, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'en' END AS language, CASE WHEN o_orderkey % 20 = 0 THEN 'bad tree' ELSE NULL END AS table_parse_error FROM {orders}""",
    "pdf_pages": "SELECT l_orderkey AS doc_id, CAST(CASE WHEN l_partkey % 50 = 0 THEN 81 ELSE l_linenumber END AS INT) AS page, CAST(CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey % 90 END AS INT) AS chars, l_suppkey % 2 = 0 AS has_image FROM {items}",
}

#: What the two engines write differently: numbered lines and words of a text.
EXPLODE = {
    "spark": {"EXPLODE_LINES": "posexplode(split(text, '\\n')) AS (p, line)", "EXPLODE_WORDS": "posexplode(split(text, ' ')) AS (p, line)"},
    "duckdb": {"EXPLODE_LINES": "unnest(range(len(string_split(text, chr(10))))) AS p, unnest(string_split(text, chr(10))) AS line",
               "EXPLODE_WORDS": "unnest(range(len(string_split(text, ' ')))) AS p, unnest(string_split(text, ' ')) AS line"},
}
_NAME = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view over given tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    used = set(_NAME.findall(text)) - {"EXPLODE_LINES", "EXPLODE_WORDS"}
    for key, sql in EXPLODE["spark"].items():
        text = text.replace("{" + key + "}", sql)
    return spark.sql(text, **{k: view(spark, sf_dir, k) for k in used})


def with_views(names, body: str) -> str:
    """Oracle SQL for DuckDB: the views as common table expressions before a query."""
    parts: list[str] = []

    def add(name: str) -> None:
        if name in TABLES or any(p.startswith(f"{name} AS") for p in parts):
            return
        text = VIEWS[name]
        for used in _NAME.findall(text):
            if used not in EXPLODE["duckdb"]:
                add(used)
        for key, sql in EXPLODE["duckdb"].items():
            text = text.replace("{" + key + "}", sql)
        parts.append(f"{name} AS ({_NAME.sub(lambda m: m[1], text).replace('{{', '{').replace('}}', '}')})")

    for n in names:
        add(n)
    if not parts:
        return body
    tail = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if tail.startswith(start):
            return start + ", ".join(parts) + ", " + tail[len(start):]
    return "WITH " + ", ".join(parts) + " " + tail
