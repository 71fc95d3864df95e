"""Small cases of the rules, and folds and windows against plain loops."""

import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from ferrule.functions import text as T
from ferrule.operators import accounts, analytics, content, ingest, layout, ledger, sequences
from ferrule.plans.rules import score
from ferrule.sources import ooxml


def test_score_is_clamped(spark):
    rows = spark.createDataFrame([(6, 0), (0, 0), (1, 1)], "c int, w int").select(score(F.col("c"), F.col("w")).alias("s")).collect()
    assert [r.s for r in rows] == [0, 100, 76]


@pytest.mark.parametrize("text,generic,raw,weak", [
    ("Click here >", False, False, False), ("Read more...", True, False, False), ("IMG_2041", False, False, True), ("chart 3", False, False, True), ("ab", False, False, True),
    ("https://www.example.com/a/long/enough/path", False, True, False), ("https://a.b", False, False, False)])
def test_text_rules(spark, text, generic, raw, weak):
    r = spark.createDataFrame([(text,)], "t string").select(T.is_generic_link(F.col("t")), T.is_raw_url(F.col("t")), T.is_weak_alt(F.col("t"))).first()
    assert tuple(r) == (generic, raw, weak)


def test_month_clamp_and_reset(spark):
    d = spark.createDataFrame([(dt.datetime(2023, 1, 31, 10),), (dt.datetime(2024, 1, 31, 10),), (dt.datetime(2023, 12, 5),)], "t timestamp")
    got = [r[0] for r in d.select(accounts.shown(accounts.next_reset(F.col("t"), F.dayofmonth("t")))).collect()]
    assert got == ["2023-02-28 08:00:00", "2024-02-29 08:00:00", "2024-01-05 08:00:00"]


def test_ledger_pools_and_stale_reset(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    events = [("a", 1, day(0), "deduct", 128), ("a", 2, day(0), "purchase", 5), ("a", 3, day(1), "deduct", 4), ("b", 1, day(0), "deduct", 1), ("b", 2, day(1), "refund", 4), ("c", 1, day(0), "deduct", 9), ("c", 2, day(100), "purchase", 0)]
    e = spark.createDataFrame(events, "user_id string, seq long, ts timestamp, kind string, amount int")
    u = spark.createDataFrame([(x, "individual", 0, day(0)) for x in "abc"], "id string, plan string, seats int, created_at timestamp")
    got = {(r.user_id, r.seq): r for r in ledger.credit_ledger(e, u).collect()}
    assert (got["a", 3].used, got["a", 3].purchased, got["a", 3].remaining) == (130, 3, 3)
    assert (got["b", 2].used, got["b", 2].purchased) == (0, 3)
    assert (got["c", 2].used, got["c", 2].reset_at) == (0, "2024-03-01 08:00:00")
    caught = {(r.user_id, r.seq): r for r in ledger.credit_ledger(e, u, catch_up=True).collect()}
    assert caught["c", 2].reset_at == "2024-05-01 08:00:00"


def test_jobs_without_tokens_do_not_count(spark):
    jobs = spark.createDataFrame([(1, "a", "completed", 2, None, None), (2, "a", "completed", 3, 1_000_000, None)], "id long, type string, status string, page_count int, input_tokens long, output_tokens long")
    total = analytics.cost_summary(jobs).where("type is null").first()
    assert (total.jobs, total.pages, total.cost_usd, total.cost_per_page) == (1, 3, 3.0, 1.0)


def test_search_wildcards(spark):
    a = spark.createDataFrame([("x", 1, "s", 1, "xABCx", None), ("y", 1, "s", 2, "acb", None)], "id string, section int, section_name string, order_num int, title string, summary string")
    assert [r.id for r in content.kb_search(a, "a_c").collect()] == ["x"]
    assert content.kb_search(a, "  ").count() == 0


def test_heading_normalize_equals_a_loop(spark):
    rnd = random.Random(5)
    docs = [[1, 3, 5, 1, 4]] + [[rnd.randint(1, 6) for _ in range(rnd.randint(1, 12))] for _ in range(150)]
    rows = [(d, i, v) for d, levels in enumerate(docs) for i, v in enumerate(levels)]
    got = {(r.doc_id, r.seq): r.new_level for r in sequences.heading_normalize(spark.createDataFrame(rows, "doc_id int, seq int, level int")).collect()}
    for d, levels in enumerate(docs):
        before, ones = 0, 0
        for i, v in enumerate(levels):
            ones += v == 1
            v = 2 if v == 1 and ones > 1 else v
            before = min(v, before + 1)
            assert got[d, i] == before
    assert [got[0, i] for i in range(5)] == [1, 2, 3, 2, 3]


def test_caption_lines_of_thirteen_words(spark):
    words = spark.createDataFrame([(1, i, f"w{i}", i * 0.4, i * 0.4 + 0.3) for i in range(13)], "media_id int, pos int, text string, start double, stop double")
    assert sorted((r.line_no, len(r.text.split())) for r in sequences.caption_lines(words).collect()) == [(1, 12), (2, 1)]


def test_reading_order_equals_a_loop(spark):
    rnd = random.Random(7)
    pages = {p: [(i, *((None,) * 4 if rnd.random() < 0.1 else (x := rnd.randint(0, 90), y := rnd.randint(0, 90), x + 10, y + rnd.randint(1, 30)))) for i in range(rnd.randint(1, 14))] for p in range(60)}
    rows = [(1, p, *[float(v) if k and v is not None else v for k, v in enumerate(b)]) for p, bs in pages.items() for b in bs]
    got = {}
    for r in layout.reading_order(spark.createDataFrame(rows, "doc_id int, page int, elem_id int, x0 double, y0 double, x1 double, y1 double")).collect():
        got.setdefault(r.page, {})[r.order] = r.elem_id
    for p, bs in pages.items():
        lines = []
        for b in sorted((b for b in bs if b[4] is not None), key=lambda b: (-b[4], b[0])):
            if lines:
                low, high = max(c[2] for c in lines[-1]), min(c[4] for c in lines[-1])
                shared = min(high, b[4]) - max(low, b[2])
                if shared > 0 and shared >= 0.35 * max(b[4] - b[2], 1):
                    lines[-1].append(b)
                    continue
            lines.append([b])
        want = [b[0] for line in lines for b in sorted(line, key=lambda b: b[1])] + [b[0] for b in bs if b[4] is None]
        assert [got[p][k] for k in range(len(bs))] == want


def test_page_backgrounds_and_repeated_images(spark):
    rows = [("t1", 1, 0, 1, 0.0, 0.0, 595.0, 882.0, "bg"), ("t1", 1, 1, 8, 125.0, 390.0, 470.0, 635.0, "dg")]
    rows += [("t2", p, *r[2:]) for p in (1, 2) for r in rows]
    images = spark.createDataFrame([(*r[:8], 595.0, 882.0, r[8]) for r in rows], "doc_id string, page int, img_idx int, bpc int, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double, hash string")
    got = {(r.doc_id, r.page, r.img_idx): r for r in layout.image_candidates(images).collect()}
    assert got["t1", 1, 0].reason == "background" and got["t1", 1, 1].reason == "candidate" and got["t1", 1, 1].coverage < 0.25
    assert [got["t2", p, 1].repeated_on_pages for p in (1, 2)] == [2, 2]


def test_padded_tables_are_rectangular(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, "th", 2, "a"), (1, 0, 0, 1, "td", 1, "b"), (1, 0, 1, 0, "td", 1, "c")], "doc_id int, table_seq int, row int, col int, tag string, colspan int, text string")
    got = sorted((r.row, r.col, r.text) for r in sequences.table_grid_pad(cells).collect())
    assert got == [(0, 0, "a"), (0, 1, ""), (0, 2, "b"), (1, 0, "c"), (1, 1, ""), (1, 2, "")]


def test_chunks_join_to_the_text(spark):
    texts = ["", None, "a" * 50, "<p>x</p>" * 9, "y<br>" * 11]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in ingest.text_chunks(docs, 20).collect():
        got.setdefault(r.doc_id, {})[r.chunk_no] = r.chunk
    for i, t in enumerate(texts):
        assert "".join(got.get(i, {}).get(k, "?") for k in range(len(got.get(i, {})))) == (t or "")


def test_annotate_tries_transient_errors_again(spark):
    def flaky(texts):
        if "bad" in texts:
            raise ValueError("no")
        if "down" in texts:
            raise ConnectionError("down")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([("a",), ("bad",), ("down",)], "t string").coalesce(1)
    got = {r.t: (r.result, r.error) for r in ingest.annotate(df, flaky, "t", batch=1).collect()}
    assert got == {"a": ("A", None), "bad": ("", "no"), "down": ("", "down")}


def test_office_packages(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p w:val="1"><w:t>hi</w:t></w:p></w:d>')
        z.writestr("bad.xml", "<a>")
    (tmp_path / "a.docx").write_bytes(out.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    rows = ooxml.elements(files).collect()
    assert [(r.local, r.parent_seq, r.text) for r in rows if r.part == "word/document.xml"] == [("d", None, None), ("p", 0, None), ("t", 1, "hi")]
    assert sum(r.parse_note is not None for r in rows) == 2


def test_los_angeles_day(spark):
    raw = spark.createDataFrame([(1, "00000000-0000-4000-8000-000000000001", "/a?x", 5000, True, "Mozilla", dt.datetime(2024, 1, 1, 3))], "event_id long, visitor_id string, path string, engaged_ms long, interaction boolean, user_agent string, ts timestamp")
    r = ingest.visit_event_ingest(raw).first()
    assert (r.visit_date, r.first_path, r.is_valid) == ("2023-12-31", "/a", True)
