"""Scalar rules over text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules.
GENERIC_LINKS = ("click here", "here", "read more", "more", "learn more", "link", "this link", "download", "see more", "details", "continue")
PLACEHOLDER_TITLE = r"^(untitled|unspecified|document\d*|presentation\d*|slide\s*show|unknown|title|new document)$"
PRODUCER_TITLE = r"^microsoft (word|powerpoint) - "
FILE_TITLE = r"\.(docx?|pptx?|pdf|pages|key|txt|rtf)$"
TEMPLATE_TITLE = r"^(title of your event|your title here|untitled|title here|add a title|enter title|document\d*|flyer\d*|new document)$"
IMAGE_FILE = r"\.(png|jpe?g|gif|bmp|tiff?|svg|webp|emf|wmf)$"
IMAGE_NOUN = r"^(picture|image|graphic|photo|screenshot|logo|icon|chart|diagram|content placeholder|placeholder)\s*\d*$"
CAMERA_NAME = r"^(img|dsc|screen shot|screenshot)[-_ ]?\d+"
SCAFFOLDING = (
    r"this (document|example|file|flyer|template)\s+(is|contains)\s+an?\s+example",
    r"intentional(ly)?\s+(accessibility\s+)?errors?",
    r"inaccessible\s+(flyer|document|example)",
    r"placeholder\s+text",
    r"lorem\s+ipsum",
)
ACRONYMS = ("aa", "ada", "ai", "html", "lms", "ocr", "pdf", "vpat", "wcag")
MANUAL_LIST = r"^([-*•·o]\s+|\d+[.)]\s+)"
_BLANK = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANK))


def is_generic_link(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), r"[.>»:]+$", "").isin(*GENERIC_LINKS)


def is_raw_url(text: Column) -> Column:
    return strip(text).rlike(r"(?i)^(https?://|www\.)\S+$") & (F.length(strip(text)) > 30)


def is_bad_link(text: Column) -> Column:
    bare = F.coalesce(text, F.lit(""))
    return (strip(bare) == "") | is_generic_link(bare) | is_raw_url(bare)


def is_placeholder_title(text: Column) -> Column:
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    return (t == "") | t.rlike(PLACEHOLDER_TITLE) | t.rlike(PRODUCER_TITLE) | t.rlike(FILE_TITLE)


def is_template_title(text: Column, file_name: Column) -> Column:
    """A missing or template title, or one that is the file's stem."""
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    stem = F.lower(F.regexp_replace(F.regexp_extract(file_name, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1"))
    return (t == "") | t.rlike(TEMPLATE_TITLE) | (t == stem)


def is_weak_alt(text: Column) -> Column:
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    return (F.length(t) < 3) | t.rlike(IMAGE_FILE) | t.rlike(IMAGE_NOUN) | t.rlike(CAMERA_NAME)


def is_scaffolding(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(SCAFFOLDING))


def clean(text: Column) -> Column:
    """Without control characters; white space runs are one space; trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0e-\x1f\x7f]", ""), r"\s+", " "))


def truncate(text: Column, n: int = 60) -> Column:
    t = strip(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit("…"))).otherwise(t)


def slug_title(slug: Column) -> Column:
    """A slug as a title: acronyms upper-case, the first word capitalised, digits joined by a point."""
    words = F.filter(F.split(slug, "-"), lambda w: w != "")
    cased = F.transform(words, lambda w, i: F.when(w.isin(*ACRONYMS), F.upper(w)).when(i == 0, F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))).otherwise(w))
    return F.regexp_replace(F.array_join(cased, " "), r"(\d) (\d)", "$1.$2")


def unfence(text: Column, kinds: str = "json") -> Column:
    """Without the code fence around a model's answer."""
    t = strip(text)
    return F.when(t.startswith("```"), strip(F.regexp_replace(F.regexp_replace(t, rf"^```(?:{kinds})?\s*", ""), r"```\s*$", ""))).otherwise(t)


def clock(seconds: Column) -> Column:
    """mm:ss, minutes not rolling into hours."""
    return F.concat(F.lpad(F.floor(seconds / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(seconds) % 60).cast("string"), 2, "0"))


def timecode(seconds: Column) -> Column:
    """hh:mm:ss.mmm; milliseconds are rounded, so they can read 1000."""
    part = lambda c, n=2: F.lpad(c.cast("string"), n, "0")
    ms = F.floor((seconds - F.floor(seconds)) * 1000 + 0.5)
    wide = F.when(ms >= 1000, ms.cast("string")).otherwise(part(ms, 3))
    return F.concat(part(F.floor(seconds / 3600)), F.lit(":"), part(F.floor((seconds % 3600) / 60)), F.lit(":"), part(F.floor(seconds % 60)), F.lit("."), wide)
