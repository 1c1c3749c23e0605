"""Column functions over text: tokens, normal forms, snippets, single fields. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright import config as C

#: White space that trimming removes at both ends.
BLANK = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def tokens(text: Column) -> Column:
    """Lower-cased words of two characters or more that are no stopwords; one per occurrence."""
    found = F.transform(F.regexp_extract_all(text, F.lit(C.TOKEN), F.lit(0)), lambda w: F.lower(w))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*C.STOPWORDS))


def long_words(text: Column) -> Column:
    """Distinct lower-cased words of four characters or more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(C.WORD4), F.lit(0)), lambda w: F.lower(w)))


def snippet(text: Column, cap: int = C.DEFAULTS.snippet) -> Column:
    """The first ``cap`` characters, cut text marked by an ellipsis."""
    return F.when(F.length(text) > cap, F.concat(F.rtrim(F.substring(text, 1, cap)), F.lit("…"))).otherwise(text)


def capped(text: Column, cap: int = C.DEFAULTS.text_cap) -> Column:
    """Full text of a result, cut at ``cap``."""
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit("…[truncated]"))).otherwise(text)


def first_heading(text: Column) -> Column:
    """P20: the first line that starts with ``#``, without the marks."""
    return F.trim(F.regexp_extract(text, r"(?dm)^#+[ \t]*(.*)$", 1))


def quote_norm(text: Column) -> Column:
    """White-space- and markdown-insensitive form."""
    bare = F.regexp_replace(text, r"(?dm)^\s*>\s?", "")
    bare = F.regexp_replace(bare, r"\*\*|__|`", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def marker_norm(text: Column) -> Column:
    """Lower-cased, without asterisks and backticks."""
    return F.lower(F.translate(text, "*`", ""))


def strip_struck(text: Column, mark: str = " ") -> Column:
    """Struck spans, never over a blank line, become ``mark``."""
    return F.regexp_replace(text, C.STRUCK, mark)


def strip_code(text: Column) -> Column:
    """Fenced blocks, then inline code."""
    return F.regexp_replace(F.regexp_replace(text, C.FENCED, ""), C.INLINE_CODE, "")


def query_text(prompt: Column, cap: int = C.DEFAULTS.query_cap) -> Column:
    """Without outer white space, Italian elisions written with a hyphen are split, then the text is cut."""
    return F.substring(F.regexp_replace(strip(prompt), C.ELISION, "$1 "), 1, cap)


def field(front: Column, key: str) -> Column:
    """One top-level field of a frontmatter block, without paired quotes; empty where missing."""
    return F.regexp_extract(front, rf"(?dm)^{key}:[ \t]*['\"]?(.*?)['\"]?[ \t]*$", 1)


def front_block(raw: Column) -> Column:
    """What stands between the fences; needs a line end after the closing fence."""
    return F.regexp_extract(raw, r"(?s)\A---\n(.*?)\n---\n", 1)


def body(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?s)\A---\n.*?\n---\n", "")


def front_map(raw: Column) -> Column:
    """``key: value`` lines that do not start with a blank; the last of repeated keys wins; quotes go from both ends."""
    block = F.regexp_extract(raw, r"(?s)\A---\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[^ :\n][^:\n]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.btrim(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), F.lit("\"'")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), -1).alias("v")))
    return F.map_from_entries(last)


def indexed(raw: Column) -> Column:
    """False where the page's frontmatter opts out of the index (a line of its body does not); an unreadable page counts as indexed."""
    return F.coalesce(~front_block(raw).rlike(r"(?im)^index:\s*(false|no|off)\s*$"), F.lit(True))


def stale(status: Column) -> Column:
    """F01."""
    return F.lower(F.coalesce(status, F.lit(""))).isin(*C.STALE_STATUSES)


def page_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def slug(path: Column) -> Column:
    return F.regexp_replace(page_name(path), r"\.md$", "")


def synthetic_address(path: Column) -> Column:
    """P08."""
    return F.concat(F.lit("syn-"), F.substring(F.sha1(path), 1, 6))


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))
