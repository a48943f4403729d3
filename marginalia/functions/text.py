"""Scalar expressions over reference strings, titles and hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the audit's formats.
DOI = r"10\.(?U:\d){4,9}/(?U:[^\s\"'<>]+)"
YEAR = r"(?U)\((\d{4})\)|\b(?:19|20)\d{2}\b"
ARXIV = r"(?Ui)arxiv[:\s]*(\d{4}\.\d{4,5})(v\d+)?"
TITLE_STOPWORDS = ["commun", "nature", "science", "journal", "lancet", "article", "elsevier", "springer", "wiley", "volume", "press", "https"]
KEYWORD_STOPWORDS = [
    "the", "and", "for", "with", "from", "into", "using", "based", "toward",
    "towards", "study", "analysis", "review", "novel", "between", "among",
    "their", "this", "that", "after", "before", "during", "versus",
]
TITLE_RATIO = 0.35
QUERY_CHARS, PREVIEW_CHARS, TITLE_CHARS, MANUSCRIPT_CHARS, SOURCE_CHARS = 250, 100, 220, 180_000, 150_000


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def doi(raw: Column) -> Column:
    """The first DOI, without trailing punctuation or unmatched closing brackets."""
    found = none_if_empty(F.regexp_extract(raw, DOI, 0))
    closing = lambda x: F.length(x) - F.length(F.replace(x, F.lit(")"), F.lit("")))
    opening = lambda x: F.length(x) - F.length(F.replace(x, F.lit("("), F.lit("")))
    cut = lambda x: F.rtrim(x, F.lit(".,;"))
    drop = lambda x, _: F.when(x.endswith(")") & (closing(x) > opening(x)), cut(x.substr(F.lit(1), F.length(x) - 1))).otherwise(x)
    # each step takes one bracket, so there are no more steps than brackets
    return F.aggregate(F.sequence(F.lit(1), F.greatest(closing(found), F.lit(1))), cut(found), drop)


def doi_repaired(raw: Column) -> Column:
    """Whether a closing bracket without an opening one was taken off the DOI."""
    return F.coalesce(doi(raw) != F.rtrim(F.regexp_extract(raw, DOI, 0), F.lit(".,;")), F.lit(False))


def year(raw: Column) -> Column:
    """The leftmost bracketed four digits or year of 1900 to 2099, as text."""
    return none_if_empty(F.translate(F.regexp_extract(raw, YEAR, 0), "()", ""))


def arxiv_id(raw: Column) -> Column:
    return none_if_empty(F.regexp_extract(raw, ARXIV, 1))


def first_name(c: Column) -> Column:
    """Letters and hyphens of the first word, lower case."""
    word = F.get(F.split(F.trim(c), r"(?U)[,\s]", 2), F.lit(0))
    return F.lower(F.regexp_replace(word, r"[^A-Za-z\-]", ""))


def slug(raw: Column, year_: Column) -> Column:
    first = F.coalesce(none_if_empty(first_name(raw)), F.lit("ref"))
    return F.when(year_.isNull(), first).otherwise(F.concat(first, F.lit("-"), year_))


def year_number(c: Column) -> Column:
    """Year as a number from its first four characters; null where they are none."""
    return F.left(c.cast("string"), F.lit(4)).try_cast("int")


def norm_title(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def hit_title(c: Column) -> Column:
    return F.rtrim(squeeze(F.coalesce(c, F.lit(""))), F.lit("."))


def keywords(title: Column, n: int = 4) -> Column:
    """The first n words of four letters or more that are no stop words; repeats stay."""
    words = F.regexp_extract_all(F.lower(title), F.lit(r"[A-Za-z][A-Za-z\-]{3,}"), F.lit(0))
    return F.slice(F.filter(words, lambda w: ~w.isin(KEYWORD_STOPWORDS)), 1, n)


def search_query(title: Column) -> Column:
    return F.array_join(keywords(title), " AND ")


def safe_title(title: Column) -> Column:
    """A title that can stand between double quotes."""
    return F.trim(F.translate(title, '"', " "))


def hit_keys(doi_: Column, title: Column) -> Column:
    """Identities of a hit: its DOI and its normalised title, where not empty."""
    return F.array_distinct(F.filter(F.array(F.coalesce(doi_, F.lit("")), norm_title(F.coalesce(title, F.lit("")))), lambda k: k != ""))


def author_year_key(authors: Column, year_: Column) -> Column:
    """``lastname-year``, or null where either is missing."""
    last = none_if_empty(first_name(authors))
    return F.when(none_if_empty(authors).isNotNull() & (F.coalesce(year_, F.lit(0)) != 0), F.concat(last, F.lit("-"), year_.cast("string")))


def title_tokens(raw: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(raw), F.lit("[a-z]{5,}"), F.lit(0)))
    return F.array_except(words, F.array(*map(F.lit, TITLE_STOPWORDS)))


def title_hits(tokens: Column, page: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: F.contains(page, t)))


def title_check(raw: Column, page_text: Column) -> Column:
    """Null where a retrieved first page passes for the reference, else the reason; an unreadable page passes."""
    page = F.lower(squeeze(F.coalesce(page_text, F.lit(""))))
    tokens = title_tokens(raw)
    n, found = F.size(tokens), title_hits(tokens, page)
    reason = F.format_string("title check failed: %d/%d reference tokens on the retrieved first page", found, n)
    return F.when((page != "") & (n > 0) & (found / n < TITLE_RATIO), reason)


def section_key(location: Column) -> Column:
    """The section of a location: what stands before a section or paragraph sign."""
    head = F.substring_index(F.substring_index(location, "§", 1), "¶", 1)
    return F.coalesce(none_if_empty(F.trim(head)), F.lit("Other"))


def preview(text: Column) -> Column:
    return F.left(text, F.lit(PREVIEW_CHARS))


def shorten(text: Column, n: int) -> Column:
    """At most n characters, with an ellipsis where some are cut."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)
