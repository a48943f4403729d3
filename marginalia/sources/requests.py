"""Addresses of the web services' requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# The services' addresses and row limits.
CROSSREF, UNPAYWALL, ARXIV, EPMC = "https://api.crossref.org/works", "https://api.unpaywall.org/v2/", "https://arxiv.org/pdf/", "https://www.ebi.ac.uk/europepmc/webservices/rest"
FIRST_ROWS, SEARCH_ROWS, CITING_ROWS = 1, 25, 100


def quoted(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def crossref(raw: Column) -> Column:
    """The best match of a reference's first characters."""
    return F.concat(F.lit(f"{CROSSREF}?query.bibliographic="), quoted(F.left(raw, F.lit(T.QUERY_CHARS))), F.lit(f"&rows={FIRST_ROWS}"))


def unpaywall(doi: Column, email: str) -> Column:
    return F.concat(F.lit(UNPAYWALL), doi, F.lit("?email="), quoted(F.lit(email)))


def arxiv(paper: Column) -> Column:
    return F.concat(F.lit(ARXIV), paper)


def search(query: Column, rows: int = SEARCH_ROWS) -> Column:
    return F.concat(F.lit(f"{EPMC}/search?query="), quoted(query), F.lit(f"&format=json&pageSize={rows}"))


def by_doi(doi: Column) -> Column:
    return search(F.concat(F.lit('DOI:"'), doi, F.lit('"')), FIRST_ROWS)


def by_title(title: Column) -> Column:
    return search(F.concat(F.lit('TITLE:"'), T.safe_title(title), F.lit('"')), FIRST_ROWS)


def citing(source: Column, paper: Column) -> Column:
    """Null where either part of the identity is missing."""
    both = (source != "") & (paper != "")
    return F.when(both, F.concat(F.lit(f"{EPMC}/"), source, F.lit("/"), paper, F.lit(f"/citations?format=json&pageSize={CITING_ROWS}")))
