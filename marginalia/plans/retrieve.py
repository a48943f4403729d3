"""Retrieval of references, and the search around a paper, behind the fetch seam.

A chain of services is asked in stages: a reference that one stage settles is
joined out before the next, so that no request is made for it.  Each stage's
answers are written before they are used, as an answer must not be fetched
twice, and not differently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as W
from ..operators import scout
from ..sources import requests as Q
from ..sources import seams
from ..sources.request_ledger import RequestLedger
from .journal import Journal

Get = Callable[[str], tuple[int, bytes]]
#: Keeps a stage's answers: a table in, the same table read back from storage.
Keep = Callable[[DataFrame, str], DataFrame]


def _asked(rows: DataFrame, url: Column, get: Get | RequestLedger) -> DataFrame:
    """(paper, ord, status, body, error) of rows (paper, ord, …) with an address; an address that several name is asked once."""
    each = rows.select("paper", "ord", url.alias("url")).where("url is not null")
    if isinstance(get, RequestLedger):
        answers = get.fetch(each)
    else:
        answers = seams.fetch(each.select(F.col("url").alias("key"), "url").distinct(), get)
    return each.join(answers.select("url", "status", "body", "error"), "url").select("paper", "ord", "status", "body", "error")


def _downloads(answers: DataFrame, source: str, first_page: Callable[[Column], Column]) -> DataFrame:
    return answers.select("paper", "ord", F.lit(source).alias("source"), F.col("status").alias("http_status"), W.is_pdf(F.col("status"), F.col("body")).alias("is_pdf"), first_page(F.col("body")).alias("first_page"))


#: Stages of the chain that ask a service, in order.
STAGES = ("arxiv", "crossref", "unpaywall-lookup", "unpaywall", "europepmc-lookup", "europepmc")


def retrieve(refs: DataFrame, files: DataFrame, get: Get | RequestLedger, first_page: Callable[[Column], Column], email: str, keep: Keep, journal: Journal | None = None) -> DataFrame:
    """(paper, ord, doi, status, resolver, reason) of references (paper, ord, num, raw, doi, slug); files: the user's (paper, name).

    With a journal, stages take what it holds of a reference and add what it
    doesn't; with a ledger for ``get``, addresses that were ever asked aren't again.
    """
    ids = ["paper", "ord"]
    step = journal.advance if journal else lambda name, rows, make: keep(make(rows), name)
    provided = keep(W.match_provided(refs, files), "provided")
    left = refs.join(provided, ids, "left_anti")

    arxiv = step("arxiv", left, lambda rows: _downloads(_asked(rows, Q.arxiv(T.arxiv_id(F.col("raw"))), get), "arxiv", first_page))
    settled = W.accepted(arxiv, refs).where("ok")
    left = keep(left.join(settled, ids, "left_anti"), "left")

    no_doi = left.where("doi is null or doi = ''")
    found = step("crossref", no_doi, lambda rows: _asked(rows, Q.crossref(F.col("raw")), get))
    found = found.select(*ids, F.when(F.col("status") == 200, W.crossref_doi(F.col("body").cast("string"))).alias("crossref_doi"))
    left = keep(left.join(found, ids, "left").select(*ids, F.coalesce(F.nullif("doi", F.lit("")), "crossref_doi").alias("asked")).where("asked is not null"), "asked")

    lookups, downloads = [], [arxiv]
    for source, url, pdf in (
        ("unpaywall", Q.unpaywall(F.col("asked"), email), W.unpaywall_url),
        ("europepmc", Q.by_doi(F.col("asked")), W.epmc_url),
    ):
        answer = step(f"{source}-lookup", left, lambda rows, url=url: _asked(rows, url, get))
        lookups.append(answer.where("error is not null").select(*ids, "error"))
        offers = answer.withColumn("pdf", pdf(F.col("status"), F.col("body").cast("string")))
        got = step(source, offers, lambda rows, source=source: _downloads(_asked(rows, F.col("pdf"), get), source, first_page))
        downloads.append(got)
        # a failed lookup ends a reference's chain, a copy that passes settles it
        left = left.join(W.accepted(got, refs).where("ok"), ids, "left_anti").join(lookups[-1], ids, "left_anti")
    errors = lookups[0].union(lookups[1]).groupBy(*ids).agg(F.min("error").alias("lookup_error"))
    looked = refs.select(*ids).join(found, ids, "left").join(errors, ids, "left")
    return W.resolve(refs, provided, downloads[0].unionByName(downloads[1]).unionByName(downloads[2]), looked)


def scout_papers(papers: DataFrame, refs: DataFrame, get: Get, keep: Keep) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Newer hits, overlooked hits and errors (paper, error) for papers (paper, doi, title).

    A paper whose search fails half-way keeps what it had, in the order found.
    """
    rows = papers.withColumn("ord", F.lit(0))
    answers = []
    for priority, (via, url, left) in enumerate((("doi", Q.by_doi(F.nullif("doi", F.lit(""))), rows), ("title", Q.by_title(F.nullif("title", F.lit(""))), None))):
        left = rows.join(W.resolved_paper(answers[0]), "paper", "left_anti") if left is None else left
        got = keep(_asked(left, url, get), f"paper-{via}")
        answers.append(got.select("paper", F.lit(priority).alias("priority"), F.lit(via).alias("via"), F.col("body").cast("string").alias("body"), "error"))
    both = answers[0].unionByName(answers[1])
    known = keep(W.resolved_paper(both), "papers")
    first = F.get(F.from_json("body", W.EPMC)["resultList"]["result"], F.lit(0))
    identity = both.select("paper", "priority", first.alias("h")).where("h is not null").groupBy("paper").agg(F.min_by("h", "priority").alias("h"))
    cites = keep(_asked(identity.withColumn("ord", F.lit(0)), Q.citing(F.col("h.source"), F.col("h.id")), get), "citing")
    failed = cites.where("error is not null").select("paper", "error")
    search = known.withColumn("ord", F.lit(0)).join(failed, "paper", "left_anti")
    near = keep(_asked(search, Q.search(F.nullif(T.search_query(F.col("paper_title")), F.lit(""))), get), "search")
    found = W.result_rows(cites.withColumn("body", F.col("body").cast("string")), "citing").unionByName(W.result_rows(near.withColumn("body", F.col("body").cast("string")), "search"))
    kept = scout.split_by_year(scout.ordered_dedup(scout.hits(found), known))
    broken = failed.union(near.where("error is not null").select("paper", "error")).union(both.where("error is not null").select("paper", "error").join(known, "paper", "left_anti"))
    lost = papers.select("paper").join(known, "paper", "left_anti").join(broken, "paper", "left_anti").select("paper", F.lit("paper not identified").alias("error"))
    errors = broken.groupBy("paper").agg(F.concat(F.lit("network: "), F.min("error"), F.lit(" — scan incomplete")).alias("error")).union(lost)
    newer = scout.soft_failed(kept.where("newer"), errors.select("paper"), scout.NEWER_CAP)
    overlooked = scout.soft_failed(scout.uncited(kept.where("not newer"), refs), errors.select("paper"), scout.OVERLOOKED_CAP)
    return newer, overlooked, errors
