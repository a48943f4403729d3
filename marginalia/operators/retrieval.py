"""How each reference was or was not obtained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MIN_TOKEN = 3  #: shorter tokens of a slug do not tell a file
PDF = b"%PDF"
CROSSREF = "struct<message:struct<items:array<struct<DOI:string>>>>"
UNPAYWALL = "struct<best_oa_location:struct<url_for_pdf:string>>"
EPMC = "struct<resultList:struct<result:array<struct<id:string,source:string,doi:string,title:string,pubYear:string,pmcid:string,journalTitle:string,journalAbbreviation:string,authorString:string>>>>"
CITATIONS = "struct<citationList:struct<citation:array<struct<id:string,source:string,doi:string,title:string,pubYear:string,journalTitle:string,journalAbbreviation:string,authorString:string>>>>"


def crossref_doi(body: Column) -> Column:
    return F.get(F.from_json(body, CROSSREF)["message"]["items"], F.lit(0))["DOI"]


def unpaywall_url(status: Column, body: Column) -> Column:
    return F.when(status == 200, F.from_json(body, UNPAYWALL)["best_oa_location"]["url_for_pdf"])


def epmc_url(status: Column, body: Column) -> Column:
    """The address of the first hit's full text."""
    pmcid = F.nullif(F.get(F.from_json(body, EPMC)["resultList"]["result"], F.lit(0))["pmcid"], F.lit(""))
    return F.when(status == 200, F.concat(F.lit("https://europepmc.org/backend/ptpmcrender.fcgi?accid="), pmcid, F.lit("&blobtype=pdf")))


def is_pdf(status: Column, content: Column) -> Column:
    return F.coalesce((status == 200) & (F.substring(content, 1, 4) == F.lit(PDF)), F.lit(False))


def result_rows(responses: DataFrame, via: str) -> DataFrame:
    """(paper, ord, via, …) of the results in search or citation answers (paper, status, body)."""
    good = F.col("status") == 200
    each = F.from_json("body", CITATIONS)["citationList"]["citation"] if via == "citing" else F.from_json("body", EPMC)["resultList"]["result"]
    rows = responses.where(good).select("paper", F.posexplode(each).alias("ord", "r"))
    return rows.select("paper", "ord", F.lit(via).alias("via"), F.col("r.title").alias("title"), F.col("r.pubYear").alias("pub_year"), F.col("r.doi").alias("doi"), F.col("r.journalTitle").alias("journal"), F.col("r.journalAbbreviation").alias("abbreviation"), F.col("r.authorString").alias("authors"))


def resolved_paper(answers: DataFrame) -> DataFrame:
    """The first answer with a hit, DOI before title; answers: paper, priority, via, body."""
    hit = F.get(F.from_json("body", EPMC)["resultList"]["result"], F.lit(0))
    rows = answers.select("paper", "priority", "via", hit.alias("h")).where("h is not null")
    best = rows.groupBy("paper").agg(F.min_by(F.struct("via", "h"), "priority").alias("b"))
    return best.select("paper", T.hit_title(F.col("b.h.title")).alias("paper_title"), F.lower(F.coalesce("b.h.doi", F.lit(""))).alias("paper_doi"), T.year_number(F.col("b.h.pubYear")).alias("paper_year"), F.col("b.via").alias("resolved_via"))


def match_provided(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(paper, ord, num, slug, file): the first file by name that holds all longer tokens of a slug.

    A file can only match a slug whose longer tokens it holds, the first of them
    among others, so names are cut into pieces as long as its beginning: an
    equi-join on (paper, piece) finds candidates, and the rest is a filter.  The files of
    a paper are few, those of all papers need not be.
    """
    width = MIN_TOKEN + 1
    tokens = F.filter(F.split("slug", "-"), lambda t: F.length(t) > MIN_TOKEN)
    wanted = refs.select("paper", "ord", "num", "slug", tokens.alias("tokens")).where(F.size("tokens") > 0)
    wanted = wanted.withColumn("piece", F.left(F.get("tokens", F.lit(0)), F.lit(width)))
    name = F.lower("name")
    starts = F.sequence(F.lit(1), F.length("name") - width + 1)
    pieces = F.array_distinct(F.transform(starts, lambda i: name.substr(i, F.lit(width))))
    held = files.where(F.length("name") >= width).select("paper", F.col("name").alias("file"), name.alias("lower_name"), F.explode(pieces).alias("piece"))
    # a merge: names make many pieces, so the files' size says little of what a broadcast would hold
    rows = wanted.join(held.hint("merge"), ["paper", "piece"]).where(F.forall("tokens", lambda t: F.contains(F.col("lower_name"), t)))
    return rows.groupBy("paper", "ord", "num", "slug").agg(F.min("file").alias("file"))


def accepted(responses: DataFrame, refs: DataFrame) -> DataFrame:
    """``ok, mismatch`` of each download; responses: paper, ord, source, http_status, is_pdf, first_page, error."""
    rows = responses.join(refs.select("paper", "ord", "raw").hint("merge"), ["paper", "ord"])
    got = F.coalesce((F.col("http_status") == 200) & F.col("is_pdf"), F.lit(False))
    detail = T.title_check(F.col("raw"), F.col("first_page"))
    reason = F.concat(F.lit("retrieved PDF looks like a different paper ("), detail, F.lit(") — wrong or mistyped DOI in the reference? Drop the correct copy into sources/"))
    return rows.select("paper", "ord", "source", (got & detail.isNull()).alias("ok"), F.when(got, reason).alias("mismatch"))


def resolve(refs: DataFrame, provided: DataFrame, downloads: DataFrame, lookups: DataFrame) -> DataFrame:
    """(paper, ord, doi, status, resolver, reason) of every reference.

    provided: paper, ord, file.  downloads: as of ``accepted``.  lookups:
    paper, ord, crossref_doi, lookup_error (of the open-access services).  A
    file of the user's comes first, then arXiv, then by DOI Unpaywall and
    Europe PMC.  A wrong paper is noted and the chain goes on; without a DOI in
    the text or from Crossref it ends.
    """
    shape = accepted(downloads, refs).groupBy("paper", "ord").agg(
        *(F.bool_or(F.when(F.col("source") == s, F.col("ok"))).alias(f"{s}_ok") for s in ("arxiv", "unpaywall", "europepmc")),
        *(F.max(F.when(F.col("source") == s, F.col("mismatch"))).alias(f"{s}_mismatch") for s in ("arxiv", "unpaywall", "europepmc")),
    )
    rows = refs.select("paper", "ord", F.col("doi").alias("text_doi")).join(provided.select("paper", "ord", "file"), ["paper", "ord"], "left")
    rows = rows.join(shape, ["paper", "ord"], "left").join(lookups, ["paper", "ord"], "left")
    yes = lambda s: F.coalesce(f"{s}_ok", F.lit(False))
    doi = F.coalesce(F.nullif("text_doi", F.lit("")), F.nullif("crossref_doi", F.lit("")))
    mine, arxiv = F.col("file").isNotNull(), yes("arxiv")
    wrong = F.coalesce("europepmc_mismatch", "unpaywall_mismatch", "arxiv_mismatch")
    from_crossref = F.nullif("text_doi", F.lit("")).isNull() & doi.isNotNull()
    chain = lambda *values: (
        F.when(mine, values[0]).when(arxiv, values[1]).when(doi.isNull(), values[2]).when(yes("unpaywall"), values[3]).when(yes("europepmc"), values[4])
        .when(F.col("lookup_error").isNotNull(), values[5]).when(wrong.isNotNull(), values[6]).otherwise(values[7])
    )
    text = lambda *values: chain(*map(F.lit, values))
    looked_up = F.when(from_crossref, F.lit("crossref"))
    return rows.select(
        "paper",
        "ord",
        F.when(mine | arxiv, F.nullif("text_doi", F.lit(""))).otherwise(doi).alias("doi"),
        text("provided", "retrieved", "no_doi", "retrieved", "retrieved", "error", "mismatch", "paywalled").alias("status"),
        chain(F.lit("user"), F.lit("arxiv"), F.lit(None), F.lit("unpaywall"), F.lit("europepmc"), looked_up, looked_up, looked_up).alias("resolver"),
        chain(
            F.concat(F.lit("matched "), F.col("file"), F.lit(" in your sources folder")),
            F.lit("arXiv"),
            F.lit("no DOI found in text or via Crossref"),
            F.lit("open-access copy via Unpaywall"),
            F.lit("open-access copy via Europe PMC"),
            F.concat(F.lit("network: "), F.col("lookup_error")),
            wrong,
            F.lit("DOI resolved but no legal open-access copy found"),
        ).alias("reason"),
    )
