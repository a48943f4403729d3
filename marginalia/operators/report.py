"""Summaries of an audit, and its report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import judgement as J
from ..functions import text as T
from . import coverage as V

EDITOR_CAPS, TERMINAL_CAPS, CONSOLE_CAP = (10, 8), (8, 6), 5
#: The converter that gives flat text, and what its reports say.
FLAT = "pymupdf"
FLAT_NOTE = "> Flat text: tables are lines and figures are missing, so claims about them may be under-checked."


def verdict_counts(claims: DataFrame) -> DataFrame:
    return claims.groupBy("paper").agg(*J.counts(F.col("verdict"), J.VERDICTS))


def status_counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("paper").agg(*J.counts(F.col("status"), J.STATUSES))


def _available() -> list[Column]:
    return [F.count_if(J.is_available(F.col("status"))).alias("available"), F.count("*").alias("total")]


_SUMMARY = lambda: F.format_string("%d/%d sources available", F.coalesce("available", F.lit(0)), F.coalesce("total", F.lit(0)))


def availability(refs: DataFrame) -> DataFrame:
    """(paper, available, total, summary)."""
    return refs.groupBy("paper").agg(*_available()).withColumn("summary", _SUMMARY())


def available_refs(refs: DataFrame) -> DataFrame:
    return refs.where(J.is_available(F.col("status")))


def checked(claims: DataFrame) -> DataFrame:
    return claims.where(~F.col("verdict").isin(J.GAPS))


def with_evidence(claims: DataFrame) -> DataFrame:
    return checked(claims).where("evidence_image <> ''")


def gaps(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("verdict").isin(J.GAPS))


def gaps_by_section(claims: DataFrame) -> DataFrame:
    """(paper, section, place, items): gaps by section, sections by their first claim, claims in order."""
    rows = gaps(claims).withColumn("section", T.section_key(F.col("location")))
    return rows.groupBy("paper", "section").agg(F.min("id").alias("place"), F.array_sort(F.collect_list(F.struct("id", "claim", "refs", "note"))).alias("items"))


def totals(claims: DataFrame) -> DataFrame:
    """Claims, gaps and evidence images of each paper."""
    return claims.groupBy("paper").agg(F.count("*").alias("claims"), F.count_if(F.col("verdict").isin(J.GAPS)).alias("gap_total"), F.count_if(F.col("evidence_image") != "").alias("crops"))


def register_totals(newer: DataFrame, overlooked: DataFrame) -> DataFrame:
    """Hits of either register, papers with neither left out."""
    rows = newer.select("paper", F.lit(1).alias("newer"), F.lit(0).alias("overlooked")).union(overlooked.select("paper", F.lit(0), F.lit(1)))
    return rows.groupBy("paper").agg(F.sum("newer").alias("newer"), F.sum("overlooked").alias("overlooked"))


def shown(rows: DataFrame, order: str, cap: int) -> DataFrame:
    """(paper, shown, more): how many rows of a list appear under a cap, and how many are left to the line of the rest."""
    n = rows.groupBy("paper").agg(F.count(order).alias("n"))
    return n.select("paper", F.least("n", F.lit(cap)).cast("long").alias("shown"), F.greatest(F.col("n") - cap, F.lit(0)).cast("long").alias("more"))


def _manifest_line() -> Column:
    return F.concat(F.lit("| "), F.col("num"), F.lit(" | "), T.shorten(F.col("raw"), 80), F.lit(" | "), F.col("status"), F.lit(" | "), F.coalesce("resolver", F.lit("—")), F.lit(" | "), F.coalesce("reason", F.lit("")), F.lit(" |"))


def manifest_rows(refs: DataFrame) -> DataFrame:
    """Lines of the retrieval table."""
    return refs.select("paper", "ord", _manifest_line().alias("line"))


def hit_rows(hits: DataFrame, via: bool = True) -> DataFrame:
    """Lines of a register's table; ``via``: with how each hit was found."""
    cut = lambda c, n: F.left(c, F.lit(n))
    year = F.coalesce(F.nullif("year", F.lit(0)).cast("string"), F.lit("?"))
    doi = F.coalesce(F.nullif("doi", F.lit("")), F.lit("—"))
    line = F.concat(F.lit("| "), year, F.lit(" | "), cut("title", 90), F.lit(" | "), cut("journal", 30), F.lit(" | "), *([F.col("via"), F.lit(" | ")] if via else []), doi, F.lit(" |"))
    return hits.select("paper", "ord", line.alias("line"))


def coverage_text() -> Column:
    """One sentence on a paper's labels, null where there is no text."""
    n, missing = F.size("labels_in_text"), F.size("missing")
    return (
        F.when(F.col("labels_in_text").isNull(), F.lit(None).cast("string"))
        .when(missing > 0, F.format_string("%d/%d labels covered — unaddressed: [%s]", F.size("covered"), n, F.array_join("missing", "], [")))
        .when(n > 0, F.format_string("all %d citation labels covered", n))
        .otherwise("no numbered citation markers found; coverage not audited")
    )


def with_coverage(rows: DataFrame, coverage: DataFrame, *columns: str) -> DataFrame:
    """Rows (paper, cited, …) with the labels of their papers' texts, null where there is no text.

    coverage: of ``coverage.coverage_audit``, or (paper, labels_in_text) alone:
    then the labels that the rows cite, gathered with them, tell it.
    """
    if "missing" in coverage.columns:
        return rows.join(coverage.select("paper", "labels_in_text", "covered", "missing"), "paper", "left").drop("cited")
    rows = rows.join(coverage.select("paper", "labels_in_text"), "paper", "left")
    return rows.withColumns(V.parted(F.col("labels_in_text"), F.col("cited"))).drop("cited")


def own_totals() -> list[Column]:
    """Aggregates of a paper's claims: verdicts, claims, gaps, evidence images and the labels they cite."""
    return [*J.counts(F.col("verdict"), J.VERDICTS), F.count("*").alias("claims"), F.count_if(F.col("verdict").isin(J.GAPS)).alias("gap_total"), F.count_if(F.col("evidence_image") != "").alias("crops"), V.cited().alias("cited")]


def in_order(kept: Column, *fields: str | Column) -> Column:
    """Aggregate: structs of the rows that are kept, in order."""
    return F.array_sort(F.collect_list(F.when(kept, F.struct(*fields))))


def told(rows: Column, line: str) -> Column:
    """The lines of gathered rows as one text."""
    return F.array_join(F.transform(rows, lambda r: r[line]), "\n")


def coverage_line(coverage: DataFrame) -> DataFrame:
    """One sentence on coverage, honest about texts that could not be audited."""
    return coverage.select("paper", coverage_text().alias("coverage"))


def _claim_section() -> Column:
    cites = F.when(F.size("refs") > 0, F.concat(F.lit(" · cites ["), F.array_join("refs", ", "), F.lit("]"))).otherwise("")
    source = F.when(F.col("source_slug") != "", F.concat(F.lit("\n### Evidence from: `"), F.col("source_slug"), F.lit("`\n- **Source:** Page "), F.coalesce(F.col("source_page").cast("string"), F.lit("?")), F.coalesce(F.concat(F.lit(" `("), F.nullif("source_block", F.lit("")), F.lit(")`")), F.lit("")))).otherwise("")
    image = F.when(F.col("evidence_image") != "", F.concat(F.lit("\n![evidence]("), F.col("evidence_image"), F.lit(")"))).otherwise("")
    note = F.when(F.col("note") != "", F.concat(F.lit("\n> "), F.col("note"))).otherwise("")
    return F.concat(F.lit("## Claim "), F.col("id").cast("string"), F.lit(': "'), F.col("claim"), F.lit('"\n**Status:** '), J.verdict_label(F.col("verdict")), F.lit("\n**Location:** "), F.col("location"), cites, F.coalesce(source, F.lit("")), F.coalesce(image, F.lit("")), F.coalesce(note, F.lit("")))


def claim_sections(claims: DataFrame) -> DataFrame:
    """The report's section of each checked claim."""
    return checked(claims).select("paper", "id", _claim_section().alias("section"))


def ordered_lines(rows: DataFrame, order: str, line: str) -> DataFrame:
    """(paper, text): a paper's lines, in order."""
    whole = rows.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct(order, line))).alias("r"))
    return whole.select("paper", F.array_join(f"r.{line}", "\n").alias("text"))


def console(claims: DataFrame, refs: DataFrame, coverage: DataFrame) -> DataFrame:
    """(paper, summary): what is said of each paper while it is audited: sources, statuses, verdicts, crops, coverage, and the first claims.

    coverage: as of ``with_coverage``.
    """
    count = lambda names: F.concat_ws(" | ", *(F.concat(F.lit(f"{n}: "), F.coalesce(n, F.lit(0)).cast("string")) for n in names))
    own = claims.groupBy("paper").agg(*own_totals(), F.slice(F.array_sort(F.collect_list(F.struct("id", "claim"))), 1, CONSOLE_CAP).alias("l"))
    listed = F.transform("l", lambda c: F.concat(F.lit("  "), c["id"].cast("string"), F.lit(". "), c["claim"]))
    more = F.when(F.col("claims") > CONSOLE_CAP, F.format_string("  … %d more", F.col("claims") - CONSOLE_CAP))
    rows = refs.groupBy("paper").agg(*_available(), *J.counts(F.col("status"), J.STATUSES)).join(own, "paper", "left")
    rows = with_coverage(rows, coverage)
    crops = F.concat(F.coalesce("crops", F.lit(0)).cast("string"), F.lit(" evidence crops"))
    parts = [_SUMMARY(), count(J.STATUSES), count(J.VERDICTS), crops, F.concat(F.lit("coverage: "), coverage_text()), F.array_join(listed, "\n"), more]
    return rows.select("paper", F.concat_ws("\n", *parts).alias("summary"))


def flat_text(converter: Column) -> Column:
    """Whether a converter gives flat text, which a report has to say."""
    return converter == FLAT


def _listed(lines: DataFrame, name: str, title: str) -> DataFrame:
    """(paper, name): lines (paper, ord, line) in order under a title that counts them."""
    whole = lines.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("r"))
    head = F.concat(F.lit(f"{title} ("), F.size("r").cast("string"), F.lit(")\n"))
    return whole.select("paper", F.concat(head, F.array_join("r.line", "\n")).alias(name))


def _uncited_line() -> Column:
    place = F.when(F.col("location") != "", F.concat(F.lit(" *("), F.col("location"), F.lit(")*"))).otherwise("")
    return F.concat(F.lit("- **[U"), F.col("id").cast("string"), F.lit("]** "), F.col("claim"), F.coalesce(place, F.lit("")))


#: Title of the assertions that carry no reference.
UNCITED = "## Assertions without citation"


def uncited_section(uncited: DataFrame) -> DataFrame:
    """(paper, uncited): assertions that carry no reference; uncited: paper, id, claim, location."""
    return _listed(uncited.select("paper", F.col("id").alias("ord"), _uncited_line().alias("line")), "uncited", UNCITED)


def scout_section(newer: DataFrame, overlooked: DataFrame, scouted: DataFrame) -> DataFrame:
    """(paper, scout): what lies around each paper, for papers with a hit or an error.

    Hits carry ``rank``; scouted: paper, paper_title, paper_year, paper_doi,
    resolved_via, query, error, null where unknown.
    """
    rows = scouted
    for hits, name, title, via in ((newer, "newer", "### Published since", True), (overlooked, "overlooked", "### Existed but uncited", False)):
        rows = rows.join(_listed(hit_rows(hits.withColumn("ord", F.col("rank")), via), name, title), "paper", "full_outer")
    rows = rows.where("newer is not null or overlooked is not null or error <> ''")
    known = F.concat(F.lit("Identified as *"), F.col("paper_title"), F.lit("* ("), F.coalesce(F.nullif("paper_year", F.lit(0)).cast("string"), F.lit("year?")), F.coalesce(F.concat(F.lit(" · `"), F.nullif("paper_doi", F.lit("")), F.lit("`")), F.lit("")), F.lit(") by its "), F.col("resolved_via"))
    failed = F.concat(F.lit("> Scan incomplete: "), F.nullif("error", F.lit("")))
    asked = F.concat(F.lit("Query: `"), F.nullif("query", F.lit("")), F.lit("`"))
    return rows.select("paper", F.concat_ws("\n", F.lit("## Around the paper"), known, failed, "newer", "overlooked", asked).alias("scout"))


def report(claims: DataFrame, refs: DataFrame, coverage: DataFrame, runs: DataFrame | None = None, uncited: DataFrame | Column | None = None, scout: DataFrame | None = None) -> DataFrame:
    """(paper, report): the report of every paper as markdown.

    coverage: as of ``with_coverage``; runs: paper, checker, date, manuscript,
    converter; uncited: as of ``uncited_section``, or which of the claims they
    are; scout: (paper, scout) of ``scout_section``.  A part without a row for a
    paper is left out of its report.
    """
    # a paper's claims and its references are gathered each by itself, where they lie, and meet last
    is_gap = F.col("verdict").isin(J.GAPS)
    mine = claims.withColumns({"line": F.when(~is_gap, _claim_section()), "section": T.section_key(F.col("location"))})
    lists = [in_order(F.col("line").isNotNull(), "id", "line").alias("claim_lines"), in_order(is_gap, "id", "section", "claim", "refs", "note").alias("items")]
    if isinstance(uncited, Column):
        mine = mine.withColumn("stated", F.when(uncited, _uncited_line()))
        lists.append(in_order(F.col("stated").isNotNull(), F.col("id").cast("long").alias("id"), F.col("stated").alias("line")).alias("own_uncited"))
    mine = mine.groupBy("paper").agg(*own_totals(), *lists)
    if not isinstance(uncited, Column):
        mine = mine.withColumn("own_uncited", F.lit(None).cast("array<struct<id:bigint,line:string>>"))
    listed = refs.select("paper", "ord", "status", _manifest_line().alias("line")).groupBy("paper").agg(*_available(), in_order(F.col("line").isNotNull(), "ord", "line").alias("ref_lines"))
    around = _around(coverage, runs, None if isinstance(uncited, Column) else uncited, scout)
    names = [c for c in around.columns if c != "paper"]
    both = [side.join(around, "paper", "left").withColumnsRenamed({n: f"{n}_{k}" for n in names}) for k, side in enumerate((mine, listed))]
    whole = both[0].join(both[1], "paper", "full_outer").withColumns({n: F.coalesce(f"{n}_0", f"{n}_1") for n in names})
    if "missing" not in names:
        whole = whole.withColumns(V.parted(F.col("labels_in_text"), F.col("cited")))

    count = lambda name: F.concat(F.lit(f"{name}: "), F.coalesce(name, F.lit(0)).cast("string"))
    top = F.concat_ws("\n", F.lit("# Audit report"), "run", F.concat(F.lit("Sources: "), _SUMMARY()), F.concat_ws(" | ", *map(count, J.VERDICTS)), F.concat(F.lit("Citation coverage: "), F.coalesce(coverage_text(), F.lit("not audited"))), "flat")
    text = lambda rows: F.when(F.size(rows) > 0, told(rows, "line"))
    assertions = F.coalesce("own_uncited", "uncited")
    stated = F.concat(F.lit(f"{UNCITED} ("), F.size(assertions).cast("string"), F.lit(")\n"), text(assertions))
    return whole.select("paper", F.concat_ws("\n\n", top, text(F.col("claim_lines")), F.concat(F.lit("## Not verified\n"), _gap_lines(F.col("items"))), stated, "scout", F.concat(F.lit("## Retrieval\n"), text(F.col("ref_lines")))).alias("report"))


def _around(coverage: DataFrame, runs: DataFrame | None, uncited: DataFrame | None, scout: DataFrame | None) -> DataFrame:
    """(paper, …) what reports tell beside claims and references, a row a paper."""
    labels = [c for c in ("labels_in_text", "covered", "missing") if c in coverage.columns]
    kinds = dict.fromkeys(labels, "array<string>") | {"run": "string", "flat": "string", "scout": "string", "uncited": "array<struct<id:bigint,line:string>>"}

    def part(rows: DataFrame, **given: Column) -> DataFrame:
        return rows.select("paper", *(given.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()))

    parts = [part(coverage, **{c: F.col(c) for c in labels})]
    if runs is not None:
        who = F.concat(F.lit("Checker: "), F.col("checker"), F.lit(" · "), F.col("date").cast("string"), F.lit("\nManuscript: "), F.col("manuscript"))
        parts.append(part(runs, run=who, flat=F.when(flat_text(F.col("converter")), FLAT_NOTE)))
    if uncited is not None:
        lines = uncited.select("paper", "id", _uncited_line().alias("line")).groupBy("paper").agg(in_order(F.col("line").isNotNull(), "id", "line").alias("l"))
        parts.append(part(lines, uncited=F.col("l")))
    if scout is not None:
        parts.append(part(scout, scout=F.col("scout")))
    return reduce(DataFrame.unionByName, parts).groupBy("paper").agg(*(F.max(n).alias(n) for n in kinds))


def _gap_lines(items: Column) -> Column:
    """Gaps by section, sections by their first claim; null where there are none."""
    shown = lambda i: F.concat(F.lit("  - ["), F.array_join(i["refs"], ", "), F.lit("] "), i["claim"], F.when(i["note"] != "", F.concat(F.lit(" — *"), i["note"], F.lit("*"))).otherwise(""))

    def section(name: Column) -> Column:
        own = F.filter(items, lambda i: i["section"] == name)
        line = F.concat_ws("\n", F.concat(F.lit("- **"), name, F.lit("** ("), F.size(own).cast("string"), F.lit("):")), F.array_join(F.transform(own, shown), "\n"))
        return F.struct(F.array_min(F.transform(own, lambda i: i["id"])).alias("place"), line.alias("line"))

    sections = F.transform(F.array_distinct(F.transform(items, lambda i: i["section"])), section)
    return F.when(F.size(items) > 0, F.array_join(F.transform(F.array_sort(sections), lambda r: r["line"]), "\n"))
