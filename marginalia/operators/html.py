"""Web pages of an audit in two looks, which differ in style and in how many hits they list."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import judgement as J
from ..functions import text as T
from . import report as P

#: Style of each look, and how many newer and overlooked hits it lists.
LOOKS = {
    "editor": ("body{font:16px serif;max-width:46em;margin:auto}", dict(zip(("newer", "overlooked"), P.EDITOR_CAPS))),
    "terminal": ("body{font:14px monospace;background:#111;color:#ddd}", dict(zip(("newer", "overlooked"), P.TERMINAL_CAPS))),
}


def escaped(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _tag(name: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))


def gap_rows(claims: DataFrame) -> DataFrame:
    """(paper, place, section, state, n, claims) of the gap table; a section goes by its first claim's verdict."""
    rows = P.gaps(claims).withColumn("section", T.section_key(F.col("location")))
    first = F.replace(F.min_by("verdict", "id"), F.lit("_"), F.lit(" "))
    listed = F.array_sort(F.collect_list(F.struct("id", "claim")))
    whole = rows.groupBy("paper", "section").agg(F.min("id").alias("place"), first.alias("state"), F.count("*").alias("n"), listed.alias("l"))
    return whole.select("paper", "place", "section", "state", "n", F.array_join("l.claim", " · ").alias("claims"))


def _gap_table(items: Column) -> Column:
    """Lines of the gap table from a paper's gaps (id, claim, verdict, section) in order; as ``gap_rows``, in one row."""

    def section(name: Column) -> Column:
        own = F.filter(items, lambda i: i["section"] == name)
        state = F.replace(F.get(own, F.lit(0))["verdict"], F.lit("_"), F.lit(" "))
        listed = F.array_join(F.transform(own, lambda i: i["claim"]), " · ")
        line = _tag("tr", _tag("td", escaped(name)), _tag("td", state, F.lit(" · "), F.size(own).cast("string")), _tag("td", escaped(listed)))
        return F.struct(F.get(own, F.lit(0))["id"].alias("place"), line.alias("line"))

    sections = F.transform(F.array_distinct(F.transform(items, lambda i: i["section"])), section)
    return P.told(F.array_sort(sections), "line")


def _hits(rows: DataFrame, name: str) -> DataFrame:
    """(paper, name, name_n): lines of a register up to the larger cap, and how many hits there are."""
    cap = max(caps[name] for _, caps in LOOKS.values())
    year = F.coalesce(F.nullif("year", F.lit(0)).cast("string"), F.lit("?"))
    more = lambda c: F.when(F.col(c) != "", F.concat(F.lit(" · "), escaped(F.col(c)))).otherwise("")
    line = _tag("tr", _tag("td", F.lit(f"{name} · "), year), _tag("td", F.col("via") if name == "newer" else F.lit("existed at publication")), _tag("td", escaped(F.col("title")), more("journal"), more("doi")))
    return rows.select("paper", "rank", line.alias("line")).groupBy("paper").agg(P.in_order(F.col("rank") <= cap, "rank", "line").alias(name), F.max("rank").alias(f"{name}_n"))


def pages(claims: DataFrame, uncited: DataFrame | Column, coverage: DataFrame, newer: DataFrame, overlooked: DataFrame, look: str, runs: DataFrame | None = None, sources: DataFrame | None = None, scouted: DataFrame | None = None) -> DataFrame:
    """(paper, html): a page for every paper with claims; newer and overlooked carry their ``rank``.

    uncited: assertions that carry no reference, or which of the claims they are;
    coverage: as of ``report.with_coverage``; runs: paper, checker, date,
    converter; sources: (paper, summary) of ``report.availability``; scouted:
    (paper, error) of the search around it.
    """
    return all_pages(claims, uncited, coverage, newer, overlooked, (look,), runs, sources, scouted).select("paper", "html")


def all_pages(claims: DataFrame, uncited: DataFrame | Column, coverage: DataFrame, newer: DataFrame, overlooked: DataFrame, looks: tuple[str, ...] = tuple(LOOKS), runs: DataFrame | None = None, sources: DataFrame | None = None, scouted: DataFrame | None = None) -> DataFrame:
    """(paper, look, html): ``pages`` in several looks, which are made of the same rows, gathered once."""
    image = F.when(F.col("evidence_image") != "", F.concat(F.lit('<img src="'), escaped(F.col("evidence_image")), F.lit('">'))).otherwise("")
    source = F.when(F.col("source_slug") != "", _tag("h3", F.lit("Evidence from: "), escaped(F.col("source_slug")), F.lit(" · page "), F.coalesce(F.col("source_page").cast("string"), F.lit("?")))).otherwise("")
    claim = F.concat(_tag("h2", F.lit("Claim "), F.col("id").cast("string"), F.lit(": “"), escaped(F.col("claim")), F.lit("”")), _tag("p", J.verdict_label(F.col("verdict"))), F.coalesce(source, F.lit("")), F.coalesce(image, F.lit("")), F.when(F.col("note") != "", _tag("p", escaped(F.col("note")))).otherwise(""))
    place = F.when(F.col("location") != "", F.concat(F.lit(" ("), escaped(F.col("location")), F.lit(")"))).otherwise("")
    stated = _tag("li", F.lit("[U"), F.col("id").cast("string"), F.lit("] "), escaped(F.col("claim")), place)
    is_gap = F.col("verdict").isin(J.GAPS)
    rows = claims.withColumns({"line": F.when(~is_gap, claim), "section": T.section_key(F.col("location"))})
    lists = [P.in_order(F.col("line").isNotNull(), "id", "line").alias("checked"), P.in_order(is_gap, "id", "claim", "verdict", "section").alias("gaps")]
    if isinstance(uncited, Column):
        rows = rows.withColumn("stated_line", F.when(uncited, stated))
        lists.append(P.in_order(F.col("stated_line").isNotNull(), "id", F.col("stated_line").alias("line")).alias("stated"))
    rows = rows.groupBy("paper").agg(*P.own_totals(), *lists)
    if not isinstance(uncited, Column):
        other = uncited.select("paper", "id", stated.alias("line")).groupBy("paper").agg(P.in_order(F.col("line").isNotNull(), "id", "line").alias("stated"))
        rows = rows.join(other, "paper", "left")
    rows = P.with_coverage(rows, coverage)
    for part, names in ((runs, ("checker", "date", "converter")), (sources, ("summary",)), (scouted, ("error",))):
        rows = rows.withColumns({n: F.lit(None).cast("string") for n in names}) if part is None else rows.join(part.select("paper", *names), "paper", "left")
    for name, hits in (("newer", newer), ("overlooked", overlooked)):
        rows = rows.join(_hits(hits, name), "paper", "left")
    told = lambda tag, *parts: F.coalesce(_tag(tag, *parts), F.lit(""))
    some = lambda name, *around: F.when(F.size(name) > 0, F.concat(F.lit(around[0]), _gap_table(F.col(name)) if name == "gaps" else P.told(F.col(name), "line"), F.lit(around[1]))).otherwise("")
    counts = F.concat_ws(" | ", *(F.concat(F.lit(f"{v.replace('_', ' ')}: "), F.col(v).cast("string")) for v in J.VERDICTS))
    above = F.concat(
        _tag("h1", F.lit("Audit report")),
        told("p", F.lit("Checker: "), F.when(F.col("checker") != "", escaped(F.col("checker"))), F.lit(" · "), F.col("date").cast("string")),
        told("p", F.lit("Sources: "), F.col("summary")),
        F.when(P.flat_text(F.col("converter")), _tag("blockquote", escaped(F.lit(P.FLAT_NOTE[2:])))).otherwise(""),
        _tag("p", counts),
        _tag("p", F.lit("Citation coverage: "), escaped(F.coalesce(P.coverage_text(), F.lit("not audited")))),
        F.coalesce(P.told(F.col("checked"), "line"), F.lit("")),
        some("stated", "<h2>Assertions without citation</h2><ul>", "</ul>"),
        _tag("h2", F.lit("Not verified ("), F.col("gap_total").cast("string"), F.lit(" of "), F.col("claims").cast("string"), F.lit(")")),
        some("gaps", "<table>", "</table>"),
    )
    failed = F.when(F.col("error") != "", _tag("p", F.lit("Scan incomplete: "), escaped(F.col("error")))).otherwise("")
    rows = rows.select("paper", above.alias("above"), failed.alias("failed"), "newer", "newer_n", "overlooked", "overlooked_n")
    each = F.array(*(F.struct(F.lit(look).alias("look"), _page(look).alias("html")) for look in looks))
    return rows.select("paper", F.inline(each))


def _page(look: str) -> Column:
    """The page of a row of parts in a look."""
    style, caps = LOOKS[look]
    first = lambda name, cap: F.filter(name, lambda r: r["rank"] <= cap)
    hits = F.concat(*(F.coalesce(P.told(first(name, cap), "line"), F.lit("")) for name, cap in caps.items()))
    more = reduce(or_, (F.coalesce(F.col(f"{name}_n") > cap, F.lit(False)) for name, cap in caps.items()))
    known = F.when(hits != "", F.concat(F.lit("<h2>What the reference list does not know</h2><table>"), hits, F.lit("</table>"))).otherwise("")
    rest = F.when(more, F.lit("<p>Full lists in scout.json.</p>")).otherwise("")
    return F.concat(F.lit(f"<!DOCTYPE html><html><head><meta charset=utf-8><style>{style}</style></head><body>"), "above", known, rest, "failed", F.lit("</body></html>"))
