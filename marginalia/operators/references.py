"""Reference lists: from blocks of a paper to numbered entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources import seams

#: Cuts rows off from how they were made: a table in, the same table read back from storage.
Keep = Callable[[DataFrame], DataFrame]

SECTION = r"(?i)^(references|bibliography|literature)\b"
MARKER = r"(?U)^\s*\[?(\d{1,3})[\].:]?\s+"
BULLET = r"^[-•*] "
_ENTRY, _TEXT = "\x1e", "\x1f"  # fences of the fold's output


def references_section(blocks: DataFrame) -> DataFrame:
    """(paper, section): text of the blocks after the first matching heading, up to the next."""
    header = F.col("type") == "sectionheader"
    number = F.count_if(header).over(Window.partitionBy("paper").orderBy("seq"))
    rows = blocks.select("paper", "seq", "text", header.alias("header"), number.alias("part"))
    matching = F.when(F.col("header") & F.trim("text").rlike(SECTION), F.col("part"))
    first = F.min(matching).over(Window.partitionBy("paper"))
    inside = rows.withColumn("wanted", first).where(~F.col("header") & (F.col("part") == F.col("wanted")))
    return inside.groupBy("paper").agg(_joined("seq", "text").alias("section"))


def _joined(order: str, text: str, sep: str = "\n") -> Column:
    rows = F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), sep)


def _lines(section: Column) -> Column:
    """Lines with their line feeds."""
    return F.split(section, "(?<=\n)")


def _is_blank(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"(?U)\s", "")) == ""


def _is_marker(line: Column, bare: Column) -> Column:
    # the marker of a bare line swallows the indentation of the line after it
    return line.rlike(MARKER) & ~(bare & line.rlike(r"(?U)^\s"))


def _bare_after(line: Column, bare: Column) -> Column:
    return F.when(_is_marker(line, bare), F.regexp_replace(line, MARKER, "") == "").otherwise(bare & _is_blank(line))


def _number(line: Column) -> Column:
    return F.coalesce(F.regexp_extract(line, MARKER, 1).try_cast("int"), F.lit(-1))


def _walk(lines: Column, next_: Column, bare: Column) -> Column:
    """Pieces of text: first what belongs to the entry before, then ``num _TEXT text`` of each that opens."""

    def step(acc: Column, line: Column) -> Column:
        opens = _is_marker(line, acc["bare"]) & (_number(line) == acc["next"])
        opened = F.concat(acc["out"], F.lit(_ENTRY), acc["next"].cast("string"), F.lit(_TEXT), F.regexp_replace(line, MARKER, ""))
        out = F.when(opens, opened).when(acc["next"] > 1, F.concat(acc["out"], line)).otherwise(acc["out"])
        return F.struct(F.when(opens, acc["next"] + 1).otherwise(acc["next"]).alias("next"), _bare_after(line, acc["bare"]).alias("bare"), out.alias("out"))

    start = F.struct(next_.alias("next"), bare.alias("bare"), F.lit("").alias("out"))
    return F.aggregate(lines, start, step, lambda acc: F.split(acc["out"], _ENTRY))


def _opened(pieces: Column, entry: Callable[[Column, Column], Column]) -> Column:
    """Entries of all pieces but the first, those without text left out."""
    each = F.transform(pieces, lambda e, k: F.when(k > 0, entry(e, k)))
    return F.filter(each, lambda e: e["raw"] != "")


def numbered_entries(section: Column) -> Column:
    """``array<struct<num, raw>>`` of entries numbered 1, 2, 3, … in text order.

    Only the next expected number opens an entry; any other marker, and what
    comes before the first, is text.  A fold over the lines, because whether a
    line opens an entry depends on all before it; for sections of some hundred
    lines, as the text is copied at each (``numbered_rows`` takes any).
    """
    pieces = _walk(_lines(section), F.lit(1), F.lit(False))
    return _opened(pieces, lambda e, k: F.struct(F.substring_index(e, _TEXT, 1).alias("num"), T.squeeze(F.substring_index(e, _TEXT, -1)).alias("raw")))


def _bullet_lines(section: Column) -> Column:
    return F.filter(F.transform(F.split(section, r"\r\n|[\n\r\x0b\x0c]"), lambda x: F.trim(x)), lambda x: x != "")


def _bullet_walk(lines: Column, inside: Column) -> Column:
    """Pieces of text as of ``_walk``; inside: whether a bullet came before."""

    def step(acc: Column, line: Column) -> Column:
        item = F.trim(line.substr(F.lit(3), F.length(line)))
        return F.when(line.rlike(BULLET), F.concat(acc, F.lit(_ENTRY), item)).when(inside | acc.contains(_ENTRY), F.concat(acc, F.lit(" "), line)).otherwise(acc)

    return F.aggregate(lines, F.lit(""), step, lambda acc: F.split(acc, _ENTRY))


def bulleted_entries(section: Column) -> Column:
    """The same for lists of bullets: each opens an item, other lines continue it; numbered by position."""
    return _opened(_bullet_walk(_bullet_lines(section), F.lit(False)), lambda e, k: F.struct(k.cast("string").alias("num"), T.squeeze(e).alias("raw")))


# -- sections of any length ------------------------------------------------------
#: Lines that are folded in one go; a longer section is cut into stretches of so many.
STRETCH = 2000


def _is_long(section: Column, stretch: int) -> Column:
    return F.length(section) - F.length(F.replace(section, F.lit("\n"))) >= stretch


def _stretches(sections: DataFrame, lines: Callable[[Column], Column], stretch: int) -> DataFrame:
    """(paper, at, lines): each section's lines by ``stretch``, dealt out."""
    count = lambda v: F.ceil(F.size(v) / stretch).cast("int")
    cut = lambda v: F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.greatest(count(v) - 1, F.lit(0))), lambda k: F.slice(v, k * stretch + 1, stretch)))
    return sections.select("paper", F.posexplode(T.once(lines(F.col("section")), cut)).alias("at", "lines"))


def _before(order: str = "at"):
    return Window.partitionBy("paper").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _with_bare(stretches: DataFrame) -> DataFrame:
    """Stretches with ``bare`` as it is before their first line.

    A stretch maps it to one of two values, whichever it was, or leaves it, or
    turns it: so the last that fixes it and the turns since then tell.
    """
    both = F.aggregate("lines", F.struct(F.lit(False).alias("no"), F.lit(True).alias("yes")), lambda acc, line: F.struct(_bare_after(line, acc["no"]).alias("no"), _bare_after(line, acc["yes"]).alias("yes")))
    rows = stretches.select("paper", "at", both.alias("to")).select("*", (F.col("to.no") & ~F.col("to.yes")).cast("int").alias("turn"))
    rows = rows.withColumn("turns", F.coalesce(F.sum("turn").over(_before()), F.lit(0)))
    fixed = F.when(F.col("to.no") == F.col("to.yes"), F.struct(F.col("to.no").alias("value"), (F.col("turns") + F.col("turn")).alias("turns")))
    rows = rows.withColumn("fixed", F.last(fixed, ignorenulls=True).over(_before()))
    odd = (F.col("turns") - F.coalesce("fixed.turns", F.lit(0))) % 2 == 1
    # the lines themselves are dealt by stretch, not by paper
    return stretches.join(rows.select("paper", "at", (F.coalesce("fixed.value", F.lit(False)) != odd).alias("bare")), ["paper", "at"])


def _followed(links: DataFrame, first: DataFrame, keep: Keep) -> DataFrame:
    """(paper, at, e) of all nodes that lead on from ``first``; links: paper, at, e, to_at, to_e.

    Each round goes twice as far as the one before: what was reached is led on
    by links of so many steps, and these are joined to themselves.
    """
    ids = ["paper", "at", "e"]
    reached, links = keep(first.select(*ids)), keep(links)
    while True:
        ahead = keep(reached.join(links, ids).select("paper", F.col("to_at").alias("at"), F.col("to_e").alias("e")))
        if ahead.isEmpty():
            return reached
        reached = reached.unionByName(ahead)
        on = links.select("paper", F.col("at").alias("to_at"), F.col("e").alias("to_e"), F.col("to_at").alias("far_at"), F.col("to_e").alias("far_e"))
        links = keep(links.join(on, ["paper", "to_at", "to_e"]).select(*ids, F.col("far_at").alias("to_at"), F.col("far_e").alias("to_e")))


def _long_numbered(sections: DataFrame, stretch: int, keep: Keep) -> DataFrame:
    """(paper, num, raw) of sections of any length, whose stretches are folded apart from each other.

    For every number that opens an entry somewhere in a stretch, a fold over the
    stretch's markers says which number is expected at its end; that number's
    next stretch is an as-of join.  The nodes that lead on from the first 1 are
    followed by doubling, which gives each stretch the number that it begins with.
    """
    rows = keep(_with_bare(keep(_stretches(sections, _lines, stretch))))
    seen = F.aggregate("lines", F.struct(F.col("bare").alias("bare"), F.array().cast("array<int>").alias("out")), lambda acc, line: F.struct(_bare_after(line, acc["bare"]).alias("bare"), F.when(_is_marker(line, acc["bare"]), F.concat(acc["out"], F.array(_number(line)))).otherwise(acc["out"]).alias("out")), lambda acc: acc["out"])
    marked = rows.select("paper", "at", F.filter(seen, lambda n: n > 0).alias("seen"))
    end = lambda e: F.aggregate("seen", e, lambda acc, n: acc + (n == acc).cast("int"))
    nodes = keep(marked.select("paper", "at", F.explode(F.transform(F.array_distinct("seen"), lambda e: F.struct(e.alias("e"), end(e).alias("to")))).alias("n")).select("paper", "at", "n.e", "n.to"))
    asks = nodes.select("paper", "at", "e", F.col("to").alias("number"), F.lit(None).cast("int").alias("there"))
    there = nodes.select("paper", "at", F.lit(None).cast("int").alias("e"), F.col("e").alias("number"), F.col("at").alias("there"))
    later = Window.partitionBy("paper", "number").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    links = asks.unionByName(there).withColumn("to_at", F.min("there").over(later)).where("e is not null and to_at is not null")
    first = nodes.where("e = 1").groupBy("paper").agg(F.min("at").alias("at"), F.first("e").alias("e"))
    reached = _followed(links.select("paper", "at", "e", "to_at", F.col("number").alias("to_e")), first, keep)
    ends = reached.join(nodes, ["paper", "at", "e"]).select("paper", "at", "to")
    begun = rows.select("paper", "at").join(ends, ["paper", "at"], "left")
    begun = begun.select("paper", "at", F.coalesce(F.last("to", ignorenulls=True).over(_before()), F.lit(1)).alias("next"))
    pieces = rows.join(begun, ["paper", "at"]).select("paper", "at", "next", F.posexplode(_walk(F.col("lines"), F.col("next"), F.col("bare"))).alias("k", "piece"))
    number = F.when(F.col("k") == 0, F.col("next") - 1).otherwise(F.substring_index("piece", _TEXT, 1).cast("int"))
    return _whole(pieces.select("paper", "at", "k", number.alias("number"), F.substring_index("piece", _TEXT, -1).alias("piece")), "")


def _whole(pieces: DataFrame, between: str) -> DataFrame:
    """(paper, num, raw) of entries whose pieces may lie in several stretches; number 0 is what comes before the first."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "k", "piece"))), lambda p: p["piece"]), between)
    rows = pieces.where("number > 0").groupBy("paper", "number").agg(T.squeeze(texts).alias("raw")).where("raw <> ''")
    return rows.select("paper", "number", F.col("number").cast("string").alias("num"), "raw")


def _long_bulleted(sections: DataFrame, stretch: int, keep: Keep) -> DataFrame:
    """The same for bullets: those of the stretches before are counted."""
    rows = keep(_stretches(sections, _bullet_lines, stretch))
    thin = rows.select("paper", "at", F.size(F.filter("lines", lambda x: x.rlike(BULLET))).alias("bullets"))
    thin = thin.select("paper", "at", F.coalesce(F.sum("bullets").over(_before()), F.lit(0)).cast("int").alias("before"))
    pieces = rows.join(thin, ["paper", "at"]).select("paper", "at", "before", F.posexplode(_bullet_walk(F.col("lines"), F.col("before") > 0)).alias("k", "piece"))
    return _whole(pieces.select("paper", "at", "k", (F.col("before") + F.col("k")).alias("number"), "piece"), " ")


def _ordered(rows: DataFrame) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("paper").orderBy("number")) - 1
    return rows.select("paper", at.alias("ord"), "num", "raw")


def _exploded(sections: DataFrame, entries: Column) -> DataFrame:
    return sections.select("paper", F.posexplode(entries).alias("ord", "entry")).select("paper", "ord", "entry.num", "entry.raw")


def numbered_rows(sections: DataFrame, stretch: int = STRETCH, keep: Keep = seams.kept) -> DataFrame:
    """(paper, ord, num, raw) of ``numbered_entries``, for sections (paper, section) of any length, one a paper.

    A section of up to ``stretch`` lines stays in its row; a longer one is dealt to tasks by stretches.
    """
    return _rows(sections, numbered_entries, _long_numbered, stretch, keep)


def bulleted_rows(sections: DataFrame, stretch: int = STRETCH, keep: Keep = seams.kept) -> DataFrame:
    """The same of ``bulleted_entries``."""
    return _rows(sections, bulleted_entries, _long_bulleted, stretch, keep)


def _rows(sections: DataFrame, short: Callable, long: Callable, stretch: int, keep: Keep) -> DataFrame:
    is_long = _is_long(F.col("section"), stretch)
    some = sections.where(is_long).select("paper", "section")
    rows = _exploded(sections.where(~is_long), short(F.col("section")))
    return rows if some.isEmpty() else rows.unionByName(_ordered(long(some, stretch, keep)))


def parse_references(sections: DataFrame, section_col: str = "section", stretch: int = STRETCH, keep: Keep = seams.kept) -> DataFrame:
    """(paper, ord, num, raw, doi, year, slug) of every entry; bullets only where no number opens one."""
    sections = sections.select("paper", F.col(section_col).alias("section"))
    is_long = _is_long(F.col("section"), stretch)
    either = T.once(numbered_entries(F.col("section")), lambda found: F.when(F.size(found) > 0, found).otherwise(bulleted_entries(F.col("section"))))
    rows, some = _exploded(sections.where(~is_long), either), sections.where(is_long)
    if not some.isEmpty():
        numbered = keep(_ordered(_long_numbered(some, stretch, keep)))
        others = _ordered(_long_bulleted(some.join(numbered, "paper", "left_anti"), stretch, keep))
        rows = rows.unionByName(numbered).unionByName(others)
    return entry_fields(rows)


def entry_fields(rows: DataFrame) -> DataFrame:
    """``doi, year, slug`` of raw entries."""
    rows = rows.withColumn("doi", T.doi(F.col("raw"))).withColumn("year", T.year(F.col("raw")))
    return rows.withColumn("slug", T.slug(F.col("raw"), F.col("year")))


def first_by_num(refs: DataFrame) -> DataFrame:
    """One entry for each label: the first of its number."""
    return _first(refs, "num")


def first_by_slug(refs: DataFrame) -> DataFrame:
    """One entry for each slug, and how many share it (``n_same``)."""
    return _first(refs.where("slug <> ''"), "slug")


def _first(refs: DataFrame, key: str) -> DataFrame:
    rest = [c for c in refs.columns if c not in ("paper", key)]
    rows = refs.groupBy("paper", key).agg(F.min_by(F.struct(*rest), "ord").alias("e"), F.count("*").alias("n_same"))
    return rows.select("paper", key, "e.*", "n_same")


def require_references(refs: DataFrame) -> DataFrame:
    """The references; an error where there are none at all."""
    if refs.isEmpty():
        raise ValueError("no references found: is there a reference section?")
    return refs
