"""Literature that a reference list does not know."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

NEWER_CAP, OVERLOOKED_CAP = 25, 15
HIT = "struct<title:string,year:string,doi:string,journal:string,abbreviation:string,authors:string>"


def hits(found: DataFrame) -> DataFrame:
    """(paper, ord, via, title, year, doi, journal, authors) of results as they came in."""
    return found.select(
        "paper",
        "ord",
        "via",
        T.hit_title(F.col("title")).alias("title"),
        T.year_number(F.col("pub_year")).alias("year"),
        F.lower(F.coalesce("doi", F.lit(""))).alias("doi"),
        F.coalesce(F.nullif("journal", F.lit("")), F.nullif("abbreviation", F.lit("")), F.lit("")).alias("journal"),
        F.coalesce("authors", F.lit("")).alias("authors"),
    )


def first_of_keys(rows: DataFrame) -> DataFrame:
    """(paper, branch, ord, ks, h): the first hit of each set of keys, and none without keys.

    Whether the first was kept or dropped, one of its keys is taken from there
    on, so no later hit of the same keys is ever kept.
    """
    branch = F.when(F.col("via") == "citing", 0).otherwise(1).alias("branch")
    keyed = rows.select("paper", T.hit_keys(F.col("doi"), F.col("title")).alias("ks"), F.struct(branch, "ord", F.struct("via", "title", "year", "doi", "journal", "authors").alias("h")).alias("hit"))
    return keyed.where(F.size("ks") > 0).groupBy("paper", "ks").agg(F.min("hit").alias("hit")).select("paper", "hit.branch", "hit.ord", "ks", "hit.h")


def ordered_dedup(rows: DataFrame, papers: DataFrame) -> DataFrame:
    """Hits in order, each dropped if it has no key or one that a hit kept before it, or the paper itself, has.

    Only kept hits register their keys, so it is a fold in order: neither
    dropping duplicates by key nor connected components give the same.  A paper's
    hits of different keys are folded in one row.
    """
    kind = "array<struct<branch:int,ord:int,ks:array<string>,h:struct<via:string,title:string,year:int,doi:string,journal:string,authors:string>>>"
    lists = first_of_keys(rows).groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("branch", "ord", "ks", "h"))).cast(kind).alias("hits"))
    own = papers.select("paper", "paper_year", T.hit_keys(F.lower(F.coalesce("paper_doi", F.lit(""))), F.col("paper_title")).alias("own"))
    lists = lists.join(own, "paper", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))

    def step(acc, x):
        drop = (F.size(x["ks"]) == 0) | F.arrays_overlap(x["ks"], acc["seen"])
        kept = F.struct(F.array_union(acc["seen"], x["ks"]).alias("seen"), F.array_append(acc["keep"], x).alias("keep"))
        return F.when(drop, acc).otherwise(kept)

    folded = F.aggregate("hits", F.struct(F.col("own").alias("seen"), F.array().cast(kind).alias("keep")), step, lambda acc: acc["keep"])
    flat = lists.select("paper", "paper_year", F.explode(folded).alias("k"))
    return flat.select("paper", "paper_year", "k.ord", "k.h.*")


def split_by_year(kept: DataFrame) -> DataFrame:
    """``newer`` of each kept hit: citing ones are, undated search ones go, others by the paper's year."""
    later = (F.coalesce("paper_year", F.lit(0)) != 0) & (F.col("year") > F.col("paper_year"))
    rows = kept.where((F.col("via") == "citing") | F.col("year").isNotNull())
    return rows.withColumn("newer", (F.col("via") == "citing") | F.coalesce(later, F.lit(False)))


def uncited(candidates: DataFrame, refs: DataFrame) -> DataFrame:
    """Candidates whose DOI no reference has, and whose first author and year no slug has: two equi-joins, not one on either."""
    dois = refs.where("doi <> ''").select("paper", F.lower("doi").alias("doi")).distinct()
    slugs = refs.where("slug <> ''").select("paper", F.col("slug").alias("author_year")).distinct()
    rows = candidates.withColumn("author_year", T.author_year_key(F.col("authors"), F.col("year")))
    return rows.join(dois, ["paper", "doi"], "left_anti").join(slugs, ["paper", "author_year"], "left_anti").select(*candidates.columns)


def top(rows: DataFrame, cap: int) -> DataFrame:
    """The latest of each paper, ties by title, with their rank."""
    order = Window.partitionBy("paper").orderBy(F.desc(F.coalesce("year", F.lit(0))), "title", F.when(F.col("via") == "citing", 0).otherwise(1), "ord")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def registers(found: DataFrame, papers: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newer and the overlooked hits of each paper (paper, paper_title, paper_doi, paper_year)."""
    rows = split_by_year(ordered_dedup(found, papers))
    return top(rows.where("newer"), NEWER_CAP), top(uncited(rows.where("not newer"), refs), OVERLOOKED_CAP)


def soft_failed(rows: DataFrame, errors: DataFrame, cap: int) -> DataFrame:
    """Registers of papers whose search failed half-way keep all they had, in the order found."""
    bad = rows.join(errors, "paper", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("paper").orderBy(F.when(F.col("via") == "citing", 0).otherwise(1), "ord")))
    return top(rows.join(errors, "paper", "left_anti"), cap).unionByName(bad)
