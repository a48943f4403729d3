"""Claims: routing to sources, prompts, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import judgement as J
from ..functions import text as T


def cited_entries(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """A row for each label of each claim, with the first entry of that number; unknown labels have none."""
    found = F.transform("refs", lambda n: F.struct(n.alias("num"), F.array_position("nums", n).alias("at")))
    entry = F.transform(found, lambda f: F.struct(f["num"].alias("num"), F.get("entries", (f["at"] - 1).cast("int")).alias("e")))
    rows = claims.select("paper", "id", "refs").join(_reference_lists(refs), "paper", "left")
    rows = rows.select("paper", "id", F.posexplode_outer(entry).alias("pos", "c"))
    return rows.select("paper", "id", "pos", "c.num", "c.e.status", "c.e.slug")


def _reference_lists(refs: DataFrame) -> DataFrame:
    """(paper, nums, entries): a paper's reference list in order, so that claims meet it by paper and are moved for nothing else."""
    rows = refs.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("ord", "num", "status", "slug"))).alias("l"))
    return rows.select("paper", F.col("l.num").alias("nums"), F.transform("l", lambda e: F.struct(e["status"].alias("status"), e["slug"].alias("slug"))).alias("entries"))


def route(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """(paper, id, source_slug, verdict, note): a claim goes to its first available source, else it is not_retrieved.

    No claim without a source that was read is ever sent to a judge.
    """
    ready = J.is_available(F.col("status")) & (F.col("slug") != "")
    rows = cited_entries(claims, refs).groupBy("paper", "id").agg(
        F.min_by("slug", F.when(ready, F.col("pos"))).alias("source_slug"),
        F.array_join(F.array_sort(F.collect_set("status")), ", ").alias("why"),
    )
    gap = F.col("source_slug").isNull()
    why = F.coalesce(F.nullif(F.col("why"), F.lit("")), F.lit("unknown ref"))
    return rows.select(
        "paper",
        "id",
        "source_slug",
        F.when(gap, "not_retrieved").alias("verdict"),
        F.when(gap, F.concat(F.lit("cited source not available ("), why, F.lit(")"))).alias("note"),
    )


def groups(routed: DataFrame) -> DataFrame:
    """(paper, slug, first_id, ids): the claims of each source, one call each."""
    return routed.where("source_slug is not null").groupBy("paper", F.col("source_slug").alias("slug")).agg(F.min("id").alias("first_id"), F.array_sort(F.collect_list("id")).alias("ids"))


def prompts(claims: DataFrame, routed: DataFrame, sources: DataFrame, template: str) -> DataFrame:
    """(paper, slug, prompt): a template with its claims, slug and source text (paper, slug, annotated_md) filled in."""
    # a paper's claims and the sources they go to meet by paper alone, as both were made
    sent = routed.where("source_slug is not null").groupBy("paper", F.col("source_slug").alias("slug")).agg(F.collect_list("id").alias("ids"))
    sent = sent.groupBy("paper").agg(F.collect_list(F.struct("slug", "ids")).alias("sent"))
    told = claims.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("id", "claim", "location"))).alias("told"))
    asked = F.transform("sent", lambda s: F.struct(s["slug"].alias("slug"), F.to_json(F.filter("told", lambda c: F.array_contains(s["ids"], c["id"]))).alias("claims_json")))
    rows = sent.join(told, "paper").select("paper", F.inline(asked)).where("claims_json <> '[]'").join(sources, ["paper", "slug"])
    filled = F.replace(F.replace(F.lit(template), F.lit("<<CLAIMS>>"), F.col("claims_json")), F.lit("<<SLUG>>"), F.col("slug"))
    return rows.select("paper", "slug", F.replace(filled, F.lit("<<SOURCE>>"), F.left("annotated_md", F.lit(T.SOURCE_CHARS))).alias("prompt"))


def verdict_rows(responses: DataFrame) -> DataFrame:
    """(paper, slug, id, …) of the answers' rows, the last of each id; answers: paper, slug, raw, error."""
    rows = responses.where("error is null").select("paper", "slug", F.posexplode_outer(J.json_array(F.col("raw"))).alias("pos", "v"))
    last = rows.where("v.id is not null").groupBy("paper", "slug", F.col("v.id").alias("id")).agg(F.max_by("v", "pos").alias("v"))
    return last.select("paper", "slug", "id", F.col("v.verdict").alias("v_verdict"), F.col("v.note").alias("v_note"), F.col("v.source_page").alias("source_page"), F.col("v.source_block").alias("source_block"), F.col("v.anchor_phrases").alias("anchor_phrases"))


def merge_verdicts(routed: DataFrame, responses: DataFrame) -> DataFrame:
    """Every routed claim with its verdict.

    An answer that failed, or holds no array, leaves its claims unchecked with
    the reason and no other source's; a claim without a row is unchecked too.
    """
    failure = F.coalesce("error", F.when(J.json_array(F.col("raw")).isNull(), F.concat(F.lit("no JSON array in model output: "), F.left("raw", F.lit(200)))))
    failed = responses.select("paper", F.col("slug").alias("source_slug"), failure.alias("failure"), F.lit(True).alias("answered"))
    given = verdict_rows(responses).withColumnRenamed("slug", "source_slug").withColumn("found", F.lit(True))
    rows = routed.join(failed, ["paper", "source_slug"], "left").join(given, ["paper", "source_slug", "id"], "left")
    sent = F.col("source_slug").isNotNull()
    broken = F.coalesce("failure", F.when(F.col("answered").isNull(), F.lit("no answer")))
    note = F.concat(F.lit("check failed ("), F.left(broken, F.lit(300)), F.lit(") — the source WAS retrieved; check again to retry"))
    return rows.select(
        "paper",
        "id",
        "source_slug",
        F.when(~sent, F.col("verdict")).when(broken.isNotNull() | F.col("found").isNull(), "unchecked").otherwise(F.coalesce("v_verdict", F.lit("partial"))).alias("verdict"),
        F.when(~sent, F.col("note")).when(broken.isNotNull(), note).when(F.col("found").isNull(), "model returned no verdict for this claim").otherwise(F.coalesce("v_note", F.lit(""))).alias("note"),
        "source_page",
        "source_block",
        F.coalesce("anchor_phrases", F.array().cast("array<string>")).alias("anchor_phrases"),
    )


def extraction_prompts(texts: DataFrame, template: str) -> DataFrame:
    """(paper, slug, prompt): a template with each manuscript's text (paper, clean_md), cut at the limit, filled in; slug is empty."""
    return texts.select("paper", F.lit("").alias("slug"), F.replace(F.lit(template), F.lit("<<MANUSCRIPT>>"), F.left("clean_md", F.lit(T.MANUSCRIPT_CHARS))).alias("prompt"))


def extracted(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and uncited assertions of extraction answers (paper, raw)."""
    rows = answers.select("paper", J.json_object(F.col("raw")).alias("o"))
    cited = rows.select("paper", F.explode("o.cited").alias("c")).select("paper", "c.id", "c.claim", F.coalesce("c.location", F.lit("")).alias("location"), F.coalesce("c.refs", F.array().cast("array<string>")).alias("refs"))
    uncited = rows.select("paper", F.explode("o.uncited").alias("c")).select("paper", "c.id", "c.claim", F.coalesce("c.location", F.lit("")).alias("location"))
    return cited, uncited
