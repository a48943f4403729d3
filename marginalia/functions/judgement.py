"""Verdicts, and the text that goes to and comes from a judge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verdicts, states and labels that reports and files carry.
VERDICTS = ["supported", "partial", "contradicted", "not_retrieved", "unchecked"]
STATUSES = ["retrieved", "provided", "paywalled", "mismatch", "no_doi", "unpublished", "error"]
BLOCK_TYPES = ["sectionheader", "text", "table", "picture", "list"]
AVAILABLE, GAPS = ["retrieved", "provided"], ["not_retrieved", "unchecked"]
LABELS = {
    "supported": "✅ SUPPORTED",
    "partial": "⚠️ PARTIALLY SUPPORTED",
    "contradicted": "❌ CONTRADICTED",
    "not_retrieved": "⊘ NOT RETRIEVED",
    "unchecked": "⚠️ NOT CHECKED (check failed — source available)",
}
VERDICT_ROWS = "array<struct<id:int,verdict:string,note:string,source_page:int,source_block:string,anchor_phrases:array<string>>>"
CLAIM_OBJECT = "struct<cited:array<struct<id:int,claim:string,location:string,refs:array<string>>>,uncited:array<struct<id:int,claim:string,location:string>>>"


def verdict_label(verdict: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(F.element_at(known, verdict), F.upper(verdict))


def is_available(status: Column) -> Column:
    return status.isin(AVAILABLE)


def unfenced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"(?m)^```(json)?|```$", ""))


def json_array(text: Column, schema: str = VERDICT_ROWS) -> Column:
    """Rows of the JSON array in a judge's answer, from the first bracket to the last; null if there is none."""
    found = F.nullif(F.regexp_extract(unfenced(text), r"(?s)\[.*\]", 0), F.lit(""))
    return F.from_json(found, schema)


def json_object(text: Column, schema: str = CLAIM_OBJECT) -> Column:
    found = F.nullif(F.regexp_extract(unfenced(text), r"(?s)\{.*\}", 0), F.lit(""))
    return F.from_json(found, schema)


def checker(model: Column, last: Column) -> Column:
    """What is disclosed about the judge."""
    return F.format_string("model judge · %s", F.coalesce(F.nullif(model, F.lit("")), F.nullif(last, F.lit("")), F.lit("account default model")))


def counts(kind: Column, values: list[str]) -> list[Column]:
    """A zero-filled count of each value."""
    return [F.count_if(kind == v).alias(v) for v in values]
