"""Citation labels in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCES_HEADING = r"(?im)^##\s+(references|bibliography|literature)\b"
LABEL_GROUP = r"\[(\d{1,3}(?:\s*[,–—-]\s*\d{1,3})*)\]"
RANGE = r"^(\d{1,3})\s*[–—-]\s*(\d{1,3})$"
WIDEST_RANGE = 50


def body(clean_md: Column) -> Column:
    """The text before the first heading of a reference section."""
    return F.get(F.split(clean_md, REFERENCES_HEADING, 2), F.lit(0))


def label_groups(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LABEL_GROUP), F.lit(1))


def expand_group(group: Column) -> Column:
    """Labels of one bracket: ranges of 50 at most are spelt out, single labels kept digit by digit."""

    def labels(part: Column) -> Column:
        low = F.regexp_extract(part, RANGE, 1).try_cast("int")
        high = F.regexp_extract(part, RANGE, 2).try_cast("int")
        spelt = F.transform(F.sequence(low, high), lambda n: n.cast("string"))
        none = F.array().cast("array<string>")
        return F.when(part.rlike(RANGE), F.when((low <= high) & (high - low <= WIDEST_RANGE), spelt).otherwise(none)).when(part.rlike(r"^\d+$"), F.array(part)).otherwise(none)

    return F.flatten(F.transform(F.split(group, r"\s*,\s*"), lambda p: labels(F.trim(p))))


def by_number(labels: Column) -> Column:
    """Labels in numeric order; equal numbers by text."""
    keyed = F.transform(labels, lambda x: F.struct(x.try_cast("int").alias("n"), x.alias("label")))
    return F.transform(F.array_sort(keyed), lambda s: s["label"])


def labels_in_text(clean_md: Column) -> Column:
    """Distinct labels of the body, in order."""
    return by_number(F.array_distinct(F.flatten(F.transform(label_groups(body(clean_md)), expand_group))))
