"""Reference lists cut into stretches against the whole text at once, and long ones in time."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from marginalia.operators import references as R


def numbered(text):
    """Markers over the whole text; only the next expected number opens an entry."""
    opens, expected = [], 1
    for m in re.finditer(r"(?m)^\s*\[?(\d{1,3})[\].:]?\s+", text):
        if int(m[1]) == expected:
            opens.append(m)
            expected += 1
    ends = [m.start() for m in opens[1:]] + [len(text)] * bool(opens)
    found = [(str(k + 1), " ".join(text[m.end() : e].split())) for k, (m, e) in enumerate(zip(opens, ends, strict=True))]
    return [x for x in found if x[1]]


def bulleted(text):
    out = []
    for line in text.splitlines():
        line = line.strip()
        if re.match("[-•*] ", line):
            out.append(line[2:].strip())
        elif line and out:
            out[-1] += " " + line
    return [(str(k + 1), " ".join(x.split())) for k, x in enumerate(out) if x.split()]


def texts(seed, n):
    rng = random.Random(seed)
    bits = ["1. a", "2. b", " 2. c", "3.", " 3. d", "[4] e", "4.", "  4.", "5. f", "", "  ", "\t", "word", "- item", "• two", "12 x", "1.", " 1. g", "6 h", "7. i", "- ", "999. z"]
    for k in range(n):
        grow = [f"{j}. entry {j}" for j in range(1, rng.choice([1, 4, 30, 60]))]
        lines = [rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 12, 40]))]
        for j, x in enumerate(grow):
            lines.insert(min(len(lines), j * rng.choice([1, 2])), x)
        yield k, "\n".join(lines) + rng.choice(["", "\n", "\n\n"])


def by_paper(rows):
    found = {}
    for r in sorted(rows.collect(), key=lambda r: (r.paper, r.ord)):
        assert r.ord == len(found.setdefault(r.paper, []))
        found[r.paper].append((r.num, r.raw))
    return found


@pytest.mark.parametrize("stretch", [1, 3, 10, 500])
def test_stretches_as_the_whole_text(spark, stretch):
    given = list(texts(stretch, 60))
    rows = spark.createDataFrame(given, "paper long, section string")
    assert by_paper(R.numbered_rows(rows, stretch)) == {k: v for k, t in given if (v := numbered(t))}
    assert by_paper(R.bulleted_rows(rows, stretch)) == {k: v for k, t in given if (v := bulleted(t))}
    either = by_paper(R.parse_references(rows, stretch=stretch))
    assert either == {k: v for k, t in given if (v := numbered(t) or bulleted(t))}


def test_empty_table(spark):
    assert R.numbered_rows(spark.createDataFrame([], "paper long, section string")).count() == 0


def long_section(lines):
    """A list whose entries go on over many lines, with stray numbers in them."""
    return "\n".join(f"{k // 300 + 1}. entry {k}" if k % 300 == 0 else f"{k % 997} and so on {k}" for k in range(lines))


def test_a_long_section_is_dealt_to_tasks(spark):
    rows = spark.createDataFrame([(1, long_section(60_000))], "paper long, section string")
    stretches = R._stretches(rows, R._lines, 500).repartition(8, "paper", "at")
    per_task = [r[1] for r in stretches.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 120 and max(per_task) < 40
    found = by_paper(R.numbered_rows(rows, 500))[1]
    assert found == numbered(long_section(60_000))


def test_doubling_at_most_doubles(spark):
    def took(lines):
        rows = spark.createDataFrame([(1, long_section(lines))], "paper long, section string")
        began = time.perf_counter()
        assert R.parse_references(rows).count() > 0
        return time.perf_counter() - began

    took(2000)
    once = took(50_000)
    assert took(100_000) < 3 * once
