"""License scans against whole-text matching, and against edit distances of all runs of words."""

import random
import re
import time

import regex

from marginalia.llm import license_scan as L
from marginalia.llm import registry
from marginalia.llm.store import read

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
LOWER = {k: k + 32 for k in range(65, 91)}


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def whole(text, given):
    """The spans that each notice's matching finds in the whole text, without seeds or windows."""
    line = " ".join(WORD.findall((text or "").translate(LOWER)))
    return sorted((m.start(), m.end(), k, sum(m.fuzzy_counts)) for k, n in enumerate(given) for m in regex.finditer(n.pattern, line))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_op13(spark, small):
    texts = {r.doc_id: r.text for r in read(spark, small, "documents").collect()}
    rows = registry.op13_license_scan(spark, small).collect()
    assert len(rows) == len(texts)
    own = L.scanner(L.notices())
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)
        line = " ".join(WORD.findall((texts[r.doc_id] or "").translate(LOWER)))
        if len(line) < 2000:
            assert own.fuzzy(line) == whole(texts[r.doc_id], own.notices)
    assert sum(bool(r.labels) for r in rows) > 0


def spoiled(rng, words, n):
    for _ in range(n):
        k = rng.randrange(len(words))
        words = rng.choice([words[:k] + words[k + 1 :], words[:k] + rng.choice("xe9 é") + words[k:], words[:k] + rng.choice("qz ") + words[k + 1 :]])
    return words


def test_spoiled_notices_as_in_the_whole_text():
    rng, own = random.Random(3), L.scanner(L.notices())
    stop = ["the", "software", "license", "licensed under", "permission is", "of", "gnu", "public license", "a", "é"]
    found = 0
    for _ in range(400):
        parts = []
        for _ in range(rng.choice([1, 2, 4])):
            parts += [rng.choice(stop) for _ in range(rng.choice([0, 1, 5]))]
            n = rng.choice(own.notices)
            parts.append(spoiled(rng, n.words, rng.choice([0, 1, 2, n.errors, n.errors + 1, 8])))
        text = " ".join(parts)
        line = " ".join(WORD.findall(text))
        spans = own.fuzzy(line)
        assert spans == whole(text, own.notices), text
        assert own.fuzzy(line) == spans  # windows that were met before
        found += bool(spans)
    assert found > 200


def test_found_where_the_edit_distance_says_so():
    rng = random.Random(4)
    own = L.Scanner(L.notices([("a", "licensed under cc by nc"), ("b", "gnu lesser general public license")]))
    for _ in range(150):
        n = rng.choice(own.notices)
        line = " ".join(WORD.findall("of the " + spoiled(rng, n.words, rng.randrange(n.errors + 3)) + " and so on"))
        words = line.split(" ")
        for k, m in enumerate(own.notices):
            near = any(distance(" ".join(words[i:j]), m.words) <= m.errors for i in range(len(words)) for j in range(i + 1, min(len(words), i + 10) + 1))
            assert near == any(x[2] == k for x in own.fuzzy(line)), (line, m)


def test_a_faulty_notice_is_found_and_reported(spark):
    docs = spark.createDataFrame([(1, "Some words. Relaesed under the MIT\nLicence!"), (2, "no license here, only a permission")], "doc_id long, text string")
    one, two = sorted(L.scan(docs).collect(), key=lambda r: r.doc_id)
    assert one.labels == [] and one.n_base == 0  # three errors, two allowed
    assert two.labels == [] and two.score == 0
    docs = spark.createDataFrame([(1, "Some words. Released undr the MIT\nLicence!")], "doc_id long, text string")
    r = L.scan(docs).first()
    span = r.spans[0]
    assert (r.labels, r.base_labels, r.n_base) == (["mit"], [], 0) and 0.5 < r.score < 1
    assert (span.label, span.first_word, span.last_word, span.errors, span.text) == ("mit", 2, 6, 2, "released undr the mit licence")


def test_odd(spark, odd_documents):
    rows = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) for r in L.scan(odd_documents).collect()), key=repr)
    assert rows == sorted(((r.doc_id, *base(r.text)) for r in odd_documents.collect()), key=repr)
    assert L.scan(odd_documents.limit(0)).count() == 0


def test_all_places_count(spark):
    text = "mit license mit license general public license, MIT-License mitlicense émit license mit"
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [(r.n_base, r.first_word, r.last_word) for r in L.scan(docs).collect()] == [(4, 0, 7)] * 2


def test_long_texts_of_seeds_are_linear():
    own = L.Scanner(L.notices())

    def took(n):
        began = time.perf_counter()
        own.scan("permission is hereby granted licensed under the gnu general " * n)
        return time.perf_counter() - began

    took(10)
    small, large = took(400), took(1600)
    assert large < 4 * 3 * small and large < 20
