"""Secret scans: multipart credential linking, in DataFrame functions only.

Three base kinds are secrets by themselves: keyword assignments, access keys
and long hexadecimal runs.  Weak kinds (account names, mixed tokens, endpoints)
are common in clean text and count only together: a join links an identifier or
endpoint with a secret of the same text when SCOPE code points at most lie
between them, those of other parts not counted, and only linked weak parts are
reported.  So no length of a part, nor of one that stands between, breaks a link.

Positions are code points, the end exclusive.  Null and empty texts have no
spans.  Repeated rows get the same result each, also when ids repeat with other
texts: spans are keyed by id and text digest.  An empty table gives an empty
result; other columns of the input pass by untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import bound, following_min, running_max, running_sum, runs
from .store import table

#: Most code points, outside all parts, between two parts that belong together.
SCOPE = 200
MASK = "[SECRET]"

#: Kinds in the order of the listing: pattern, and what a match must hold besides.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {
    "assign": (ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: F.length(m) >= 20),
    "hex": (r"[0-9a-f]{24,}", lambda m: F.lit(True)),  # greedy, so the same as runs of any length cut at 24
}
#: Likewise, with the role. No length ends a match, and possessive quantifiers keep long ones linear.
WEAK = {
    "account": (r"""(?i)\b(?:access_key_id|client_id|username|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}+""", None, "id"),
    "mixed": (r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{32,}+={0,2}+(?![A-Za-z0-9+/=_-])", lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"), "secret"),
    "phrase": (r"""(?i)\b(?:pwd|pass|credential|private_key)["']?\x20*[:=]\x20*["']?[^\s"']{6,}+""", None, "secret"),
    "endpoint": (r"""(?i)\b(?:https?|ftp|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\s"'<>]{4,}+""", None, "place"),
}
#: Letters that every match of a kind holds as they stand.
MUST = {"access": "AKIA", "endpoint": "://"}
ROLE = {"assign": "secret", "access": "id", "hex": "secret"} | {k: role for k, (_, _, role) in WEAK.items()}
ORDER = {kind: k for k, kind in enumerate([*BASE, *WEAK])}
SPAN = "struct<start:int,ord:int,end:int>"


def find(text: Column, kind: str, pattern: str, holds=None) -> Column:
    """Leftmost non-overlapping matches of a pattern as an array of SPAN.

    Matches are fenced by two control characters, which the text itself is
    freed of first, one for one; lengths of the split pieces give positions.
    The pieces are one element of an array, so that they are made once.
    """
    fixed = lambda k, piece: F.length(piece) - F.when(k > 0, 1).otherwise(0)  # noqa: E731 - less the fence after the match

    def spans(pieces: Column) -> Column:
        starts = running_sum(F.transform(pieces, lambda piece, k: fixed(k, piece)))

        def span(at: Column) -> Column:
            def one(piece: Column, k: Column) -> Column:
                match = F.substring_index(piece, "\x02", 1)
                start = F.get(at, k + 1)
                whole = F.struct(start.alias("start"), F.lit(ORDER[kind]).alias("ord"), (start + F.length(match)).alias("end"))
                return whole if holds is None else F.when(holds(match), whole)

            return F.filter(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one), lambda x: x.isNotNull()).cast(f"array<{SPAN}>")

        return bound(starts, span)

    return bound(F.split(F.regexp_replace(text, pattern, "\x01$0\x02"), "\x01"), spans)


def parts(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep``, then ``__digest`` of the whole text and its ``__base`` and ``__weak`` spans."""
    whole = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, F.xxhash64(whole).alias("__digest"), F.translate(whole, "\x01\x02", "\x03\x03").alias("__free"))

    def found(kind: str, pattern: str, holds) -> Column:
        spans = find(F.col("__free"), kind, pattern, holds)
        # a text without the fixed letters of a pattern has no match of it
        return F.when(F.col("__free").contains(MUST[kind]), spans).otherwise(F.array().cast(f"array<{SPAN}>")) if kind in MUST else spans

    base = F.concat(*(found(kind, pattern, holds) for kind, (pattern, holds) in BASE.items()))
    weak = F.concat(*(found(kind, pattern, holds) for kind, (pattern, holds, _) in WEAK.items()))
    rows = rows.select(*keep, "__digest", F.array_sort(base).alias("__base"), weak.alias("__weak"))
    return rows.withColumn("__weak", apart(F.col("__base"), F.col("__weak")))


def apart(base: Column, weak: Column) -> Column:
    """The weak spans that no base span overlaps."""

    def kept(every: Column) -> Column:
        is_base = lambda s: s["ord"] < len(BASE)
        # of two spans that start at one place the base one is first
        ended = running_max(F.transform(every, lambda s: F.when(is_base(s), s["end"]).otherwise(0)))
        begins = following_min(F.transform(every, lambda s: F.when(is_base(s), s["start"]).otherwise(2**31 - 1)))
        marks = F.arrays_zip(every.alias("span"), ended.alias("ended"), begins.alias("begins"))
        free = F.filter(marks, lambda m: ~is_base(m["span"]) & (m["ended"] <= m["span"]["start"]) & (m["begins"] >= m["span"]["end"]))
        return F.transform(free, lambda m: m["span"])

    return F.when((F.size(weak) == 0) | (F.size(base) == 0), weak).otherwise(bound(F.array_sort(F.concat(base, weak)), kept))


def in_free_text(spans: Column) -> Column:
    """The spans by start, each as ``span`` with ``free``, the code points before it that are in no span."""

    def placed(every: Column) -> Column:
        def gaps(ended: Column) -> Column:
            return F.transform(every, lambda s, k: F.greatest(s["start"] - F.get(ended, k), F.lit(0)))

        def items(gap: Column) -> Column:
            return bound(running_sum(gap), lambda free: F.transform(every, lambda s, k: F.struct(s.alias("span"), (F.get(free, k) + F.get(gap, k)).alias("free"))))

        return bound(bound(running_max(F.transform(every, lambda s: s["end"])), gaps), items)

    return bound(F.array_sort(spans), placed)


def linked(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Weak spans with a complementary part in scope: ``e_id``, ``e_digest``, ``extra`` array of SPAN, a row for each id and digest; found: as of ``parts``."""
    role = F.element_at(F.create_map(*(F.lit(x) for kind, k in ORDER.items() for x in (k, ROLE[kind]))), F.col("span.ord"))
    has_weak = found.where(F.size("__weak") > 0).select(F.col(id_col).alias("e_id"), F.col("__digest").alias("e_digest"), "__base", "__weak").dropDuplicates(["e_id", "e_digest"])
    each = has_weak.select("e_id", "e_digest", F.explode(in_free_text(F.concat("__base", "__weak"))).alias("part"))
    each = each.select("e_id", "e_digest", "part.span", "part.free").select("*", role.alias("role"), F.floor(F.col("free") / SCOPE).alias("cell"))
    # all parts of a cell lie in scope of each other, and of those beside it the nearest decides
    cells = each.groupBy("e_id", "e_digest", "cell", (F.col("role") == "secret").alias("secret")).agg(F.min("free").alias("least"), F.max("free").alias("most"))
    near = cells.select(F.col("e_id").alias("n_id"), F.col("e_digest").alias("n_digest"), "least", "most", F.col("secret").alias("n_secret"), F.explode(F.array(*(F.col("cell") + k for k in (-1, 0, 1)))).alias("n_cell"))
    meets = F.col("e_id").eqNullSafe(F.col("n_id")) & (F.col("e_digest") == F.col("n_digest")) & (F.col("cell") == F.col("n_cell"))
    in_scope = (F.col("least") <= F.col("free") + SCOPE) & (F.col("most") >= F.col("free") - SCOPE)
    weak = each.where(F.col("span.ord") >= len(BASE)).withColumn("secret", F.col("role") == "secret")
    pairs = [weak.where(mine).join(near.where(other), meets & in_scope, "left_semi") for mine, other in ((F.col("secret"), ~F.col("n_secret")), (~F.col("secret"), F.col("n_secret")))]
    return reduce(DataFrame.unionByName, pairs).groupBy("e_id", "e_digest").agg(F.collect_set("span").alias("extra"))


def with_spans(found: DataFrame, id_col: str) -> DataFrame:
    """``found`` with ``__spans``: its base spans and the linked weak ones by start, then kind.  Rows without a weak part are not moved."""
    alone, mixed = found.where(F.size("__weak") == 0), found.where(F.size("__weak") > 0)
    meets = F.col(id_col).eqNullSafe(F.col("e_id")) & (F.col("__digest") == F.col("e_digest"))
    mixed = mixed.join(linked(found, id_col), meets, "left")
    every = F.array_sort(F.concat("__base", F.coalesce("extra", F.array().cast(f"array<{SPAN}>"))))
    return alone.withColumn("__spans", F.col("__base")).unionByName(mixed.withColumn("__spans", every).drop("e_id", "e_digest", "extra"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, digest, ``base`` spans, and ``spans``: those and the linked weak ones, each by start, then kind."""
    rows = with_spans(table(parts(docs, text_col, [id_col]), "secret-parts"), id_col)
    return rows.select(id_col, F.col("__digest").alias("digest"), F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def listing(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with every span of ``scan`` replaced by MASK; overlapping spans become one.

    The texts are written once with their spans; only those with weak parts are dealt out for the link.
    """
    found = with_spans(table(parts(docs, text_col, docs.columns), "secret-texts"), id_col)
    text = F.col(text_col)

    def masked(marks: Column) -> Column:
        # a run of spans reads its stretch of the text only, as finding a position walks from the start
        def stretch(run: Column) -> Column:
            from_ = F.get(run, F.lit(0))["ended"]
            last = F.element_at(run, F.lit(-1))["span"]
            till = F.greatest(F.element_at(run, F.lit(-1))["ended"], last["start"])
            part = lambda own: F.array_join(F.transform(run, lambda m: F.when(m["span"]["start"] >= m["ended"], F.concat(own.substr(m["ended"] - from_ + 1, m["span"]["start"] - m["ended"]), F.lit(MASK)))), "")
            return bound(text.substr(from_ + 1, till - from_), part)

        end = F.greatest(F.element_at(marks, F.lit(-1))["ended"], F.element_at(marks, F.lit(-1))["span"]["end"])
        return F.concat(F.array_join(F.transform(runs(marks), stretch), ""), text.substr(end + 1, F.length(text)))

    ends = running_max(F.transform("__spans", lambda s: s["end"]))
    masked = bound(F.arrays_zip(F.col("__spans").alias("span"), ends.alias("ended")), masked)
    return found.withColumn(text_col, F.when(F.size("__spans") == 0, text).otherwise(masked)).select(*docs.columns)
