"""Queries of the scalar functions (F), label functions and set operations (U), with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import judgement as J
from ..functions import labels as L
from ..functions import text as T
from ..operators import coverage as V
from ..operators import merged as MG
from ..operators import scout
from . import derived as D
from . import sql as Q


def _scalar(name: str, keys: list[str], columns: Callable[[], dict[str, Column]]):
    """Some expressions over a derived table; made when asked for, as columns need a session."""
    return lambda spark, sf_dir: D.table(spark, sf_dir, name).select(*keys, *(c.alias(k) for k, c in columns().items()))


def _coverage(spark, sf_dir):
    return V.coverage_audit(D.table(spark, sf_dir, "papers"), D.claims(spark, sf_dir))


def _labels(fn):
    return lambda spark, sf_dir: fn(D.table(spark, sf_dir, "papers"), D.claims(spark, sf_dir))


def _rows(how):
    return _labels(lambda texts, claims: V.covered_rows(texts, claims, how))


_c = F.col
_RAW = ["paper", "ord"]
_REF = lambda expr, name: f"{Q.ctes('ref_lines')} SELECT paper, ord, {expr} AS {name} FROM ref_lines"
_FOUND = lambda expr, name: f"{Q.ctes('found')} SELECT paper, ord, {expr} AS {name} FROM found"
_LAB = Q.with_(Q.LABEL_ROWS, Q.CITED, names=("papers", "claim_rows"))
_NUM = "ORDER BY CAST(label AS INT), label"
_BY = lambda cond: f"coalesce(list(label {_NUM}) FILTER (WHERE {cond}), [])"
_AUDIT = f"""{Q.with_(Q.LABEL_ROWS, Q.CITED, names=("papers", "claim_rows"))},
j AS (SELECT papers.paper, lab.label, cited.label IS NOT NULL AS is_covered FROM papers LEFT JOIN lab USING (paper) LEFT JOIN cited ON cited.paper = lab.paper AND cited.label = lab.label),
a AS (SELECT paper, {_BY('label IS NOT NULL')} AS labels_in_text, {_BY('label IS NOT NULL AND is_covered')} AS covered, {_BY('label IS NOT NULL AND NOT is_covered')} AS missing FROM j GROUP BY paper)
SELECT paper, labels_in_text, covered, missing, CASE WHEN len(labels_in_text) = 0 THEN 'not audited' WHEN len(missing) > 0 THEN 'missing' ELSE 'all covered' END AS status FROM a"""
_BOX = "l, t, r, b"
_FLIP = "CASE WHEN coord_origin LIKE '%BOTTOM%' THEN coalesce(page_height, 842.0) - {0} ELSE {0} END"
_FENCED = f"{Q.ctes('answers')} SELECT paper, slug, raw, "


def _audit_columns(*cols: str):
    return lambda spark, sf_dir: _coverage(spark, sf_dir).select("paper", *cols)


def _region(spark, sf_dir):
    rows = D.table(spark, sf_dir, "raw_blocks").select("paper", "seq", F.struct("x0", "y0", "x1", "y1").alias("r"))
    return rows.select("paper", "seq", G.padded(_c("r"), F.lit(150.0), F.lit(120.0)).alias("p")).select("paper", "seq", "p.*", G.zoom(_c("p")).alias("zoom"))


def _flip(spark, sf_dir):
    rows = D.table(spark, sf_dir, "layout_items")
    return rows.select("paper", "seq", G.to_top_left(*map(_c, ("l", "t", "r", "b", "coord_origin", "page_height"))).alias("b")).select("paper", "seq", "b.*")


QUERIES = {
    "coverage_audit": (_coverage, _AUDIT),
    "A11_coverage_bits": (lambda s, d: MG.coverage_by_bits(D.table(s, d, "papers"), MG.cited_bits(D.claims(s, d))), _AUDIT),
    "F1_squeeze": (_scalar("ref_lines", _RAW, lambda: dict(text=T.squeeze(_c("raw")))), _REF(Q.SQUEEZE.format("raw"), "text")),
    "F2_doi": (_scalar("ref_lines", _RAW, lambda: dict(doi=T.doi(_c("raw")))), _REF(Q.DOI, "doi")),
    "W8_doi_repair": (lambda s, d: D.table(s, d, "ref_lines").select("paper", "ord", T.doi(_c("raw")).alias("doi"), T.doi_repaired(_c("raw")).alias("repaired")), f"{Q.ctes('ref_lines')} SELECT paper, ord, {Q.DOI} AS doi, coalesce({Q.DOI} <> {Q.CUT}, false) AS repaired FROM ref_lines"),
    "F3_year": (_scalar("ref_lines", _RAW, lambda: dict(year=T.year(_c("raw")))), _REF(Q.YEAR, "year")),
    "F4_arxiv": (_scalar("ref_lines", _RAW, lambda: dict(arxiv=T.arxiv_id(_c("raw")))), _REF(r"nullif(regexp_extract(raw, '(?i)arxiv[:\s]*(\d{4}\.\d{4,5})(v\d+)?', 1), '')", "arxiv")),
    "F5_slug": (_scalar("ref_lines", _RAW, lambda: dict(slug=T.slug(_c("raw"), T.year(_c("raw"))))), _REF(Q.SLUG, "slug")),
    "F6_marker": (
        lambda s, d: D.table(s, d, "sections").select("paper", F.posexplode(F.split("section", "\n")).alias("line", "t")).select("paper", "line", F.regexp_extract("t", r"(?U)^\s*\[?(\d{1,3})[\].:]?\s+", 1).alias("marker")),
        rf"{Q.ctes('sections')} SELECT paper, CAST(generate_subscripts(string_split(section, chr(10)), 1) - 1 AS INT) AS line, regexp_extract(unnest(string_split(section, chr(10))), '^\s*\[?(\d{{1,3}})[\].:]?\s+', 1) AS marker FROM sections",
    ),
    "F7_label_groups": (
        lambda s, d: D.table(s, d, "papers").select("paper", F.explode(L.label_groups(L.body(_c("clean_md")))).alias("label_group")),
        f"{_LAB} SELECT paper, g AS label_group FROM grp",
    ),
    "F8_expand": (
        lambda s, d: D.table(s, d, "papers").select("paper", F.explode(F.flatten(F.transform(L.label_groups(L.body(_c("clean_md"))), L.expand_group))).alias("label")),
        f"{_LAB} SELECT paper, CAST(unnest(range(lo, hi + 1)) AS VARCHAR) AS label FROM ends WHERE lo <= hi AND hi - lo <= 50 UNION ALL SELECT paper, p FROM ends WHERE lo IS NULL",
    ),
    "F9_year_number": (_scalar("found", _RAW, lambda: dict(year=T.year_number(_c("pub_year")))), _FOUND("try_cast(left(pub_year, 4) AS INT)", "year")),
    "F10_norm_title": (_scalar("found", _RAW, lambda: dict(norm=T.norm_title(_c("title")))), _FOUND(Q.NORM.format("title"), "norm")),
    "F11_hit": (
        lambda s, d: scout.hits(D.table(s, d, "found")),
        f"{Q.with_(Q.HITS, names=Q.SCOUT).replace('WITH', 'WITH RECURSIVE', 1)} {Q.FOUND} FROM h",
    ),
    "F12_keys": (_scalar("found", _RAW, lambda: dict(ks=F.array_sort(T.hit_keys(F.lower(_c("doi")), T.hit_title(_c("title")))))), f"{Q.with_(Q.HITS, names=Q.SCOUT).replace('WITH', 'WITH RECURSIVE', 1)} SELECT paper, ord, list_sort(ks) AS ks FROM hk"),
    "F13_author_year": (
        _scalar("found", _RAW, lambda: dict(author_year=T.author_year_key(_c("authors"), T.year_number(_c("pub_year"))))),
        _FOUND(f"CASE WHEN authors <> '' AND {Q.NAME.format('authors')} <> '' THEN {Q.NAME.format('authors')} || '-' || CAST(try_cast(left(pub_year, 4) AS INT) AS VARCHAR) END", "author_year"),
    ),
    "F14_title_tokens": (_scalar("ref_lines", _RAW, lambda: dict(tokens=F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("raw"), F.lit("[a-z]{5,}"), F.lit(0)))))), _REF("list_sort(list_distinct(regexp_extract_all(lower(raw), '[a-z]{5,}')))", "tokens")),
    "U4_stopwords": (_scalar("ref_lines", _RAW, lambda: dict(tokens=F.array_sort(T.title_tokens(_c("raw"))))), _REF(f"list_sort({Q.TOKENS})", "tokens")),
    "F16_section": (_scalar("claim_rows", ["paper", "id"], lambda: dict(section=T.section_key(_c("location")))), f"{Q.ctes('claim_rows')} SELECT paper, id, {Q.SECTION} AS section FROM claim_rows"),
    "F17_json_array": (
        lambda s, d: D.table(s, d, "answers").select("paper", "slug", "raw", F.size(J.json_array(_c("raw"))).alias("n")).select("paper", "slug", "raw", F.when(_c("n") >= 0, _c("n")).alias("n")),
        _FENCED + "CASE WHEN raw LIKE '%[%' THEN 3 END AS n FROM answers",
    ),
    "F19_top_left": (_flip, f"{Q.ctes('layout_items')} SELECT paper, seq, round(l, 2) AS x0, round(least({_FLIP.format('t')}, {_FLIP.format('b')}), 2) AS y0, round(r, 2) AS x1, round(greatest({_FLIP.format('t')}, {_FLIP.format('b')}), 2) AS y1 FROM layout_items"),
    "F20_region": (
        _region,
        f"{Q.ctes('raw_blocks')}, p AS (SELECT paper, seq, greatest(x0 - 6, 0.0) AS x0, greatest(y0 - 6, 0.0) AS y0, least(x1 + 6, 150.0) AS x1, least(y1 + 6, 120.0) AS y1 FROM raw_blocks) SELECT *, least(8.0, greatest(2.0, 2400.0 / greatest(x1 - x0, 1.0))) AS zoom FROM p",
    ),
    "F21_crop_name": (_scalar("claim_rows", ["paper", "id"], lambda: dict(file=G.crop_name(_c("id"), _c("source_slug"), _c("source_page")))), f"{Q.ctes('claim_rows')} SELECT paper, id, 'claim_' || lpad(CAST(id AS VARCHAR), CAST(greatest(2, length(CAST(id AS VARCHAR))) AS INT), '0') || '_' || source_slug || '_p' || CAST(source_page AS VARCHAR) || '.png' AS file FROM claim_rows"),
    "F22_verdict_label": (
        _scalar("claim_rows", ["paper", "id"], lambda: dict(label=J.verdict_label(_c("verdict")))),
        f"{Q.ctes('claim_rows')} SELECT paper, id, CASE verdict {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in J.LABELS.items())} ELSE upper(verdict) END AS label FROM claim_rows",
    ),
    "F23_preview": (_scalar("papers", ["paper"], lambda: dict(preview=T.preview(_c("clean_md")))), f"{Q.ctes('papers')} SELECT paper, left(clean_md, 100) AS preview FROM papers"),
    "F24_query": (
        _scalar("found", _RAW, lambda: dict(query=T.search_query(_c("title")), safe=T.safe_title(_c("title")))),
        f"{Q.ctes('found')} SELECT paper, ord, array_to_string(list_filter(regexp_extract_all(lower(title), '[A-Za-z][A-Za-z\\-]{{3,}}'), lambda x: NOT list_contains({Q.KEYWORD_STOP}, x))[1:4], ' AND ') AS query, trim(replace(title, '\"', ' ')) AS safe FROM found",
    ),
    "T4_keywords": (
        _scalar("found", _RAW, lambda: dict(keywords=T.keywords(_c("title")))),
        _FOUND(f"list_filter(regexp_extract_all(lower(title), '[A-Za-z][A-Za-z\\-]{{3,}}'), lambda x: NOT list_contains({Q.KEYWORD_STOP}, x))[1:4]", "keywords"),
    ),
    "F27_checker": (
        lambda s, d: D.table(s, d, "lookups").select("paper", "ord", J.checker(_c("crossref_doi"), _c("lookup_error")).alias("checker")),
        f"{Q.ctes('lookups')} SELECT paper, ord, 'model judge · ' || coalesce(crossref_doi, lookup_error, 'account default model') AS checker FROM lookups",
    ),
    "T7_cut": (_scalar("papers", ["paper"], lambda: dict(n=F.length(F.left("clean_md", F.lit(T.QUERY_CHARS))))), f"{Q.ctes('papers')} SELECT paper, CAST(least(length(clean_md), 250) AS INT) AS n FROM papers"),
    "P15_body": (_scalar("papers", ["paper"], lambda: dict(n=F.length(L.body(_c("clean_md"))))), f"{_LAB} SELECT paper, CAST(length(body) AS INT) AS n FROM body"),
    "P17_shorten": (_scalar("ref_lines", _RAW, lambda: dict(raw=T.shorten(_c("raw"), 80))), _REF("CASE WHEN length(raw) > 80 THEN left(raw, 80) || '…' ELSE raw END", "raw")),
    "A10_labels": (_labels(lambda texts, _: V.label_rows(texts)), f"{_LAB} SELECT paper, label FROM lab"),
    "A11_covered": (_labels(lambda _, claims: V.covered_labels(claims).select("paper", F.array_sort("cited").alias("cited"))), f"{_LAB} SELECT paper, list(label ORDER BY label) AS cited FROM cited GROUP BY paper"),
    "A16_coverage_counts": (
        lambda s, d: _coverage(s, d).select("paper", F.size("labels_in_text").cast("long").alias("n_text"), F.size("missing").cast("long").alias("n_missing"), "status"),
        f"SELECT paper, len(labels_in_text) AS n_text, len(missing) AS n_missing, status FROM ({_AUDIT}) t",
    ),
    "T1_label_order": (_labels(lambda texts, _: texts.select("paper", L.labels_in_text(_c("clean_md")).alias("labels"))), f"{_LAB} SELECT papers.paper, {_BY('label IS NOT NULL')} AS labels FROM papers LEFT JOIN lab USING (paper) GROUP BY papers.paper"),
    "J8_semi": (_rows("left_semi"), f"{_LAB} SELECT paper, label FROM lab SEMI JOIN cited USING (paper, label)"),
    "J8_anti": (_rows("left_anti"), f"{_LAB} SELECT paper, label FROM lab ANTI JOIN cited USING (paper, label)"),
    "U1_missing": (_audit_columns("missing"), f"SELECT paper, missing FROM ({_AUDIT}) t"),
    "U2_covered": (_audit_columns("covered"), f"SELECT paper, covered FROM ({_AUDIT}) t"),
    "U3_union": (
        _labels(lambda texts, claims: V.label_rows(texts).union(claims.select("paper", F.explode("refs"))).distinct()),
        f"{_LAB} SELECT paper, label FROM lab UNION SELECT paper, label FROM cited",
    ),
    "C8_not_audited": (lambda s, d: _coverage(s, d).where("status = 'not audited'").select("paper"), f"SELECT paper FROM ({_AUDIT}) t WHERE status = 'not audited'"),
}
