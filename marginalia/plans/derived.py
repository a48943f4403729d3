"""Audit tables derived from the driver's tables, in SQL that both engines read.

The driver's text carries no citations, so the inputs of the audit's operators
are computed from its columns.  ``{lines}`` stands for an ordered string
aggregate and ``{array}`` for splitting at a bar, which the two write
differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = ("customer", "orders", "lineitem", "part", "documents", "conversations")

SQL = {
    # papers with labels, some without a reference section, some without labels
    "papers": """
SELECT doc_id AS paper, coalesce(text, '')
  || CASE WHEN doc_id % 11 = 0 THEN ' (2020)' ELSE
     ' [' || CAST(doc_id % 90 + 1 AS STRING) || '-' || CAST(doc_id % 90 + 1 + doc_id % 7 AS STRING) || ', ' || CAST(doc_id % 50 + 1 AS STRING) || '] and ['
     || CAST(doc_id % 13 + 5 AS STRING) || '-' || CAST(doc_id % 60 + 1 AS STRING) || '] or [0' || CAST(doc_id % 9 + 1 AS STRING) || '] or [1-90]' END
  || CASE WHEN doc_id % 5 = 0 THEN '' ELSE chr(10) || '## ' || CASE WHEN doc_id % 2 = 0 THEN 'REFERENCES' ELSE 'Literature cited' END || chr(10) || '[99] x' END AS clean_md
FROM documents""",
    # reference strings of a customer's orders
    "ref_lines": """
SELECT o_custkey AS paper, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS ord, o_orderkey AS k,
  CASE o_orderkey % 6 WHEN 0 THEN 'Smith' WHEN 1 THEN 'Jones-Lee' WHEN 2 THEN 'O''Hara' WHEN 3 THEN '123' WHEN 4 THEN 'Du' ELSE 'Garcia' END
  || CASE WHEN o_orderkey % 2 = 0 THEN ' A,  Roe B. ' ELSE ', C. ' END || lower(o_orderpriority) || ' imaging of lancet volume ' || lower(o_orderstatus) || ' screening'
  || CASE o_orderkey % 5 WHEN 0 THEN ' (' || CAST(1990 + o_orderkey % 40 AS STRING) || ')' WHEN 1 THEN ' 2019 (2020)' WHEN 2 THEN '' WHEN 3 THEN ' (1234)' ELSE ' ' || CAST(1990 + o_orderkey % 40 AS STRING) END
  || CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' doi.org/10.1000/abc(' || CAST(o_orderkey % 500 AS STRING) || ').' WHEN 2 THEN ' (10.1234/xyz.' || CAST(o_orderkey % 500 AS STRING) || ').;'
     WHEN 3 THEN ' arXiv:2309.' || CAST(10000 + o_orderkey % 500 AS STRING) || 'v2' ELSE ' doi:10.1016/S0140-6736(13)0' || CAST(o_orderkey % 500 AS STRING) || '-X,' END AS raw
FROM orders""",
    "refs": """
SELECT paper, ord, CAST(CASE WHEN k % 17 = 0 THEN 1 ELSE ord END AS STRING) AS num, raw,
  CASE k % 7 WHEN 0 THEN 'retrieved' WHEN 1 THEN 'provided' WHEN 2 THEN 'paywalled' WHEN 3 THEN 'mismatch' WHEN 4 THEN 'no_doi' WHEN 5 THEN 'retrieved' ELSE 'error' END AS status,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 'unpaywall' END AS resolver, 'why ' || CAST(k % 4 AS STRING) AS reason, k
FROM (SELECT * FROM ref_lines) t""",
    # one text a paper: numbers in order, stray numbers, continuation lines, and papers of bullets
    "sections": """
SELECT paper, {lines} AS section FROM (
  SELECT paper, ord, CASE WHEN paper % 10 = 7 THEN CASE WHEN ord % 4 = 0 THEN 'wrapped ' || raw ELSE '- ' || raw END
    ELSE CASE WHEN k % 19 = 0 THEN CAST(ord + 5 AS STRING) || '. stray ' WHEN paper % 3 = 0 THEN '[' || CAST(ord AS STRING) || '] ' ELSE CAST(ord AS STRING) || '. ' END || raw || chr(10) || '  383 continued' END AS line
  FROM ref_lines) t GROUP BY paper""",
    # whole manuscripts as blocks: a heading, a text that cites, the reference list
    "drafts": """
SELECT paper, 0 AS seq, 1 AS page, 14.0 AS size, 'Rivers and their gauges, paper ' || CAST(paper AS STRING) AS text FROM (SELECT DISTINCT paper FROM ref_lines) t
UNION ALL SELECT DISTINCT paper, 1, 1, 9.0, 'Levels rose in spring [1, 2] and fell again in the long dry autumn [3], as the observers of every station on the river wrote. Some say so still.' FROM ref_lines
UNION ALL SELECT DISTINCT paper, 2, 2, 14.0, 'References' FROM ref_lines
UNION ALL SELECT paper, 2 + ord, 2, 9.0, CAST(ord AS STRING) || '. ' || raw FROM ref_lines""",
    "claim_rows": """
SELECT o_custkey AS paper, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS id,
  'claim on part ' || CAST(l_partkey AS STRING) AS claim,
  CASE l_linenumber WHEN 1 THEN 'Methods §2' WHEN 2 THEN 'Introduction ¶3' WHEN 3 THEN '§1' WHEN 4 THEN '' WHEN 5 THEN 'Table 2' ELSE 'Results § 4 ¶1' END AS location,
  CASE WHEN l_partkey % 13 = 0 THEN '' ELSE CAST(l_linenumber AS STRING) || '|' || CAST(l_partkey % 9 + 1 AS STRING) || CASE WHEN l_partkey % 4 = 0 THEN '|99' ELSE '' END END AS labels,
  CASE WHEN l_partkey % 29 = 0 THEN 'odd' WHEN l_returnflag = 'A' THEN 'supported' WHEN l_returnflag = 'R' THEN 'contradicted' WHEN l_linestatus = 'O' THEN 'partial' WHEN l_partkey % 2 = 0 THEN 'not_retrieved' ELSE 'unchecked' END AS verdict,
  'note ' || CAST(l_partkey % 5 AS STRING) AS note,
  CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'src-' || CAST(l_partkey % 5 AS STRING) END AS source_slug,
  CAST(l_quantity AS INT) % 6 AS source_page, 'block_000' || CAST(l_suppkey % 7 + 1 AS STRING) AS source_block,
  CASE WHEN l_partkey % 3 = 0 THEN 'evidence/' || CAST(l_partkey AS STRING) || '.png' WHEN l_partkey % 3 = 1 THEN '' ELSE NULL END AS evidence_image
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    # blocks as a flat reader gives them: a paper an order
    "raw_blocks": """
SELECT l_orderkey AS paper, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS seq,
  CASE WHEN l_suppkey % 23 = 0 THEN 1 ELSE 0 END AS type, l_linenumber AS page,
  l_quantity * 1.23417 AS x0, l_quantity * 2.5 AS y0, l_quantity * 1.23417 + 100 AS x1, l_quantity * 2.5 + 12.25 AS y1,
  CASE l_partkey % 6 WHEN 0 THEN 'References' WHEN 1 THEN 'Introduction ' || CAST(l_partkey AS STRING) WHEN 2 THEN ''
    ELSE repeat(p_name || ' ', CAST(1 + l_partkey % 17 AS INT)) || CAST(l_partkey AS STRING) END AS text,
  8.0 + CAST(l_quantity AS INT) % 9 AS size
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "layout_items": """
SELECT paper, seq, CASE seq % 7 WHEN 0 THEN 'DocItemLabel.PAGE_FOOTER' WHEN 1 THEN 'section_header' WHEN 2 THEN 'LABEL.List_Item' WHEN 3 THEN 'title' ELSE 'text' END AS label,
  CASE WHEN page = 4 THEN 'TableItem' WHEN page = 5 THEN 'PictureItem' ELSE 'TextItem' END AS kind, text, '| a | b |' AS table_md,
  CASE WHEN seq % 2 = 0 THEN ' Caption ' || CAST(seq AS STRING) ELSE '' END AS caption, CASE WHEN size = 9.0 THEN NULL ELSE page END AS page_no,
  CASE WHEN seq % 3 = 0 THEN NULL ELSE 800.0 END AS page_height, x0 AS l, y1 AS t, x1 AS r, y0 AS b, CASE WHEN seq % 2 = 0 THEN 'BOTTOMLEFT' ELSE 'TOPLEFT' END AS coord_origin
FROM (SELECT * FROM raw_blocks) t""",
    # results of a citation and a keyword search: a paper a brand
    "found": """
SELECT p_brand AS paper, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS ord, CASE WHEN p_partkey % 10 < 3 THEN 'citing' ELSE 'search' END AS via,
  CASE WHEN p_partkey % 37 = 0 THEN ' ..' ELSE p_name || '  number ' || CAST(p_partkey % 31 AS STRING) || '.' END AS title,
  CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 9 = 1 THEN 'n.d.' ELSE CAST(1990 + p_size AS STRING) || '-01' END AS pub_year,
  CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN NULL ELSE '10.1/P' || CAST(p_partkey % 23 AS STRING) END AS doi,
  CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END AS journal, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'J. ' || p_type END AS abbreviation,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Smith A, Roe B.' WHEN 2 THEN ' Jones-Lee C.' ELSE '123 X' END AS authors
FROM part""",
    "paper_ids": """
SELECT DISTINCT p_brand AS paper, 'Small  ring number 3.' AS paper_title, '10.1/P7' AS paper_doi, CASE WHEN p_brand = 'Brand#3' THEN NULL ELSE 2015 END AS paper_year FROM part""",
    "scout_refs": """
SELECT p_brand AS paper, '10.1/p' || CAST(p_partkey % 23 AS STRING) AS doi, 'smith-' || CAST(1990 + p_size AS STRING) AS slug FROM part WHERE p_partkey % 11 = 0""",
    # answers of a judge: fenced arrays, failures, answers without an array
    "answers": """
SELECT CAST(conv_id AS BIGINT) AS paper, 'src-' || CAST(turn AS STRING) AS slug, CASE WHEN conv_id % 9 = 0 THEN NULL WHEN conv_id % 7 = 0 THEN 'no verdicts here' ELSE
  '```json' || chr(10) || '[{{"id": 1, "verdict": "supported", "note": "first"}}, {{"id": ' || CAST(2 + conv_id % 3 AS STRING) || ', "note": "n' || CAST(turn AS STRING) || '", "source_page": ' || CAST(turn AS STRING)
  || '}}, {{"id": 1, "verdict": "partial", "source_block": "block_0002"}}]' || chr(10) || '```' END AS raw, CASE WHEN conv_id % 9 = 0 THEN 'RuntimeError: timed out' ELSE NULL END AS error
FROM conversations""",
    # downloads and lookups of each reference
    "downloads": """
SELECT paper, ord, source, CASE WHEN (k + n) % 4 = 0 THEN 404 ELSE 200 END AS http_status, (k + n) % 5 <> 0 AS is_pdf,
  CASE (k + n) % 3 WHEN 0 THEN '' WHEN 1 THEN 'Imaging  of lancet screening study' ELSE 'wholly other words' END AS first_page
FROM (SELECT paper, ord, k FROM ref_lines) t CROSS JOIN (SELECT 'arxiv' AS source, 0 AS n UNION ALL SELECT 'unpaywall', 1 UNION ALL SELECT 'europepmc', 2) s WHERE k % (n + 2) = 0""",
    "lookups": """
SELECT paper, ord, CASE WHEN k % 2 = 0 THEN '10.5555/found.' || CAST(k % 100 AS STRING) ELSE NULL END AS crossref_doi, CASE WHEN k % 11 = 0 THEN 'ReadTimeout' ELSE NULL END AS lookup_error FROM ref_lines""",
    "files": """
SELECT c_custkey AS paper, CASE c_custkey % 4 WHEN 0 THEN 'SMITH-et-al-1994-method.pdf' WHEN 1 THEN 'garcia-2019.pdf' WHEN 2 THEN 'jones-lee-1999.pdf' ELSE 'b.pdf' END AS name FROM customer
UNION ALL SELECT c_custkey, 'a-smith-1994-2019.pdf' FROM customer""",
}

#: Tables that others of the list are made from.
_USES = {"refs": ["ref_lines"], "drafts": ["ref_lines"], "sections": ["ref_lines"], "layout_items": ["raw_blocks"], "downloads": ["ref_lines"], "lookups": ["ref_lines"]}

LINES = {"spark": "listagg(line, chr(10)) WITHIN GROUP (ORDER BY ord)", "duckdb": "string_agg(line, chr(10) ORDER BY ord)"}


#: A table of one select whose second column numbers the rows of a paper.
_NUMBERED = re.compile(r"\s*SELECT (?P<key>\w+) AS paper, (?P<number>CAST\(row_number\(\) OVER \([^()]*\) AS INT\)) AS (?P<n>\w+),(?P<rest>.*)\nFROM (?P<tables>[^()]*)", re.DOTALL)


def _text(name: str, engine: str) -> str:
    text = SQL[name].replace("{lines}", LINES[engine]).replace("{{", "{").replace("}}", "}")
    numbered = _NUMBERED.fullmatch(text) if engine == "spark" else None
    if not numbered:
        return text
    # Spark makes the columns beside a window before it shuffles for it: here the
    # driver's narrow columns are moved, and the texts made once they are numbered
    return "SELECT paper, {n}, {rest} FROM (SELECT *, {key} AS paper, {number} AS {n} FROM {tables}) t".format(**numbered.groupdict())


def ctes(*names: str, engine: str = "duckdb") -> str:
    """WITH clause of derived tables and what they are made from."""
    order = list(dict.fromkeys(x for n in names for x in [*_USES.get(n, []), n]))
    return "WITH " + ",\n".join(f"{n} AS ({_text(n, engine)})" for n in order)


def _views(spark: SparkSession, sf_dir: str, name: str) -> None:
    """The driver's tables that a derived one is made from."""
    uses = [*_USES.get(name, []), name]
    for t in {t for u in uses for t in DRIVER_TABLES if f" {t}" in SQL[u]}:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table."""
    _views(spark, sf_dir, name)
    return spark.sql(f"{ctes(name, engine='spark')} SELECT * FROM {name}")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with their parsed fields."""
    from ..operators.references import entry_fields

    return entry_fields(table(spark, sf_dir, "refs")).drop("k").withColumn("pdf_path", F.concat(F.lit("in/"), F.col("num"), F.lit(".pdf")))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with their labels as an array."""
    rows = table(spark, sf_dir, "claim_rows")
    none = F.array().cast("array<string>")
    labels = F.when(F.col("labels") == "", none).otherwise(F.split("labels", r"\|"))
    phrases = F.array(F.concat(F.lit("part "), F.substring_index("claim", " ", -1)))
    return rows.withColumn("refs", labels).withColumn("anchor_phrases", phrases).drop("labels")


def raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxed(table(spark, sf_dir, "raw_blocks"))


def _boxed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bbox", F.struct("x0", "y0", "x1", "y1")).drop("x0", "y0", "x1", "y1")


def ordered_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The rows of ``raw_blocks`` with the columns that they were numbered by, and the names of these.

    The numbering is by ``paper`` itself, so what it has dealt out and sorted
    serves all that follows by paper in that order: the texts, made after it,
    are neither shuffled nor sorted.
    """
    parts = _NUMBERED.fullmatch(_text("raw_blocks", "duckdb")).groupdict()
    order = re.search(r"ORDER BY ([^()]*)\)", parts["number"])[1]
    parts["number"] = parts["number"].replace(f"PARTITION BY {parts['key']} ", "PARTITION BY paper ")
    _views(spark, sf_dir, "raw_blocks")
    rows = spark.sql("SELECT paper, {n}, {rest}, {order} FROM (SELECT *, {number} AS {n} FROM (SELECT *, {key} AS paper FROM {tables}) t) t".format(order=order, **parts))
    return _boxed(rows), order.split(", ")
