"""Pieces of DuckDB SQL that several oracles share; written apart from the Spark operators."""

from .derived import ctes

DOI_FOUND = r"""regexp_extract(raw, '10\.\d{4,9}/[^\s"''<>]+')"""
CUT = f"rtrim({DOI_FOUND}, '.,;')"
_OVER = "(length({0}) - length(replace({0}, ')', ''))) > (length({0}) - length(replace({0}, '(', '')))"
DOI = f"nullif(CASE WHEN {CUT} LIKE '%)' AND {_OVER.format(CUT)} THEN rtrim({CUT}[:-2], '.,;') ELSE {CUT} END, '')"
YEAR = r"nullif(translate(regexp_extract(raw, '\((\d{4})\)|\b(?:19|20)\d{2}\b'), '()', ''), '')"
NAME = r"lower(regexp_replace(regexp_extract(trim({0}), '^[^,\s]*'), '[^A-Za-z\-]', '', 'g'))"
SLUG = f"coalesce(nullif({NAME.format('raw')}, ''), 'ref') || coalesce('-' || {YEAR}, '')"
SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
STOP = "['commun','nature','science','journal','lancet','article','elsevier','springer','wiley','volume','press','https']"
KEYWORD_STOP = "['the','and','for','with','from','into','using','based','toward','towards','study','analysis','review','novel','between','among','their','this','that','after','before','during','versus']"
TOKENS = f"list_filter(list_distinct(regexp_extract_all(lower(raw), '[a-z]{{5,}}')), lambda x: NOT list_contains({STOP}, x))"
NORM = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
SECTION = "coalesce(nullif(trim(split_part(split_part(location, '§', 1), '¶', 1)), ''), 'Other')"
LABELS = "CASE WHEN labels = '' THEN [] ELSE string_split(labels, '|') END"
GAP = "verdict IN ('not_retrieved', 'unchecked')"
READY = "status IN ('retrieved', 'provided')"


def with_(*parts: str, names: tuple[str, ...] = ()) -> str:
    """WITH clause: derived tables, then further ones given as ``name AS (…)``."""
    return ctes(*names) + "".join(",\n" + p for p in parts)


ENTRIES = f"e AS (SELECT paper, ord, num, raw, status, resolver, reason, {DOI} AS doi, {YEAR} AS year, {SLUG} AS slug FROM refs)"
#: Labels of each paper's body, as numbers written out.
LABEL_ROWS = r"""
body AS (SELECT paper, regexp_split_to_array(clean_md, '(?im)^##\s+(references|bibliography|literature)\b')[1] AS body FROM papers),
grp AS (SELECT paper, unnest(regexp_extract_all(body, '\[(\d{1,3}(?:\s*[,–—-]\s*\d{1,3})*)\]', 1)) AS g FROM body),
piece AS (SELECT paper, trim(unnest(regexp_split_to_array(g, '\s*,\s*'))) AS p FROM grp),
ends AS (SELECT paper, p, try_cast(regexp_extract(p, '^(\d{1,3})\s*[–—-]\s*(\d{1,3})$', 1) AS INT) AS lo, try_cast(regexp_extract(p, '^(\d{1,3})\s*[–—-]\s*(\d{1,3})$', 2) AS INT) AS hi FROM piece),
lab AS (SELECT DISTINCT paper, label FROM (
  SELECT paper, CAST(unnest(range(lo, hi + 1)) AS VARCHAR) AS label FROM ends WHERE lo <= hi AND hi - lo <= 50
  UNION ALL SELECT paper, p FROM ends WHERE lo IS NULL AND regexp_full_match(p, '\d+')) t)""".strip()
CITED = f"cited AS (SELECT DISTINCT paper, unnest({LABELS}) AS label FROM claim_rows)"
BLOCKS = """
b0 AS (SELECT * FROM raw_blocks WHERE type = 0 AND text <> ''),
bs AS (SELECT paper, coalesce(median(size) FILTER (WHERE length(text) > 80), 10.0) AS body FROM b0 GROUP BY paper),
b1 AS (SELECT b0.*, size > body * 1.12 AND length(text) <= 120 AS opens FROM b0 JOIN bs USING (paper)),
b AS (SELECT paper, seq, 'block_' || lpad(CAST(row_number() OVER (PARTITION BY paper ORDER BY seq) AS VARCHAR), 4, '0') AS id, CASE WHEN opens THEN 'sectionheader' ELSE 'text' END AS type, page,
  round(x0, 2) AS x0, round(y0, 2) AS y0, round(x1, 2) AS x1, round(y1, 2) AS y1, text,
  coalesce(last_value(CASE WHEN opens THEN text END IGNORE NULLS) OVER (PARTITION BY paper ORDER BY seq ROWS UNBOUNDED PRECEDING), '') AS heading FROM b1)""".strip()
#: First entry of each number, and labels of each claim with it.
ROUTES = f"""
{ENTRIES},
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY paper, num ORDER BY ord) = 1),
cl AS (SELECT paper, id, unnest({LABELS}) AS num, generate_subscripts({LABELS}, 1) - 1 AS pos FROM claim_rows),
cf AS (SELECT cl.*, f.status, f.slug FROM cl LEFT JOIN f USING (paper, num)),
r AS (SELECT c.paper, c.id, min_by(slug, pos) FILTER (WHERE {READY} AND slug <> '') AS source_slug, string_agg(DISTINCT status, ', ' ORDER BY status) AS why FROM claim_rows c LEFT JOIN cf USING (paper, id) GROUP BY c.paper, c.id)""".strip()
HITS = rf"""
h AS (SELECT paper, ord, via, rtrim({SQUEEZE.format("coalesce(title, '')")}, '.') AS title, try_cast(left(pub_year, 4) AS INT) AS year, lower(coalesce(doi, '')) AS doi,
  coalesce(nullif(journal, ''), nullif(abbreviation, ''), '') AS journal, coalesce(authors, '') AS authors FROM found),
hk AS (SELECT *, list_distinct(list_filter([doi, {NORM.format('title')}], lambda x: x <> '')) AS ks, row_number() OVER (PARTITION BY paper ORDER BY CASE via WHEN 'citing' THEN 0 ELSE 1 END, ord) AS n FROM h),
fold AS (
  SELECT paper, CAST(0 AS BIGINT) AS n, list_distinct(list_filter([lower(paper_doi), {NORM.format('paper_title')}], lambda x: x <> '')) AS seen, false AS kept FROM paper_ids
  UNION ALL
  SELECT hk.paper, hk.n, CASE WHEN len(ks) = 0 OR list_has_any(ks, seen) THEN seen ELSE list_distinct(list_concat(seen, ks)) END, len(ks) > 0 AND NOT list_has_any(ks, seen) FROM fold JOIN hk ON hk.paper = fold.paper AND hk.n = fold.n + 1
),
kept AS (SELECT hk.*, paper_year FROM hk JOIN fold USING (paper, n) JOIN paper_ids USING (paper) WHERE kept),
split AS (SELECT *, via = 'citing' OR (coalesce(paper_year, 0) <> 0 AND year > paper_year) AS newer FROM kept WHERE via = 'citing' OR year IS NOT NULL),
un AS (SELECT * FROM split s WHERE NOT newer AND NOT EXISTS (SELECT 1 FROM scout_refs r WHERE r.paper = s.paper AND (r.doi = s.doi OR
  (s.authors <> '' AND coalesce(s.year, 0) <> 0 AND {NAME.format('s.authors')} <> '' AND r.slug = {NAME.format('s.authors')} || '-' || CAST(s.year AS VARCHAR)))))""".strip()
SCOUT = ("found", "paper_ids", "scout_refs")
FOUND = "SELECT paper, ord, via, title, year, doi, journal, authors"
