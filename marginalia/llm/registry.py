"""Queries and SQL of this folder's operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, hilbert_ann, license_scan, merkle, mixing, ngram_join, quality_classifier, quality_rules, secret_scan, sharding, token_alignment, token_counts
from .store import drop_path, new_path, read, table, temporary

Query = Callable[[SparkSession, str], DataFrame]


#: Arrivals in which op1 appends the documents, and bytes of a full file there.
ARRIVALS, FULL_FILE = 8, 64 << 20


def _only(rows: DataFrame, *paths: str) -> DataFrame:
    """``rows`` as a table that stays; the folders that they come from go."""
    spark = rows.sparkSession
    out = table(rows, "result", keep=True)
    for path in paths:
        drop_path(spark, path)
    return out


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "shards")
    store = sharding.ShardStore(spark, path, FULL_FILE)
    for arrival in sharding.arrivals(read(spark, sf_dir, "documents"), "doc_id", ARRIVALS):
        store.append(arrival)
    store.compact()
    store.vacuum(grace=0)  # no other writer has this folder
    rows = store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))
    return _only(rows, path)


OP1_SQL = "SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents"


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"), n=3, percent=90)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    with temporary(spark):
        rows = table(quality_classifier.featurize(read(spark, sf_dir, "documents")), "features")
        return _only(quality_classifier.classify(rows, read(spark, sf_dir, "labels")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = byte_bpe.round_trip(read(spark, sf_dir, "documents"), path, pattern)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model, cache = read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), new_path(spark, "token-cache")
    # an earlier call has counted the first arrival, so that the whole table meets a cache with hits and misses
    with temporary(spark):
        token_counts.count_tokens(sharding.arrivals(docs, "doc_id", 2)[0], model, cache)
        rows = token_counts.count_tokens(docs, model, cache)
        return _only(rows.withColumn("over_limit", F.col("n_tokens") > 4096), cache)


#: A conversation whose texts hold the template's own control strings.
CONFLICT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(CONFLICT, "conv_id long, turn long, role string, text string"))
    return chat_format.digests(chat_format.format_conversations(rows))


_REST = r"(/?INST\]|/s>|</?SYS>>|</ROLE>>|<ROLE:[0-9A-F]*>>)"
OP7_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 WHEN 'system' THEN 15 ELSE 18 + 2 * strlen(role) END AS marks,
    regexp_matches(text, '[\[<]\\+{_REST}') OR CASE role
      WHEN 'user' THEN contains(text, ' [/INST]')
      WHEN 'system' THEN contains(text, '<</SYS>>')
      WHEN 'assistant' THEN contains(text, '</s>') OR starts_with(text, '<<SYS>>') AND contains(text, '<</SYS>>')
        OR starts_with(text, '[INST] ') AND contains(substr(text, 8), ' [/INST]')
        OR regexp_matches(text, '(?s)^<<ROLE:[0-9A-F]*>>.*<</ROLE>>')
      ELSE contains(text, '<</ROLE>>') END AS conflict
  FROM t
), f AS (
  SELECT *, marks + length(CASE WHEN conflict THEN regexp_replace(text, '([\[<])(\\*){_REST}', '\1\\\2\3', 'g') ELSE text END) AS shown FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


#: Target weights of the mixture; a source that is not named shares the rest.
WEIGHTS = {"src0": 0.15} | {f"src{k}": 0.045 for k in range(1, 19)} | {"src19": 0.03}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source"), WEIGHTS)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies and ablations come from the stored ledger; n_only: documents that ``only_rule`` alone rejects."""
    stored = quality_rules.store(read(spark, sf_dir, "documents"), new_path(spark, "rule-ledger"))
    rows = quality_rules.apply_policy(quality_rules.apply_policy(stored, "v1"), "v2", "kept_v2").withColumn("only_rule", quality_rules.only_rule("v1"))
    only = quality_rules.ablations(stored, "v1").select(F.col("rule").alias("only_rule"), "n_only")
    rows = rows.join(F.broadcast(only), "only_rule", "left")  # a row a rule
    base = F.lit(quality_rules.mask("base")).cast("long")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed").bitwiseAND(base) != 0).alias("base_failed"), "kept", "failed", "kept_v2", "only_rule", "n_only")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    with temporary(spark):
        return _only(_op10(secret_scan.scan(read(spark, sf_dir, "documents"))))


def _op10(rows: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["ord"] == secret_scan.ORDER[kind])).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, secret_scan.BASE), F.sha2(secret_scan.listing(F.col("base")), 256).alias("base_sha256"), secret_scan.listing(F.col("spans")).alias("spans"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    with token_alignment.aligned(read(spark, sf_dir, "documents"), a, b) as rows:
        digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
        return table(rows.withColumn("groups_sha256", digest).drop("groups"), "alignment-digests", keep=True)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan.scan(read(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first_word"], s["last_word"], s["errors"])), ",")
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score", shown.alias("spans"))


_LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, and what tampering with a third of them does to the root."""
    docs = read(spark, sf_dir, "documents")
    fields = [F.col(c) for c in _LEAF]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf(*fields[:-1], lowered))
    with temporary(spark):
        manifest = merkle.build(docs, fields, F.col("lang"), F.col("doc_id"), F.struct("doc_id", tampered.alias("tampered")))
        root = F.lit(manifest.root).cast("string")
        again = merkle.folded(F.coalesce("item.tampered", "leaf"), F.col("path"))
        rows = manifest.proofs().select("item.doc_id", "leaf", "subroot", root.alias("root"), F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), again.alias("folded_root"))
        return table(rows.withColumn("verified", F.col("folded_root") == F.col("root")), "proofs", keep=True)


def _op11_sql(height: int = 8) -> str:
    """Levels written out, as many as 8 ** height leaves take; a node that is alone stays as it is."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    hashed = lambda last: "sha256(" + " || ".join([*map(part, _LEAF[:-1]), part(last)]) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = ["WITH RECURSIVE crc AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8)"]
    out.append("steps AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8)")
    state = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]))"
    out.append(f"d AS (SELECT doc_id, lang, {hashed('text')} AS leaf, CASE WHEN xor({state}, 4294967295) % 3 = 0 THEN {hashed(lowered)} ELSE {hashed('text')} END AS fold FROM documents, steps)")
    out.append("a0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM d)")

    def climb(prefix: str, by: str, on: str) -> None:
        for k in range(height):
            out.append(f"{prefix}n{k} AS (SELECT {by}, i, h, count(*) OVER (PARTITION BY {by}) AS n FROM (SELECT DISTINCT {by}, i, h FROM {prefix}{k}))")
            out.append(f"{prefix}p{k} AS (SELECT {by}, i // 8 AS p, max(n) AS n, list(h ORDER BY i) AS c, CASE WHEN max(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS up FROM {prefix}n{k} GROUP BY {by}, i // 8)")
            proof = "CASE WHEN n = 1 THEN '' ELSE array_to_string(list_concat(c[1 : x.i % 8], c[x.i % 8 + 2 : 8]), '') END"
            fold = "CASE WHEN n = 1 THEN x.fold ELSE sha256(array_to_string(list_concat(c[1 : x.i % 8], [x.fold], c[x.i % 8 + 2 : 8]), '')) END"
            kept = "doc_id, leaf, x.lang" + (", subroot" if prefix == "b" else "")
            seen = "''" if (prefix, k) == ("a", 0) else "x.proof"
            out.append(f"{prefix}{k + 1} AS (SELECT {kept}, p.p AS i, up AS h, {seen} || {proof} AS proof, {fold} AS fold FROM {prefix}{k} x JOIN {prefix}p{k} p ON {on} AND x.i // 8 = p.p)")

    climb("a", "lang", "x.lang IS NOT DISTINCT FROM p.lang")
    out.append(f"b0 AS (SELECT doc_id, leaf, '' AS lang, h AS subroot, h, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, proof, fold FROM a{height})")
    climb("b", "lang", "x.lang = p.lang")
    return ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM b{height}"


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
OP2_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3) t
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY x, y
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 90 * (a.n + b.n - shared)
), e AS (
  SELECT x, y FROM l UNION SELECT y, x FROM l
), r AS (
  SELECT x AS doc_id, y AS other FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""

OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i : i + 4], ' ')) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5) t
), c AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g CROSS JOIN range(5) r(k) WHERE n > 1 GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters FROM d LEFT JOIN c USING (doc_id)
), f AS (
  SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END + CASE WHEN 10 * word_chars < 20 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END + CASE WHEN 100 * n_upper > 60 * greatest(n_letters, 1) THEN 64 ELSE 0 END AS BIGINT) AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed % 4 <> 0 AS base_failed, failed = 0 AS kept, failed, failed & 55 = 0 AS kept_v2,
  CASE failed {" ".join(f"WHEN {1 << k} THEN '{name}'" for k, name in enumerate(quality_rules.POLICIES["v1"]))} END AS only_rule,
  CASE WHEN failed IN (1, 2, 4, 8, 16, 32, 64) THEN count(*) OVER (PARTITION BY failed) END AS n_only FROM f
"""


def queries() -> dict[str, Query]:
    return {
        "op1_sharding": op1_sharding,
        "op2_ngram_join": op2_ngram_join,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_hilbert_ann": op5_hilbert_ann,
        "op6_token_counts": op6_token_counts,
        "op7_chat_format": op7_chat_format,
        "op8_mixing": op8_mixing,
        "op9_quality_rules": op9_quality_rules,
        "op10_secret_scan": op10_secret_scan,
        "op11_merkle": op11_merkle,
        "op12_token_alignment": op12_token_alignment,
        "op13_license_scan": op13_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": OP1_SQL,
        "op2_ngram_join": OP2_SQL,
        "op7_chat_format": OP7_SQL,
        "op9_quality_rules": OP9_SQL,
        "op11_merkle": _op11_sql(),
    }
