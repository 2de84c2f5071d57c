"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, lines, media, mixing, ngrams, quality, simhash, suffixes, toxicity
from .common import fold, shared_dir, table, text_of


def _hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, threshold=3)
    return groups.select("doc_id", _hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = quality.marked(labels, "quality").where(fold(F.col("doc_id"), 4) != 2)
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, marks), threshold=0.7)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    repeats = suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=50, keep_text=False)
    return repeats.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = quality.marked(labels, "toxic").where(fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, marks), threshold=0.5)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store(table(spark, sf_dir, "documents"), shared_dir(spark, "media")))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    made = chat.format_trees(chat.turns_as_tree(turns.unionByName(extra)))
    back = made.withColumn("parts", chat.parse(F.col("formatted")))
    said = F.array_join(F.transform("parts", lambda p: F.concat(chat.role_of(p), F.lit("\n"), chat.text_of_turn(p), F.lit("\n"))), "")
    masked = F.transform(F.arrays_zip("parts", "spans"), lambda z: chat.unescape(F.substring(z["parts"], z["spans"]["start"] - z["spans"]["begin"] - len(chat.START) + 1, z["spans"]["length"])))
    loss = back.withColumn("said", said).withColumn("loss", F.array_join(masked, ""))
    return loss.select("conv_id", F.size("parts").cast("long").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_CONTROL_SQL = r"(\\*(<\|im_start\|>|<\|im_end\|>|<\|im_sep\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>))"
OP6_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C')) + 1 + length(regexp_replace(text, '{_CONTROL_SQL}', '\\\1', 'g')) + 12)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    -ln((('0x' || substr(md5('17/' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / (0.1 + 0.9 * coalesce(length(regexp_replace(coalesce(text, ''), '[^\\p{Ll}\\x20\\x09-\\x0D]', '', 'g'))::DOUBLE / nullif(length(coalesce(text, '')), 0), 0)) AS k
  FROM documents),
s AS (
  SELECT source, sum(size) AS source_size, 3.0::DOUBLE * sum(size) AS most,
    [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
t AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER w, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weights
  FROM s WINDOW w AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, most <= rest / weights * weight AS stops, rest / weights AS level FROM t),
g AS (
  SELECT source, source_size, CASE WHEN stops THEN most ELSE weight * (SELECT max(level) FROM u WHERE NOT stops) END AS target FROM u),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS complete FROM g),
p AS (
  SELECT d.doc_id, size, source_size, target, complete, round(target - complete * source_size) AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, round(target, 6) AS target,
  (complete * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM p
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gone = lines.removals(docs).groupBy("row").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda p: p.cast("string")), ",").alias("removed"))
    rows = docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), F.size(F.split(text_of(), "\n", -1)).cast("long").alias("n_lines"))
    none = F.lit(0).cast("long")
    return rows.join(gone, "row", "left").select("doc_id", "n_lines", F.coalesce("n", none).alias("n_removed"), F.coalesce("chars", none).alias("removed_chars"), F.coalesce("removed", F.lit("")).alias("removed"))


OP8_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos
  FROM documents),
f AS (SELECT line, length(line) AS n, min((doc_id, pos)) AS first FROM l WHERE length(line) >= 24 GROUP BY line),
near AS (
  SELECT DISTINCT a.line FROM f a JOIN f b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND b.first < a.first AND levenshtein(a.line, b.line) <= 2),
gone AS (
  SELECT doc_id, pos, n FROM l JOIN f USING (line) LEFT JOIN near USING (line) WHERE near.line IS NOT NULL OR (doc_id, pos) <> first)
SELECT d.doc_id, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n_lines, count(g.pos) AS n_removed,
  coalesce(sum(g.n), 0)::BIGINT AS removed_chars, coalesce(string_agg(g.pos::VARCHAR, ',' ORDER BY g.pos), '') AS removed
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id GROUP BY d.doc_id, d.text
"""


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(F.col("doc_id"), 10) != 0).alias("train"))
    scored = ngrams.score(docs)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict:
    return {"op1_quality": op1_quality, "op2_suffix_dedup": op2_suffix_dedup, "op3_simhash": op3_simhash, "op4_toxicity": op4_toxicity, "op5_media": op5_media, "op6_chat": op6_chat, "op7_mixing": op7_mixing, "op8_line_dedup": op8_line_dedup, "op9_decontaminate": op9_decontaminate, "op10_lm_score": op10_lm_score}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat": OP6_SQL, "op7_mixing": OP7_SQL, "op8_line_dedup": OP8_SQL}
