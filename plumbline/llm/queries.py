"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The share of rows that scoring learns nothing from, as documented for op3: crc32(id) mod 5 = 0.
HELD_OUT = 5
KEEP_AT = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.line_dedup import line_dedup

    kept = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"), shards=40)


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.rule_ensemble import fit_quality, quality_scores

    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD_OUT)) == 0
    model = fit_quality(docs, labels.filter(~out))
    scored = quality_scores(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


def op4_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.ann import ann_search

    vectors = _table(spark, sf_dir, "embeddings")
    return ann_search(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), length=4096, end=1)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.quality_rules import quality_rules

    trusted = _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    judged = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op7_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.simhash import near_components

    return near_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, radius=3)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.secrets import secret_scan

    found = secret_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


#: Fixed: a conversation whose texts are control strings.
HARD_TEXT = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.chat import chat_format, masked, read_back, turns_of_rows

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text")
    )
    done = chat_format(turns_of_rows(rows.unionByName(hard)))
    done = done.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", masked(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.sentencepiece_words import sentencepiece_encode

    model = tokenizer_path("piece_bpe_32k.model")
    back = sentencepiece_encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded="decoded")
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import written
    from plumbline.llm.mixing import mixed, row_key, word_count

    # the texts are read once
    sized = written(_table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"), row_key("doc_id", "text").alias("key")))
    mix = mixed(sized, "key", weights=(5, 2, 1), share=1.5, most=2.0)
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.alignment import aligned, with_pair_counts

    found = aligned(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    done = with_pair_counts(found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "linked_a", "linked_b", "times"))
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.lexical import lexical_search

    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict:
    own = (
        op1_line_dedup, op2_stratified_shards, op3_rule_ensemble, op4_additive_ann, op5_best_fit_packing, op6_quality_rules, op7_simhash_tiles, op8_secret_scan, op9_chat_format, op10_sentencepiece,
        op11_source_mix, op12_token_alignment, op13_lexical_search,
    )
    return {f.__name__: f for f in own}


_WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1_SQL = f"""
WITH lines AS (
  SELECT d.doc_id, u.line, u.pos
  FROM documents d, LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS pos) u
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
GROUP BY doc_id
"""


def _escaped_sql(column: str) -> str:
    from plumbline.llm.chat import CONTROLS

    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


def op9_sql() -> str:
    from plumbline.llm.chat import BODY, END, TURN

    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HARD_TEXT}'
  UNION ALL SELECT -7, 1, 'assistant', '{HARD_TEXT}'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum({len(TURN) + len(BODY) + len(END)} + length({_escaped_sql('role')}) + length({_escaped_sql('text')}))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""


#: Targets: in the order of size over weight, sources are full as long as their part of what is left is above their top.
OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')) AS key
  FROM documents
), sources AS (
  SELECT k, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(((row_number() OVER (ORDER BY k)) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM docs GROUP BY k
), filling AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0)) / sum(w) OVER after AS level
  FROM sources
  WINDOW before AS (ORDER BY source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY source_size / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), goals AS (
  SELECT k, source_size, least(w * (SELECT coalesce(max(level), 0) FROM filling WHERE level * w <= 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size) AS target FROM filling
), placed AS (
  SELECT doc_id, size, source_size, target, (row_number() OVER (PARTITION BY d.k ORDER BY length(bin(size)), substr(bin(size), 1, 4), key)) - 1 AS i,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
         ('0x' || substr(md5('42 ' || d.k), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM docs d JOIN goals g ON d.k = g.k
)
SELECT doc_id, size, source_size, target, (least(floor((i + 1) * e + u) - floor(i * e + u), ceil(e)) * size)::BIGINT AS taken FROM placed
"""

OP13_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), docs AS (
  SELECT r, doc_id, len(t)::BIGINT AS n, t FROM words WHERE len(t) > 0
), whole AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs
), posts AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM docs) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM posts, whole GROUP BY term
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scores AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN posts USING (term), whole GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r))::INT AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can state the result; the others are tested against brute force in tests/llm."""
    return {"op1_line_dedup": OP1_SQL, "op9_chat_format": op9_sql(), "op11_source_mix": OP11_SQL, "op13_lexical_search": OP13_SQL}
