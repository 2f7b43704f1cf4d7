"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import alignment, mixing, packing, pieces, pii, pstable, quality, repetition, sharding, simhash, survival, toxicity, warc
from auditlake.llm.common import held_out, sized, work_dir
from auditlake.plans import Registry

REG = Registry()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _judged(scored: DataFrame, limit: float) -> DataFrame:
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        F.when(F.col("score") >= limit, 1).otherwise(0).alias("predicted"),
    )


@REG.add(
    "op1_warc",
    """
    WITH p AS (
      SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
    ), d AS (
      SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p
    ), b AS (
      SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS best FROM d
    )
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM best THEN best END AS refers_to
    FROM b
    """,
)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_warc(warc.page_records(table(spark, sf_dir, "pages")), work_dir(spark, "warc"))
    found = warc.read_warc(spark, path).filter(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return found.select(
        as_id(F.col("record_id")).alias("page_id"),
        # What was read back counts; a revisit has no payload, so its headers tell.
        F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"),
        "record_type",
        as_id(F.col("refers_to")).alias("refers_to"),
    )


@REG.add("op3_sharding")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(spark, table(spark, sf_dir, "documents"), 40)
    return out.select(
        F.col("record.doc_id").alias("doc_id"),
        (sized("record.text") + 16).alias("size"),
        F.crc32(F.coalesce("record.text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@REG.add("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 0.3)


@REG.add("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )


@REG.add("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 0.7)


def _rules_sql() -> str:
    """The repetition rules for DuckDB: windows as word lists, coverage by a running maximum."""
    limits = repetition.Limits()
    parts, columns, totals = [], [], []
    for n in sorted(limits.ngrams):
        parts.append(f"""
    g{n} AS (
      SELECT doc_id, pos, chars, len(gram) = {n} AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS dup FROM (
        SELECT doc_id, pos, chars, array_agg(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS gram FROM w)
    ), c{n} AS (
      SELECT doc_id, sum(chars) FILTER (inside)::BIGINT AS c{n}, count(*) FILTER (inside) AS r{n} FROM (
        SELECT doc_id, chars, bool_or(dup) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM g{n})
      GROUP BY doc_id)""")
        columns.append(f"coalesce(c{n}, 0)")
        totals.append(f"100 * coalesce(c{n}, 0) > {limits.ngrams[n]} * word_chars")
    joins = " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in sorted(limits.ngrams))
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (
      SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos, length(unnest(words)) AS chars
      FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d)
    ), n AS (
      SELECT doc_id, count(*) AS n_words, sum(chars)::BIGINT AS word_chars FROM w GROUP BY doc_id
    ), l AS (
      SELECT doc_id, sum(k - 1)::BIGINT AS n_dup_lines, sum((k - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')))::BIGINT AS line_chars
      FROM (SELECT doc_id, line, count(*) AS k FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line)
      GROUP BY doc_id
    ),{",".join(parts)}, a AS (
      SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(line_chars, 0) AS line_chars, coalesce(r{repetition.BASE_WINDOW}, 0) AS n_repeat_words, [{", ".join(columns)}] AS cover,
        {" OR ".join(totals)} AS over_grams
      FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id) {joins}
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
      NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR coalesce(over_grams, false)
           OR (n_words >= {limits.least_words} AND 100 * line_chars > {limits.lines} * word_chars)) AS kept,
      cover
    FROM a
    """


@REG.add("op6_quality_rules", _rules_sql())
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition.repetition_rules(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cover"
    )


@REG.add(
    "op7_embedding_near_dedup",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
    ), links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93
    ), reach AS (
      SELECT vec_id AS a, vec_id AS b FROM embeddings
      UNION
      SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
    ), least AS (
      SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
    ), n AS (
      SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
    )
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN least USING (vec_id)
    """,
)
def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.near_duplicates(table(spark, sf_dir, "embeddings"))


@REG.add("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "fingerprint", "component_id", "kept")


@REG.add("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_mix(spark, table(spark, sf_dir, "documents"))


@REG.add("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"))
    decoded = pieces.decode(encoded.withColumn("n_pieces", F.size("ids").cast("long")))
    return decoded.select(
        "doc_id", "n_pieces", "ids_crc32", "scores", (F.xxhash64("text") == F.col("text_hash")).alias("round_trip")
    )


@REG.add("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(table(spark, sf_dir, "documents"))


@REG.add("op12_packing")
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@REG.add(
    "op13_filter_audit",
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
    ), w AS (
      SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d
    ), l AS (
      SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
    ), f AS (
      SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
        'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
        'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)
      } AS x FROM w LEFT JOIN l USING (doc_id)
    ), g AS (
      SELECT part, [k FOR k IN ['A', 'B', 'C', 'D', 'E'] IF struct_extract(x, 'A') AND k = 'A' OR struct_extract(x, 'B') AND k = 'B'
        OR struct_extract(x, 'C') AND k = 'C' OR struct_extract(x, 'D') AND k = 'D' OR struct_extract(x, 'E') AND k = 'E'] AS failed,
        count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM f GROUP BY ALL
    ), k AS (
      SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k
    ), o AS (
      SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM k a, k b, k c, k d, k e
      WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
    ), s AS (
      SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS k, string_split(substr(filter_order, 1, step - 1), '') AS before FROM o, range(1, 6) r(step)
    ), j AS (
      SELECT part, filter_order, step, k, n, good, toxic, failed, list_contains(failed, k) AS fails, list_has_any(failed, before) AS gone FROM s, g
    ), r AS (
      SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (failed = [k]), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
      FROM j GROUP BY part, filter_order, step, k
    )
    SELECT * EXCLUDE (k), (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM r
    """,
)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
