"""The registered queries of the text operators, and SQL where SQL can say
the same."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm import chat, filter_audit, fingerprints, html_text, lm, mixing, ngram_join, packing, sharding, tokenstore, topk, toxicity, vectorcodes
from firnline.llm.common import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.held_out_scores(read_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.stored(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, tokenizer_path("word_bpe_49k.json"), 1, 4096), 4096)


def op6_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    # The layout before: 16 shards by a hash of the key.
    old = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 16, F.lit(0))
    return sharding.reshard(docs, old, 24).rows().select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read_table(spark, sf_dir, "pages"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), 10)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_counts(mixing.mix(read_table(spark, sf_dir, "documents"))).drop("_row")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


MARKS = r"\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Conversation -7 comes as one record, a list of messages.
    said = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(MARKS).alias("content")) for role in ("user", "assistant")])
    record = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), said.alias("messages"))
    return chat.read_back(chat.formatted_conversations(read_table(spark, sf_dir, "conversations"), record))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compressed(read_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_fingerprints, op3_language_model, op4_token_files, op5_packing, op6_resharding,
        op7_ngram_join, op8_main_text, op9_topk, op10_mixing, op11_filter_audit, op12_chat_format, op13_vector_codes, pipeline,
    )
}


def _audit_sql() -> str:
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))
    bits = lambda letters: " + ".join(f"CASE WHEN contains({letters}, '{f}') THEN {1 << i} ELSE 0 END" for i, f in enumerate("ABCDE"))
    return rf"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), m AS (
            SELECT d.doc_id, part,
                   CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
                   + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
                   + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
                   + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                   + CASE WHEN first_id IS NOT NULL AND (d.doc_id IS NULL OR d.doc_id > first_id) THEN 16 ELSE 0 END AS mask
            FROM (SELECT *, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d) d
        ), l AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
        ), c AS (
            SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY ALL
        ), o AS (
            SELECT filter_order, CAST(step AS INTEGER) AS step, {bits("substr(filter_order, step, 1)")} AS own, {bits("substr(filter_order, 1, step - 1)")} AS before
            FROM (VALUES {orders}) AS x(filter_order), range(1, 6) AS y(step)
        )
        SELECT part, filter_order, step,
               CAST(sum(CASE WHEN mask & (own + before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
               CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
               CAST(sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
               CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
               CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
               CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost,
               CAST(sum(CASE WHEN mask & own <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END) AS BIGINT) AS shapley
        FROM c, o GROUP BY part, filter_order, step
    """


def _chat_sql() -> str:
    mark = MARKS.replace("'", "''")
    slash = "chr(92)"
    grown = lambda x: f"""(length({x}) + length({x}) - length(replace({x}, {slash}, ''))
        + (length({x}) - length(replace({x}, '</turn>', ''))) // 7
        + coalesce(list_sum(list_transform(regexp_extract_all({x}, '#{{3,}}'), lambda r: length(r) - 2)), 0))"""  # noqa: E731
    return f"""
        WITH turns AS (
            SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, NULL, 0, 'user', '{mark}' UNION ALL SELECT -7, NULL, 1, 'assistant', '{mark}'
        ), chats AS (
            SELECT conv_id, own, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS turns,
                   coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS LAST, role, text), '') AS learned,
                   sum(14 + {grown("role")} + (length(role) - length(replace(role, ': ', ''))) // 2 + {grown("text")}) AS chars
            FROM turns GROUP BY conv_id, own
        )
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM chats
    """


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    steps = f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, ints) AS id, vec_id, label, ints FROM (
                SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS ints FROM embeddings
                WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
        ), x AS MATERIALIZED (
            SELECT id, p, list_slice(ints, p * len(ints) // {parts} + 1, (p + 1) * len(ints) // {parts}) AS part FROM v, range({parts}) AS r(p)
        ), b0 AS MATERIALIZED (SELECT p, id - 1 AS e, part AS entry FROM x WHERE id <= {entries})"""
    for k in range(rounds + 1):
        steps += f""", a{k} AS MATERIALIZED (
            SELECT id, p, min(struct_pack(d := d, e := e)) AS near FROM (
                SELECT x.id, x.p, e, list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{k} USING (p)) GROUP BY id, p)"""
        if k < rounds:
            steps += f""", m{k} AS MATERIALIZED (
                SELECT p, e, list(floor_mean ORDER BY i) AS entry FROM (
                    SELECT x.p, near.e AS e, i, (sum(part[i]) - (((sum(part[i]) % count(*)) + count(*)) % count(*))) // count(*) AS floor_mean
                    FROM x JOIN a{k} USING (id, p), range(1, 1 + len(part)) AS r(i) GROUP BY ALL) GROUP BY p, e
            ), b{k + 1} AS MATERIALIZED (SELECT b{k}.p, b{k}.e, coalesce(m{k}.entry, b{k}.entry) AS entry FROM b{k} LEFT JOIN m{k} USING (p, e))"""
    return f"""{steps}, c AS (
            SELECT id, string_agg(lower(printf('%02x', CAST(near.e AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(near.d) AS BIGINT) AS error FROM a{rounds} GROUP BY id
        ), h AS (SELECT sha256(string_agg(array_to_string(list_transform(entry, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (id), h
    """


ORACLES = {
    "op9_topk": """
        SELECT query_id, rank, vec_id, distance FROM (
            SELECT query_id, vec_id, distance,
                   CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank
            FROM (
                SELECT q.vec_id AS query_id, e.vec_id AS vec_id,
                       CAST(list_sum(list_transform(list_zip(q.embedding, e.embedding),
                            lambda x: CASE WHEN (x[1] > 0) <> (x[2] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
                FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0))
        WHERE rank <= 10
    """,
    "op11_filter_audit": _audit_sql(),
    "op12_chat_format": _chat_sql(),
    "op13_vector_codes": _codes_sql(),
}
