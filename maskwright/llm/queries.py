"""The queries of the corpus operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.catalog import Catalog
from maskwright.llm.chat_format import chat_digests, format_chats
from maskwright.llm.chat_repair import damaged, repair_report
from maskwright.llm.common import table
from maskwright.llm.embedding_dedup import near_dedup
from maskwright.llm.exact_dedup import dedup_report
from maskwright.llm.html_text import main_text
from maskwright.llm.language_id import held_out, identify, train
from maskwright.llm.mixing import mix
from maskwright.llm.ngram_join import jaccard_join
from maskwright.llm.periodic_runs import made_periodic, periodic_runs, run_digests
from maskwright.llm.sentencepiece_sampling import sample_segmentations
from maskwright.llm.sql import CHAT_REPAIR, PERIODIC_RUNS
from maskwright.llm.token_binary import read_documents, write_tokens
from maskwright.llm.token_counts import token_counts
from maskwright.llm.warc import read_warc, write_warc

CATALOG = Catalog()


@CATALOG.query(
    "op1_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_report(docs, largest=True)


def byte_bpe() -> str:
    """The path of the byte-level tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@CATALOG.query("op5_token_binary")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_documents(write_tokens(docs, byte_bpe(), end_id=0, added=True))


@CATALOG.query(
    "op8_warc",
    """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
    g AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first, count(*) OVER (PARTITION BY d) AS copies FROM p)
    SELECT page_id, n AS payload_bytes, d AS payload_digest,
           CASE WHEN n >= 100 AND copies > 1 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 100 AND copies > 1 AND page_id <> first THEN first END AS refers_to
    FROM g
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return read_warc(write_warc(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@CATALOG.query(
    "op3_chat_format",
    r"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
    m AS (SELECT *, chr(10) || '</turn>' || chr(10) AS tail FROM c),
    e AS (
      SELECT *, CASE WHEN regexp_matches(text, '\\(### |</turn>)') OR strpos(text || tail, tail) <> length(text) + 1
                     THEN regexp_replace(text, '(\\*)(### |</turn>)', '\\\1\2', 'g') ELSE text END AS body
      FROM m)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length('### ' || role || ': ' || body || tail)) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    planted = spark.range(2).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_digests(format_chats(rows.unionByName(planted)))


@CATALOG.query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    profiles = train(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


REPETITIONS = 2.0  # passes over the smallest source at most
BUDGET = 1.25  # passes over all tokens


@CATALOG.query(
    "op2_mixing",
    r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents),
    s AS (SELECT source, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY source),
    t AS (SELECT max(tokens)::DOUBLE AS most, sum(tokens)::DOUBLE AS total FROM s),
    r AS (SELECT list(tokens / most ORDER BY tokens) AS q, min(tokens / most) AS least, any_value(1.25 * total / most) AS share FROM s, t WHERE tokens > 0),
    b AS (
      SELECT 0 AS i, 0.0::DOUBLE AS low, CASE WHEN pow(least, -1.0) / len(q) * share <= 2.0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS high, q, least, share FROM r
      UNION ALL
      SELECT i + 1, CASE WHEN m <= 2.0 THEN low ELSE (low + high) / 2 END, CASE WHEN m <= 2.0 THEN (low + high) / 2 ELSE high END, q, least, share
      FROM (SELECT *, pow(least, (low + high) / 2 - 1) / list_sum(list_transform(q, lambda x: pow(x, (low + high) / 2))) * share AS m FROM b WHERE i < 48)),
    a AS (SELECT round(high, 6) AS alpha FROM b WHERE i = 48),
    z AS (SELECT list_sum(list_transform(q, lambda x: pow(x, alpha))) AS z FROM r, a),
    p AS (
      SELECT s.source, CASE WHEN tokens > 0 THEN round(pow(tokens / most, alpha) / z * (1.25 * total) / tokens, 6) ELSE 1.0 END AS epochs,
             greatest(CAST(ceil(tokens / 262144.0) AS BIGINT), 1) AS n_blocks
      FROM s, t, a, z),
    k AS (
      SELECT doc_id, d.source, n, epochs, CAST(floor(epochs) AS BIGINT) AS whole,
             ('0x' || substr(md5('17:' || doc_id), 1, 12))::BIGINT % n_blocks AS mix_block
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
    w AS (
      SELECT *, sum(n) OVER (PARTITION BY source, mix_block ORDER BY md5('17:' || (whole + 1) || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS running,
             sum(n) OVER (PARTITION BY source, mix_block) AS total
      FROM k),
    c AS (SELECT *, whole + CASE WHEN epochs > whole AND 2 * running - n <= 2 * (epochs - whole) * total THEN 1 ELSE 0 END AS times FROM w),
    e AS (SELECT *, unnest(range(1, times + 1)) AS mix_epoch FROM c),
    f AS (SELECT *, md5('17:' || mix_epoch || ':' || doc_id) AS mix_key FROM e)
    SELECT doc_id, source, CAST(mix_epoch AS INTEGER) AS mix_epoch, mix_block, mix_key,
           CAST(row_number() OVER (PARTITION BY source, mix_block, mix_epoch ORDER BY mix_key, doc_id) AS INTEGER) AS mix_position
    FROM f
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, repetitions=REPETITIONS, budget=BUDGET, carry=["doc_id", "source"])


def piece_model() -> str:
    """The path of the SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@CATALOG.query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sample_segmentations(docs, piece_model())


@CATALOG.query("op9_embedding_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).select("vec_id", "n_links", "component_id", "kept")


@CATALOG.query(
    "op4_ngram_join",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS (
      SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
    n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.k + y.k - common)),
    r AS (SELECT doc_id AS a, doc_id AS low FROM n UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.a)
    SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, coalesce(c.low, d.doc_id) AS component_id
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(low) AS low FROM r GROUP BY a) c ON c.a = d.doc_id
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join(docs).select("doc_id", "n_shingles", "component_id")


@CATALOG.query("op10_html_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@CATALOG.query("op13_periodic_runs", PERIODIC_RUNS)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return run_digests(periodic_runs(docs, text_col=made_periodic(F.col("doc_id"), F.col("text"))))


@CATALOG.query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe())


@CATALOG.query("op12_chat_repair", CHAT_REPAIR)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(damaged(rows), rows)
