"""The operators as queries over the demo tables, and their statements in SQL where SQL can tell them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweir.llm import (
    ann, bpe, decontaminate, hard_negatives, html_text, jaccard_join, language, packing, quality, suffix_dedup,
    url_filter, vector_codes, warc,
)
from tallyweir.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


URL_RULES = [
    url_filter.Rule("com/", "allow"),
    url_filter.Rule("example.com/en/", "block"),
    url_filter.Rule("www.example.com/en/", "allow"),
    url_filter.Rule("net/es/", "block"),
    url_filter.Rule("net/fr/", "block"),
]


def op1_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    model = url_filter.train(url_filter.labelled_pages(pages, table(spark, sf_dir, "labels")))
    return url_filter.judge(pages, model, URL_RULES)


def op2_decontaminate(spark, sf_dir):
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages)).select("page_id", "url", "text", "n_chars")


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.join(table(spark, sf_dir, "documents"), size=4, percent=85)


def op5_bpe(spark, sf_dir):
    return bpe.encode_report(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality(spark, sf_dir):
    trusted = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return quality.classify(table(spark, sf_dir, "documents"), trusted)


def op7_language(spark, sf_dir):
    return language.with_language(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op9_nearest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(ann.build_index(vectors), vectors.where(F.col("vec_id") % 100 == 0))


def op10_warc(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest",
        "record_type", "refers_to",
    )


def op11_vector_codes(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(vectors.withColumn("label", moved), vectors.where(F.col("vec_id") % 100 == 0))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_decontaminate, op3_html_text, op4_jaccard_join, op5_bpe, op6_quality, op7_language,
    op8_suffix_dedup, op9_nearest, op10_warc, op11_vector_codes, op12_packing, op13_hard_negatives,
)}

ORACLES = {
    "op2_decontaminate": decontaminate.REPORT_SQL,
    "op11_vector_codes": vector_codes.COMPRESS_SQL,
    "op13_hard_negatives": hard_negatives.MINE_SQL,
    "op10_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS owner FROM p)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER) + 1, 1)), '')
    AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM o
""",
}
