"""Queries of the operators for training data. Each takes (spark, sf_dir)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspark.llm import (
    conversation_repair,
    decontamination,
    html_extraction,
    lm_scoring,
    near_dedup,
    quality_classifier,
    quality_rules,
    segmentation,
    sharding,
    source_divergence,
    toxicity,
    url_filters,
    zstd_warc,
)
from crawlspark.workspace import Scratch, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The rules of the URL filter (host, path, verdict), and the number of shards.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
SHARDS = 8


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL, from rules and from its aliases."""
    pages = table(spark, sf_dir, "pages")
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), r, strict=True)]) for r in URL_RULES]
    rules = spark.range(1).select(F.inline(F.array(*rows)))
    scratch = Scratch(spark)
    links = scratch.keep(url_filters.page_links(pages), "links")
    return url_filters.judged(pages, links, rules, scratch)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bigram stupid-backoff score of every document under the counts of all documents."""
    # As many partitions of the count table as the session shuffles to.
    buckets = 1 << max(0, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    found = lm_scoring.scored(table(spark, sf_dir, "documents"), buckets)
    return found.withColumn("log_score", F.round("log_score", 3))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a uniform shuffle into eight shards whose counts are at most one apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit("")).cast("binary")
    return sharding.sharded(docs, SHARDS, Scratch(spark)).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from Zstandard archives written from all pages."""
    scratch = Scratch(spark)
    records = zstd_warc.with_record_types(table(spark, sf_dir, "pages"), scratch)
    files = zstd_warc.write_archives(records, shared_dir(spark, "archives"), scratch)
    read = scratch.keep(zstd_warc.read_archives(files, with_payload=False).drop("payload", "target_uri"), "read")
    return zstd_warc.resolved(read).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"
    )


def held_out(doc_id: str = "doc_id") -> Column:
    """A third of the documents, by id: no label of these is learned from. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_classifier.QualityModel:
    labels = table(spark, sf_dir, "labels")
    return quality_classifier.fit_quality(docs.where(~held_out()), labels, Scratch(spark))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = quality_classifier.with_quality(docs, fitted_quality(spark, docs, sf_dir), keep=["doc_id"])
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


#: The vocabulary of the sampled segmentations.
SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model: str = SENTENCEPIECE_MODEL) -> DataFrame:
    """Sampled segmentations of every document: their ids, sizes, probabilities and inclusion scores."""
    vocabulary = segmentation.Vocabulary.load(model)
    return segmentation.sampled_segmentations(table(spark, sf_dir, "documents"), vocabulary)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_extraction.main_text(table(spark, sf_dir, "pages"), Scratch(spark))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and the verdict of every document, with cutoffs controlled by language."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.judged(docs, labels, Scratch(spark)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of documents and benchmark items that leaked into them."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, from sets of four-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark), shingle_words=4)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation, from messages with planted faults."""
    messages = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.digested(conversation_repair.repaired(messages, Scratch(spark)))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergence of the sources of each language from one another, and the terms each has more of than its language."""
    return source_divergence.divergences(table(spark, sf_dir, "documents"), Scratch(spark))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs.where(~held_out()), labels, Scratch(spark))
    return toxicity.with_toxicity(docs, model, keep=["doc_id"], passages=False).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


QUERIES = {
    query.__name__: query
    for query in (
        op1_url_filters,
        op2_lm_scoring,
        op3_sharding,
        op4_zstd_warc,
        op5_quality_classifier,
        op6_sentencepiece,
        op7_html_extraction,
        op8_quality_rules,
        op9_decontamination,
        op10_near_dedup,
        op11_conversation_repair,
        op12_source_divergence,
        op13_toxicity,
    )
}
