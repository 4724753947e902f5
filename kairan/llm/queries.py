"""The registered queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import lexical, lines, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document, by the public byte-level ranks."""
    import public_tokenizers

    from .bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents on two-word shingles."""
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document with the forest's verdict."""
    from .secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of base spans, and all spans."""
    from .pii import find_pii, fit

    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, fit(docs))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labels of three quarters of them."""
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines that are boilerplate of its source."""
    from .lines import drop_boilerplate

    return drop_boilerplate(table(spark, sf_dir, "documents"), counts=True).select("doc_id", "n_lines", "n_dropped", "text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and benchmark item that it holds with few errors, and the number of errors."""
    from .decontam import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url; listed are the pages of four domains."""
    from .url_filter import judge_urls, listed_pages

    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, listed_pages(pages))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurrent language-model score of every document, learnt from six sevenths of them, beside a unigram base."""
    from .language_model import held_out_scores

    return held_out_scores(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two public tokenizers aligned over every document, and how common its links are."""
    import public_tokenizers

    from .alignment import align

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item by lexical score."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in as few sequences of 1024 as the linear grouping scheme finds."""
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_language_model": op10_language_model,
    "op11_token_alignment": op11_token_alignment,
    "op12_lexical_search": op12_lexical_search,
    "op13_best_fit_packing": op13_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op9_url_filter": url_filter.SQL,
    "op12_lexical_search": lexical.SQL,
    "op5_line_dedup": "WITH " + lines.SQL.strip().format(docs="documents") + """
SELECT doc_id,
  CAST(coalesce(len(list_filter(lines, lambda x: trim(x) <> '')), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(lines) - len(kept_lines), 0) AS BIGINT) AS n_dropped,
  CASE WHEN len(kept_lines) < len(lines) THEN array_to_string(kept_lines, chr(10)) ELSE text END AS text
FROM kept""",
}
