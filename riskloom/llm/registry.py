"""The thin queries over the driver tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.session import shared_path

from . import (chunk_bpe, decontaminate, html_text, jaccard_join, language_id, neighbours, quality, resampling,
               suffix_dedup, token_counts, token_files, url_filter, whitening)
from .common import table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file (a parameter of the operators)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents as Simple-8b files and report what the files hold."""
    path = shared_path(spark, f"token-files-{uuid.uuid4().hex[:8]}")
    token_files.write_ids(table(spark, sf_dir, "documents", "doc_id", "text"), path,
                          vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.read_ids(spark, path, digest=True)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of at least 50 words that several documents hold."""
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents", "doc_id", "text"))


#: Rules of the URL query: verdict, host and path.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
             ("block", "com/de/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; the urls that a rule decides are the labelled table."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items that documents hold."""
    return decontaminate.matches(table(spark, sf_dir, "documents", "doc_id", "text"),
                                 table(spark, sf_dir, "benchmark", "item_id", "text"))


def op6_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return chunk_bpe.encode_digests(table(spark, sf_dir, "documents", "doc_id", "text"),
                                    vocabulary("word_bpe_49k.json"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found for every vector whose id is divisible by 100."""
    return neighbours.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "id % 100 = 0", k=10)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links (similarity of 0.8 or more) of every document."""
    return jaccard_join.links(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count the tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"),
                                     vocabulary("byte_bpe_50k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 8 whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=8)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language_id.predict(docs, language_id.train(docs))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the n-grams of the benchmark texts."""
    return resampling.resample(table(spark, sf_dir, "documents", "doc_id", "text"),
                               table(spark, sf_dir, "benchmark", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_files, op2_suffix_dedup, op3_url_filter, op4_html_text, op5_decontaminate, op6_chunk_bpe,
        op7_neighbours, op8_quality, op9_jaccard_join, op10_token_counts, op11_whitening,
        op12_language_id, op13_resampling)}
#: No query's columns are all SQL (tokens, hashes of ids, learned scores, eigenvectors, crc32); each is
#: tested against a brute-force version.
ORACLES: dict[str, str] = {}
