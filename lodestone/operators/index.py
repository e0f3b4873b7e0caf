"""The inverted index: postings, document frequencies, weights and magnitudes of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import tokens


def term_rows(docs: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """``key, term, raw_freq``: how often each term is in each text (map-side combined)."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").cast("int").alias("raw_freq"))


def token_counts(docs: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """``key, token_count``; 0 for texts without terms. No shuffle."""
    return docs.select(key, F.size(tokens(F.col(text))).alias("token_count"))


def postings(docs: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """``key, term, raw_freq, tf, dl``. The text's length rides along with the terms, so there is one shuffle."""
    listed = docs.select(key, tokens(F.col(text)).alias("ts"))
    rows = listed.select(key, F.size("ts").alias("n"), F.explode("ts").alias("term"))
    counted = rows.groupBy(key, "term").agg(F.count("*").cast("int").alias("raw_freq"), F.first("n").alias("dl"))
    return counted.select(key, "term", "raw_freq", (F.col("raw_freq") / F.greatest("dl", F.lit(1))).alias("tf"), "dl")


def idf_of(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def doc_freqs(posts: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``term, df`` over postings that hold each (key, term) once."""
    return posts.groupBy("term").agg(F.count(key).alias("df"))


def doc_freqs_of(posts: DataFrame, terms: list[str]) -> DataFrame:
    """``term, df`` of the asked terms, 0 for those that no text has."""
    spark = posts.sparkSession
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    have = doc_freqs(posts.where(F.col("term").isin(list(dict.fromkeys(terms)))))
    return asked.join(have, "term", "left").select("term", F.coalesce("df", F.lit(0).cast("long")).alias("df"))


def corpus_size(docs: DataFrame) -> DataFrame:
    """One row ``n``: the number of texts, at least 1."""
    return docs.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))


def idf(posts: DataFrame, docs: DataFrame) -> DataFrame:
    return doc_freqs(posts).crossJoin(F.broadcast(corpus_size(docs))).select("term", "df", idf_of(F.col("n"), F.col("df")).alias("idf"))


def weighted(posts: DataFrame, docs: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, term, raw_freq, tf, tfidf``. Terms are joined on a hash of term: the size of the term list decides the strategy."""
    weights = idf(posts, docs).select("term", "idf")
    return posts.join(weights, "term").select(key, "term", "raw_freq", "tf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def magnitudes(weighted_posts: DataFrame, docs: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, magnitude`` of every text; 0 without terms."""
    own = weighted_posts.groupBy(key).agg(F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("m"))
    return docs.select(key).join(own, key, "left").select(key, F.coalesce("m", F.lit(0.0)).alias("magnitude"))


def index_stats(docs: DataFrame, files: DataFrame, text: str = "content") -> DataFrame:
    """One row: files, chunks, mean length in terms (at least 1)."""
    own = docs.agg(F.count("*").alias("chunks"), F.greatest(F.avg(F.size(tokens(F.col(text)))), F.lit(1.0)).alias("avgdl"))
    return own.crossJoin(F.broadcast(files.agg(F.countDistinct("path").alias("files"))))
