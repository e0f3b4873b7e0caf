"""Ranked search: candidates, path filters, BM25, and fusion with vector ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import query_terms
from lodestone.operators.index import idf_of

#: Term saturation and length weight of BM25 (fixed values).
K1, B = 1.2, 0.75


def terms_of(spark, query: str) -> list[str]:
    """The distinct terms of a query, in order; the same expression as the index uses."""
    return spark.range(1).select(query_terms(F.lit(query)).alias("t")).first()["t"]


def path_matches(path: Column, contains: str = "", extensions: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Path holds ``contains``, none of ``exclude``, and ends in one of ``extensions``.

    An extension without a dot matches with and without one; blank extensions
    match nothing; an empty exclusion excludes everything.
    """
    ok = path.contains(contains) if contains else F.lit(True)
    for x in exclude or []:
        ok = ok & ~path.contains(x)
    if extensions:
        ends = [F.lit(False)]
        for e in extensions:
            e = e.strip()
            if e:
                ends.append(path.endswith(e))
                if not e.startswith("."):
                    ends.append(path.endswith("." + e))
        any_end = ends[0]
        for c in ends[1:]:
            any_end = any_end | c
        ok = ok & any_end
    return ok


def candidates(posts: DataFrame, files: DataFrame, matches: Column | None = None) -> DataFrame:
    """``chunk_id, term, raw_freq, dl, path`` of postings whose file is there and ``matches``; no content is read."""
    own = files.select("file_id", "path")
    return posts.select("chunk_id", "file_id", "term", "raw_freq", "dl").join(own if matches is None else own.where(matches), "file_id")


def query_idf(posts: DataFrame, docs: DataFrame, terms: list[str]) -> DataFrame:
    """``term, df, idf`` of every asked term, also of unknown ones."""
    from lodestone.operators.index import corpus_size, doc_freqs_of

    return doc_freqs_of(posts, terms).crossJoin(F.broadcast(corpus_size(docs))).select("term", "df", idf_of(F.col("n"), F.col("df")).alias("idf"))


def _gain(avgdl: Column) -> Column:
    dl = F.greatest(F.col("dl"), F.lit(1))
    tf = F.col("raw_freq")
    return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(cands: DataFrame, weights: DataFrame, terms: list[str], limit: int | None, avgdl: DataFrame | None = None) -> DataFrame:
    """``chunk_id, path, score, matched_terms`` of candidates, ranked.

    ``avgdl`` is a one-row table (corpus-wide mean); without it the mean is
    that of the candidates as filtered. Ties go to the smaller chunk id. A
    limit of 0 or less gives no rows, None gives all. Matched terms keep the
    query's order.
    """
    if avgdl is None:
        avgdl = cands.select("chunk_id", "dl").dropDuplicates(["chunk_id"]).agg(F.greatest(F.coalesce(F.avg("dl"), F.lit(1.0)), F.lit(1.0)).alias("avgdl"))
    asked = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    scored = (
        cands.join(F.broadcast(weights.select("term", "idf")), "term")  # a row per query term
        .crossJoin(F.broadcast(avgdl))
        .withColumn("gain", _gain(F.col("avgdl")))
        .groupBy("chunk_id")
        .agg(F.sum("gain").alias("score"), F.collect_set("term").alias("got"), F.first("path").alias("path"))
        .select("chunk_id", "path", "score", F.filter(asked, lambda t: F.array_contains(F.col("got"), t)).alias("matched_terms"))
    )
    return scored if limit is None else scored.orderBy(F.desc("score"), "chunk_id").limit(max(0, limit))


def results(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked chunks as results: ``uri, score, matched_terms, content, start_line, end_line, chunk_id``.

    ``ranked`` is as long as the query's limit, so it is the side that is broadcast.
    """
    lines = chunks.select("chunk_id", "content", "start_line", "end_line")
    return lines.join(F.broadcast(ranked), "chunk_id").select(F.concat(F.lit("file://"), "path").alias("uri"), "score", "matched_terms", "content", "start_line", "end_line", "chunk_id")


def fuse(ranked: DataFrame, near: DataFrame, limit: int, bm25_weight: float = 0.5) -> DataFrame:
    """``chunk_id, score``: weighted BM25 (by its best) plus weighted reciprocal vector rank.

    ``ranked`` holds the best 2 x limit by BM25, ``near`` (``chunk_id, rank``)
    the nearest 2 x limit. A weight out of 0..1 counts 0.5 on the side it spoils.
    """
    wb = 0.5 if bm25_weight < 0 else bm25_weight
    wv = 0.5 if 1 - bm25_weight < 0 else 1 - bm25_weight
    best = Window.partitionBy()
    own = ranked.select("chunk_id", "score").withColumn("top", F.max("score").over(best))
    own = own.select("chunk_id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias("b"))
    return (
        own.join(near.select("chunk_id", (1.0 / F.col("rank")).alias("v")), "chunk_id", "full")
        .select("chunk_id", (wb * F.coalesce("b", F.lit(0.0)) + wv * F.coalesce("v", F.lit(0.0))).alias("score"))
        .orderBy(F.desc("score"), "chunk_id")
        .limit(max(0, limit))
    )
