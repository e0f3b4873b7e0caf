"""The pN_ queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import stuffed_pages
from lodestone.llm.corpus_encode import count_tokens, encode_corpus, tokenizer_path
from lodestone.llm.credentials import find_credentials
from lodestone.llm.garbled import find_garbled, fit_on
from lodestone.llm.neighbours import nearest, similar_pairs
from lodestone.llm.packing import pack
from lodestone.llm.provenance import classify
from lodestone.llm.splitting import oversized_lines, split_items
from lodestone.llm.stuffed_pages import find_stuffed
from lodestone.llm.syntax_repair import broken, rates, repairs
from lodestone.session import read_table

VOCABULARY = "byte_bpe_50k.tiktoken"
CAPACITY = 2048


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tbl, row_key, content`` of files and chunks."""
    files = read_table(spark, sf_dir, "files").select(F.lit("files").alias("tbl"), F.col("file_id").alias("row_key"), "content")
    chunks = read_table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("row_key"), "content")
    return files.unionByName(chunks)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "files").select("file_id", "path", "content", "language")


def _repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(_sources(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose repair costs something; ``p1_causes`` says how much."""
    return broken(_sources(spark, sf_dir)).distinct()


def p1_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What broke each file, the line of the first edit, and the edits' number."""
    return _repairs(spark, sf_dir).where("cost > 0").select("file_id", "language", "cause", "line", "cost").dropDuplicates(["file_id"])


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and files that don't parse, per repository and language."""
    return rates(_repairs(spark, sf_dir))


def _pieces(spark: SparkSession, sf_dir: str, contents: bool) -> DataFrame:
    files = read_table(spark, sf_dir, "files").select("file_id", "content", "language")
    return split_items(files, read_table(spark, sf_dir, "split_limits"), contents=contents)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized_lines(_pieces(spark, sf_dir, contents=False))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, contents=True).dropDuplicates(["file_id", "piece"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(read_table(spark, sf_dir, "vectors"), k=10, least=0.80, dims=96)
    return similar_pairs(found).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p4_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with the kinds of evidence against it (bits; 0: hand-written) and its family."""
    return classify(read_table(spark, sf_dir, "files").select("file_id", "path", "content"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_origins(spark, sf_dir).where("kinds > 0").select("file_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_on(read_table(spark, sf_dir, "files"), "file_id", "content")
    return find_garbled(_contents(spark, sf_dir), model, ["tbl", "row_key"], "content").select("tbl", "row_key").distinct()


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled rows with every line set right that can be."""
    model = fit_on(read_table(spark, sf_dir, "files"), "file_id", "content")
    return find_garbled(_contents(spark, sf_dir), model, ["tbl", "row_key"], "content", restored=True).dropDuplicates(["tbl", "row_key"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_credentials(_contents(spark, sf_dir), ["tbl", "row_key"], "content").distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that held credentials, with these replaced."""
    return find_credentials(_contents(spark, sf_dir), ["tbl", "row_key"], "content", redacted=True).dropDuplicates(["tbl", "row_key"])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(VOCABULARY))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(VOCABULARY))
    return pack(sizes, CAPACITY, "doc_id", "n_tokens")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_stuffed(docs, stuffed_pages.fit_on(docs)).select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_causes": p1_causes, "p1_rates": p1_rates, "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p4_found": p4_found, "p4_origins": p4_origins, "p5_found": p5_found, "p5_restored": p5_restored, "p6_found": p6_found, "p6_redacted": p6_redacted, "p7_ids": p7_ids, "p8_containers": p8_containers, "p9_found": p9_found}


#: Lines above their file's limit; a file above it without such a line gets line 0.
P2_SQL = """
WITH f AS (SELECT DISTINCT file_id, content, lower(language) AS language FROM files),
sized AS (
  SELECT file_id, content, coalesce(l.max_bytes, (SELECT max_bytes FROM split_limits WHERE language = 'default')) AS most
  FROM f LEFT JOIN split_limits l ON l.language = f.language
),
over AS (SELECT * FROM sized WHERE strlen(content) > most),
lines AS (
  SELECT file_id, most, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n
  FROM over
)
SELECT file_id, CAST(n AS INTEGER) AS line_no FROM lines WHERE strlen(line) > most
UNION
SELECT file_id, CAST(0 AS INTEGER) AS line_no FROM over
WHERE file_id NOT IN (SELECT file_id FROM lines WHERE strlen(line) > most)
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL}
