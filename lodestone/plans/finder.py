"""Search over a stored index: terms, filters, BM25 or fusion with vectors, and results with their content."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lodestone.functions.render import markdown, result_json
from lodestone.operators import search, vectors
from lodestone.operators.index import idf_of
from lodestone.plans.store import IndexStore
from lodestone.sources.embeddings import Provider

NO_TERMS, NO_MATCHES, NO_MATCHES_LEFT = "No search terms.", "No matches.", "No matches after filters."
#: Results of a search that names no limit (fixed value).
DEFAULT_LIMIT = 10


@dataclass(frozen=True)
class Filters:
    contains: str = ""
    extensions: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    def matches(self):
        """The filter as a column over ``path``; None if it lets all pass."""
        if not (self.contains or self.extensions or self.exclude):
            return None
        return search.path_matches(F.col("path"), self.contains, self.extensions, self.exclude)


def query_weights(store: IndexStore, posts: DataFrame, terms: list[str]) -> DataFrame:
    """``term, df, idf`` of every asked term over the whole index, before any filter."""
    n = max(1, store.status()["chunks"])
    asked = store.spark.createDataFrame([(t,) for t in terms], "term string")
    have = posts.groupBy("term").agg(F.count("*").alias("df"))
    df = F.coalesce("df", F.lit(0).cast("long"))
    return asked.join(have, "term", "left").select("term", df.alias("df"), idf_of(F.lit(n), df).alias("idf"))


def ranked(store: IndexStore, terms: list[str], limit: int | None, filters: Filters = Filters()) -> DataFrame:
    """``chunk_id, path, score, matched_terms`` of the best chunks by BM25; mean length over the filtered candidates."""
    posts = store.terms(terms)
    cands = search.candidates(posts, store.rows("files"), filters.matches())
    return search.bm25(cands, query_weights(store, posts, terms), terms, limit)


def hybrid(store: IndexStore, terms: list[str], query: list[float], limit: int, filters: Filters = Filters(), weight: float = 0.5) -> DataFrame:
    """As ``ranked``, fused with the vectors nearest to ``query``; these come from the whole index, past the filters."""
    best = ranked(store, terms, 2 * limit, filters)
    near = vectors.nearest(store.rows("vectors"), query, 2 * limit)
    fused = search.fuse(best, near, limit, weight)
    # at most ``limit`` rows; ids that the index doesn't know drop out here
    home = store.rows("chunks").select("chunk_id", "file_id").join(F.broadcast(fused), "chunk_id").join(store.rows("files").select("file_id", "path"), "file_id")
    return (
        home.join(best.select("chunk_id", "matched_terms"), "chunk_id", "left")
        .select("chunk_id", "path", "score", F.coalesce("matched_terms", F.array().cast("array<string>")).alias("matched_terms"))
        .orderBy(F.desc("score"), "chunk_id")
    )


@dataclass(frozen=True)
class Answer:
    """Results, best first, or what to say instead."""

    results: list[Row]
    message: str | None = None


def find(store: IndexStore, query: str, limit: int = DEFAULT_LIMIT, filters: Filters = Filters(), provider: Provider | None = None, weight: float = 0.5) -> Answer:
    """Search an index; a limit of 0 or less gives no results.

    With a provider and vectors in the store the ranking is fused; it still
    needs a keyword match that passes the filters.
    """
    terms = search.terms_of(store.spark, query)
    if not terms:
        return Answer([], NO_TERMS)
    if limit <= 0:
        return Answer([])
    top = ranked(store, terms, limit, filters)
    rows = top.collect()  # at most ``limit``
    if not rows:
        bare = filters.matches() is None or ranked(store, terms, 1).isEmpty()
        return Answer([], NO_MATCHES if bare else NO_MATCHES_LEFT)
    if provider is not None and store.manifest()["segments"]["vectors"]:
        rows = hybrid(store, terms, provider.embed([query])[0], limit, filters, weight).collect()
    return Answer(fetch(store, rows))


def fetch(store: IndexStore, rows: list[Row]) -> list[Row]:
    """Ranked chunks with content and lines; their ids reach the scan of the chunks, which are sorted by id."""
    ids = [r["chunk_id"] for r in rows]
    got = store.rows("chunks").where(F.col("chunk_id").isin(ids)).select("chunk_id", "content", "start_line", "end_line").collect()
    by = {r["chunk_id"]: r for r in got}
    return [Row(uri=f"file://{r['path']}", score=r["score"], matched_terms=r["matched_terms"], content=c["content"], start_line=c["start_line"], end_line=c["end_line"], chunk_id=r["chunk_id"])
            for r in rows if (c := by.get(r["chunk_id"]))]


def _numbered(store: IndexStore, rows: list[Row]) -> DataFrame:
    kind = "rank int, uri string, score double, matched_terms array<string>, content string, start_line int, end_line int, chunk_id long"
    return store.spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], kind)


def as_markdown(store: IndexStore, rows: list[Row], root: str = "", content: bool = True) -> str:
    block = markdown(F.col("rank"), F.col("uri"), F.col("start_line"), F.col("end_line"), F.col("content") if content else None, root)
    return "".join(r["b"] for r in _numbered(store, rows).select("rank", block.alias("b")).orderBy("rank").collect())


def as_json(store: IndexStore, rows: list[Row], root: str = "", content: bool = False) -> str:
    one = result_json(F.col("uri"), F.col("score"), F.col("start_line"), F.col("end_line"), F.col("matched_terms"), F.col("content") if content else None, root)
    return '{"results":[' + ",".join(r["j"] for r in _numbered(store, rows).select("rank", one.alias("j")).orderBy("rank").collect()) + "]}"
