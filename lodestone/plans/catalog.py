"""Registered queries over whole tables, each with SQL that gives the same rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import render, text
from lodestone.functions.stemmer import stemmed
from lodestone.operators import chunking, index, maintain, search, structural, vectors
from lodestone.plans import finder
from lodestone.plans.store import IndexStore
from lodestone.session import materialize, read_table, scratch_dir
from lodestone.sources import embeddings, scan
from lodestone.streaming import watch

QUERY = "getCursorManifest rebuild_index"
TERMS = ("get", "cursor", "manifest", "rebuild", "index")
LIMIT = 10
FILTER = {"contains": "/src/", "extensions": ["go", ".py", "ts"], "exclude": ["/tests/", "vendor"]}
PROBE = "SELECT embedding FROM vectors WHERE embedding IS NOT NULL AND len(embedding) = 96 ORDER BY chunk_id LIMIT 1"


# ---- tables, each row once ---------------------------------------------------


def files(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").dropDuplicates(["file_id"])


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "chunks").dropDuplicates(["chunk_id"])


def vecs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "vectors").dropDuplicates(["chunk_id"])


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "file_events").distinct()


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(chunks(spark, d))


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """The stored files as a later scan might see them: some moved in time, some in content, some gone."""
    own = files(spark, d)
    return (
        own.where(F.col("file_id") % 11 != 0)
        .withColumn("mtime", F.col("mtime") + F.when(F.col("file_id") % 7 == 0, 5000).otherwise(400))
        .withColumn("hash", F.when(F.col("file_id") % 5 == 0, F.concat(F.lit("x"), F.coalesce("hash", F.lit("")))).otherwise(F.col("hash")))
    )


# ---- queries -------------------------------------------------------------------


def tokenize_terms(s, d):
    return index.term_rows(documents(s, d), "doc_id", "text")


def token_counts(s, d):
    return index.token_counts(chunks(s, d))


def tokenize_identifier_edges(s, d):
    """Distinct path segments of files, split."""
    parts = files(s, d).select(F.explode(F.split("path", "/")).alias("segment")).distinct()
    return parts.select("segment", F.array_join(text.tokens(F.col("segment")), " ").alias("terms"))


def postings_tf(s, d):
    return _posts(s, d).select("chunk_id", "term", "raw_freq", F.round("tf", 6).alias("tf"))


def doc_freqs_list(s, d):
    return index.doc_freqs_of(_posts(s, d), [*TERMS, "nosuchterm"])


def doc_freqs_all(s, d):
    return index.doc_freqs(_posts(s, d))


def idf_all(s, d):
    return index.idf(_posts(s, d), chunks(s, d)).select("term", F.round("idf", 6).alias("idf"))


def _written_posts(s, d):
    """Postings that several branches of a plan read: written once, not computed for each."""
    return materialize(_posts(s, d), "postings")


def tfidf_vectors(s, d):
    return index.weighted(_written_posts(s, d), chunks(s, d)).select("chunk_id", "term", "raw_freq", F.round("tf", 6).alias("tf"), F.round("tfidf", 6).alias("tfidf"))


def chunk_magnitude(s, d):
    own = chunks(s, d)
    return index.magnitudes(index.weighted(_written_posts(s, d), own), own).select("chunk_id", F.round("magnitude", 6).alias("magnitude"))


def index_stats(s, d):
    return index.index_stats(chunks(s, d), files(s, d)).select("files", "chunks", F.round("avgdl", 6).alias("avgdl"))


def _chunked(s, d, size):
    return chunking.explode_chunks(files(s, d), "file_id", chunking.chunk_lines(F.col("content"), size))


def chunk_lines_1000(s, d):
    return _chunked(s, d, 1000)


def chunk_lines_200(s, d):
    return _chunked(s, d, 200)


def merge_small_chunks(s, d):
    merged = chunking.merge_small(chunking.chunk_lines(F.col("content"), 200), 1000)
    return chunking.explode_chunks(files(s, d), "file_id", merged)


def structural_chunks(s, d):
    return structural.structural_chunks(files(s, d))


_stores: dict[tuple[str, str], IndexStore] = {}


def stored(s, d) -> IndexStore:
    """The index of a folder's tables: built by the application's first query that needs it, read by all."""
    key = (s.sparkContext.applicationId, d)
    if key not in _stores:
        own = IndexStore(s, f"{scratch_dir(s)}/index-{uuid.uuid4().hex}")
        own.load(read_table(s, d, "files"), read_table(s, d, "chunks"), read_table(s, d, "vectors"))
        _stores[key] = own
    return _stores[key]


def _terms(s) -> list[str]:
    return search.terms_of(s, QUERY)


def _candidates(s, d, filters=finder.Filters()):
    ix = stored(s, d)
    return search.candidates(ix.terms(_terms(s)), ix.rows("files"), filters.matches())


def _shape(ix, ranked):
    """Ranked chunks with their lines, which are fetched for them alone."""
    return search.results(ranked, ix.rows("chunks")).select(
        "uri", F.round("score", 6).alias("score"), F.array_join("matched_terms", " ").alias("matched_terms"), "start_line", "end_line", "chunk_id"
    )


def index_build(s, d):
    """A new index of the whole tables, counted from its segments."""
    own = IndexStore(s, f"{scratch_dir(s)}/index-{uuid.uuid4().hex}")
    own.load(read_table(s, d, "files"), read_table(s, d, "chunks"), read_table(s, d, "vectors"))
    own.rebuild()
    counts = [own.rows(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), "n") for n in ("files", "chunks", "postings", "vectors", "idf")]
    return functools.reduce(DataFrame.unionByName, counts)


def store_rebuild(s, d):
    """Stored tf-idf of every posting after a rebuild."""
    own = stored(s, d)
    if not own.manifest()["segments"]["idf"]:
        own.rebuild()
    return own.rows("postings").select("chunk_id", "term", "raw_freq", F.round("tfidf", 6).alias("tfidf"))


def store_magnitudes(s, d):
    own = stored(s, d)
    if not own.manifest()["segments"]["idf"]:
        own.rebuild()
    return own.table("chunks").select("chunk_id", F.round("magnitude", 6).alias("magnitude"))


def store_refresh(s, d):
    """Paths, hashes and numbers of chunks after a whole and then an incremental run over what changed and went."""
    own = IndexStore(s, f"{scratch_dir(s)}/index-{uuid.uuid4().hex}")
    whole = files(s, d).where(F.col("content").isNotNull())
    own.apply(whole.drop("file_id"))
    own.refresh(_scanned(s, d).where(F.col("content").isNotNull()).drop("file_id"))
    chunks_of = own.rows("chunks").groupBy("file_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("terms"))
    return own.rows("files").join(chunks_of, "file_id", "left").select("path", "hash", "mtime", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("terms", F.lit(0)).alias("terms"))


def search_candidates(s, d):
    lines = stored(s, d).rows("chunks").select("chunk_id", "start_line", "end_line")
    return _candidates(s, d).join(lines, "chunk_id").select("chunk_id", "term", "raw_freq", "path", "start_line", "end_line", F.col("dl").alias("token_count"))


def _best(s, d, limit=LIMIT, filters=finder.Filters()):
    return finder.ranked(stored(s, d), _terms(s), limit, filters)


def bm25_memory(s, d):
    """Mean length over the whole corpus."""
    ix, terms = stored(s, d), _terms(s)
    avgdl = ix.rows("chunks").agg(F.sum(F.size(text.tokens(F.col("content")))).alias("terms"), F.count("*").alias("n"))
    avgdl = avgdl.select(F.greatest(F.col("terms") / F.col("n"), F.lit(1.0)).alias("avgdl"))
    return _shape(ix, search.bm25(_candidates(s, d), finder.query_weights(ix, ix.terms(terms), terms), terms, LIMIT, avgdl))


def bm25_storage(s, d):
    """Mean length over the candidates."""
    return _shape(stored(s, d), _best(s, d))


def bm25_filtered(s, d):
    return _shape(stored(s, d), _best(s, d, filters=finder.Filters(**FILTER)))


def matched_terms(s, d):
    return _best(s, d, None).select("chunk_id", F.array_join("matched_terms", " ").alias("matched_terms"))


def query_idf(s, d):
    return search.query_idf(_posts(s, d), chunks(s, d), [*TERMS, "nosuchterm"]).select("term", "df", F.round("idf", 6).alias("idf"))


def path_filter(s, d):
    return files(s, d).where(search.path_matches(F.col("path"), **FILTER)).select("file_id", "path")


def ext_filter(s, d):
    return files(s, d).where(search.path_matches(F.col("path"), extensions=["go"])).select("file_id", "path")


def skip_dirs(s, d):
    return files(s, d).where(scan.not_skipped(F.col("path"))).select("file_id", "path")


def scan_filters(s, d):
    own = files(s, d).where(scan.extension(F.col("path")).isin([".go", ".py"]) & (F.col("size") <= 4000))
    return own.select("path", "size", "mtime")


def ignore_rules(s, d):
    rules = scan.compile_ignore(["# caches", "*.min.js", "/docs/", "tests/**", "!keep_*", "build?"])
    return files(s, d).where(~scan.ignored(F.regexp_replace("path", "^[^/]*/", ""), rules)).select("path")


def change_detection(s, d):
    return maintain.changed(_scanned(s, d), files(s, d)).select("file_id", "path")


def event_change_detection(s, d):
    return maintain.changed(_scanned(s, d), files(s, d), by_time=False).select("file_id", "path")


def deleted_paths(s, d):
    return maintain.vanished(files(s, d), _scanned(s, d))


def upsert_files(s, d):
    own = files(s, d)
    new = maintain.changed(_scanned(s, d), own)
    return maintain.upsert_files(own, new).select("file_id", "path", "hash", "mtime")


def _gone(s, d):
    return maintain.delete_files(maintain.vanished(files(s, d), _scanned(s, d)), files(s, d), chunks(s, d), None, vecs(s, d))


def delete_cascade(s, d):
    kept = _gone(s, d)
    parts = [kept[n].select(F.lit(n).alias("tbl"), F.col(k).alias("row_key")) for n, k in (("files", "file_id"), ("chunks", "chunk_id"), ("vectors", "chunk_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def replace_chunks(s, d):
    own = chunks(s, d).select("chunk_id", "file_id", "start_line", "end_line")
    new = own.where(F.col("file_id") % 9 == 0).select((F.col("chunk_id") + 1_000_000_000).alias("chunk_id"), "file_id", "start_line", "end_line")
    return maintain.replace_rows(own, new, "file_id")


def get_chunk(s, d):
    """Every chunk with its file's path."""
    return chunks(s, d).join(files(s, d).select("file_id", "path"), "file_id").select("chunk_id", "path", "content", "start_line", "end_line")


def list_chunks_by_file(s, d):
    own = chunks(s, d).join(files(s, d).select("file_id", "path"), "file_id")
    return own.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("chunk_id")), lambda x: x.cast("string")), ",").alias("chunk_ids"))


def list_files(s, d):
    return files(s, d).select("path").orderBy("path")


def sha256_hash(s, d):
    return files(s, d).select("file_id", text.sha256_hex(F.col("content")).alias("sha256"))


def data_dir_hash(s, d):
    return read_table(s, d, "projects").distinct().select("path", text.data_dir_name(F.col("path")).alias("folder"))


def lang_dim(s, d):
    return files(s, d).select("path", scan.language_for(scan.extension(F.col("path"))).alias("grammar"))


def embedding_safe(s, d):
    return documents(s, d).where(text.embedding_safe(F.col("text"))).select("doc_id")


def truncate_runes(s, d):
    return documents(s, d).select("doc_id", text.truncate_runes(F.col("text"), 100).alias("head"))


def split_comma(s, d):
    return documents(s, d).select("doc_id", F.array_join(text.split_comma(F.col("text")), "|").alias("parts"))


def stem_terms(s, d):
    own = documents(s, d).select("doc_id", F.explode(stemmed(text.tokens(F.col("text")))).alias("term"))
    return own.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def _probe(s, d):
    row = vecs(s, d).where((F.size("embedding") == 96) & F.col("embedding").isNotNull()).orderBy("chunk_id").select("embedding").first()
    return row["embedding"]


def knn_l2(s, d):
    return vectors.nearest(vecs(s, d), _probe(s, d), 20).select("chunk_id", F.round("distance", 6).alias("distance"), "rank")


def vector_rr(s, d):
    return vectors.nearest(vecs(s, d), _probe(s, d), 20).select("chunk_id", F.round(1.0 / F.col("rank"), 6).alias("score"))


def hybrid_fusion(s, d):
    near = vectors.nearest(vecs(s, d), _probe(s, d), 2 * LIMIT)
    return search.fuse(_best(s, d, 2 * LIMIT), near, LIMIT).select("chunk_id", F.round("score", 6).alias("score"))


def hybrid_results(s, d):
    """Fused results with path and lines; chunks without their file drop out."""
    ix = stored(s, d)
    return _shape(ix, finder.hybrid(ix, _terms(s), _probe(s, d), LIMIT))


def hybrid_bm25_only(s, d):
    none = vecs(s, d).where(F.lit(False)).select("chunk_id", F.lit(1).alias("rank"))
    return search.fuse(_best(s, d, 2 * LIMIT), none, LIMIT).select("chunk_id", F.round("score", 6).alias("score"))


def vector_upsert(s, d):
    own = vecs(s, d).where(F.size("embedding") == 96)
    new = own.where(F.col("chunk_id") % 3 == 0).select("chunk_id", F.transform("embedding", lambda x: (x * 2).cast("float")).alias("embedding"), F.lit("new").alias("metadata"))
    return vectors.upsert(own, new, 96).select("chunk_id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), "metadata")


def vector_delete(s, d):
    return vectors.delete(vecs(s, d), chunks(s, d).where(F.col("file_id") % 2 == 0)).select("chunk_id")


def embed_hash(s, d):
    return embeddings.embed_chunks(chunks(s, d), embeddings.HashProvider(8)).select("chunk_id", F.size("embedding").alias("dims"), "status")


def classify_events(s, d):
    return watch.relevant(events(s, d)).groupBy("path", "op").agg(F.count("*").alias("n"))


def debounce_events(s, d):
    own = watch.relevant(events(s, d))
    return watch.debounce_batch(own, 600, ["path"], order=["op"]).select("path", "first_ts", "last_ts", "op", "events")


def apply_events(s, d):
    """Each path's last operation by event time, and whether the index knows the path."""
    last = watch.final_state(watch.relevant(events(s, d)), ["ts", "seen_at", "op"])
    known = files(s, d).select("path", F.lit(True).alias("known")).distinct()
    return last.join(known, "path", "left").select("path", "op", F.coalesce("known", F.lit(False)).alias("known"))


def debounce_global(s, d):
    """Each path's last operation in each burst, a burst ending when no path had an event for two seconds."""
    return watch.debounce_all(watch.relevant(events(s, d)), 2, order=["op"]).select("burst", "path", "op", "last_ts", "events")


def _result(s, d):
    top = search.results(_best(s, d), stored(s, d).rows("chunks"))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))  # the limit's rows


def results_json(s, d):
    own = _result(s, d)
    return own.select("rank", render.result_json(F.col("uri"), F.round("score", 3), F.col("start_line"), F.col("end_line"), F.col("matched_terms")).alias("json"))


def results_markdown(s, d):
    return _result(s, d).select("rank", render.markdown(F.col("rank"), F.col("uri"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("block"))


# ---- the same in SQL --------------------------------------------------------------


def _tok(x: str) -> str:
    """Terms of a text as a DuckDB list."""
    cut = "s"
    for pattern, with_ in (("([A-Z]+)([A-Z][a-z])", r"\1 \2"), ("([a-z])([A-Z])", r"\1 \2"), ("([A-Za-z_])([0-9])", r"\1 \2"), ("([0-9])([A-Za-z_])", r"\1 \2"), ("(_+)", r" \1 ")):
        cut = f"regexp_replace({cut}, '{pattern}', '{with_}', 'g')"
    split = f"CASE WHEN regexp_full_match(s, '[A-Za-z0-9_]+') THEN string_split({cut}, ' ') ELSE [s] END"
    return rf"list_filter(list_transform(flatten(list_transform(regexp_extract_all(coalesce({x}, ''), '[\p{{L}}\p{{N}}_]+'), lambda s: {split})), lambda t: lower(t)), lambda t: strlen(t) >= 2)"


_BASE = f"""
f AS (SELECT DISTINCT * FROM files),
c AS (SELECT DISTINCT * FROM chunks),
v AS (SELECT DISTINCT * FROM vectors),
tok AS (SELECT chunk_id, file_id, content, start_line, end_line, {_tok("content")} AS ts FROM c),
post AS (SELECT chunk_id, term, CAST(count(*) AS INTEGER) AS raw_freq FROM (SELECT chunk_id, unnest(ts) AS term FROM tok) GROUP BY ALL),
dl AS (SELECT chunk_id, len(ts) AS dl FROM tok),
n AS (SELECT greatest(count(*), 1) AS n FROM c),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT term, ln((n + 1) / (df + 1)) + 1 AS idf FROM df, n),
tfidf AS (SELECT chunk_id, term, raw_freq, raw_freq / greatest(dl, 1) AS tf, raw_freq / greatest(dl, 1) * idf AS tfidf FROM post JOIN dl USING (chunk_id) JOIN idf USING (term)),
q AS (SELECT unnest([{", ".join(f"'{t}'" for t in TERMS)}]) AS term, unnest(range({len(TERMS)})) AS k),
cand AS (SELECT post.chunk_id, term, k, raw_freq, dl, path, tok.content, tok.start_line, tok.end_line
         FROM post JOIN q USING (term) JOIN tok ON tok.chunk_id = post.chunk_id JOIN dl ON dl.chunk_id = post.chunk_id JOIN f ON f.file_id = tok.file_id)
"""


def _bm25(name: str, source: str, avgdl: str) -> str:
    return f"""
{name}_avg AS ({avgdl}),
{name} AS (
  SELECT 'file://' || any_value(path) AS uri,
         sum(idf * raw_freq * 2.2 / (raw_freq + 1.2 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))) AS score,
         array_to_string(list(term ORDER BY k), ' ') AS matched_terms, any_value(start_line) AS start_line, any_value(end_line) AS end_line, chunk_id,
         any_value(content) AS content, list(term ORDER BY k) AS terms
  FROM {source} JOIN idf USING (term), {name}_avg GROUP BY chunk_id
)"""


_STORAGE = _bm25("r", "cand", "SELECT greatest(avg(dl), 1.0) AS avgdl FROM (SELECT DISTINCT chunk_id, dl FROM cand)")
_TOP = "SELECT uri, round(score, 6) AS score, matched_terms, start_line, end_line, chunk_id FROM r ORDER BY r.score DESC, chunk_id LIMIT 10"
_NEAR = f"""
p AS ({PROBE.replace("vectors", "v")}),
near AS (SELECT chunk_id, list_sum(list_transform(list_zip(v.embedding, p.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))) AS distance
         FROM v, p WHERE v.embedding IS NOT NULL AND len(v.embedding) = 96 ORDER BY distance, chunk_id LIMIT 20),
ranked AS (SELECT *, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM near)
"""
_SCANNED = """
s AS (SELECT * REPLACE (mtime + CASE WHEN file_id % 7 = 0 THEN 5000 ELSE 400 END AS mtime,
      CASE WHEN file_id % 5 = 0 THEN 'x' || coalesce(hash, '') ELSE hash END AS hash) FROM f WHERE file_id % 11 <> 0),
new AS (SELECT s.* FROM s LEFT JOIN f ON s.path = f.path WHERE NOT coalesce(s.hash = f.hash AND abs(s.mtime - f.mtime) <= 1000, false))
"""
_MATCH = "contains(path, '/src/') AND NOT contains(path, '/tests/') AND NOT contains(path, 'vendor') AND (ends_with(path, 'go') OR ends_with(path, '.py') OR ends_with(path, 'ts'))"
_EVENTS = """
e0 AS (SELECT DISTINCT * FROM file_events),
e AS (SELECT path, ts, seen_at, CASE lower(trim(op)) WHEN 'create' THEN 'Add' WHEN 'add' THEN 'Add' WHEN 'write' THEN 'Change' WHEN 'change' THEN 'Change'
      WHEN 'modify' THEN 'Change' WHEN 'remove' THEN 'Remove' WHEN 'delete' THEN 'Remove' END AS op FROM e0),
r AS (SELECT * FROM e WHERE path IS NOT NULL AND op IS NOT NULL AND NOT regexp_matches(path, '(^|/)(\\.git|node_modules|vendor|dist|build)/'))
"""


#: The grammar of each extension, pair by pair.
_GRAMMAR_SQL = """
m AS (SELECT * FROM (VALUES
  ('go', 'go'), ('js', 'javascript'), ('javascript', 'javascript'), ('mjs', 'javascript'), ('cjs', 'javascript'), ('ts', 'typescript'), ('typescript', 'typescript'),
  ('tsx', 'tsx'), ('css', 'css'), ('md', 'markdown'), ('markdown', 'markdown'), ('yaml', 'yaml'), ('yml', 'yaml'), ('toml', 'toml'), ('proto', 'protobuf'),
  ('protobuf', 'protobuf'), ('json', 'json'), ('py', 'python'), ('python', 'python'), ('rb', 'ruby'), ('ruby', 'ruby'), ('c', 'c'), ('h', 'c'), ('cpp', 'cpp'),
  ('cc', 'cpp'), ('cxx', 'cpp'), ('hpp', 'cpp'), ('hh', 'cpp'), ('hxx', 'cpp'), ('cs', 'csharp'), ('csharp', 'csharp'), ('sh', 'bash'), ('bash', 'bash'),
  ('html', 'html'), ('htm', 'html'), ('java', 'java'), ('rs', 'rust'), ('rust', 'rust'), ('swift', 'swift'), ('php', 'php'), ('lua', 'lua'), ('kt', 'kotlin'),
  ('kotlin', 'kotlin'), ('scala', 'scala'), ('sc', 'scala'), ('groovy', 'groovy'), ('grvy', 'groovy'), ('gy', 'groovy'), ('gvy', 'groovy'), ('ex', 'elixir'),
  ('exs', 'elixir'), ('elixir', 'elixir'), ('elm', 'elm'), ('ml', 'ocaml'), ('mli', 'ocaml'), ('ocaml', 'ocaml'), ('hcl', 'hcl'), ('cue', 'cue'),
  ('dockerfile', 'dockerfile'), ('svelte', 'svelte'), ('sql', 'sql')) AS pairs(ext, grammar))
"""


def _chunk_sql(size: int) -> str:
    """Line packing as a recursive walk over each file's lines."""
    return f"""
WITH RECURSIVE f AS (SELECT DISTINCT file_id, content FROM files WHERE content <> ''),
l AS (SELECT file_id, string_split(content, chr(10)) AS ls FROM f),
w AS (
  SELECT file_id, ls, 0 AS n, '' AS buf, 1 AS start, CAST([] AS STRUCT(content VARCHAR, start_line INTEGER, end_line INTEGER)[]) AS out FROM l
  UNION ALL
  SELECT file_id, ls, n + 1,
    CASE WHEN full_ AND strlen(line) > {size} THEN '' WHEN full_ THEN line ELSE joined END,
    CASE WHEN full_ AND strlen(line) > {size} THEN n + 2 WHEN full_ THEN n + 1 ELSE start END,
    CASE WHEN full_ AND strlen(line) > {size} THEN [{{'content': buf, 'start_line': CAST(start AS INTEGER), 'end_line': CAST(n AS INTEGER)}}, {{'content': line, 'start_line': CAST(n + 1 AS INTEGER), 'end_line': CAST(n + 1 AS INTEGER)}}]
         WHEN full_ THEN [{{'content': buf, 'start_line': CAST(start AS INTEGER), 'end_line': CAST(n AS INTEGER)}}] ELSE [] END
  FROM (SELECT *, strlen(joined) > {size} AND buf <> '' AS full_ FROM
    (SELECT *, CASE WHEN buf = '' THEN line ELSE buf || chr(10) || line END AS joined FROM (SELECT *, ls[n + 1] AS line FROM w WHERE n < len(ls))))
),
parts AS (
  SELECT file_id, n AS pos, unnest(out) AS p, generate_subscripts(out, 1) AS sub FROM w
  UNION ALL
  SELECT file_id, n + 1, {{'content': buf, 'start_line': CAST(start AS INTEGER), 'end_line': CAST(n AS INTEGER)}}, 1 FROM w WHERE n = len(ls) AND buf <> ''
)
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY pos, sub) - 1 AS INTEGER) AS ordinal, p.content AS content, 'text' AS type, p.start_line AS start_line, p.end_line AS end_line FROM parts
"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1]


SQL: dict[str, str] = {
    "tokenize_terms": f"SELECT doc_id, term, CAST(count(*) AS INTEGER) AS raw_freq FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY ALL",
    "token_counts": _with(_BASE, "SELECT chunk_id, CAST(dl AS INTEGER) AS token_count FROM dl"),
    "tokenize_identifier_edges": f"SELECT segment, array_to_string({_tok('segment')}, ' ') AS terms FROM (SELECT DISTINCT unnest(string_split(path, '/')) AS segment FROM files)",
    "postings_tf": _with(_BASE, "SELECT chunk_id, term, raw_freq, round(tf, 6) AS tf FROM tfidf"),
    "doc_freqs_list": _with(_BASE, "SELECT t.term, coalesce(df, 0) AS df FROM (SELECT term FROM q UNION SELECT 'nosuchterm') t LEFT JOIN df ON df.term = t.term"),
    "doc_freqs_all": _with(_BASE, "SELECT term, df FROM df"),
    "idf_all": _with(_BASE, "SELECT term, round(idf, 6) AS idf FROM idf"),
    "tfidf_vectors": _with(_BASE, "SELECT chunk_id, term, raw_freq, round(tf, 6) AS tf, round(tfidf, 6) AS tfidf FROM tfidf"),
    "chunk_magnitude": _with(_BASE, "SELECT c.chunk_id, round(coalesce(m, 0), 6) AS magnitude FROM c LEFT JOIN (SELECT chunk_id, sqrt(sum(tfidf * tfidf)) AS m FROM tfidf GROUP BY chunk_id) x ON x.chunk_id = c.chunk_id"),
    "index_stats": _with(_BASE, "SELECT (SELECT count(DISTINCT path) FROM f) AS files, count(*) AS chunks, round(greatest(avg(dl), 1.0), 6) AS avgdl FROM dl"),
    "chunk_lines_1000": _chunk_sql(1000),
    "chunk_lines_200": _chunk_sql(200),
    "search_candidates": _with(_BASE, "SELECT chunk_id, term, raw_freq, path, start_line, end_line, CAST(dl AS INTEGER) AS token_count FROM cand"),
    "bm25_memory": _with(_BASE, _bm25("r", "cand", "SELECT greatest(avg(dl), 1.0) AS avgdl FROM dl"), _TOP),
    "bm25_storage": _with(_BASE, _STORAGE, _TOP),
    "bm25_filtered": _with(_BASE, f"sel AS (SELECT * FROM cand WHERE {_MATCH})", _bm25("r", "sel", "SELECT greatest(avg(dl), 1.0) AS avgdl FROM (SELECT DISTINCT chunk_id, dl FROM sel)"), _TOP),
    "matched_terms": _with(_BASE, _STORAGE, "SELECT chunk_id, matched_terms FROM r"),
    "query_idf": _with(_BASE, "SELECT t.term, coalesce(df, 0) AS df, round(ln((n + 1) / (coalesce(df, 0) + 1)) + 1, 6) AS idf FROM (SELECT term FROM q UNION SELECT 'nosuchterm') t LEFT JOIN df ON df.term = t.term, n"),
    "path_filter": _with(_BASE, f"SELECT file_id, path FROM f WHERE {_MATCH}"),
    "ext_filter": _with(_BASE, "SELECT file_id, path FROM f WHERE ends_with(path, 'go')"),
    "skip_dirs": _with(_BASE, r"SELECT file_id, path FROM f WHERE NOT regexp_matches(path, '(^|/)(\.git|node_modules|vendor|dist|build)/')"),
    "scan_filters": _with(_BASE, r"SELECT path, size, mtime FROM f WHERE lower(regexp_extract(path, '(\.[^./]*)$', 1)) IN ('.go', '.py') AND size <= 4000"),
    "change_detection": _with(_BASE, _SCANNED, "SELECT file_id, path FROM new"),
    "event_change_detection": _with(_BASE, _SCANNED, "SELECT s.file_id, s.path FROM s LEFT JOIN f ON s.path = f.path WHERE NOT coalesce(s.hash = f.hash, false)"),
    "deleted_paths": _with(_BASE, _SCANNED, "SELECT path FROM f WHERE path NOT IN (SELECT path FROM s)"),
    "upsert_files": _with(_BASE, _SCANNED, "SELECT file_id, path, hash, mtime FROM f WHERE path NOT IN (SELECT path FROM new) UNION ALL SELECT file_id, path, hash, mtime FROM new"),
    "delete_cascade": _with(
        _BASE, _SCANNED, "g AS (SELECT file_id FROM f WHERE path NOT IN (SELECT path FROM s))", "gc AS (SELECT chunk_id FROM c WHERE file_id IN (SELECT file_id FROM g))",
        """SELECT 'files' AS tbl, file_id AS row_key FROM f WHERE file_id NOT IN (SELECT file_id FROM g)
UNION ALL SELECT 'chunks', chunk_id FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM gc) UNION ALL SELECT 'vectors', chunk_id FROM v WHERE chunk_id NOT IN (SELECT chunk_id FROM gc)""",
    ),
    "replace_chunks": _with(_BASE, "SELECT chunk_id + CASE WHEN file_id % 9 = 0 THEN 1000000000 ELSE 0 END AS chunk_id, file_id, start_line, end_line FROM c"),
    "get_chunk": _with(_BASE, "SELECT chunk_id, path, c.content, start_line, end_line FROM c JOIN f USING (file_id)"),
    "list_chunks_by_file": _with(_BASE, "SELECT path, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunk_ids FROM c JOIN f USING (file_id) GROUP BY path"),
    "list_files": _with(_BASE, "SELECT path FROM f ORDER BY path"),
    "sha256_hash": _with(_BASE, "SELECT file_id, sha256(content) AS sha256 FROM f"),
    "data_dir_hash": "SELECT DISTINCT path, substr(sha256(path), 1, 16) AS folder FROM (SELECT DISTINCT * FROM projects)",
    "lang_dim": _with(_BASE, _GRAMMAR_SQL, r"SELECT path, grammar FROM f LEFT JOIN m ON m.ext = lower(regexp_extract(path, '\.([^./]*)$', 1))"),
    "truncate_runes": "SELECT doc_id, substr(text, 1, 100) AS head FROM documents",
    "split_comma": "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS parts FROM documents",
    "knn_l2": _with(_BASE, _NEAR, "SELECT chunk_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM ranked"),
    "vector_rr": _with(_BASE, _NEAR, "SELECT chunk_id, round(1.0 / rank, 6) AS score FROM ranked"),
    "hybrid_fusion": _with(
        _BASE, _STORAGE, _NEAR, "b AS (SELECT chunk_id, score / max(score) OVER () AS b FROM (SELECT * FROM r ORDER BY score DESC, chunk_id LIMIT 20))",
        "x AS (SELECT coalesce(b.chunk_id, ranked.chunk_id) AS chunk_id, 0.5 * coalesce(b, 0) + 0.5 * coalesce(1.0 / rank, 0) AS score FROM b FULL JOIN ranked ON b.chunk_id = ranked.chunk_id)",
        "SELECT chunk_id, round(score, 6) AS score FROM x ORDER BY x.score DESC, chunk_id LIMIT 10",
    ),
    "hybrid_bm25_only": _with(_BASE, _STORAGE, "b AS (SELECT chunk_id, 0.5 * score / max(score) OVER () AS score FROM (SELECT * FROM r ORDER BY score DESC, chunk_id LIMIT 20))", "SELECT chunk_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, chunk_id LIMIT 10"),
    "hybrid_results": _with(
        _BASE, _STORAGE, _NEAR, "b AS (SELECT chunk_id, matched_terms, score / max(score) OVER () AS b FROM (SELECT * FROM r ORDER BY score DESC, chunk_id LIMIT 20))",
        "x AS (SELECT coalesce(b.chunk_id, ranked.chunk_id) AS chunk_id, coalesce(matched_terms, '') AS matched_terms, 0.5 * coalesce(b, 0) + 0.5 * coalesce(1.0 / rank, 0) AS score FROM b FULL JOIN ranked ON b.chunk_id = ranked.chunk_id)",
        "t AS (SELECT * FROM x ORDER BY score DESC, chunk_id LIMIT 10)",
        "SELECT 'file://' || path AS uri, round(score, 6) AS score, matched_terms, start_line, end_line, chunk_id FROM t JOIN c USING (chunk_id) JOIN f USING (file_id)",
    ),
    "index_build": _with(
        _BASE,
        "SELECT 'files' AS tbl, count(DISTINCT file_id) AS n FROM f UNION ALL SELECT 'chunks', count(DISTINCT chunk_id) FROM c UNION ALL SELECT 'postings', count(*) FROM post"
        " UNION ALL SELECT 'vectors', count(DISTINCT chunk_id) FROM v UNION ALL SELECT 'idf', count(*) FROM df",
    ),
    "store_rebuild": _with(_BASE, "SELECT chunk_id, term, raw_freq, round(tfidf, 6) AS tfidf FROM tfidf"),
    "store_magnitudes": _with(_BASE, "SELECT c.chunk_id, round(coalesce(m, 0), 6) AS magnitude FROM c LEFT JOIN (SELECT chunk_id, sqrt(sum(tfidf * tfidf)) AS m FROM tfidf GROUP BY chunk_id) x ON x.chunk_id = c.chunk_id"),
    "vector_upsert": _with(_BASE, "SELECT chunk_id, round(CAST(CASE WHEN chunk_id % 3 = 0 THEN embedding[1] * 2 ELSE embedding[1] END AS DOUBLE), 6) AS first, CASE WHEN chunk_id % 3 = 0 THEN 'new' ELSE metadata END AS metadata FROM v WHERE len(embedding) = 96"),
    "vector_delete": _with(_BASE, "SELECT chunk_id FROM v WHERE chunk_id NOT IN (SELECT chunk_id FROM c WHERE file_id % 2 = 0)"),
    "classify_events": _with(_EVENTS, "SELECT path, op, count(*) AS n FROM r GROUP BY ALL"),
    "debounce_events": _with(
        _EVENTS, "g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY path ORDER BY ts, op))",
        "i AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, op ROWS UNBOUNDED PRECEDING) AS island FROM g)",
        "SELECT path, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(op, (ts, op)) AS op, count(*) AS events FROM i GROUP BY path, island",
    ),
    "debounce_global": _with(
        _EVENTS, "g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, path, op) < INTERVAL 2 SECOND THEN 0 ELSE 1 END AS fresh FROM r)",
        "i AS (SELECT *, sum(fresh) OVER (ORDER BY ts, path, op ROWS UNBOUNDED PRECEDING) AS burst FROM g)",
        "SELECT CAST(burst AS BIGINT) AS burst, path, arg_max(op, (ts, op)) AS op, max(ts) AS last_ts, count(*) AS events FROM i GROUP BY burst, path",
    ),
    "apply_events": _with(_EVENTS, "SELECT path, arg_max(op, (ts, seen_at, op)) AS op, path IN (SELECT path FROM files) AS known FROM r GROUP BY path"),
    "results_markdown": _with(
        _BASE, _STORAGE, "t AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM r)",
        "SELECT CAST(rank AS INTEGER) AS rank, '### ' || rank || '. ' || substr(uri, 8) || ' (L' || start_line || '-L' || end_line || ')' || chr(10) || chr(10) || '```' || chr(10) || regexp_replace(content, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') || chr(10) || '```' || chr(10) || chr(10) AS block FROM t WHERE rank <= 10",
    ),
}

#: Printing characters and separators.
_PRINTS = r"[\p{L}\p{M}\p{N}\p{P}\p{S}\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL |= {
    "results_json": _with(
        _BASE, _STORAGE, "t AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM r)",
        "SELECT CAST(rank AS INTEGER) AS rank, CAST(to_json({'uri': uri, 'path': substr(uri, 8), 'score': round(score, 3), 'start_line': start_line, 'end_line': end_line, 'matched_terms': terms}) AS VARCHAR) AS json FROM t WHERE rank <= 10",
    ),
    "embedding_safe": f"SELECT doc_id FROM documents WHERE length(text) = 0 OR NOT contains(text, chr(0)) AND len(regexp_extract_all(text, '{_PRINTS}')) / length(text) >= 0.85",
    "ignore_rules": _with(
        _BASE, "x AS (SELECT path, regexp_replace(path, '^[^/]*/', '') AS p FROM f)",
        r"""SELECT path FROM x WHERE NOT CASE WHEN regexp_matches(p, '(^|/)build[^/](/|$)') THEN true WHEN regexp_matches(p, '(^|/)keep_[^/]*(/|$)') THEN false
ELSE regexp_matches(p, '^tests/') OR regexp_matches(p, '^docs/') OR regexp_matches(p, '(^|/)[^/]*\.min\.js(/|$)') END""",
    ),
    "merge_small_chunks": f"""
WITH RECURSIVE c AS ({_chunk_sql(200)}),
g AS (
  SELECT file_id, ordinal, content, start_line, end_line, 0 AS part FROM c WHERE ordinal = 0
  UNION ALL
  SELECT file_id, next, CASE WHEN fits THEN content || chr(10) || more ELSE more END, CASE WHEN fits THEN start_line ELSE from_line END, to_line, part + CASE WHEN fits THEN 0 ELSE 1 END
  FROM (SELECT g.*, c.ordinal AS next, c.content AS more, c.start_line AS from_line, c.end_line AS to_line,
          strlen(g.content) + 1 + strlen(c.content) <= 1000 AND g.end_line + 1 >= c.start_line AS fits FROM g JOIN c ON c.file_id = g.file_id AND c.ordinal = g.ordinal + 1)
)
SELECT file_id, part AS ordinal, arg_max(content, ordinal) AS content, 'text' AS type, min(start_line) AS start_line, max(end_line) AS end_line FROM g GROUP BY file_id, part
""",
    "store_refresh": f"""
WITH RECURSIVE c AS ({_chunk_sql(1000)}),
k AS (SELECT file_id, count(*) AS chunks, sum(len({_tok("content")})) AS terms FROM c GROUP BY file_id),
f AS (SELECT DISTINCT * FROM files),{_SCANNED}
SELECT s.path, CASE WHEN n.path IS NULL THEN f.hash ELSE s.hash END AS hash, CASE WHEN n.path IS NULL THEN f.mtime ELSE s.mtime END AS mtime, coalesce(chunks, 0) AS chunks, CAST(coalesce(terms, 0) AS BIGINT) AS terms
FROM s JOIN f ON f.path = s.path LEFT JOIN (SELECT path FROM new) n ON n.path = s.path LEFT JOIN k ON k.file_id = f.file_id WHERE f.content IS NOT NULL
""",
}

NAMES = (
    "tokenize_terms token_counts tokenize_identifier_edges postings_tf doc_freqs_list doc_freqs_all idf_all tfidf_vectors chunk_magnitude index_stats"
    " chunk_lines_1000 chunk_lines_200 merge_small_chunks structural_chunks search_candidates bm25_memory bm25_storage bm25_filtered matched_terms query_idf"
    " path_filter ext_filter skip_dirs scan_filters ignore_rules change_detection event_change_detection deleted_paths upsert_files delete_cascade replace_chunks"
    " get_chunk list_chunks_by_file list_files sha256_hash data_dir_hash lang_dim embedding_safe truncate_runes split_comma stem_terms knn_l2 vector_rr"
    " hybrid_fusion hybrid_results hybrid_bm25_only index_build store_rebuild store_magnitudes store_refresh debounce_global vector_upsert vector_delete embed_hash classify_events debounce_events apply_events results_json results_markdown"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
