"""Queries on documentation: chunking, the chunk table, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.functions.text import base_name, split_lines, suffix
from logquarry.operators import chunk_index, documents, knowledge, payloads, retrieval
from logquarry.plans.registry import LOGS, query
from logquarry.sources import sinks
from logquarry.sources.tables import document_logs, file_folder, spread, table
from logquarry.sources.text_logs import scan_documentation
from logquarry.staging import new_folder, plain_folder

# Every seventh line becomes a heading, of one to five marks.
MARKDOWN = f"""{LOGS}, md AS (SELECT file_path, line_no, CASE WHEN line_no % 7 = 3
  THEN concat(repeat('#', CAST(1 + line_no % 5 AS INT)), ' ', line) ELSE line END AS line FROM lines)"""


def markdown(spark, folder):
    body = F.transform(split_lines(F.col("text")), lambda line, i: F.when(
        (i + 1) % 7 == 3, F.concat(F.repeat(F.lit("#"), 1 + (i + 1) % 5), F.lit(" "), line)).otherwise(line))
    return document_logs(spark, folder).select(
        F.lit("r").alias("repo_id"), "file_path", F.lit("c").alias("commit_hash"),
        F.array_join(body, "\n").alias("content"))


@query("doc_sections", f"""WITH {MARKDOWN}, heads AS (SELECT *, regexp_matches(line, '^#{{1,4}}\\s+.+$') AS head FROM md),
parts AS (SELECT *, sum(CASE WHEN head OR line_no = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY line_no)
  - 1 AS section FROM heads)
SELECT file_path, CAST(section AS BIGINT) AS section, CASE WHEN bool_or(head)
  THEN trim(regexp_extract(min(line) FILTER (head), '^#{{1,4}}\\s+(.+)$', 1)) ELSE 'Introduction' END AS heading,
  trim(string_agg(line, chr(10) ORDER BY line_no)) AS content FROM parts GROUP BY 1, 2
HAVING trim(string_agg(line, chr(10) ORDER BY line_no)) <> ''""")
def doc_sections(spark, folder):
    return documents.sections(markdown(spark, folder)).select(
        "file_path", F.col("section").cast("long").alias("section"), "heading", "content")


def whole_documents(spark, folder):
    return document_logs(spark, folder).select(
        F.lit("r").alias("repo_id"), "file_path", F.lit("c").alias("commit_hash"), F.lit("Doc").alias("heading"),
        F.col("text").alias("content"))


@query("doc_word_windows", """WITH w AS (SELECT concat(source, '/', doc_id, '.log') AS file_path, text,
  regexp_extract_all(text, '[^\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+') AS ws
  FROM documents),
cut AS (SELECT file_path, ws, text, unnest(CASE WHEN len(ws) > 600
  THEN range(0, CAST(ceil((len(ws) - 400) / 360.0) AS BIGINT) + 1) ELSE [-1] END) AS i FROM w),
pieces AS (SELECT file_path, i, CASE WHEN i < 0 THEN text ELSE array_to_string(ws[i * 360 + 1 : i * 360 + 400], ' ') END
  AS content, CASE WHEN i < 0 THEN len(ws) ELSE len(ws[i * 360 + 1 : i * 360 + 400]) END AS word_count FROM cut)
SELECT file_path, CASE WHEN i > 0 THEN concat('Doc (part ', i + 1, ')') ELSE 'Doc' END AS heading,
  CASE WHEN i >= 0 THEN i + 1 END AS part, content, word_count, length(content) AS char_count,
  '.log' AS file_extension, concat('r:', split_part(file_path, '/', 2), ':', md5(content), CASE WHEN i >= 0
  THEN concat('_', i) ELSE '' END) AS chunk_id FROM pieces""")
def doc_word_windows(spark, folder):
    chunks = documents.to_chunks(documents.word_windows(whole_documents(spark, folder)))
    return chunks.select(
        "file_path", "heading", F.col("metadata.part").cast("long").alias("part"), "content",
        F.col("metadata.word_count").cast("long").alias("word_count"),
        F.col("metadata.char_count").cast("long").alias("char_count"), "metadata.file_extension", "chunk_id")


@query("doc_paragraph_pack", f"""WITH RECURSIVE {LOGS},
sizes AS (SELECT file_path, line, row_number() OVER w AS i, sum(n) OVER w AS cum, n FROM (SELECT *, len(regexp_extract_all(
  line, '[^\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'))
  AS n FROM lines WHERE trim(line) <> '') WINDOW w AS (PARTITION BY file_path ORDER BY line_no)),
ends AS (SELECT file_path, max(i) + 1 AS past FROM sizes GROUP BY 1),
carry AS (SELECT a.file_path, a.i, coalesce(min(b.i), a.i) AS keep FROM sizes a LEFT JOIN sizes b ON
  b.file_path = a.file_path AND b.i < a.i AND a.cum - a.n - (b.cum - b.n) <= 40 GROUP BY 1, 2),
steps AS (
  SELECT e.file_path, 1 AS first, coalesce(min(z.i), any_value(past)) AS i FROM ends e
  LEFT JOIN sizes z ON z.file_path = e.file_path AND z.i > 1 AND z.cum > 400 GROUP BY 1
  UNION ALL
  SELECT x.file_path, any_value(x.first), coalesce(min(z.i), any_value(past)) FROM (
    SELECT s.file_path, s.i AS at, CASE WHEN s.i - s.first > 1 THEN greatest(s.first, c.keep) ELSE s.i END AS first
    FROM steps s JOIN carry c ON c.file_path = s.file_path AND c.i = s.i) x
  JOIN sizes f ON f.file_path = x.file_path AND f.i = x.first JOIN ends e ON e.file_path = x.file_path
  LEFT JOIN sizes z ON z.file_path = x.file_path AND z.i > x.at AND z.cum - (f.cum - f.n) > 400 GROUP BY x.file_path)
SELECT s.file_path, 'Documentation' AS heading, string_agg(z.line, chr(10) || chr(10) ORDER BY z.i) AS content
FROM steps s JOIN sizes z ON z.file_path = s.file_path AND z.i >= s.first AND z.i < s.i GROUP BY s.file_path, s.first, s.i""")
def doc_paragraph_pack(spark, folder):
    """Every line is a paragraph."""
    spaced = document_logs(spark, folder).select(
        F.lit("r").alias("repo_id"), "file_path", F.lit("c").alias("commit_hash"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"))
    return documents.packed_paragraphs(spaced).select("file_path", "heading", "content")


@query("retrieval_query_text", """WITH p AS (SELECT page_id, html AS t FROM pages),
found AS (SELECT page_id, list_concat(['page'],
  regexp_extract_all(t, '(?i)\\b\\w+Exception\\b'), regexp_extract_all(t, '(?i)\\b\\w+Error\\b'),
  regexp_extract_all(t, '\\b\\w+\\.py\\b'), regexp_extract_all(t, '\\b\\w+\\.js\\b'), regexp_extract_all(t, '\\b\\w+\\.php\\b'),
  regexp_extract_all(t, '\\bmodules/\\w+\\b'), regexp_extract_all(t, '\\bcomponents/\\w+\\b'),
  regexp_extract_all(t, '\\bservices/\\w+\\b'), regexp_extract_all(t, '(?i)\\b\\w+integration\\b'),
  regexp_extract_all(t, '(?i)\\b\\w+service\\b'), regexp_extract_all(t, '(?i)\\b\\w+plugin\\b'),
  regexp_extract_all(t, '(?i)\\b\\w+module\\b'), regexp_extract_all(t, '(?i)\\b\\w+component\\b'),
  [k FOR k IN ['connection', 'timeout', 'failed', 'denied', 'forbidden', 'unauthorized', 'certificate', 'ssl', 'tls',
   'database', 'authentication', 'permission', 'configuration', 'dependency'] IF contains(lower(t), k)],
  ['web']) AS parts FROM p)
SELECT page_id, array_to_string(list_filter(parts, lambda x, i: list_position(parts, x) = i), ' ') AS parts FROM found""")
def retrieval_query_text(spark, folder):
    pages = spread(table(spark, folder, "pages"), "page_id")
    parts = retrieval.query_parts(F.lit("page"), F.array("html"), F.lit("web"))
    return pages.select("page_id", F.array_join(parts, " ").alias("parts"))


@query("doc_scan", """SELECT doc_id, 'r' AS repo_id, length(text) + 1 AS n_chars, md5(concat(text, chr(10))) AS content_md5
FROM documents""")
def doc_scan(spark, folder):
    """Texts written as one file each and scanned as documentation; hidden files beside them are left out."""
    target = plain_folder(spark, new_folder(spark, "docs"))
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    sinks.write_files(docs.select(file_folder("doc_id").alias("folder"), "doc_id", F.col("text").alias("value")), target, ["folder"], "doc_id")
    found = scan_documentation(spark, target, "r", "c", ["**/*.txt"])
    return found.select(
        F.regexp_extract("file_path", r"/doc_id=(\d+)[/.]", 1).cast("long").alias("doc_id"), "repo_id",
        F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("content_md5"))


def vector_queries(spark, folder):
    rows = table(spark, folder, "embeddings")
    return rows.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("m"), "label").alias("module"),
                       F.col("embedding").alias("vector"))


def vector_chunks(spark, folder):
    rows = table(spark, folder, "embeddings")
    return rows.select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("repo_id"),
        F.col("embedding").alias("vector"), F.concat(F.lit("H"), "vec_id").alias("heading"),
        F.concat(F.lit("text "), F.col("vec_id") % 97).alias("content"),
        F.concat(F.lit("docs/guide"), F.col("vec_id") % 13, F.lit(".md")).alias("file_path"))


def module_repos(spark, folder):
    labels = table(spark, folder, "embeddings").select("label").distinct()
    return labels.select(F.concat(F.lit("m"), "label").alias("module"), F.explode(F.array(
        F.col("label").cast("string"), ((F.col("label") + 3) % 10).cast("string"))).alias("repo_id"))


PAIRS = """pairs AS (SELECT q.vec_id AS query_id, q.label AS q_label, c.vec_id AS chunk_id, c.label AS c_label,
  round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings c)"""


@query("knn", f"""WITH {PAIRS} SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pairs) WHERE rank <= 5""")
def knn(spark, folder):
    hits = retrieval.nearest(vector_queries(spark, folder), vector_chunks(spark, folder), 5)
    return hits.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


OWN = "(c_label = q_label OR c_label = (q_label + 3) % 10)"


@query("knn_indexed")
def knn_indexed(spark, folder):
    index = chunk_index.build(vector_chunks(spark, folder))
    return chunk_index.search(index, vector_queries(spark, folder), 5).select(
        "query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("knn_index_recall", f"""WITH {PAIRS} SELECT count(*) AS hits, true AS enough FROM (SELECT row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pairs) WHERE rank <= 5""")
def knn_index_recall(spark, folder):
    queries, chunks = vector_queries(spark, folder), vector_chunks(spark, folder)
    found = chunk_index.search(chunk_index.build(chunks), queries, 5)
    return chunk_index.recall(found, retrieval.nearest(queries, chunks, 5)).select("hits", (F.col("recall") >= 0.9).alias("enough"))


@query("knn_repo", f"""WITH {PAIRS} SELECT query_id, chunk_id, score, rank FROM (SELECT *,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pairs WHERE {OWN}) WHERE rank <= 5""")
def knn_repo(spark, folder):
    queries = retrieval.in_repos(vector_queries(spark, folder), module_repos(spark, folder))
    hits = retrieval.nearest(queries, vector_chunks(spark, folder), 5, bucket="repo_id", query_tile=64, chunk_tile=32)
    return hits.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def retrieved_sql(source: str, similarity: str, threshold: float) -> str:
    return f"""{PAIRS}, {source},
good AS (SELECT *, concat('text ', chunk_id % 97) AS content FROM hits WHERE {similarity} >= {threshold}),
single AS (SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY rank) AS copy FROM good),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM single WHERE copy = 1)"""


FILTERED = f"""hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)
  AS rank FROM pairs WHERE {OWN}) WHERE rank <= 10)"""
OVERFETCHED = f"""wide AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)
  AS wide_rank FROM pairs) WHERE wide_rank <= 20), hits AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY wide_rank) AS rank FROM wide WHERE {OWN}) WHERE rank <= 10)"""


@query("retrieve_threshold", f"""WITH {retrieved_sql(FILTERED, "score", 0.1)}
SELECT query_id, chunk_id, place AS rank, content FROM final WHERE place <= 5""")
def retrieve_threshold(spark, folder):
    hits = retrieval.retrieve(vector_queries(spark, folder), vector_chunks(spark, folder), module_repos(spark, folder),
                              threshold=0.1)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "content")


@query("retrieve_inverse_similarity", f"""WITH {retrieved_sql(OVERFETCHED, "1 / (1 + score)", 0.7)}
SELECT query_id, chunk_id, place AS rank, content FROM final WHERE place <= 5""")
def retrieve_inverse_similarity(spark, folder):
    hits = retrieval.retrieve(vector_queries(spark, folder), vector_chunks(spark, folder), module_repos(spark, folder),
                              similarity="inverse", prefilter=False)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "content")


@query("docs_context", f"""WITH {retrieved_sql(FILTERED, "score", 0.1)}
SELECT query_id, concat(chr(10), chr(10), '--- Relevant Documentation ---', chr(10), string_agg(concat(chr(10), place,
   '. H', chunk_id, chr(10), content, chr(10)), '' ORDER BY place)) AS context,
  string_agg(concat('[', place, '] H', chunk_id, ' (guide', chunk_id % 13, '.md)'), '|' ORDER BY place) AS citations
FROM final WHERE place <= 5 GROUP BY 1""")
def docs_context(spark, folder):
    hits = retrieval.retrieve(vector_queries(spark, folder), vector_chunks(spark, folder), module_repos(spark, folder),
                              threshold=0.1)
    return payloads.docs_context(hits, ["query_id"]).select(
        "query_id", "context", F.array_join("citations", "|").alias("citations"))


def supplier_repos(spark, folder):
    rows = table(spark, folder, "supplier")
    url = F.concat(F.lit("https://git.example.org/"), F.col("s_name"))
    return rows.select(
        documents.repo_id(url, F.lit("main")).alias("repo_id"), url.alias("url"), F.lit("main").alias("branch"),
        F.concat(F.lit("c"), "s_nationkey").alias("commit_hash"),
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("c"), "s_nationkey")).when(
            F.col("s_suppkey") % 3 == 1, "old").alias("indexed_hash"), "s_suppkey")


def supplier_chunks(spark, folder):
    vectors = table(spark, folder, "embeddings")
    repos = supplier_repos(spark, folder).select("repo_id", F.col("s_suppkey").alias("label"))
    return vectors.join(repos, "label").select(
        F.concat(F.lit("k"), "vec_id").alias("chunk_id"), "repo_id", "label", "embedding")


REPOS = """repos AS (SELECT substr(sha256(concat('https://git.example.org/', s_name, '#main')), 1, 16) AS repo_id,
  concat('https://git.example.org/', s_name) AS url, concat('c', s_nationkey) AS commit_hash, CASE s_suppkey % 3 WHEN 0
  THEN concat('c', s_nationkey) WHEN 1 THEN 'old' END AS indexed_hash, coalesce(n, 0) AS chunk_count, s_suppkey
  FROM supplier LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) ON label = s_suppkey)"""


@query("repo_status", f"""WITH {REPOS} SELECT repo_id, url, commit_hash, indexed_hash, chunk_count,
  indexed_hash IS DISTINCT FROM commit_hash AS needs_reindexing FROM repos""")
def repo_status(spark, folder):
    return knowledge.repo_status(supplier_repos(spark, folder), supplier_chunks(spark, folder)).drop(
        "branch", "s_suppkey")


@query("reindex_plan", f"""WITH {REPOS} SELECT repo_id, chunk_count FROM repos
WHERE indexed_hash IS DISTINCT FROM commit_hash OR chunk_count = 0""")
def reindex_plan(spark, folder):
    return knowledge.reindex_plan(supplier_repos(spark, folder), supplier_chunks(spark, folder)).select(
        "repo_id", "chunk_count")


@query("chunk_counts", f"WITH {REPOS} SELECT repo_id, chunk_count FROM repos WHERE chunk_count > 0")
def chunk_counts(spark, folder):
    return knowledge.chunk_counts(supplier_chunks(spark, folder))


@query("store_stats", """SELECT count(*) AS total_chunks, count(embedding) AS vectors, max(len(embedding)) AS dimension,
  round(count(*) * max(len(embedding)) * 4 / 1073741824.0, 9) AS estimated_gb FROM embeddings""")
def store_stats(spark, folder):
    return knowledge.store_stats(table(spark, folder, "embeddings")).withColumn(
        "estimated_gb", F.round("estimated_gb", 9))


@query("repo_chunks", """SELECT vec_id AS chunk_id, label FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 100""")
def repo_chunks(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("repo_id"), "label")
    return knowledge.repo_chunks(rows, "3").select("chunk_id", F.col("label"))


@query("upsert_chunks", """WITH incoming AS (SELECT doc_id AS chunk_id, concat('new ', max(seq)) AS heading FROM (
  SELECT doc_id, 1 AS seq FROM labels UNION ALL SELECT doc_id, 2 + quality FROM labels) GROUP BY 1)
SELECT vec_id AS chunk_id, concat('old ', label) AS heading FROM embeddings WHERE vec_id NOT IN (SELECT chunk_id FROM incoming)
UNION ALL SELECT chunk_id, heading FROM incoming""")
def upsert_chunks(spark, folder):
    stored = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.concat(F.lit("old "), "label").alias("heading"))
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("chunk_id"), F.explode(F.array(
        F.lit(1), 2 + F.col("quality"))).alias("seq"))
    incoming = labels.withColumn("heading", F.concat(F.lit("new "), F.col("seq").cast("string")))
    return knowledge.upserted(stored, incoming, "seq")


@query("delete_repo", "SELECT vec_id AS chunk_id, CAST(label AS VARCHAR) AS repo_id FROM embeddings WHERE label <> 4")
def delete_repo(spark, folder):
    return knowledge.without_repo(vector_chunks(spark, folder), "4").select("chunk_id", "repo_id")


@query("embed_hash", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text),
  '[^\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+')) AS word FROM documents),
b AS (SELECT doc_id, CAST(concat('0x', md5(word)[1:8]) AS BIGINT) % 64 AS bucket, count(*) AS n FROM w GROUP BY ALL),
v AS (SELECT doc_id, count(*) AS n_buckets, min(bucket) FILTER (n = most) + 1 AS largest,
  round(max(n) / sqrt(sum(n * n)), 4) AS most FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS most FROM b) GROUP BY doc_id)
SELECT doc_id, coalesce(n_buckets, 0) AS n_buckets, coalesce(largest, 1) AS largest, coalesce(most, 0) AS most,
  CASE WHEN n_buckets > 0 THEN 1.0::DOUBLE ELSE 0 END AS length FROM documents LEFT JOIN v USING (doc_id)""")
def embed_hash(spark, folder):
    vectors = documents.embed(table(spark, folder, "documents").select("doc_id", "text"), text="text", size=64)
    vector = F.col("embedding")
    length = F.sqrt(retrieval.inner_product(vector, vector))
    return vectors.select(
        "doc_id", F.size(F.filter(vector, lambda x: x > 0)).cast("long").alias("n_buckets"),
        F.array_position(vector, F.array_max(vector)).alias("largest"),
        F.round(F.array_max(vector).cast("double"), 4).alias("most"), F.round(length, 4).alias("length"))


@query("unit_vectors", """SELECT vec_id, round(list_sum([v * v FOR v IN CAST(embedding AS DOUBLE[])]), 4) AS norm,
  round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum([v * v FOR v IN CAST(embedding AS DOUBLE[])])), 5) AS head
  FROM embeddings""")
def unit_vectors(spark, folder):
    rows = table(spark, folder, "embeddings")
    return rows.select("vec_id", F.round(retrieval.inner_product(F.col("embedding"), F.col("embedding")), 4).alias("norm"),
                       F.round(retrieval.normalised(F.col("embedding"))[0], 5).alias("head"))


@query("page_paths", """SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, CASE WHEN
  regexp_matches(regexp_extract(url, '([^/]*)$', 1), '[^.]\\.?\\.[^.]+$') THEN regexp_extract(url, '(\\.[^.]+)$', 1) ELSE '' END
  AS ext, substr(sha256(concat(url, '#', 'main')), 1, 16) AS repo_id FROM pages""")
def page_paths(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", base_name(F.col("url")).alias("base"), suffix(F.col("url")).alias("ext"),
                        documents.repo_id(F.col("url"), F.lit("main")).alias("repo_id"))
