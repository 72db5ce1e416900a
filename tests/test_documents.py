import random
import re

import numpy as np
from pyspark.sql import functions as F

from logquarry.operators import documents, knowledge, payloads, retrieval
from logquarry.plans.analyze import with_documentation

GUIDE = "intro text\nmore\n\n# One\nbody one\n##### not a section\n## Two \n\n### \t \nunder blank title\n#### Four\n" + "w " * 1200


def docs(spark, files):
    rows = [("r", name, "c", text) for name, text in files.items()]
    return spark.createDataFrame(rows, "repo_id string, file_path string, commit_hash string, content string")


def sequential_sections(text):
    out, heading, body = [], "Introduction", []
    for line in text.replace("\r\n", "\n").split("\n"):
        m = re.match(r"^(#{1,4})\s+(.+)$", line)
        if m:
            if "\n".join(body).strip():
                out.append((heading, "\n".join(body).strip()))
            heading, body = m.group(2).strip() or heading, [line]
        else:
            body.append(line)
    if "\n".join(body).strip():
        out.append((heading, "\n".join(body).strip()))
    return out


def sequential_packing(text):
    parts = [p.strip() for p in re.split(r"(?:^|\n)[ \t]*(?:\n[ \t]*)*(?:\n|$)", text) if p.strip()]
    out, held, total = [], [], 0
    for part in parts:
        size = len(part.split())
        if held and total + size > 400:
            out.append("\n\n".join(held))
            kept = []
            if len(held) > 1:
                while len(kept) < len(held) and sum(len(p.split()) for p in held[len(held) - len(kept) - 1:]) <= 40:
                    kept = held[len(held) - len(kept) - 1:]
            held = list(kept)
            total = sum(len(p.split()) for p in held)
        held.append(part)
        total += size
    return out + (["\n\n".join(held)] if held else [])


def test_sections(spark):
    rows = documents.sections(docs(spark, {"guide.md": GUIDE, "empty.md": "", "plain.md": "a\nb"})).orderBy("section").collect()
    got = [(r.heading, r.content) for r in rows if r.file_path == "guide.md"]
    assert got == sequential_sections(GUIDE)
    assert [h for h, _ in got] == ["Introduction", "One", "Two", "Two", "Four"]
    assert [(r.heading, r.content) for r in rows if r.file_path == "plain.md"] == [("Introduction", "a\nb")]


def test_packing(spark):
    rnd = random.Random(1)
    files = {"notes.txt": "\n \n".join(" ".join(["w"] * n) for n in (15, 390, 30, 5, 700)), "none.txt": " \n\n"}
    for i in range(30):
        sizes = [rnd.choice([1, 5, 20, 39, 40, 41, 100, 399, 400, 401, 700]) for _ in range(rnd.randint(1, 25))]
        files[f"f{i}.txt"] = "\n\n".join(" ".join(f"p{k}" for _ in range(n)) for k, n in enumerate(sizes))
    rows = documents.packed_paragraphs(docs(spark, files)).orderBy("section").collect()
    for name, text in files.items():
        assert [r.content for r in rows if r.file_path == name] == sequential_packing(text), name


def test_windows_and_metadata(spark):
    sizes = [1, 599, 600, 601, 759, 760, 761, 1120, 1121, 3000]
    rows = spark.createDataFrame([("r", f"d/n{n}.md", "c", "H", " ".join(map(str, range(n)))) for n in sizes],
                                 "repo_id string, file_path string, commit_hash string, heading string, content string")
    chunks = documents.to_chunks(documents.word_windows(rows)).collect()
    for n in sizes:
        words, expected, start = list(map(str, range(n))), [], 0
        while n > 600:
            expected.append(" ".join(words[start:start + 400]))
            if start + 400 >= n:
                break
            start += 360
        got = sorted((c for c in chunks if c.file_path == f"d/n{n}.md"), key=lambda c: c.metadata.part or 0)
        assert [c.content for c in got] == (expected or [" ".join(words)])
        assert [c.heading for c in got] == ["H"] + [f"H (part {i})" for i in range(2, len(got) + 1)]
        assert all(c.metadata.word_count == len(c.content.split()) and c.metadata.char_count == len(c.content)
                   and c.metadata.file_extension == ".md" for c in got)
    assert len({c.chunk_id for c in chunks}) == len(chunks)


def test_chunking_by_suffix(spark):
    chunks = documents.chunk_documents(docs(spark, {"a/guide.MD": "# T\nx", "b/notes.rst": "# T\n\nx"})).collect()
    assert sorted((c.file_path, c.heading, c.content) for c in chunks) == [
        ("a/guide.MD", "T", "# T\nx"), ("b/notes.rst", "Documentation", "# T\n\nx")]


def test_embeddings(spark):
    rows = spark.createDataFrame([("disk full error",), ("disk full error",), ("Disk FULL Error",), ("other words",), ("",)],
                                 "content string")
    vectors = [np.array(r.embedding) for r in documents.embed(rows, size=64).collect()]
    assert np.allclose(vectors[0], vectors[1]) and np.allclose(vectors[0], vectors[2])
    assert abs(np.linalg.norm(vectors[0]) - 1) < 1e-5 and np.linalg.norm(vectors[4]) == 0
    own = documents.embed(rows, embedder=lambda texts: np.array([[len(t), 1.0] for t in texts])).collect()
    assert np.allclose(own[0].embedding, np.array([15, 1]) / np.linalg.norm([15, 1]), atol=1e-6)


def test_query_text_order(spark):
    excerpt = ["ConnectionError in app.py", "MyException at modules/light TypeError", "the Mqttservice timed: SSL failed app.py"]
    row = spark.range(1).select(retrieval.query_text(
        F.lit("msg"), F.array(*[F.lit(e) for e in excerpt]), F.lit("pipe")).alias("q")).first()
    assert row.q == "msg MyException ConnectionError TypeError app.py modules/light Mqttservice connection failed ssl pipe"


def vectors(spark, n, dim, seed, repeat=False):
    rnd = np.random.default_rng(seed)
    data = rnd.normal(size=(n, dim))
    if repeat:
        data[n // 2:] = data[: n - n // 2]
    return data, [(int(i), f"r{i % 3}", [float(x) for x in v], f"h{i}", f"text {i % 7}", f"d/f{i}.md") for i, v in enumerate(data)]


CHUNKS = "chunk_id long, repo_id string, vector array<float>, heading string, content string, file_path string"


def test_nearest_is_exact_for_any_tiling(spark):
    data, rows = vectors(spark, 60, 8, 1, repeat=True)
    chunks = spark.createDataFrame(rows, CHUNKS)
    queries = chunks.select(F.col("chunk_id").alias("query_id"), "vector")
    unit = data.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    for tiles in ((1000, 1000), (7, 11), (60, 1)):
        got = {(r.query_id, r["rank"]): r.chunk_id for r in retrieval.nearest(queries, chunks, 4, None, *tiles).collect()}
        for q in range(60):
            best = sorted(range(60), key=lambda c: (-scores[q, c], c))[:4]
            assert [got[(q, k)] for k in range(1, 5)] == best


def test_nearest_sends_rows_a_bounded_number_of_times(spark, monkeypatch):
    """Small tiles do not send every row to as many units as the table has tiles; equal scores still go by id."""
    monkeypatch.setattr(retrieval, "SCORES", 50)
    data, rows = vectors(spark, 200, 4, 5, repeat=True)
    chunks = spark.createDataFrame(rows, CHUNKS)
    queries = chunks.select(F.col("chunk_id").alias("query_id"), "vector", "repo_id")
    unit = data.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    seen = spark.sparkContext.accumulator(0)
    plain = retrieval.best_of

    def counted(asked, offered, k):
        seen.add(len(asked))
        return plain(asked, offered, k)

    monkeypatch.setattr(retrieval, "best_of", counted)
    for bucket in (None, "repo_id"):
        seen.value = 0
        got = {(r.query_id, r["rank"]): r.chunk_id for r in retrieval.nearest(queries, chunks, 3, bucket, 2, 2).collect()}
        assert 200 <= seen.value <= 200 * retrieval.TILES
        for q in range(200):
            own = [c for c in range(200) if bucket is None or c % 3 == q % 3]
            best = sorted(own, key=lambda c: (-scores[q, c], c))[:3]
            assert [got[(q, k)] for k in range(1, 4)] == best


def test_best_rows_without_numbers_come_last():
    asked, offered = np.eye(2), np.array([[np.nan, 0], [0.5, 0], [0.25, 0.1], [0.5, 0]])
    rows, columns, scores = retrieval.best_of(asked, offered, 3)
    assert rows.tolist() == [0, 0, 0, 1, 1, 1] and columns.tolist() == [1, 3, 2, 2, 1, 3]
    assert scores.tolist() == [0.5, 0.5, 0.25, 0.1, 0, 0]


def test_fewer_chunks_than_k_and_buckets(spark):
    _, rows = vectors(spark, 5, 4, 2)
    chunks = spark.createDataFrame(rows, CHUNKS)
    queries = chunks.select(F.col("chunk_id").alias("query_id"), "vector", F.lit("r0").alias("repo_id"))
    assert retrieval.nearest(queries, chunks, 10).count() == 25
    got = retrieval.nearest(queries, chunks, 10, bucket="repo_id").collect()
    assert {r.chunk_id for r in got} == {0, 3} and len(got) == 10


def test_retrieval_rules(spark):
    def unit(angle):
        return [float(np.cos(angle)), float(np.sin(angle))]

    rows = [(0, "a", unit(0), "h0", "same", "x/f0.md"), (1, "a", unit(0.1), "h1", "same", "f1.md"),
            (2, "a", unit(0.2), "h2", "two", "f2.md"), (3, "b", unit(0.0), "h3", "three", "f3.md"),
            (4, "a", unit(1.5), "h4", "far", "f4.md"), (5, "a", unit(3.0), "h5", "behind", "f5.md")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    queries = spark.createDataFrame([(9, "m", unit(0.0))], "query_id long, module string, vector array<double>")
    repos = spark.createDataFrame([("m", "a"), ("m", "a"), ("n", "b")], "module string, repo_id string")

    def ids(**options):
        return [r.chunk_id for r in retrieval.retrieve(queries, chunks, repos, **options).orderBy("rank").collect()]

    assert ids() == [0, 2]
    assert ids(top_k=1) == [0]
    assert ids(max_chunks=1) == [0]
    assert ids(prefilter=False, max_chunks=1) == [0]
    assert ids(similarity="inverse") == [4, 5]
    hits = retrieval.retrieve(queries, chunks, repos)
    row = payloads.docs_context(hits, ["query_id"]).first()
    assert row.context == "\n\n--- Relevant Documentation ---\n\n1. h0\nsame\n\n2. h2\ntwo\n"
    assert row.citations == ["[1] h0 (f0.md)", "[2] h2 (f2.md)"]


def test_chunk_table(spark, tmp_path):
    stored = spark.createDataFrame([("a", "r1", "old"), ("b", "r1", "old"), ("c", "r2", "old")],
                                   "chunk_id string, repo_id string, content string")
    incoming = spark.createDataFrame([("b", "r1", "mid", 1), ("b", "r1", "new", 2), ("d", "r1", "new", 1)],
                                     "chunk_id string, repo_id string, content string, seq int")
    merged = knowledge.upserted(stored, incoming, "seq")
    assert sorted(tuple(r) for r in merged.collect()) == [
        ("a", "r1", "old"), ("b", "r1", "new"), ("c", "r2", "old"), ("d", "r1", "new")]
    path = str(tmp_path / "chunks")
    knowledge.write_chunks(merged, path)
    knowledge.write_chunks(merged.where("chunk_id = 'a'"), path)
    assert sorted(r.chunk_id for r in spark.read.parquet(path).collect()) == ["a", "c"]
    assert knowledge.without_repo(merged, "r1").count() == 1
    repos = spark.createDataFrame([("r1", "h", "h"), ("r2", "h", "g"), ("r3", "h", "h"), ("r4", "h", None)],
                                  "repo_id string, commit_hash string, indexed_hash string")
    assert sorted(r.repo_id for r in knowledge.reindex_plan(repos, merged).collect()) == ["r2", "r3", "r4"]
    marked = knowledge.mark_indexed(repos, repos.where("repo_id = 'r2'"))
    assert {r.repo_id: r.indexed_hash for r in marked.collect()} == {"r1": "h", "r2": "h", "r3": "h", "r4": None}
    empty = knowledge.store_stats(spark.createDataFrame([], "chunk_id string, embedding array<float>")).first()
    assert tuple(empty) == (0, 0, 384, 0.0)


def test_documentation_for_findings(spark):
    files = {"disk.md": "# Disk full\nfree some disk space when disk is full", "net.md": "# Network\ncheck the network cable"}
    chunks = documents.embed(documents.chunk_documents(docs(spark, files)), size=256).withColumnRenamed("embedding", "vector")
    findings = spark.createDataFrame(
        [(1, "m", "disk is full", ["disk full"], "p"), (2, "m", "disk is full", ["disk full"], "p"), (3, "n", "x", ["x"], "p")],
        "id long, module_name string, message string, excerpt array<string>, pipeline_name string")
    repos = spark.createDataFrame([("m", "r")], "module string, repo_id string")
    rows = with_documentation(findings, chunks, repos, size=256, threshold=0.3).orderBy("id").collect()
    assert rows[0].citations[0] == "[1] Disk full (disk.md)" and rows[0].context == rows[1].context
    assert rows[2].context is None


def test_indexed_chunks(spark, monkeypatch):
    """All cells give the exact answer; the probes of the default find nine tenths of it; odd tables give defined results."""
    from logquarry.operators import chunk_index

    rnd = np.random.default_rng(3)
    middles = rnd.normal(size=(30, 16))
    vectors = middles[rnd.integers(0, 30, 1500)] + rnd.normal(size=(1500, 16)) * 0.4
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows + [(9999, None), (10000, [0.0] * 16)], "chunk_id long, vector array<double>")
    queries = spark.createDataFrame([(i, v) for i, v in rows if i % 10 == 0], "query_id long, vector array<double>")
    index = chunk_index.build(chunks, sample=600)
    assert index.cells.count() == 1501 and len(index.centres) == 39
    exact = retrieval.nearest(queries, chunks.where("vector IS NOT NULL"), 5)
    expected = sorted(map(tuple, exact.select("query_id", "rank", "chunk_id").collect()))
    every = chunk_index.search(index, queries, 5, probes=len(index.centres))
    assert sorted(map(tuple, every.select("query_id", "rank", "chunk_id").collect())) == expected
    found = chunk_index.recall(chunk_index.search(index, queries, 5), exact).first()
    assert found["hits"] == 750 and found["recall"] >= 0.9
    # Cells of several groups: the same as with a bucket for each cell, and each query goes once to a group.
    monkeypatch.setattr(chunk_index, "CHUNK_TILE", 100)
    monkeypatch.setattr(chunk_index, "TILES", 6)
    groups = chunk_index.cell_groups(index)
    assert len(groups) == 39 and groups == sorted(groups) and 4 <= len(set(groups)) <= 7
    sent = queries.select("query_id", F.explode(chunk_index.grouped(index.centres, 20, groups)("vector")).alias("g"))
    assert sent.groupBy("query_id", "g.part").count().where("count > 1").count() == 0
    assert {r.n for r in sent.groupBy("query_id").agg(F.sum(F.size("g.cells")).alias("n")).collect()} == {20}
    cells = queries.select("query_id", "vector", F.explode(chunk_index.closest(index.centres, 20)("vector")).alias("cell"))
    plain = retrieval.nearest(cells, index.cells, 5, bucket="cell").select("query_id", "rank", "chunk_id")
    several = chunk_index.search(index, queries, 5, probes=20).select("query_id", "rank", "chunk_id")
    assert sorted(map(tuple, several.collect())) == sorted(map(tuple, plain.collect()))
    assert chunk_index.search(chunk_index.build(chunks.limit(0)), queries, 5).count() == 0
    assert chunk_index.search(index, queries.limit(0), 5).count() == 0


def test_products_of_32_bits_leave_out_only_what_cannot_be_among_the_best():
    """Hits are those of all products, also where many are equal, differ less than 32 bits can tell or round alike; few
    vectors are multiplied in 64 bits."""
    import numpy as np
    import pandas as pd

    from logquarry.operators import retrieval

    def slow(asked, offered, k, allowed):
        scores = np.round(np.einsum("id,jd->ij", asked, offered), 6) + 0.0
        return [(i, j, scores[i, j]) for i in range(len(asked))
                for j in sorted(np.flatnonzero(allowed[i]), key=lambda j: (-scores[i, j], j))[:k]]

    draw = np.random.default_rng(8)
    base = draw.normal(size=(700, 24))
    near = base[:150] + draw.normal(size=(150, 24)) * 1e-7
    offered = np.concatenate([base, near, base[:40], base[:40], np.zeros((30, 24)), np.repeat(base[5:6], 90, axis=0) + draw.normal(size=(90, 24)) * 3e-6])
    offered = retrieval.unit(pd.Series(list(offered[draw.permutation(len(offered))])))
    asked = np.concatenate([offered[::9], retrieval.unit(pd.Series(list(draw.normal(size=(40, 24)))))])
    every = np.ones((len(asked), len(offered)), bool)
    cell = draw.integers(0, 6, len(offered))
    cells = pd.Series([np.sort(draw.permutation(6)[:draw.integers(1, 5)]).astype(np.int32) for _ in asked])
    some = np.array([np.isin(cell, c) for c in cells])
    for k in (1, 5, 20):
        assert [*zip(*retrieval.best_of(asked, offered, k), strict=True)] == slow(asked, offered, k, every)
        assert [*zip(*retrieval.best_in_cells(asked, cells, offered, cell, k), strict=True)] == slow(asked, offered, k, some)
    rows, _ = retrieval.candidates(asked[-40:].astype(np.float32), offered.astype(np.float32), 5, None)
    assert len(rows) < len(offered)
