"""Documentation chunks: sections, packed paragraphs, word windows, embeddings.

A documentation file is one row. Sections, paragraphs and windows are arrays inside that row, so chunking needs no
shuffle; only the greedy packing of paragraphs is a Python step, on word counts alone.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from logquarry.functions.arrays import unfold
from logquarry.functions.patterns import java
from logquarry.functions.text import base_name, is_blank, split_lines, strip, suffix, word_count, words

TARGET_WORDS = 400
OVERLAP_WORDS = 40
LARGEST_CHUNK = TARGET_WORDS * 3 // 2
EMBEDDING_SIZE = 384

# What opens a section, and the headings of text without one.
HEADING = r"^(#{1,4})\s+(.+)$"
FIRST_HEADING = "Introduction"
PLAIN_HEADING = "Documentation"

IDS = ["repo_id", "file_path", "commit_hash"]


def repo_id(url: Column, branch: Column) -> Column:
    return F.substring(F.sha2(F.concat(url, F.lit("#"), branch), 256), 1, 16)


def positions(items: Column) -> Column:
    """0 .. size-1; empty for an empty array."""
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))


def sections(docs: DataFrame) -> DataFrame:
    """Sections of Markdown texts: heading and stripped content with the heading line; empty ones are dropped."""
    def is_heading(line: Column) -> Column:
        return line.rlike(java(HEADING))

    split = docs.select(*IDS, split_lines(F.col("content")).alias("body"))
    heads = F.filter(positions(F.col("body")), lambda i: (i == 0) | is_heading(F.get("body", i)))
    marked = split.withColumn("starts", heads)
    title = F.transform("starts", lambda i: F.when(
        is_heading(F.get("body", i)), strip(F.regexp_extract(F.get("body", i), java(HEADING), 2))
    ).otherwise(F.lit(FIRST_HEADING)))
    marked = marked.withColumn("titles", title)
    first = F.lit(FIRST_HEADING)
    cut = F.transform("starts", lambda at, k: F.struct(
        k.alias("section"),
        F.when(F.get("titles", k) != "", F.get("titles", k)).otherwise(F.coalesce(
            F.try_element_at(F.filter(F.slice("titles", 1, k + 1), lambda t: t != ""), F.lit(-1)), first))
        .alias("heading"),
        strip(F.array_join(F.slice(
            "body", at + 1, F.coalesce(F.get("starts", k + 1), F.size("body")) - at), "\n")).alias("content")))
    rows = unfold(marked, IDS, cut, "s").select(*IDS, "s.*")
    return rows.where(F.length("content") > 0)


RANGES = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


@F.pandas_udf(RANGES)
def packed(sizes: pd.Series) -> pd.Series:
    """Ranges of paragraphs per chunk, from the word counts of one document's paragraphs."""
    def ranges(counts):
        out, first, total = [], 0, 0
        for i, size in enumerate(counts):
            if total + size > TARGET_WORDS and first < i:
                out.append({"first": first, "last": i - 1})
                keep, carried = i, 0
                if i - first > 1:
                    while carried + counts[keep - 1] <= OVERLAP_WORDS:
                        keep -= 1
                        carried += counts[keep]
                        if keep == first:
                            break
                first, total = keep, carried
            total += size
        if first < len(counts):
            out.append({"first": first, "last": len(counts) - 1})
        return out

    return sizes.map(ranges)


def with_paragraphs(docs: DataFrame) -> DataFrame:
    """Add `parts`: runs of non-blank lines, stripped. Each step is a column, so no array is computed per element."""
    body = docs.withColumn("body", split_lines(F.col("content")))
    blank = body.withColumn("blank", F.transform("body", is_blank))
    edges = blank.withColumns({
        "opens": F.filter(positions(F.col("blank")), lambda i: ~F.get("blank", i) & F.coalesce(
            F.get("blank", i - 1), F.lit(True))),
        "ends": F.filter(positions(F.col("blank")), lambda i: ~F.get("blank", i) & F.coalesce(
            F.get("blank", i + 1), F.lit(True)))})
    return edges.withColumn("parts", F.zip_with("opens", "ends", lambda a, b: strip(
        F.array_join(F.slice("body", a + 1, b - a + 1), "\n"))))


def packed_paragraphs(docs: DataFrame) -> DataFrame:
    """Plain texts packed to about 400 words per chunk; short trailing paragraphs open the next chunk again."""
    parts = with_paragraphs(docs).select(*IDS, "parts")
    sized = parts.withColumn("ranges", packed(F.transform("parts", word_count)))
    return unfold(sized, [*IDS, "parts"], "ranges", "r", "section").select(
        *IDS, "section", F.lit(PLAIN_HEADING).alias("heading"),
        F.array_join(F.slice("parts", F.col("r.first") + 1, F.col("r.last") - F.col("r.first") + 1), "\n\n")
        .alias("content"))


def word_windows(chunks: DataFrame) -> DataFrame:
    """Chunks of more than 600 words cut into windows of 400 with 40 shared; later parts are named in the heading."""
    step = TARGET_WORDS - OVERLAP_WORDS
    counted = chunks.withColumn("words", words(F.col("content")))
    n = F.size("words")
    pieces = F.transform(
        F.sequence(F.lit(0), F.ceil(F.greatest(n - TARGET_WORDS, F.lit(0)) / step).cast("int")),
        lambda i: F.struct(
            (i + 1).alias("part"), F.array_join(F.slice("words", i * step + 1, TARGET_WORDS), " ").alias("content")))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("part"), F.col("content").alias("content")))
    rest = [c for c in chunks.columns if c not in ("content", "heading")]
    cut = unfold(counted, [*rest, F.col("heading").alias("base")],
                 F.when(n > LARGEST_CHUNK, pieces).otherwise(whole), "p")
    return cut.select(
        *rest,
        F.when(F.col("p.part") > 1, F.concat("base", F.lit(" (part "), F.col("p.part").cast("string"), F.lit(")")))
        .otherwise(F.col("base")).alias("heading"),
        F.col("p.content").alias("content"), F.col("p.part").alias("part"))


def to_chunks(pieces: DataFrame) -> DataFrame:
    """Add a stable chunk id and the metadata."""
    text_hash = F.md5("content")
    part = F.when(F.col("part").isNotNull(), F.concat(F.lit("_"), (F.col("part") - 1).cast("string"))).otherwise("")
    return pieces.select(
        F.concat(F.concat_ws(":", "repo_id", base_name(F.col("file_path")), text_hash), part).alias("chunk_id"),
        *IDS, "heading", "content",
        F.struct(
            suffix(F.col("file_path")).alias("file_extension"),
            word_count(F.col("content")).alias("word_count"),
            F.length("content").cast("int").alias("char_count"),
            F.col("part").cast("int").alias("part"),
        ).alias("metadata"))


def chunk_documents(docs: DataFrame) -> DataFrame:
    """Chunks of documentation files: Markdown by section, everything else by paragraph, both cut to size."""
    is_markdown = F.lower(suffix(F.col("file_path"))) == ".md"
    pieces = sections(docs.where(is_markdown)).unionByName(packed_paragraphs(docs.where(~is_markdown)))
    return to_chunks(word_windows(pieces))


def embed(rows: DataFrame, text: str = "content", out: str = "embedding", size: int = EMBEDDING_SIZE,
          embedder: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """Add unit vectors. A given embedder maps a batch of texts to a matrix; the default counts words by the
    leading 32 bits of their md5."""
    if embedder is not None:
        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            matrix = np.asarray(embedder(texts.fillna("").tolist()), dtype=np.float64)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            return pd.Series(list((matrix / np.where(norms == 0, 1, norms)).astype(np.float32)))

        return rows.withColumn(out, run(F.col(text)))

    @F.pandas_udf("array<float>")
    def unit_counts(places: pd.Series) -> pd.Series:
        counts = [np.bincount(np.asarray(p, np.int64), minlength=size).astype(np.float64) for p in places]
        return pd.Series([(c / (np.sqrt((c * c).sum()) or 1)).astype(np.float32) for c in counts])

    places = F.transform(words(F.lower(F.coalesce(F.col(text), F.lit("")))), lambda w: F.pmod(
        F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(size)))
    return rows.withColumn(out, unit_counts(places))
