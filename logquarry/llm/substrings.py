"""Removal of repeated passages: every byte covered by a WIDTH-byte string that also starts earlier.

1. Anchors. The anchor of a WIDTH-byte string is its k-gram with the least hash, leftmost of equal ones; equal strings
   have equal anchors. Consecutive strings with one anchor form a segment. Only anchors met twice or more are followed.
2. Equal segments are grouped, so a passage that thousands of documents share is one segment with its first place.
   All strings of its later places start earlier elsewhere.
3. Different segments with one anchor may share strings. Blocks of them are laid end to end and compared on a
   Burrows-Wheeler transform: breadth-first backward extension of intervals gives common prefixes by increasing value
   and stops at WIDTH; suffixes with no boundary between them by then share a string. The earliest place keeps it.
4. The strings to remove become spans of bytes, which are cut out of the texts.

An anchor with more than CROWD different segments (a frequent short line in many surroundings) is not put into one
block; the strings of its segments are compared by 128-bit hash with a plain grouping.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from logquarry.llm.common import arrow_batches, documents, query, small
from logquarry.staging import stage

WIDTH, GRAM = 100, 20
CROWD = 20_000
BLOCK_BYTES = 1 << 20
CHUNK = 1 << 20
NO_ID = -(1 << 63)


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on; made by doubling, then scattered."""
    base = np.uint64(0x9E3779B97F4A7C15)
    sums, power, span = data.astype(np.uint64) + np.uint64(1), base, 1
    kept = {}
    while span * 2 <= GRAM:
        kept[span] = sums, power
        sums, power, span = sums[:-span] * power + sums[span:], np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF), span * 2
    left = GRAM - span
    while left:
        step = max(s for s in kept if s <= left)
        more, times = kept[step]
        size = len(sums) - step
        sums = sums[:size] * times + more[span:span + size]
        span, left = span + step, left - step
    sums ^= sums >> np.uint64(29)
    sums *= np.uint64(0xBF58476D1CE4E5B9)
    return sums ^ (sums >> np.uint64(32))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of `width` values from each place on, leftmost of equal ones. The leading 32 bits are
    compared; the place behind them settles ties."""
    best, span = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64), 1
    while span < width:
        step = min(span, width - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


def segments_of(text: bytes) -> tuple[np.ndarray, ...]:
    """(anchor, start, count, place): runs of `count` strings from `start` on with one anchor, which stands `place` bytes
    behind the start. Long texts go chunk by chunk."""
    anchors, starts, counts, places = [], [], [], []
    for at in range(0, len(text) - WIDTH + 1, CHUNK):
        data = np.frombuffer(text[at:at + CHUNK + WIDTH - 1], np.uint8)
        values = grams(data)
        place = least_places(values, WIDTH - GRAM + 1)
        begins = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        anchors.append(values[place[begins]].view(np.int64))
        starts.append(begins + at)
        counts.append(np.diff(np.concatenate([begins, [len(place)]])))
        places.append(place[begins] - begins)
    if not anchors:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(c).astype(np.int64) for c in (anchors, starts, counts, places))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, print, bytes): rows that repeat id and text have one key."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))


def anchor_list(keys: DataFrame) -> DataFrame:
    def work(batch):
        found = [segments_of(b)[0] for b in batch.column(0).to_pylist()]
        yield {"anchor": pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))}

    return arrow_batches(keys.select("bytes"), "anchor bigint", work, 1 << 20)


def segment_list(keys: DataFrame) -> DataFrame:
    """(doc, print, anchor, signature, start, count, place); the signature is a hash of the segment's bytes."""
    def work(batch):
        doc, label, texts = (batch.column(i).to_pylist() for i in range(3))
        out = [[], [], [], [], [], [], []]
        for d, p, text in zip(doc, label, texts, strict=True):
            anchor, start, count, place = segments_of(text)
            digest = xxhash.xxh3_64_intdigest
            marks = np.fromiter((digest(text[s:s + c + WIDTH - 1]) for s, c in zip(start.tolist(), count.tolist(), strict=True)),
                                np.uint64, len(start)).view(np.int64)
            for column, values in zip(out, (np.full(len(start), d), np.full(len(start), p), anchor, marks, start, count, place), strict=True):
                column.append(values)
        names = ("doc", "print", "anchor", "signature", "start", "count", "place")
        yield {n: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for n, c in zip(names, out, strict=True)}

    return arrow_batches(keys, ", ".join(
        f"{n} bigint" for n in ("doc", "print", "anchor", "signature", "start", "count", "place")), work, 1 << 20)


def with_company(variants: DataFrame) -> DataFrame:
    """The segments that may share a string with another one of their anchor.

    A string of WIDTH bytes around an anchor holds half of what is not the anchor on one side of it, at least. So two
    segments that share one agree in the anchor with as many bytes before it, or with as many behind it.
    """
    side = (WIDTH - GRAM) // 2
    place, size = F.col("place"), F.length("bytes")
    core = lambda from_: F.substring("bytes", (from_ + 1).cast("int"), F.lit(side + GRAM))
    keys = F.array_compact(F.array(
        F.when(place >= side, F.xxhash64("anchor", F.lit(0), core(place - side))),
        F.when(size - place >= side + GRAM, F.xxhash64("anchor", F.lit(1), core(place)))))
    named = variants.select("anchor", "signature", F.explode(keys).alias("core"))
    shared = named.groupBy("core").count().where("count > 1").select("core")
    kept = named.join(shared, "core", "left_semi").select("anchor", "signature").distinct()
    return variants.join(kept, ["anchor", "signature"], "left_semi")


def suffix_order(symbols: np.ndarray, separators: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse, from the first five symbols on by putting the ranks of neighbouring stretches together. Symbols below `separators` occur once
    each and stand between texts; what follows one does not matter, so it is read as one number."""
    size = len(symbols)
    plain = np.maximum(symbols - (separators - 1), 0)
    key, stop, open_ = np.zeros(size, np.int64), np.zeros(size, np.int64), np.ones(size, bool)
    for step in range(5):
        at = np.minimum(np.arange(step, size + step), size - 1)
        key = key * 257 + np.where(open_, plain[at], 0)
        ends = open_ & (symbols[at] < separators)
        stop[ends] = symbols[at[ends]] + 1
        open_ &= ~ends
    key, span = key * np.int64(separators + 1) + stop, 5
    while True:
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(size, np.int64)
        rank[order] = fresh
        if fresh[-1] == size - 1:
            return order, rank
        # Three ranks fit in one number while there are under two million suffixes; else two.
        parts = 3 if size < (1 << 21) - 1 else 2
        key = rank
        for part in range(1, parts):
            following = np.zeros(size, np.int64)
            following[:max(0, size - part * span)] = rank[part * span:] + 1
            key = key * np.int64(size + 1) + following
        span *= parts


def shared_prefix_classes(symbols: np.ndarray, separators: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, class): suffixes in order, those that share `width` symbols in one class.

    An interval holds the suffixes that begin with one word. Reading the transform inside it, each symbol extends the
    word to the left and leads to the interval of the longer word. Where that interval's end is not yet known as a
    boundary, the common prefix there is the length of the shorter word, and the interval is extended in turn. Level by
    level the words grow by one symbol; at `width` the boundaries that are missing have longer common prefixes.
    """
    order, rank = suffix_order(symbols, separators)
    size = len(symbols)
    back = rank[order - 1]  # where a suffix goes when extended by the symbol before it
    forth = np.empty(size, np.int64)
    forth[back] = np.arange(size)
    first = symbols[order]
    joined = np.concatenate([first[1:] == first[:-1], [False]])
    following = np.where(joined[back], forth[np.minimum(back + 1, size - 1)], size)  # next place with the same symbol
    begun = np.concatenate([[False], joined[:-1]])
    preceding = np.where(begun[back], forth[np.maximum(back - 1, 0)], -1)
    boundary = np.zeros(size + 1, bool)
    boundary[0] = boundary[size] = True
    low, high = np.array([0]), np.array([size - 1])
    for _ in range(width):
        if not len(low):
            break
        sizes = high - low + 1
        which = np.repeat(np.arange(len(low)), sizes)
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which]
        starts = inside[preceding[inside] < low[which]]
        begins = which[preceding[inside] < low[which]]
        last = following[inside] > high[which]
        ends, closes = inside[last], which[last]
        to_low, to_high = back[starts], back[ends]
        to_low = to_low[np.lexsort((to_low, begins))]
        to_high = to_high[np.lexsort((to_high, closes))]
        new = ~boundary[to_high + 1]
        low, high = to_low[new], to_high[new]
        boundary[high + 1] = True
        high, at = np.unique(high, return_index=True)
        low = low[at]
    return order, np.cumsum(boundary[:-1])


def later_strings(texts: list[bytes], docs: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(segment, low, high): runs of offsets of strings that start earlier in another segment; a string's place is
    (doc, start + offset)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    count, total = len(texts), int(lengths.sum()) + len(texts)
    symbols, owner, offset = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
    at = 0
    for i, text in enumerate(texts):
        size = len(text)
        symbols[at:at + size] = np.frombuffer(text, np.uint8).astype(np.int64) + count
        symbols[at + size] = i
        owner[at:at + size + 1] = i
        offset[at:at + size + 1] = np.arange(size + 1)
        at += size + 1
    order, classes = shared_prefix_classes(symbols, count, width)
    several = np.bincount(classes)[classes] > 1
    place, classes = order[several], classes[several]
    later = np.zeros(total, bool)
    if len(place):
        # One number for the place of a string in the corpus: the rank of its document here, then its start.
        rank = np.unique(docs, return_inverse=True)[1]
        where = (rank[owner[place]] << 40) + starts[owner[place]] + offset[place]
        begins = np.concatenate([[0], np.flatnonzero(np.diff(classes)) + 1])
        least = np.minimum.reduceat(where, begins)
        later[place] = where != np.repeat(least, np.diff(np.concatenate([begins, [len(place)]])))
    # Runs of such strings end at the separators, so they can be read off the whole row of symbols.
    edges = np.diff(np.concatenate([[0], later.astype(np.int8), [0]]))
    low, high = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    return owner[low], offset[low], offset[high]


def compared_in_blocks(variants: DataFrame, blocks: int) -> DataFrame:
    """(anchor, signature, low, high): strings of a segment's first place that start earlier in another segment."""
    def work(pdf):
        import pandas as pd

        which, low, high = later_strings(pdf["bytes"].tolist(), pdf["doc"].to_numpy(), pdf["start"].to_numpy())
        return pd.DataFrame({
            "anchor": pdf["anchor"].to_numpy()[which], "signature": pdf["signature"].to_numpy()[which], "low": low, "high": high})

    block = F.pmod(F.xxhash64("anchor"), F.lit(blocks))
    return variants.groupBy(block.alias("block")).applyInPandas(
        lambda pdf: work(pdf), "anchor bigint, signature bigint, low bigint, high bigint")


def compared_by_string(variants: DataFrame) -> DataFrame:
    """The same for crowded anchors, by grouping the strings themselves under a 128-bit hash."""
    def work(batch):
        out = {n: [] for n in ("string", "doc", "place", "anchor", "signature", "low")}
        for row in batch.to_pylist():
            for low in range(row["count"]):
                values = xxhash.xxh3_128_digest(row["bytes"][low:low + WIDTH]), row["doc"], row["start"] + low, row["anchor"], row["signature"], low
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
        yield {n: pa.array(v, pa.binary() if n == "string" else pa.int64()) for n, v in out.items()}

    strings = arrow_batches(
        variants.select("doc", "start", "count", "anchor", "signature", "bytes"),
        "string binary, doc bigint, place bigint, anchor bigint, signature bigint, low bigint", work, 1 << 18)
    firsts = strings.groupBy("string").agg(F.min(F.struct("doc", "place")).alias("lead"))
    later = strings.join(firsts, "string").where("doc <> lead.doc OR place <> lead.place")
    return later.select("anchor", "signature", "low", F.col("low").alias("high"))


def repeated_spans(docs: DataFrame, crowd: int = CROWD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc, print, spans): the byte spans [low, high) to remove, in order and apart; rows without one are absent."""
    keys = keyed(docs).where(F.length("bytes") >= WIDTH)
    anchors = stage(anchor_list(keys).groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    repeated = stage(segment_list(keys).join(small(anchors, 4_000_000), "anchor"), "segments")
    groups = stage(repeated.groupBy("anchor", "signature").agg(
        F.min(F.struct("doc", "start")).alias("lead"), F.max("count").alias("count"), F.max("place").alias("place")), "segment-groups")
    wide = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")
    compared = groups.join(wide, "anchor").select("anchor", "signature", "variants", "count", "place", "lead.*")
    # The texts of first places: where several rows hold one place, they agree in it.
    wanted = compared.join(
        repeated.select("anchor", "signature", "doc", "start", "print"), ["anchor", "signature", "doc", "start"]
    ).groupBy("anchor", "signature", "doc", "start", "count", "place", "variants").agg(F.min("print").alias("print"))
    by_row = stage(wanted.groupBy("doc", "print").agg(
        F.collect_list(F.struct("anchor", "signature", "start", "count", "place", "variants")).alias("places")), "places")
    held = keys.join(small(by_row, 200_000), ["doc", "print"]).select("doc", "print", "bytes", F.explode("places").alias("p"))
    found = stage(held.select(
        "doc", "p.*", F.substring("bytes", (F.col("p.start") + 1).cast("int"), (F.col("p.count") + WIDTH - 1).cast("int")).alias("bytes")
    ), "variants")
    variants = stage(with_company(found).dropDuplicates(["anchor", "signature"]), "compared")
    total = variants.where(f"variants <= {crowd}").agg(F.sum(F.length("bytes"))).first()[0] or 0
    partial = compared_in_blocks(variants.where(f"variants <= {crowd}"), max(1, -(-total // block_bytes)))
    crowded = variants.where(f"variants > {crowd}")
    if not crowded.isEmpty():
        partial = partial.union(compared_by_string(crowded))
    partial = stage(partial, "later-strings")
    placed = repeated.join(groups.select("anchor", "signature", "lead"), ["anchor", "signature"])
    is_lead = (F.col("doc") == F.col("lead.doc")) & (F.col("start") == F.col("lead.start"))
    whole = placed.where(~is_lead).select("doc", "print", F.col("start").alias("low"), (F.col("start") + F.col("count") - 1).alias("high"))
    parts = placed.where(is_lead).join(partial, ["anchor", "signature"]).select(
        "doc", "print", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    every = whole.union(parts).groupBy("doc", "print").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("strings"))

    def work(batch):
        lists = batch.column(2)
        sizes = np.diff(np.asarray(lists.offsets))
        strings = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows, dtype=np.int64) << 40, sizes)
        low, high = row + np.asarray(strings.field(0)), row + np.asarray(strings.field(1)) + WIDTH
        reach = np.maximum.accumulate(high)
        first = np.concatenate([[True], low[1:] > reach[:-1]])
        last = np.concatenate([first[1:], [True]])
        spans = np.bincount((low[first] >> 40), minlength=batch.num_rows)
        mask = np.int64((1 << 40) - 1)
        pieces = pa.StructArray.from_arrays([pa.array(low[first] & mask), pa.array(reach[last] & mask)], ["low", "high"])
        yield {"doc": batch.column(0), "print": batch.column(1),
               "spans": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(spans)]), pa.int32()), pieces)}

    return arrow_batches(every, "doc bigint, print bigint, spans array<struct<low: bigint, high: bigint>>", work, 1 << 20)


def without_repeats(docs: DataFrame, crowd: int = CROWD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (those removed), kept (the remaining bytes).

    Texts are UTF-8 bytes; null counts as empty; strings never cross documents. A string starts earlier at a smaller
    doc_id or, in one document, at a smaller place; a null id is smaller than any other. Rows with equal ids are one
    document: a string at the same place of both starts in neither earlier. Texts under WIDTH bytes are kept whole.
    """
    spans = stage(repeated_spans(docs, crowd, block_bytes), "spans")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", text.cast("binary").alias("bytes"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).alias("print"))
    found = rows.join(small(spans, 200_000), ["doc", "print"], "left")
    # What lies between the spans; the place behind a missing span is the end of the text, that before it the start.
    gap = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.struct(
        F.when(i == 0, F.lit(0)).otherwise(F.try_element_at("spans", F.greatest(i, F.lit(1)))["high"]).cast("int").alias("low"),
        F.coalesce(F.try_element_at("spans", i + 1)["low"], F.length("bytes")).cast("int").alias("high")))
    pieces = F.transform(gap, lambda g: F.hex(F.substring("bytes", g["low"] + 1, g["high"] - g["low"])))
    none = F.array().cast("array<struct<low:bigint,high:bigint>>")
    return found.select(
        "doc_id", F.length("bytes").cast("long").alias("n_bytes"), F.coalesce("spans", none).alias("spans"),
        F.when(F.col("spans").isNull(), F.col("bytes")).otherwise(F.unhex(F.array_join(pieces, ""))).alias("kept"))


@query("op4_repeated_passages")
def op4(spark, folder):
    rows = without_repeats(documents(spark, folder))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["high"] - x["low"])
    return rows.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
