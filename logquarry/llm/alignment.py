"""Alignment of two tokenizers by the byte offsets at which tokens of both end.

Such an offset is a shared cut. Cuts are found by divide and conquer: an open interval of tokens probes the end of the
token in its middle by bisection among the ends of the other tokenizer, then its neighbours outward, and the first shared
end splits it in two; an interval without a cut inside is a leaf, one group of tokens that covers the same bytes on both
sides. All intervals of a batch of documents are probed together, level by level.

Tokens of a group are linked. How many documents hold a pair of ids linked is counted over all documents: tasks count
blocks of documents, the blocks' counts are summed by pair, and the sums go back to the blocks they came from. Rows of
documents move once, by block; nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from logquarry.llm.common import documents, extended, query
from logquarry.llm.token_counts import AGREED, PIECES, byte_letters, vocabulary_path
from logquarry.staging import stage

FIRST, FIRST_RANKS, SECOND = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
# Distinct pairs of documents, copies among documents counted, after which a block is closed; a document is never cut.
BLOCK_PAIRS = 3_000_000
# Probes of an interval one at a time before all of its other ends are probed at once.
SINGLE_PROBES = 6
# Groups of more links than this are reduced to distinct ids before their pairs are made.
LARGE_GROUP = 4096
# Texts with longer runs of white space are left to the library that the vocabulary is made for.
LONGEST_BLANK = 5_000
# Ids that are written at once, so that what is between stays in a cache.
CACHED = 1 << 14
# Bytes of rows that are worked on together.
SLICE_BYTES = 4 << 20


class First:
    """Ids by the byte-level vocabulary. The rank file holds the same vocabulary and is read by the quicker library; texts
    on whose splitting the two libraries may differ go to the other one."""

    def __init__(self, path: str, ranks_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.quick = tiktoken.Encoding("first", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.unsure = regex.compile(AGREED.replace("[", "[^", 1) + r"|\s{%d}" % LONGEST_BLANK)
        letters = byte_letters()
        self.bytes = [b""] * self.library.get_vocab_size()
        for token, i in self.library.get_vocab().items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def encode(self, text: str) -> list[int]:
        if self.unsure.search(text) is None:
            return self.quick.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


class Second:
    """Ids by the piece vocabulary, which puts a space before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(self.library.id_to_piece, range(n)))]

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text)


def tokens(text: str | None, first: First, second: Second) -> tuple[list[int], list[int]]:
    """Ids of both tokenizers, none where the text is empty or the bytes of either differ from space + text."""
    if not text:
        return [], []
    spaced = " " + text
    try:
        whole = spaced.encode()
    except UnicodeEncodeError:
        return [], []
    a = first.encode(spaced)
    if b"".join(map(first.bytes.__getitem__, a)) != whole:
        return [], []
    b = second.encode(text)
    return (a, b) if b"".join(map(second.bytes.__getitem__, b)) == whole else ([], [])


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Indices into `a_ends` of the ends that `b_ends` has too, by divide and conquer over the intervals [low, high).

    Both arrays ascend without repeats. An interval probes its middle end by bisection, then its neighbours by growing
    distance; the nearest shared end splits it. After SINGLE_PROBES distances without one, its other ends are probed at
    once and again the nearest shared one splits it, so that a round costs no more than the interval has ends.
    """
    found = []

    def is_shared(at):
        where = np.minimum(np.searchsorted(b_ends, a_ends[at]), len(b_ends) - 1)
        return b_ends[where] == a_ends[at]

    open_ = lows < highs
    lows, highs = lows[open_], highs[open_]
    while len(lows):
        middles, cuts = (lows + highs) // 2, np.full(len(lows), -1, np.int64)
        for away in range(SINGLE_PROBES):
            for side in (1, -1) if away else (1,):
                left = np.flatnonzero(cuts < 0)
                at = middles[left] + side * away
                inside = (at >= lows[left]) & (at < highs[left])
                left, at = left[inside], at[inside]
                hit = is_shared(at)
                cuts[left[hit]] = at[hit]
            if (cuts >= 0).all():
                break
        for n in np.flatnonzero((cuts < 0) & (highs - lows > 2 * SINGLE_PROBES - 2)):
            rest = np.arange(lows[n], highs[n])
            hits = rest[is_shared(rest)]
            if len(hits):
                cuts[n] = hits[np.argmin(np.abs(hits - middles[n]))]
        split = cuts >= 0
        cuts, lows, highs = cuts[split], lows[split], highs[split]
        found.append(cuts)
        # Intervals stay in order, so that probes ascend.
        lows, highs = np.stack([lows, cuts + 1], axis=1).ravel(), np.stack([cuts, highs], axis=1).ravel()
        open_ = lows < highs
        lows, highs = lows[open_], highs[open_]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def ends_of(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths[ids])


def group_bounds(a_ends: np.ndarray, b_ends: np.ndarray, a_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a row of documents one after the other, with token ends over all of it and the tokens of each in the first
    tokenizer: one past the last token of each group on both sides."""
    closes = np.cumsum(a_counts)
    final = closes[a_counts > 0] - 1  # the end of a document is always shared
    cuts = np.sort(np.concatenate([shared_cuts(a_ends, b_ends, (closes - a_counts)[a_counts > 0], final), final]))
    return cuts + 1, np.searchsorted(b_ends, a_ends[cuts]) + 1


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. n - 1 for each n of `counts`, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def pair_counts(docs: np.ndarray, a: np.ndarray, b: np.ndarray, a_to: np.ndarray, b_to: np.ndarray, base: int):
    """(doc, key, links): the distinct linked pairs of each document with the number of their links, key = a * base + b.

    `docs` has the document of each group. Groups of many links are reduced to distinct ids on both sides first.
    """
    a_from, b_from = np.concatenate([[0], a_to[:-1]]), np.concatenate([[0], b_to[:-1]])
    a_size, b_size = a_to - a_from, b_to - b_from
    large = np.flatnonzero(a_size * b_size > LARGE_GROUP)
    few = np.flatnonzero(a_size * b_size <= LARGE_GROUP)
    # Every token of the first tokenizer meets all of the second in its group.
    meets = np.repeat(b_size[few], a_size[few])
    tokens_a = np.repeat(a_from[few], a_size[few]) + spread(a_size[few])
    at_b = np.repeat(np.repeat(b_from[few], a_size[few]), meets) + spread(meets)
    keys = np.repeat(a[tokens_a], meets).astype(np.int64) * base + b[at_b]
    owners, times = np.repeat(np.repeat(docs[few], a_size[few]), meets), np.ones(len(keys), np.int64)
    parts = [(owners, keys, times)]
    for n in large:
        left, left_n = np.unique(a[a_from[n]:a_to[n]], return_counts=True)
        right, right_n = np.unique(b[b_from[n]:b_to[n]], return_counts=True)
        made = (left.astype(np.int64)[:, None] * base + right).ravel()
        parts.append((np.full(len(made), docs[n]), made, np.outer(left_n, right_n).ravel()))
    owners, keys, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    # A document and a key as one number, where it fits into 63 bits.
    if len(keys) and (int(owners.max()) + 1) * (int(keys.max()) + 1) < 1 << 62:
        span = int(keys.max()) + 1
        both = owners * span + keys
        order = np.argsort(both, kind="stable")
        both = both[order]
        starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        return both[starts] // span, both[starts] % span, np.add.reduceat(times[order], starts)
    order = np.lexsort((keys, owners))
    owners, keys, times = owners[order], keys[order], times[order]
    starts = np.flatnonzero(np.concatenate([[len(keys) > 0], (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])]))
    return owners[starts], keys[starts], np.add.reduceat(times, starts) if len(starts) else times


class Written:
    """Words in rows of equal width, and how many of their bytes count."""

    def __init__(self, words: list[bytes]):
        self.sizes = np.array([len(w) for w in words], np.int64)
        width = int(self.sizes.max(initial=1))
        self.rows = np.frombuffer(b"".join(w.ljust(width) for w in words), np.uint8).reshape(-1, width)

    def joined(self, which: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The words one after the other, and where each ends."""
        sizes, places = self.sizes[which], np.arange(self.rows.shape[1])
        parts = [
            self.rows[which[at:at + CACHED]][places < sizes[at:at + CACHED, None]].tobytes() for at in range(0, len(which), CACHED)]
        return b"".join(parts), np.cumsum(sizes)


def written(a_count: int, b_count: int) -> Written:
    """Ids as they are hashed: of the first tokenizer followed by a comma, then by a bar; of the second by a comma, then
    by a semicolon."""
    return Written([b"%d%c" % (i, mark) for n, marks in ((a_count, b",|"), (b_count, b",;")) for mark in marks for i in range(n)])


def group_digests(
    a: np.ndarray, b: np.ndarray, a_to: np.ndarray, b_to: np.ndarray, groups: np.ndarray, a_count: int, b_count: int, words: Written,
) -> list[str]:
    """The digest of each document's groups, `groups` of each, written as ids in order: `a1,a2|b1;a3|b2,b3`."""
    a_from, b_from = np.concatenate([[0], a_to[:-1]]), np.concatenate([[0], b_to[:-1]])
    sizes = np.stack([a_to - a_from, b_to - b_from], axis=1)
    before = np.cumsum(sizes.ravel()) - sizes.ravel()
    order = np.empty(len(a) + len(b), np.int64)
    a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_last[a_to - 1], b_last[b_to - 1] = a_count, b_count
    order[np.repeat(before[0::2], sizes[:, 0]) + spread(sizes[:, 0])] = a + a_last
    order[np.repeat(before[1::2], sizes[:, 1]) + spread(sizes[:, 1])] = b + b_last + 2 * a_count
    text, ends = words.joined(order)
    tokens = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))])[np.concatenate([[0], np.cumsum(groups)])]
    places = np.concatenate([[0], ends])[tokens].tolist()
    return [
        hashlib.sha256(memoryview(text)[begin:end - 1]).hexdigest() if end > begin else "" for begin, end in zip(places, places[1:], strict=False)]


def lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


BLOCK = "__block string, __at array<int>, __times array<int>, __keys array<bigint>, __docs array<int>, "
FACTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def aligned(docs: DataFrame, keep: list[str], first: str, first_ranks: str, second: str, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row per document with its facts and its distinct pairs, as places (__at) in the list of pairs of its block
    and numbers of links (__times); and one row per block with the pairs and their documents (__keys, __docs)."""
    names = [f"__k{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col("text").alias("__text"))
    schema = extended(source, names, BLOCK + FACTS)
    held: dict = {}

    def tokenizers():
        if "first" not in held:
            held["first"], held["second"] = First(first, first_ranks), Second(second)
            for side in ("first", "second"):
                held[side, "lengths"] = np.array([len(t) for t in held[side].bytes], np.int64)
            held["words"] = written(len(held["first"].bytes), len(held["second"].bytes))
        return held["first"], held["second"]

    def facts(batch):
        """The facts of a batch, and its distinct pairs: (columns, document, key, links)."""
        one, two = tokenizers()
        both = [tokens(t, one, two) for t in batch.column(len(names)).to_pylist()]
        a_counts = np.array([len(x) for x, _ in both], np.int64)
        b_counts = np.array([len(y) for _, y in both], np.int64)
        a = np.fromiter(chain.from_iterable(x for x, _ in both), np.int64, a_counts.sum())
        b = np.fromiter(chain.from_iterable(y for _, y in both), np.int64, b_counts.sum())
        a_to, b_to = group_bounds(ends_of(a, held["first", "lengths"]), ends_of(b, held["second", "lengths"]), a_counts)
        owners = np.searchsorted(np.cumsum(a_counts), a_to - 1, side="right")
        groups = np.bincount(owners, minlength=len(both)).astype(np.int64)
        links = np.diff(a_to, prepend=0) * np.diff(b_to, prepend=0)
        summed = np.concatenate([[0], np.cumsum(links)])
        closes = np.cumsum(groups)
        columns = {n: batch.column(i) for i, n in enumerate(names)} | {
            "n_a": pa.array(a_counts), "n_b": pa.array(b_counts), "n_groups": pa.array(groups),
            "n_links": pa.array(summed[closes] - summed[closes - groups]),
            "groups_sha256": pa.array(group_digests(a, b, a_to, b_to, groups, len(one.bytes), len(two.bytes), held["words"]), pa.string()),
        }
        return columns, *pair_counts(owners, a, b, a_to, b_to, len(two.bytes))

    def closed(batches, block):
        """The rows of the batches of a block, then the row of the block."""
        every = np.concatenate([keys for _, _, keys, _ in batches])
        distinct, where, counts = np.unique(every, return_inverse=True, return_counts=True)
        at = 0
        for columns, owners, keys, times in batches:
            rows = len(columns["n_a"])
            per = np.bincount(owners, minlength=rows)
            yield columns | {
                "__block": pa.array([block] * rows, pa.string()), "__at": lists(where[at:at + len(keys)], per, pa.int32()),
                "__times": lists(times, per, pa.int32()), "__keys": pa.nulls(rows, pa.list_(pa.int64())),
                "__docs": pa.nulls(rows, pa.list_(pa.int32()))}
            at += len(keys)
        kinds = {n: c.type for n, c in columns.items()}
        yield {n: pa.nulls(1, k) for n, k in kinds.items()} | {
            "__block": pa.array([block]), "__at": pa.nulls(1, pa.list_(pa.int32())), "__times": pa.nulls(1, pa.list_(pa.int32())),
            "__keys": lists(distinct, np.array([len(distinct)]), pa.int64()),
            "__docs": lists(counts, np.array([len(distinct)]), pa.int32())}

    def run(parts):
        task, number, batches, pairs = TaskContext.get().partitionId(), 0, [], 0
        for part in parts:
            rows = part.num_rows
            step = max(1, int(rows * SLICE_BYTES / max(part.nbytes, 1)))
            for begin in range(0, rows, step):
                batches.append(facts(part.slice(begin, step)))
                pairs += len(batches[-1][2])
                if pairs > block_pairs:
                    yield from closed(batches, f"{task}-{number}")
                    number, batches, pairs = number + 1, [], 0
        if batches:
            yield from closed(batches, f"{task}-{number}")

    order = schema.names
    return source.mapInArrow(
        lambda parts: (pa.RecordBatch.from_pydict({c: columns[c] for c in order}) for columns in run(parts)), schema)


def alignment(
    docs: DataFrame, keep: list[str], first: str | None = None, first_ranks: str | None = None, second: str | None = None,
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """The columns `keep` and n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256, one row per row.

    Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros and an
    empty string. Repeated rows each give a row and count as documents of their own. Texts of any length are taken whole;
    one text is in one task. A pair's count is the same in every document, so ties for the highest count of an id are
    all best. Other columns, also of clashing names, are not read; an empty table gives an empty result.
    """
    first, first_ranks = first or vocabulary_path(FIRST), first_ranks or vocabulary_path(FIRST_RANKS)
    second = second or vocabulary_path(SECOND)
    names = [f"__k{i}" for i in range(len(keep))]
    staged = stage(aligned(docs, keep, first, first_ranks, second, block_pairs), "aligned")
    rows = staged.where("__keys IS NULL").drop("__keys", "__docs")
    blocks = staged.where("__keys IS NOT NULL").select("__block", F.explode_outer(F.arrays_zip("__keys", "__docs")).alias("p")).select(
        "__block", F.col("p.__keys").alias("key"), F.col("p.__docs").alias("n")).where("key IS NOT NULL")
    # Pairs and blocks they occur in are few beside the documents' pairs. What is highest for an id of the first
    # tokenizer is one row per id.
    import sentencepiece

    base = sentencepiece.SentencePieceProcessor(model_file=second).get_piece_size()
    counted = stage(blocks.groupBy("key").agg(F.sum("n").alias("count")).withColumn("a", F.floor(F.col("key") / base)), "pair-counts")
    highest = counted.groupBy("a").agg(F.max("count").alias("most"))
    known = counted.join(highest, "a").select("key", "count", (F.col("count") == F.col("most")).alias("best"))
    looked_up = blocks.select(F.col("__block").alias("__of"), "key").join(known, "key").select("__of", "key", "count", "best")
    out_names = [*names, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = extended(rows, names, "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")

    def judged(mine: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs.column("key").to_numpy())
        count, best = pairs.column("count").to_numpy()[order], pairs.column("best").to_numpy(zero_copy_only=False)[order]
        mine = mine.combine_chunks()
        sums, bests = [], []
        for chunk in mine.to_batches():
            at, times = chunk.column(chunk.schema.get_field_index("__at")), chunk.column(chunk.schema.get_field_index("__times"))
            ends = np.cumsum(np.concatenate([[0], at.value_lengths().to_numpy(zero_copy_only=False)])).astype(np.int64)
            places, n = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            for value, into in ((count, sums), (best, bests)):
                total = np.concatenate([[0], np.cumsum(n * value[places])]) if len(places) else np.zeros(1, np.int64)
                into.append(total[ends[1:]] - total[ends[:-1]])
        whole = {"count_sum": np.concatenate(sums) if sums else np.zeros(0), "n_best": np.concatenate(bests) if bests else np.zeros(0)}
        made = {n: pa.array(v.astype(np.int64)) for n, v in whole.items()}
        return pa.table({n: made[n] if n in made else mine.column(n) for n in out_names})

    judged_rows = rows.groupBy("__block").cogroup(looked_up.groupBy("__of")).applyInArrow(judged, schema)
    facts = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return judged_rows.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *facts)


@query("op12_alignment")
def op12(spark, folder):
    return alignment(documents(spark, folder), ["doc_id"])
