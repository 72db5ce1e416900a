"""Exact token counts of every prefix of a text, by dynamic programming.

A byte-pair encoding has one last token for every prefix of a piece of text. The last token t of a prefix is the one
that ends there and fits behind the last token of what precedes it, so its count is that prefix's count plus one. Two
tokens fit when none of the merges that made them would have been replaced by a merge across their border.

Truncation to a token budget, and whether a text fits one, are then look-ups in the stored counts.
"""

from __future__ import annotations

import json
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from logquarry.llm.common import arrow_batches, documents, extended, query

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
# The pattern that splits text before the merges, and the string the vocabulary marks as special.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"
# Code points on whose kind this pattern's engine and the library's agree; texts with others are split by the library.
AGREED = r"[\x00-ԯḀ-῿‐-⁤₠-₿　-鿯가-힣\U0001F300-\U0001F64F]"
# What a task keeps of pieces and pairs met before, twice each; pieces of more bytes than LONG are worked out by
# themselves and not kept, the others all at once for a batch of texts.
KNOWN_PIECES, KNOWN_PAIRS, LONG = 300_000, 300_000, 32
# Places of the table in which a batch looks pairs of tokens up, a power of two.
PLACES = 1 << 20


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


class Known(dict):
    """Results of strings met before; a missing one is worked out. Two generations of `most` are kept: a full one becomes
    the old one, from which what is met again moves back, so frequent strings are never forgotten."""

    def __init__(self, work, most: int):
        super().__init__()
        self.work, self.most, self.old = work, most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.work(key)
            if isinstance(key, str) and len(key) > LONG:
                return found
        self.keep(key, found)
        return found

    def keep(self, key, found) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found


class Counter:
    """Prefix counts of texts. Holds the merges, and the counts of pieces met before."""

    def __init__(self, merges: list[tuple[bytes, bytes]], path: str):
        self.parts = {a + b: (n, a, b) for n, (a, b) in reversed(list(enumerate(merges)))}
        self.longest = max(map(len, self.parts), default=1)
        self.path = path
        self.known = Known(self.piece, KNOWN_PIECES)
        self.pairs = Known(lambda pair: self.apart(*pair), KNOWN_PAIRS)
        self.pieces = regex.compile(PIECES)
        self.blanks = regex.compile(r"\s\s+")
        self.unsure = regex.compile(AGREED.replace("[", "[^", 1))
        self.library = None
        self.at_once: AtOnce | None = None
        # The texts of a batch, cut into pieces.
        self.cut: dict[str, list[str]] = {}
        # A token that its own bytes do not lead to never ends a prefix.
        self.tokens = {t for t, (n, a, b) in self.parts.items() if self.apart(a, b, n)}
        # Lengths of the tokens that end in the same bytes, the longest first: few at any place of a text.
        lengths: dict[bytes, set[int]] = {}
        for token in self.tokens:
            lengths.setdefault(token[-3:], set()).add(len(token))
        self.lengths = {
            ending: tuple(sorted(found | {2} if len(ending) == 3 and ending[1:] in self.tokens else found, reverse=True))
            for ending, found in lengths.items()}

    @classmethod
    def load(cls, path: str) -> "Counter":
        letters = byte_letters()
        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        return cls([tuple(bytes(letters[c] for c in side) for side in pair) for pair in pairs], path)

    def apart(self, left: bytes, right: bytes, until: int = 1 << 60) -> bool:
        """Whether `left` and `right` stay apart, up to a merge number. Walks back through the merges of both, latest
        first: tokens at the border live from their own merge to that of their parent, and a merge of the two in that
        time would join them."""
        get = self.parts.get
        left_until = right_until = until
        made_left, made_right = get(left), get(right)
        while True:
            joined = get(left + right)
            if joined is not None and joined[1] == left and joined[0] < left_until and joined[0] <= right_until:
                return False
            if made_left is None and made_right is None:
                return True
            if made_right is None or (made_left is not None and made_left[0] > made_right[0]):
                left_until, left = made_left[0], made_left[2]
                made_left = get(left)
            else:
                right_until, right = made_right[0], made_right[1]
                made_right = get(right)

    def counts(self, piece: bytes) -> bytes:
        """Tokens of every byte prefix, from 1 byte on, as 32-bit numbers. The last token of a prefix is the longest that
        ends there and fits behind the last token of what precedes it; only lengths that some token with the same
        ending has are tried."""
        size, tokens, lengths, pairs = len(piece), self.tokens, self.lengths, self.pairs
        count, last = [0] * (size + 1), [b""] * (size + 1)
        for end in range(1, size + 1):
            ending = piece[end - 3 if end > 3 else 0:end]
            for length in lengths.get(ending) or lengths.get(ending[-2:], ()):
                start = end - length
                if start < 0:
                    continue
                token = piece[start:end]
                if token in tokens and (not start or pairs[last[start], token]):
                    count[end], last[end] = count[start] + 1, token
                    break
            else:
                count[end], last[end] = count[end - 1] + 1, piece[end - 1:end]
        return array("i", count[1:]).tobytes()

    def piece(self, piece: str) -> bytes:
        """Tokens of every prefix of one piece, by code points, as 32-bit numbers."""
        encoded = piece.encode("utf-8", "surrogatepass")
        return self.by_characters(piece, encoded, self.counts(encoded))

    @staticmethod
    def by_characters(piece: str, encoded: bytes, counts: bytes) -> bytes:
        if len(encoded) > len(piece):
            begins = np.frombuffer(encoded[1:] + b"\x00", np.uint8) & 0xC0 != 0x80
            counts = np.frombuffer(counts, np.int32)[begins].tobytes()
        if piece in ("'re", "'ve", "'ll"):  # cut after two characters, the pattern sees a mark and a letter
            counts = counts[:4] + (2).to_bytes(4, sys.byteorder) + counts[8:]
        return counts

    def split(self, text: str) -> list[str]:
        if self.unsure.search(text) is None:
            return self.pieces.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def ordinary(self, text: str) -> np.ndarray:
        """Prefix counts of a text without special strings. A prefix that ends in white space has all of it as one
        piece, while the whole text may give its last blank to the next word; those places are counted as such."""
        if not text:
            return np.zeros(0, np.int32)
        pieces = self.cut.get(text) or self.split(text)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.int32)
        ends = np.cumsum(lengths)
        before = np.concatenate([[0], np.cumsum(flat[ends - 1])[:-1]])
        out = flat + np.repeat(before, lengths)
        for run in self.blanks.finditer(text):
            base = out[run.start() - 1] if run.start() else 0
            out[run.start():run.end()] = base + np.frombuffer(self.known[run[0]], np.int32)
        return out.astype(np.int32)

    def learn(self, texts: list[str]) -> None:
        """Work out the pieces of the texts that are not known, up to LONG bytes, by the recurrence of all at once."""
        if self.at_once is None:
            self.at_once = AtOnce(self)
        known, old = self.known, self.known.old
        self.cut = {t: self.split(t) for t in texts if SPECIAL not in t}
        new = [p for p in set().union(*self.cut.values()) if p not in known and p not in old]
        encoded = [p.encode("utf-8", "surrogatepass") for p in new]
        short = [n for n, e in enumerate(encoded) if len(e) <= LONG]
        for n, counts in zip(short, self.at_once.counts([encoded[n] for n in short]), strict=True):
            known.keep(new[n], self.by_characters(new[n], encoded[n], counts))

    def text(self, text: str) -> np.ndarray:
        """Prefix counts of a text; a whole special string is one token, a part of it is ordinary text."""
        segments = text.split(SPECIAL)
        out, base = [], 0
        for segment in segments[:-1]:
            counts = self.ordinary(segment + SPECIAL)
            counts[-1] = (counts[len(segment) - 1] if segment else 0) + 1
            out.append(base + counts)
            base += int(counts[-1])
        out.append(base + self.ordinary(segments[-1]))
        return np.concatenate(out).astype(np.int32)


class AtOnce:
    """The recurrence over many short pieces side by side: place after place, all pieces that are as long."""

    def __init__(self, counter: Counter):
        self.counter = counter
        self.tokens = [bytes([b]) for b in range(256)] + sorted(t for t in counter.tokens if 1 < len(t) <= LONG)
        ids: dict[int, list[int]] = {}
        for i, t in enumerate(self.tokens):
            if len(t) > 1:
                ids.setdefault(len(t), []).append(i)
        # Tokens of each length by the words of eight bytes that they end in, and which pairs of last bytes they have.
        self.by_length = {}
        for length, of in ids.items():
            words = self.words(np.frombuffer(b"".join(self.tokens[i] for i in of), np.uint8).reshape(-1, length))
            order = np.argsort(self.mixed(words), kind="stable")
            endings = np.zeros(1 << 16, bool)
            endings[[self.tokens[i][-2] << 8 | self.tokens[i][-1] for i in of]] = True
            self.by_length[length] = self.mixed(words)[order], [w[order] for w in words], np.array(of, np.int64)[order], endings
        self.met, self.joins = np.full(PLACES, -1, np.int64), np.zeros(PLACES, bool)

    @staticmethod
    def words(rows: np.ndarray) -> list[np.ndarray]:
        """Rows of bytes as words of eight bytes, the last first; the first bytes of a row are a shorter word."""
        out = []
        for end in range(rows.shape[1], 0, -8):
            word = np.zeros(len(rows), np.uint64)
            for at in range(max(0, end - 8), end):
                word = (word << np.uint64(8)) | rows[:, at]
            out.append(word)
        return out

    @staticmethod
    def mixed(words: list[np.ndarray]) -> np.ndarray:
        out = words[0]
        for word in words[1:]:
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
        return out

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether tokens fit, by id. A place of the table has the pair that was looked up there last."""
        keys = left * len(self.tokens) + right
        places = ((keys * 0x2545F4914F6CDD1D) >> 33) & (PLACES - 1)
        unknown = np.flatnonzero(self.met[places] != keys)
        found = self.joins[places]
        if len(unknown):
            pairs, tokens = self.counter.pairs, self.tokens
            some, which = np.unique(keys[unknown], return_inverse=True)
            values = np.array([pairs[tokens[k // len(tokens)], tokens[k % len(tokens)]] for k in some.tolist()], bool)[which]
            found[unknown] = self.joins[places[unknown]] = values
            self.met[places[unknown]] = keys[unknown]
            # Of two pairs with one place the later was kept, in both tables.
        return found

    def counts(self, pieces: list[bytes]) -> list[bytes]:
        """Tokens of every byte prefix of each piece of up to LONG bytes, as 32-bit numbers."""
        if not pieces:
            return []
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        begins = np.cumsum(sizes) - sizes
        offsets = np.arange(len(flat)) - np.repeat(begins, sizes)
        # The eight bytes that end at each place, and the last two of them.
        word = np.zeros(len(flat), np.uint64)
        for back in range(7, -1, -1):
            shifted = np.zeros(len(flat), np.uint64)
            shifted[back:] = flat[:max(0, len(flat) - back)]
            word = (word << np.uint64(8)) | shifted
        ending = (word & np.uint64(0xFFFF)).astype(np.int64)
        # Of each place: which lengths have a token that ends there, as bits, and the tokens by length.
        lengths = np.zeros(len(flat), np.int64)
        found_at = {}
        for length, (hashes, words, ids, endings) in self.by_length.items():
            at = np.flatnonzero((offsets >= length - 1) & endings[ending])
            if not len(at):
                continue
            mine = []
            for n in range(-(-length // 8)):
                kept = min(8, length - 8 * n)
                mine.append(word[at - 8 * n] & np.uint64((1 << 8 * kept) - 1))
            where = np.minimum(np.searchsorted(hashes, self.mixed(mine)), len(hashes) - 1)
            same = np.ones(len(at), bool)
            for one, other in zip(mine, words, strict=True):
                same &= one == other[where]
            at = at[same]
            lengths[at] |= 1 << (length - 1)
            token = found_at[length] = np.full(len(flat), -1, np.int64)
            token[at] = ids[where[same]]
        counts, last = np.ones(len(flat), np.int32), flat.astype(np.int64)
        longest_first = sorted(found_at, reverse=True)
        for offset in range(1, int(sizes.max())):
            at = begins[sizes > offset] + offset
            counts[at] = counts[at - 1] + 1
            for length in longest_first:
                if length > offset + 1 or not len(at):
                    continue
                mine = (lengths[at] >> (length - 1)) & 1 == 1
                if not mine.any():
                    continue
                some = at[mine]
                token = found_at[length][some]
                if length == offset + 1:
                    good = np.ones(len(some), bool)
                    counts[some] = 1
                else:
                    good = self.fits(last[some - length], token)
                    counts[some[good]] = counts[some[good] - length] + 1
                last[some[good]] = token[good]
                left = ~mine
                left[np.flatnonzero(mine)[~good]] = True
                at = at[left]
        whole = counts.tobytes()
        return [whole[4 * b:4 * (b + n)] for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)]


def prefix_counts(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns `keep` and prefix_tokens, an array: entry i is the token count of the first i code points.

    One row per input row; a null or empty text has an empty array. The vocabulary is the file at `path`, read by the
    tasks; 50 thousand merges, so its size is bounded.
    """
    path = path or vocabulary_path(VOCABULARY)
    source = docs.select(*keep, F.col("text").alias("__text"))
    schema = extended(docs, keep, "prefix_tokens array<int>")
    state: dict[str, Counter] = {}

    def work(batch):
        if "counter" not in state:
            state["counter"] = Counter.load(path)
        texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
        state["counter"].learn(texts)
        counts = [state["counter"].text(t) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int32)
        flat = np.concatenate(counts) if counts else np.zeros(0, np.int32)
        columns = {c: batch.column(i) for i, c in enumerate(keep)}
        yield columns | {"prefix_tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))}

    return arrow_batches(source, schema, work)


def tokens(prefix: Column) -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.try_element_at(prefix, F.lit(-1)), F.lit(0)).cast("long")


def truncated_length(prefix: Column, budget: int) -> Column:
    """Code points of the longest prefix with at most `budget` tokens; counts may fall as a prefix grows."""
    within = F.transform(prefix, lambda c: c <= budget)
    behind = F.array_position(F.reverse(within), True)
    return F.when(behind > 0, F.size(prefix) - behind + 1).otherwise(F.lit(0)).cast("long")


@query("op1_token_counts")
def op1(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = prefix_counts(docs, ["doc_id", "n_bytes"]).select("doc_id", "n_bytes", tokens(F.col("prefix_tokens")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
