"""Secrets in texts: fixed patterns, and strings that look random to two character Markov models.

One model is trained on random strings, one on ordinary identifiers and words. A string of the candidate alphabet is a
secret when the mean log-likelihood ratio per character passes a threshold that was set on held-out samples.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logquarry.llm.common import arrow_batches, documents, extended, query
from logquarry.staging import stage

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ORDINARY = re.compile(r"[A-Za-z][A-Za-z0-9_-]{3,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")
# Documents and strings of each kind that are used for training, at most; taken in the order of md5.
TRAIN_DOCUMENTS, TRAIN_STRINGS = 2_000, 20_000
# Trainings that leave out unlabelled strings that look random, at most.
ROUNDS = 6


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind, those that are too short left out."""
    found = []
    folded = text.lower()
    if any(k in folded for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if any(len(w) >= 32 for w in text.split()):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratios of character pairs, random over ordinary; the threshold of the mean per character."""
    ratios: np.ndarray
    threshold: float

    def score(self, text: str) -> float:
        return score(self.ratios, text)


def codes(text: str) -> np.ndarray:
    """Characters as 1..95 (ASCII from the space on) or 96 for any other, with 0 for the start."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) - 31
    return np.concatenate([[0], np.where((points > 0) & (points < 96), points, 96)])


def score(ratios: np.ndarray, text: str) -> float:
    at = codes(text)
    return float(ratios[at[:-1], at[1:]].mean()) if len(at) > 1 else 0.0


def train_pairs(samples: list[str]) -> np.ndarray:
    """Log probabilities of a character after another, with half a count added to each."""
    counts = np.full((97, 97), 0.5)
    for sample in samples:
        at = codes(sample)
        np.add.at(counts, (at[:-1], at[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def drawn(count: int, seed: int = 7) -> list[str]:
    """Random strings over the alphabets of keys, 20 to 64 characters, the same at each call."""
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef",
                 string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "-_", "0123456789ABCDEF",
                 string.ascii_lowercase + string.digits)
    draw = random.Random(seed)
    return ["".join(draw.choices(alphabets[i % len(alphabets)], k=draw.randint(20, 64))) for i in range(count)]


def train(secret: list[str], ordinary: list[str]) -> Models:
    """Models from samples of both kinds; every fifth string is held out and sets the threshold.

    Unlabelled strings that look random may be keys and ids: those of 8 characters or more that score above the middle
    between the medians of both kinds are left out and the models trained again, until none changes side (ROUNDS at
    most). Medians do not move with such strings while they are the lesser part. The threshold is above every held-out
    ordinary string left by a tenth of the gap to the median of the secrets, not below what all but a hundredth of the
    held-out secrets pass, and never below 0.
    """
    numbered, kept = list(enumerate(ordinary)), list(range(len(ordinary)))
    known = train_pairs([s for i, s in enumerate(secret) if i % 5])
    for _ in range(ROUNDS):
        ratios = known - train_pairs([ordinary[i] for i in kept if i % 5])
        marks = np.array([score(ratios, s) for s in secret[::5]])
        scored = [(i, score(ratios, s)) for i, s in numbered if len(s) >= 8]
        chosen = set(kept)
        held = np.array([x for i, x in scored if i % 5 == 0 and i in chosen])
        if not len(marks) or not len(held):
            break
        cut = (float(np.median(marks)) + float(np.median(held))) / 2
        held = held[held <= cut]
        random_looking = {i for i, x in scored if x > cut}
        left = [i for i, _ in numbered if i not in random_looking]
        if left == kept:
            break
        kept = left
    highest = float(held.max()) if len(held) else 0.0
    if not len(marks):
        return Models(ratios, max(0.0, highest))
    middle = float(np.median(marks))
    return Models(ratios, max(0.0, highest + 0.1 * max(0.0, middle - highest), float(np.quantile(marks, 0.01))))


def samples(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> tuple[list[str], list[str]]:
    """Labelled strings of the corpus: values the fixed patterns find are secrets, other identifiers are ordinary."""
    some = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.md5(F.col("doc_id").cast("string"))).limit(documents)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text")

    def work(batch):
        out = set()
        for text in batch.column(0).to_pylist():
            text = text or ""
            spans = base_spans(text)
            out.update((text[a:b] if k else ASSIGN.match(text, a)[1], True) for a, k, b in spans)
            covered = np.zeros(len(text) + 1, bool)
            for a, _, b in spans:
                covered[a:b] = True
            out.update((m[0], False) for m in ORDINARY.finditer(text) if not covered[m.start()] and m.end() - m.start() <= 64)
        listed = sorted(out)
        yield {"sample": pa.array([s for s, _ in listed], pa.string()), "secret": pa.array([x for _, x in listed], pa.bool_())}

    strings = stage(arrow_batches(texts, "sample string, secret boolean", work).distinct(), "training-strings")
    kinds = []
    for secret in (True, False):
        rows = strings.where(F.col("secret") == secret).orderBy(F.md5("sample"), "sample").limit(TRAIN_STRINGS).select("sample").collect()
        kinds.append([r["sample"] for r in rows])
    return kinds[0], kinds[1]


def learn(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> Models:
    """Models from the strings of at most `documents` documents."""
    secret, ordinary = samples(docs, documents)
    return train(drawn(2 * TRAIN_STRINGS // 5) + secret, ordinary)


def all_spans(text: str, models: Models) -> tuple[list, list]:
    """The fixed spans, and these with the random-looking strings that overlap none of them, by start, then kind."""
    base = base_spans(text)
    # A candidate overlaps a fixed span if one of those that start before its end reaches beyond its start.
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    added = []
    if any(len(w) >= 20 for w in text.split()):
        for m in CANDIDATE.finditer(text):
            value = m[0]
            if any(c.isalpha() for c in value) and models.score(value) > models.threshold:
                before = bisect_left(starts, m.end())
                if not before or reach[before - 1] <= m.start():
                    added.append((m.start(), 3, m.end()))
    return base, sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, models: Models, keep: list[str]) -> DataFrame:
    """The columns `keep`, and n_assign, n_access, n_hex, base_spans and spans as kind:start:end lists in code points.

    One row per input row; a null or empty text has no span. Random-looking strings are of kind `random`. Texts of any
    length are scanned whole.
    """
    source = docs.select(*keep, F.col("text").alias("__text"))
    schema = extended(docs, keep, "n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string")

    def work(batch):
        found = [all_spans(t or "", models) for t in batch.column(len(keep)).to_pylist()]
        columns = {c: batch.column(i) for i, c in enumerate(keep)}
        for kind, name in enumerate(("n_assign", "n_access", "n_hex")):
            columns[name] = pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64())
        columns["base_spans"] = pa.array([joined(base) for base, _ in found], pa.string())
        columns["spans"] = pa.array([joined(spans) for _, spans in found], pa.string())
        yield columns

    return arrow_batches(source, schema, work)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@query("op7_secret_scan")
def op7(spark, folder):
    docs = documents(spark, folder)
    return scan(docs, learn(docs), ["doc_id"]).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
