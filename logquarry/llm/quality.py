"""Quality rules learned as an ordered decision list over statistics of the text.

Statistics of every whole text are computed in Arrow batches. Rules that reject are learned from labelled documents by
sequential covering: a conjunction of thresholds is grown on one part of the examples until it covers no good document,
pruned on the other part, kept if it is precise there, and what it covers is set aside before the next one. The list is
then one Spark `CASE WHEN` over the statistics.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logquarry.llm.common import arrow_batches, documents, extended, labels, query

# Labelled rows used for learning, at most; taken in the order of md5(doc_id).
LABELLED_ROWS = 20_000
WINDOW = 8
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_distinct",
          "n_upper", "n_digits", "n_marks")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of `window` (a power of two) found twice or more; equal windows get equal numbers by
    doubling, so the comparison is exact."""
    count = len(numbers)
    if count <= window:
        return 0
    span, same = 1, numbers
    while span < window:
        pairs = same[:-span] * np.int64(count) + same[span:]
        same = np.unique(pairs, return_inverse=True)[1]
        span *= 2
    hit = np.bincount(same)[same] > 1
    if not hit.any():
        return 0
    edges = np.zeros(count + 1, np.int64)
    starts = np.flatnonzero(hit)
    edges[starts] += 1
    np.subtract.at(edges, starts + window, 1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORDS.findall(text)
    known: dict[str, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    written = [line for line in text.split("\n") if WORDS.search(line)]
    each = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    return (
        len(words), sum(map(len, words)), int(sum(each[ord(c)] for c in SYMBOLS)), len(written) - len(set(written)),
        repeated_words(numbers), len(text), len(written), len(known), int(each[65:91].sum()), int(each[48:58].sum()),
        int(each[ord("!")] + each[ord("?")]),
    )


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and one column `__counts`, a struct of the statistics of `text` (null counts as empty)."""
    source = docs.select(*keep, F.col("text").alias("__text"))
    schema = extended(docs, keep, f"__counts struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>")

    def work(batch):
        rows = [counts_of(t) for t in batch.column(len(keep)).to_pylist()]
        columns = {c: batch.column(i) for i, c in enumerate(keep)}
        each = zip(*rows, strict=True) if rows else [()] * len(COUNTS)
        columns["__counts"] = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in each], list(COUNTS))
        yield columns

    return arrow_batches(source, schema, work)


def features(counts: Column) -> dict[str, Column]:
    """Ratios the rules may test; 0 where a text has no word, line or character."""
    def ratio(a, b):
        return F.coalesce(counts[a] / F.nullif(counts[b], F.lit(0)), F.lit(0.0))

    return {
        "words": counts["n_words"].cast("double"), "word_length": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"), "dup_lines": ratio("n_dup_lines", "n_lines"),
        "repeated": ratio("n_repeat_words", "n_words"),
        "richness": F.coalesce(F.log1p(counts["n_distinct"]) / F.nullif(F.log1p(counts["n_words"]), F.lit(0)), F.lit(0.0)),
        "upper": ratio("n_upper", "n_chars"), "digits": ratio("n_digits", "n_chars"),
        "marks_per_word": ratio("n_marks", "n_words"), "words_per_line": ratio("n_words", "n_lines"),
    }


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def covers(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] > self.threshold if self.above else values[self.feature] <= self.threshold

    def column(self, columns: dict[str, Column]) -> Column:
        value = columns[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


def covered(rule: list[Test], values: dict[str, np.ndarray], size: int) -> np.ndarray:
    hit = np.ones(size, bool)
    for test in rule:
        hit &= test.covers(values)
    return hit


def grow(values: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> list[Test]:
    """Add the test of greatest information gain until no good document is covered or nothing is gained."""
    rule: list[Test] = []
    hit = np.ones(len(bad), bool)
    while len(rule) < longest and hit.any() and not bad[hit].all():
        was = np.log2(bad[hit].mean()) if bad[hit].any() else -np.inf
        best, gain = None, 1e-9
        for name, column in values.items():
            inside = np.unique(np.quantile(column[hit], np.linspace(0, 1, 65)))
            cuts = (inside[:-1] + inside[1:]) / 2
            order = np.argsort(column[hit], kind="stable")
            below = np.searchsorted(column[hit][order], cuts, side="right")
            bads = np.concatenate([[0], np.cumsum(bad[hit][order])])
            for above in (False, True):
                rows = len(order) - below if above else below
                positive = bads[-1] - bads[below] if above else bads[below]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(positive > 0, positive * (np.log2(positive / rows) - was), 0)
                if len(gains) and gains.max() > gain:
                    gain, at = gains.max(), int(gains.argmax())
                    best = Test(name, above, float(cuts[at]))
        if best is None:
            break
        rule.append(best)
        hit &= best.covers(values)
    return rule


def prune(rule: list[Test], values: dict[str, np.ndarray], bad: np.ndarray) -> list[Test]:
    """The leading part of the rule with the best balance of bad and good documents; the shortest of equal ones."""
    def worth(part):
        hit = covered(part, values, len(bad))
        return (2 * bad[hit].sum() - hit.sum()) / max(1, hit.sum()), -len(part)

    return max((rule[:n] for n in range(1, len(rule) + 1)), key=worth, default=[])


def learn(values: dict[str, np.ndarray], bad: np.ndarray, precision=0.9, most_rules=16, longest=4) -> list[list[Test]]:
    """Rules that reject, in order. A rule stays if `precision` of what it covers is bad, both in the pruning part and,
    with one document of each kind added, in all examples not yet covered. Examples alternate: two of three grow, the third prunes."""
    left = np.ones(len(bad), bool)
    pruning = np.arange(len(bad)) % 3 == 2
    rules: list[list[Test]] = []
    while len(rules) < most_rules and (bad & left).any():
        at_grow, at_prune = left & ~pruning, left & pruning
        rule = grow({k: v[at_grow] for k, v in values.items()}, bad[at_grow], longest)
        rule = prune(rule, {k: v[at_prune] for k, v in values.items()}, bad[at_prune])
        if not rule:
            break
        hit = covered(rule, values, len(bad))
        fresh, tried = hit & left, hit & at_prune
        if (bad[fresh].sum() + 1) / (fresh.sum() + 2) < precision or bad[tried].sum() < precision * tried.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[list[Test]], columns: dict[str, Column]) -> Column:
    """The decision list as one conditional expression: true keeps, the first rule that covers a row rejects it."""
    decided = F.lit(True)
    for rule in reversed(rules):
        condition = F.lit(True)
        for test in rule:
            condition = condition & test.column(columns)
        decided = F.when(condition, F.lit(False)).otherwise(decided)
    return decided


def examples(docs: DataFrame, marked: DataFrame, limit: int = LABELLED_ROWS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Statistics and labels of at most `limit` labelled documents; a document with several labels has its lowest.
    Labels or ids that are null are not used."""
    chosen = marked.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")) \
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    counted = with_counts(texts, ["doc_id", "quality"])
    columns = features(F.col("__counts"))
    rows = counted.select("doc_id", "quality", F.struct(*[c.alias(n) for n, c in columns.items()]).alias("v")) \
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("v").alias("v")) \
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").select("quality", "v.*").toPandas()
    return {n: rows[n].to_numpy(float) for n in columns}, rows["quality"].to_numpy() == 0


def judged_by(rules: list[list[Test]], docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs`, the statistics, base_failed and kept, one row per input row.

    A null or empty text has no words and fails the base rule. Other columns are neither read nor changed.
    """
    counted = with_counts(docs, keep)
    counts = F.col("__counts")
    failed = base_failed(counts)
    return counted.select(
        *keep, "__counts", failed.alias("base_failed"), (~failed & verdict(rules, features(counts))).alias("kept"))


def judged(docs: DataFrame, marked: DataFrame, keep: list[str], limit: int = LABELLED_ROWS) -> DataFrame:
    """`judged_by` rules that are learned from `marked` (doc_id, quality); without usable labels the list is empty and
    the base rule alone decides."""
    return judged_by(learn(*examples(docs, marked, limit)), docs, keep)


@query("op2_quality_rules")
def op2(spark, folder):
    found = judged(documents(spark, folder), labels(spark, folder), ["doc_id"])
    return found.select(
        "doc_id", *[F.col("__counts")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "kept")
