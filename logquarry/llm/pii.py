"""Personal data by generated candidates and boosted trees.

Generators are patterns with high recall whose spans may overlap: the four fixed patterns, whose valid matches are
always kept, and looser ones (telephone numbers without a plus sign, addresses with the at sign or the dots written
out). Boosted trees judge loose candidates by their format and by the words before them. They are trained from the
corpus itself: valid matches of the fixed patterns, with the telling mark taken off, against other strings of digits or
words of the same shape. A threshold calibrated on held-out samples selects what is redacted.

Main path: DataFrame functions only; the trees are a sum of conditional expressions. Training is in numpy on a bounded
sample of candidate features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from logquarry.llm.common import documents, query

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns. Possessive quantifiers and the test of the character before keep every scan linear: a match begins
# where its run of characters begins, or where the match before ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A card number is a whole run of digits with single separators; only runs of a possible length are picked out.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Loose candidates of the kinds they may turn out to be.
SPELT = r"(?i)(?<![A-Za-z0-9._%+-])[a-z0-9._%+-]{2,64}+\x20?[\[({]\x20?at\x20?[\])}]\x20?[a-z0-9-]{1,63}+(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?)[a-z0-9-]{1,63}+){1,8}+"
LOCAL = r"(?<![0-9A-Za-z+.])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]\x20?[0-9]{2,5}){1,5}+(?![0-9A-Za-z])"
CONTEXT = 24
# Candidates of each label used for training, and documents they come from, at most; in the order of md5.
TRAIN_ROWS, TRAIN_DOCUMENTS = 4_000, 20_000
FEATURES = ("digits", "length", "groups", "brackets", "dots", "dashes", "blanks", "slashes", "first_group", "last_group",
            "told", "letters", "spelt_marks", "longest_group")


def spans(text: Column, pattern: str) -> Column:
    """All matches as structs (start, end, value) in code points; the gaps between them give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.transform(found, lambda m, i: F.struct(
        (F.length(F.element_at(gaps, i + 1)) + F.length(m)).alias("step"), m.alias("value")))
    placed = F.aggregate(
        lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out")),
        lambda s, m: F.struct(
            (s["at"] + m["step"]).alias("at"),
            F.concat(s["out"], F.array(F.struct(
                (s["at"] + m["step"] - F.length(m["value"])).alias("start"), (s["at"] + m["step"]).alias("end"),
                m["value"].alias("value")))).alias("out")))
    return placed["out"]


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """From the right, every second digit counts double, less 9 if above 9; the sum must divide by ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise(F.try_element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = digits_of(value)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(value, r"\."), lambda p: F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 3).cast("int") <= 255)
    if kind == "card":
        return F.length(digits).between(14, 19) & passes_luhn(F.substring(digits, 1, 19))
    return F.length(digits).between(10, 15)


def is_valid(kind: str):
    return lambda s: valid(kind, s["value"])


def of_kind(number: int, text: Column | None = None):
    """A span with its kind and, given the text, its features."""
    def typed(s):
        fields = [s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value")]
        if text is not None:
            fields.append(described(s["value"], context(text, s["start"])).alias("features"))
        return F.struct(*fields)

    return typed


def base_spans(text: Column) -> Column:
    """Valid matches of the fixed patterns as structs (start, kind number, end, value), ordered by start, then kind."""
    found = []
    for number, (kind, pattern, sign) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), ("@", ".", None, "+"), strict=True)):
        kept = F.filter(spans(text, pattern), is_valid(kind))
        typed = F.transform(kept, of_kind(number))
        empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
        asked = text.contains(sign) if sign else F.lit(True)
        if kind != "email":
            asked = asked & F.rlike(text, F.lit({"ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?){13}[0-9]", "phone": r"\+[0-9]"}[kind]))
        found.append(F.when(asked, typed).otherwise(empty))
    return F.array_sort(F.concat(*found))


def described(value: Column, before: Column) -> Column:
    """Format and context features of a candidate, as an array of doubles in the order of FEATURES."""
    groups = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    sizes = F.transform(groups, lambda g: F.length(g))
    none = F.lit(0)
    told = before.rlike(r"(?i)\b(?:tel|telefon|phone|mobile?|call|fax|mail|e-mail|contact|kontakt|contacto|appel)")
    count = lambda chars: F.length(value) - F.length(F.translate(value, chars, ""))
    listed = (
        F.length(digits_of(value)), F.length(value), F.size(groups), count("()[]{}"), count("."), count("-"), count(" "),
        count("/"), F.coalesce(F.try_element_at(sizes, F.lit(1)), none), F.coalesce(F.try_element_at(sizes, F.lit(-1)), none),
        told.cast("int"), F.regexp_count(value, F.lit("[A-Za-z]")), F.regexp_count(value, F.lit(r"(?i)\b(?:at|dot)\b")),
        F.coalesce(F.array_max(sizes), none))
    return F.array(*[c.cast("double") for c in listed])


def context(text: Column, start: Column) -> Column:
    return F.substring(text, F.greatest(F.lit(1), start - CONTEXT + 1), F.least(start, F.lit(CONTEXT)))


def loose(text: Column) -> Column:
    """Loose candidates as structs (start, kind number, end, value, features)."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,features:array<double>>>")
    found = []
    for number, pattern, sign in ((0, SPELT, r"(?i)[\[({]\x20?at\x20?[\])}]"), (3, LOCAL, r"[0-9][)]?[\x20./-]\x20?[0-9]{2}")):
        found.append(F.when(F.rlike(text, F.lit(sign)), F.transform(spans(text, pattern), of_kind(number, text))).otherwise(empty))
    return F.concat(*found)


@dataclass(frozen=True)
class Tree:
    """A split, its two sides, or a leaf with a value."""
    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    low: "Tree | None" = None
    high: "Tree | None" = None

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(rows), self.value)
        return np.where(rows[:, self.feature] <= self.threshold, self.low.score(rows), self.high.score(rows))

    def column(self, features: Column) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(features[self.feature] <= F.lit(self.threshold), self.low.column(features)).otherwise(self.high.column(features))


@dataclass(frozen=True)
class Model:
    """Boosted trees; `start` is the log odds before them, `threshold` the score that selects."""
    start: float
    trees: tuple[Tree, ...]
    threshold: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return self.start + sum((t.score(rows) for t in self.trees), np.zeros(len(rows)))

    def selects(self, features: Column) -> Column:
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + tree.column(features)
        return total >= F.lit(self.threshold)


def fit_tree(rows: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int, rate: float) -> Tree:
    """One Newton step: the split of greatest gain at each node, with one unit of shrinkage on the leaves."""
    total, weight = slope.sum(), curve.sum()
    leaf = Tree(value=float(rate * total / (weight + 1)))
    if depth == 0 or len(rows) < 8:
        return leaf
    best, gain = None, 1e-6
    for feature in range(rows.shape[1]):
        order = np.argsort(rows[:, feature], kind="stable")
        values = rows[order, feature]
        cuts = np.flatnonzero(values[1:] > values[:-1])
        if not len(cuts):
            continue
        g, h = np.cumsum(slope[order])[cuts], np.cumsum(curve[order])[cuts]
        gains = g * g / (h + 1) + (total - g) ** 2 / (weight - h + 1) - total * total / (weight + 1)
        if gains.max() > gain:
            gain, at = gains.max(), cuts[int(gains.argmax())]
            best = feature, float((values[at] + values[at + 1]) / 2)
    if best is None:
        return leaf
    low = rows[:, best[0]] <= best[1]
    return Tree(feature=best[0], threshold=best[1], low=fit_tree(rows[low], slope[low], curve[low], depth - 1, rate),
                high=fit_tree(rows[~low], slope[~low], curve[~low], depth - 1, rate))


def fit(rows: np.ndarray, truth: np.ndarray, count: int = 16, depth: int = 3, rate: float = 0.4) -> Model | None:
    """Boosted trees on two thirds; on the last third the threshold is the lowest score, not below even odds, from
    which on no more than one in two hundred selected samples is wrong. None without samples of both kinds or where no
    threshold is that sure."""
    held = np.arange(len(truth)) % 3 == 2
    here, y = rows[~held], truth[~held].astype(float)
    if not len(y) or y.min() == y.max() or not truth[held].any():
        return None
    start = float(np.log(y.mean() / (1 - y.mean())))
    score, trees = np.full(len(y), start), []
    for _ in range(count):
        chance = 1 / (1 + np.exp(-score))
        tree = fit_tree(here, y - chance, chance * (1 - chance), depth, rate)
        score = score + tree.score(here)
        trees.append(tree)
    model = Model(start, tuple(trees), 0.0)
    tried, right = model.score(rows[held]), truth[held]
    for threshold in np.unique(np.concatenate([[0.0], tried[tried > 0]])):
        chosen = tried >= threshold
        if chosen.any() and (~right[chosen]).sum() <= 0.005 * chosen.sum():
            return Model(start, tuple(trees), float(threshold))
    return None


def samples(docs: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Features and labels of candidates by kind, from a bounded number of documents.

    Telephone: fixed matches without their plus sign and country code are true; loose candidates of digits that are
    part of no telephone match (dates, addresses, amounts, card numbers) are false. Address: fixed matches with the
    at sign and the dots written out are true; pairs of ordinary words joined the same way are false.
    """
    some = docs.where("doc_id IS NOT NULL").select("doc_id").distinct() \
        .orderBy(F.md5(F.col("doc_id").cast("string"))).limit(TRAIN_DOCUMENTS)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    text = F.col("text")
    known = texts.select(text, F.explode(base_spans(text)).alias("s")).select("text", "s.*")
    near = context(F.col("text"), F.col("start"))
    value = F.col("value")
    local = F.regexp_replace(value, r"^\+[0-9]{1,3}[\x20.-]*", "")
    written = F.regexp_replace(F.regexp_replace(value, "@", " [at] "), r"\.", " [dot] ")
    rows = [
        known.where("kind = 3").select(F.lit(3).alias("kind"), F.lit(True).alias("truth"), local.alias("value"), near.alias("before")),
        known.where("kind IN (1, 2)").select(F.lit(3), F.lit(False), value, near),
        known.where("kind = 0").select(F.lit(0), F.lit(True), written, near),
        texts.select(text, F.explode(spans(text, LOCAL)).alias("s")).select("text", "s.*").where(~near.rlike(r"\+[0-9() .-]*$"))
        .select(F.lit(3), F.lit(False), value, near),
        texts.select(F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z]{3,} [A-Za-z]{3,}"), F.lit(0))).alias("value"))
        .select(F.lit(0), F.lit(False), F.regexp_replace(value, " ", " (at) "), F.lit("")),
    ]
    every = rows[0]
    for more in rows[1:]:
        every = every.union(more)
    every = every.distinct()
    out = {}
    for kind in (0, 3):
        parts = []
        for truth in (True, False):
            found = every.where((F.col("kind") == kind) & (F.col("truth") == truth)).orderBy(F.md5("value"), "value", "before") \
                .limit(TRAIN_ROWS).select(described(F.col("value"), F.col("before")).alias("f")).collect()
            parts.append(np.array([r["f"] for r in found], float).reshape(-1, len(FEATURES)))
        truth = np.concatenate([np.ones(len(parts[0]), bool), np.zeros(len(parts[1]), bool)])
        order = np.random.default_rng(11).permutation(len(truth))
        out[kind] = np.concatenate(parts)[order], truth[order]
    return out


def learn(docs: DataFrame) -> dict[int, Model | None]:
    return {kind: fit(*sample) for kind, sample in samples(docs).items()}


def find(docs: DataFrame, models: dict[int, Model | None], keep: list[str]) -> DataFrame:
    """The columns `keep`, `base` and `spans`: arrays of (start, kind, end) by start, then kind, in code points.

    base holds the valid fixed matches; spans holds these and the loose candidates that the trees select and that
    overlap no base span. A null or empty text has none. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(*keep, text.alias("__text")).select("*", base_spans(F.col("__text")).alias("__base"))
    guesses = F.filter(loose(F.col("__text")), lambda s: selected(s, models))
    apart = F.filter(guesses, lambda s: ~F.exists(F.col("__base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    bare = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select(*keep, bare(F.col("__base")).alias("base"), F.array_sort(F.concat(bare(F.col("__base")), bare(apart))).alias("spans"))


def selected(span: Column, models: dict[int, Model | None]) -> Column:
    chosen = F.lit(False)
    for kind, model in models.items():
        if model is not None:
            chosen = chosen | ((span["kind"] == kind) & model.selects(span["features"]))
    return chosen


def listed(spans_column: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, models: dict[int, Model | None], keep: list[str], mark: str = "[{kind}]") -> DataFrame:
    """The columns `keep` and `redacted`, the text with each span replaced by its mark; null stays null. Of spans that
    overlap, the one that starts first is replaced and the others with it."""
    found = find(docs, models, [*dict.fromkeys([*keep, "text"])])
    names = F.array(*[F.lit(mark.format(kind=k)) for k in KINDS])
    folded = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["parts"], F.array(
                F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.element_at(names, x["kind"] + 1))))
            .otherwise(s["parts"]).alias("parts")))
    rest = F.substring(F.col("text"), folded["at"] + 1, F.length("text"))
    return found.select(*keep, F.concat(F.array_join(folded["parts"], ""), rest).alias("redacted"))


@query("op10_pii")
def op10(spark, folder):
    docs = documents(spark, folder)
    found = find(docs, learn(docs), ["doc_id"])
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, F.lit(i)))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
