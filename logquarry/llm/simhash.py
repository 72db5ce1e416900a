"""Near duplicates by SimHash fingerprints and deletion-variant signatures.

A fingerprint has 64 bits; two texts are linked at DISTANCE or fewer differing bits. The fingerprint is cut into two
halves of 32 bits, so one half of any two linked fingerprints differs in at most one bit. Distinct fingerprints are
indexed by signatures, found again by equality joins and verified on all bits:

- a half as it is (the other half may differ in two bits);
- a half with one bit left out, once for each bit. The side with the bit 0 meets the side with the bit 1, so a pair is
  found in one way only and equal halves are not paired 32 times.

Copies have one fingerprint and are linked through it without a pair. A signature that more than CROWD fingerprints
share is not paired either: its members get finer signatures that leave out up to two bits of the rest. At most four
fingerprints share one of those, all within the distance, and a chain through them keeps them linked.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from logquarry.llm.common import arrow_batches, documents, extended, query
from logquarry.llm.components import components
from logquarry.staging import stage

DISTANCE, SHINGLE, CROWD = 2, 3, 64
SEED = 42
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HALF = (1 << 32) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits as a signed number; bit i is 1 if set in over half the shingle hashes. No word: 0."""
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) <= shingle else map(
        " ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest, encode = xxhash.xxh64_intdigest, str.encode
    hashes = np.fromiter((digest(encode(p, "utf-8", "surrogatepass"), SEED) for p in parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and `__fingerprint` of the text, one row per input row."""
    source = docs.select(*keep, F.col("text").alias("__text"))
    schema = extended(docs, keep, "__fingerprint bigint")

    def work(batch):
        columns = {c: batch.column(i) for i, c in enumerate(keep)}
        columns["__fingerprint"] = pa.array([fingerprint(t) for t in batch.column(len(keep)).to_pylist()], pa.int64())
        yield columns

    return arrow_batches(source, schema, work)


def without(*bits: int) -> int:
    """A mask of all bits but these, as a signed number."""
    mask = (1 << 64) - 1
    for bit in bits:
        mask &= ~(1 << bit)
    return mask - (1 << 64) if mask >> 63 else mask


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def half(value: Column, side: int) -> Column:
    return F.shiftrightunsigned(value, 32) if side else value.bitwiseAND(F.lit(HALF))


def paired(members: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Members (key..., value) by equality of `key`: candidate pairs of small groups, and the members of crowded ones."""
    crowded = stage(members.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded")
    if crowded.isEmpty():
        few, many = members, members.limit(0)
    else:
        few, many = members.join(crowded, "key", "left_anti"), members.join(crowded, "key")
    other = few.withColumnRenamed("value", "b")
    return few.withColumnRenamed("value", "a").join(other, "key").where("a < b").select("a", "b"), many


def chained(members: DataFrame) -> DataFrame:
    """Links between successive members of groups that are small by construction."""
    order = Window.partitionBy("key").orderBy("value")
    return members.select(F.lag("value").over(order).alias("a"), F.col("value").alias("b")).where("a IS NOT NULL")


def finer(members: DataFrame, side: int) -> DataFrame:
    """Members of crowded groups that agree in half `side`, by this half and up to two bits left out of the other.

    Two members that differ in bits i and j of the other half agree once these are left out; if they differ in one bit
    or in none, any pair with that bit does. Four values at most agree in all other bits.
    """
    bits = [32 * (1 - side) + i for i in range(32)]
    masks = F.array(*[F.lit(without(i, j)).cast("long") for n, i in enumerate(bits) for j in bits[n + 1:]])
    spread = members.select("value", F.posexplode(masks).alias("which", "mask"))
    return spread.select(F.struct("which", F.col("value").bitwiseAND(F.col("mask")).alias("rest")).alias("key"), "value")


def links(values: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of `values` (value): every two values at DISTANCE or fewer bits
    are linked directly or through others that are within the distance of each other."""
    found = []
    for side in (0, 1):
        same, many = paired(values.select(half(F.col("value"), side).alias("key"), "value"), crowd)
        found += [same, chained(finer(many, side))]
    # One half differs in one bit and so does the other: leave that bit of the low half out.
    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(32)])
    variants = values.select("value", F.posexplode(bits).alias("bit", "mask")).select(
        "value", (F.col("value").bitwiseAND(F.col("mask")) != 0).alias("set"),
        F.struct("bit", half(F.col("value"), 0).bitwiseAND(F.bitwise_not("mask")).alias("rest")).alias("key"))
    crowded = stage(
        variants.groupBy("key").agg(F.count_if("set").alias("ones"), F.count_if(~F.col("set")).alias("zeros"))
        .where(f"ones * zeros > {crowd * crowd}").select("key"), "crowded")
    few, many = variants, variants.limit(0)
    if not crowded.isEmpty():
        few, many = variants.join(crowded, "key", "left_anti"), variants.join(crowded, "key")
    zeros = few.where("NOT set").select("key", F.col("value").alias("a"))
    ones = few.where("set").select("key", F.col("value").alias("b"))
    found.append(zeros.join(ones, "key").select("a", "b"))
    # Crowded: the low half agrees without one bit; leave out one bit of the high half as well.
    high = F.array(*[F.lit(without(32 + i)).cast("long") for i in range(32)])
    both = many.select("key", "value", F.posexplode(high).alias("other", "mask")).select(
        F.struct("key", "other", F.shiftrightunsigned(F.col("value").bitwiseAND(F.col("mask")), 32).alias("rest")).alias("key"), "value")
    found.append(chained(both))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.where(distance("a", "b") <= DISTANCE)


def classes(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """`prints` (doc_id, __fingerprint, ...) with component_id, the smallest doc_id reachable over links."""
    nodes = stage(prints.groupBy(F.col("__fingerprint").alias("value")).agg(F.min("doc_id").alias("smallest")), "fingerprints")
    rooted = components(links(nodes.select("value"), crowd))
    joined = nodes.join(rooted, nodes["value"] == rooted["node"], "left").select(
        "value", "smallest", F.coalesce("root", "value").alias("root"))
    ids = joined.groupBy("root").agg(F.min("smallest").alias("component_id"))
    known = joined.join(ids, "root").select(F.col("value").alias("__value"), "component_id")
    return prints.join(known, F.col("__fingerprint") == F.col("__value")).drop("__value")


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have the fingerprint zero and link like any other. Ids that are null are never a component's
    id unless all of it are null. Repeated rows each give a row. An empty table gives an empty result; columns other
    than doc_id and text are not read.
    """
    prints = stage(fingerprints(docs, ["doc_id"]), "prints")
    return classes(prints, crowd).select(
        "doc_id", F.lower(F.lpad(F.hex("__fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_simhash")
def op8(spark, folder):
    return near_duplicates(documents(spark, folder))
