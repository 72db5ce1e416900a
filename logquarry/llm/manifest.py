"""A Merkle manifest of a table: content-addressed nodes, and proofs by descent from the root.

Rows are leaves. The leaves of a source, in order, are hashed together FAN at a time until one node is left, the subroot;
the subroots in the order of their sources make the root the same way. What is stored is one record per node, from its
digest to the digests of its children.

A proof is found from the root down: a request looks up the record of the digest it has reached, goes on to the child
that the next digit of its rank names (ranks count leaves from zero, digits have base FAN), and collects the children not
taken, left and right. The segments are reversed at the end, so that they read from the leaf up. Requests under one node
share their way to it and travel as one row until they part, so the long part of the paths is never multiplied by the
leaves; leaves meet it in the last step and keep digests only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logquarry.llm.common import documents, query
from logquarry.staging import broadcast_if_small, stage

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = "__top"
# Records that may be sent to every task, of up to FAN digests each (some 35 MB); more are joined by a shuffle.
SENT = 32_768


def field(value: Column) -> Column:
    """A value as it is hashed: `-` if null, else the number of its bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def digest_of(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def ranked(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """`rows` with `rank`, the place of a row in its tree from zero, and `leaves`, the number of rows of the tree.

    Rows are sorted by ranges of (tree, order), so a tree of any size is spread over tasks; each range is numbered by
    itself and one row per range and tree carries the numbers on. Rows that are equal in `order` are told apart by a
    number of their own, which is only there to spread them.
    """
    keys = [F.col(tree).asc_nulls_first(), *order]
    sorted_ = stage(rows.withColumn("__apart", F.monotonically_increasing_id()).repartitionByRange(
        *keys, F.col("__apart")).withColumn("__range", F.spark_partition_id()), "sorted")
    sizes = sorted_.groupBy(tree, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(tree).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select(
        F.col(tree).alias("__tree"), F.col("__range").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(tree)).alias("leaves"))
    inside = Window.partitionBy(tree, "__range").orderBy(*order, "__apart")
    numbered = sorted_.withColumn("__local", F.row_number().over(inside) - 1)
    return numbered.join(carried, F.col(tree).eqNullSafe(F.col("__tree")) & (F.col("__range") == F.col("__at"))).select(
        *rows.columns, (F.col("__local") + F.col("__before")).alias("rank"), "leaves")


def records(leaves: DataFrame, tree: str) -> tuple[DataFrame, DataFrame, int]:
    """Of `leaves` (tree, rank, leaves, digest): the records (digest, children, level), the roots (tree, digest, height)
    and the greatest height. A level has a FANth of the nodes of the level below; a lone leaf is the root of its tree."""
    level, nodes, made, tops = 0, leaves.select(tree, "rank", "leaves", "digest"), [], []
    while True:
        tops.append(nodes.where("leaves = 1").select(tree, "digest", F.lit(level).alias("height")))
        nodes = nodes.where("leaves > 1")
        if nodes.isEmpty():
            break
        level += 1
        parents = stage(nodes.groupBy(tree, F.floor(F.col("rank") / FAN).alias("rank")).agg(
            F.first(F.ceil(F.col("leaves") / FAN)).alias("leaves"),
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "digest"))), lambda c: c["digest"]).alias("children"),
        ).withColumn("digest", digest_of(F.col("children"))), f"level-{level}")
        made.append(parents.select("digest", "children", F.lit(level).alias("level")))
        nodes = parents.select(tree, "rank", "leaves", "digest")
    found, roots = leaves.select("digest", F.array("digest").alias("children"), F.lit(0).alias("level")).limit(0), tops[0]
    for more in made:
        found = found.union(more)
    for more in tops[1:]:
        roots = roots.union(more)
    return found, stage(roots, "roots"), level


SEGMENTS = "array<struct<left:string,right:string>>"


def descended(starts: DataFrame, stored: DataFrame, heights: int) -> DataFrame:
    """From nodes `starts` (tree, digest, height, path) down to the leaves: (tree, rank, digest, path).

    `stored` are records (digest, children, level). A tree joins the descent at its own height. Records are looked up by
    digest; a table of records that is small is sent to the requests, a larger one is joined by a shuffle.
    """
    starts = starts.withColumn("rank", F.lit(0).cast("bigint"))
    reached = starts.where(F.col("height") == heights).select("tree", "rank", "digest", "path")
    for level in range(heights, 0, -1):
        of_level = stage(stored.where(F.col("level") == level).select("digest", "children").dropDuplicates(["digest"]), "records")
        met = reached.join(broadcast_if_small(of_level, SENT), "digest")
        parted = met.select("tree", "rank", "path", "children", F.posexplode(F.col("children")).alias("digit", "child"))
        c, d = F.col("children"), F.col("digit")
        beside = F.struct(
            F.array_join(F.slice(c, F.lit(1), d), "").alias("left"),
            F.array_join(F.slice(c, d + 2, F.size(c)), "").alias("right"))
        below = parted.select(
            "tree", (F.col("rank") * FAN + d).alias("rank"), F.col("child").alias("digest"),
            F.concat("path", F.array(beside)).cast(SEGMENTS).alias("path"))
        reached = below.union(starts.where(F.col("height") == level - 1).select("tree", "rank", "digest", "path"))
        if level > 1:
            reached = stage(reached, "reached")
    return reached


def parents_with_paths(starts: DataFrame, stored: DataFrame, heights: int) -> DataFrame:
    """The descent without its last step: nodes just above the leaves, (tree, rank, digest, path), ranks counted in nodes."""
    ups = stored.where("level > 1").withColumn("level", F.col("level") - 1)
    return descended(starts.where("height > 0").withColumn("height", F.col("height") - 1), ups, heights - 1)


def folded(own: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings, from the leaf up, lead to."""
    return F.aggregate(path, own, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered: Column | None = None, other: Column | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified.

    Fields that the table lacks count as null. Leaves of a source ascend by doc_id, null ids first, equal ids by leaf;
    sources ascend by their bytes, null first. `tampered` says in which rows the text is replaced by `other` before the
    root is recomputed from the row's own siblings; verified says whether it is the root. Repeated rows are equal leaves
    at neighbouring places. An empty table has no root and no rows; other columns, also of clashing names, are not read.
    """
    have = {f: F.col(f) if f in docs.columns else F.lit(None).cast("string") for f in fields}
    changed = F.when(tampered, other).otherwise(have["text"]) if tampered is not None else have["text"]
    leaves = docs.select(
        F.col("doc_id"), have["source"].cast("string").alias("tree"), leaf(list(have.values())).alias("digest"),
        leaf([changed if f == "text" else c for f, c in have.items()]).alias("own"))
    placed = stage(ranked(leaves, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")]), "leaves")
    stored, subroots, heights = records(placed, "tree")
    # The subroots are the leaves of one more tree, in the order of their sources.
    named = ranked(subroots.select("tree", F.col("digest"), F.lit(TOP).alias("top")), "top", [F.col("tree").asc_nulls_first()])
    named = stage(named.withColumnRenamed("tree", "source"), "subroots")
    top_stored, roots, top_heights = records(named, "top")
    root = roots.select(F.col("top").alias("tree"), "digest", "height", F.array().cast(SEGMENTS).alias("path"))
    tops = descended(root, top_stored, top_heights)
    starts = named.join(tops.select("rank", "path"), "rank").select(F.col("source").alias("__source"), "path")
    subs = subroots.join(starts, F.col("tree").eqNullSafe(F.col("__source"))).select("tree", "digest", "height", "path")
    subs = stage(subs, "starts")
    last = stored.where("level = 1").select("digest", "children").dropDuplicates(["digest"])
    nodes = parents_with_paths(subs, stored, heights) if heights > 0 else subs.withColumn("rank", F.lit(0)).select("tree", "rank", "digest", "path").limit(0)
    above = nodes.join(last, "digest").select(F.col("tree").alias("__tree"), F.col("rank").alias("__node"), "path", "children")
    # A lone leaf is its tree's subroot: its path is that of the subroot.
    alone = subs.where("height = 0").select(
        F.col("tree").alias("__tree"), F.lit(0).cast("bigint").alias("__node"), "path", F.lit(None).cast("array<string>").alias("children"))
    ways = above.union(alone).join(
        subs.select(F.col("tree").alias("__of"), F.col("digest").alias("subroot")), F.col("__tree").eqNullSafe(F.col("__of"))).drop("__of")
    met = placed.withColumn("__at", F.floor(F.col("rank") / FAN)).join(
        ways, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("__at") == F.col("__node")))
    digit = (F.col("rank") % FAN).cast("int")
    c = F.col("children")
    beside = F.struct(
        F.array_join(F.slice(c, F.lit(1), digit), "").alias("left"), F.array_join(F.slice(c, digit + 2, F.size(c)), "").alias("right"))
    path = F.reverse(F.when(c.isNull(), F.col("path")).otherwise(F.concat("path", F.array(beside)).cast(SEGMENTS)))
    siblings = F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
    whole = roots.select(F.col("digest").alias("root"))
    proved = met.select(
        "doc_id", F.col("tree").alias("source"), F.col("digest").alias("leaf"), "subroot", F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.col("own"), path).alias("folded_root"))
    # One row: the root of the one tree of subroots.
    digest = whole.first()
    top = F.lit(digest["root"] if digest else None).cast("string")
    return proved.select(
        "doc_id", "source", "leaf", "subroot", top.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == top).alias("verified"))


def lower_text(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


# The same in SQL, with as many levels as any table of up to FAN ** LEVELS rows a source needs.
LEVELS = 5


def levels_sql(prefix: str, tree: str) -> str:
    """Views {prefix}1 .. {prefix}LEVELS of nodes (tree, rank, leaves, digest, children), made of {prefix}0."""
    return "".join(f""",
{prefix}{k} AS (SELECT {tree}, rank // {FAN} AS rank, (any_value(leaves) + {FAN - 1}) // {FAN} AS leaves,
  sha256(string_agg(digest, '' ORDER BY rank)) AS digest, list(digest ORDER BY rank) AS children
  FROM {prefix}{k - 1} WHERE leaves > 1 GROUP BY {tree}, rank // {FAN})""" for k in range(1, LEVELS + 1))


def climb_sql(prefix: str, tree: str, rank: str) -> tuple[str, list[tuple[str, str]]]:
    """Joins from a row of rank `rank` to its nodes of all levels, and the siblings on the left and right in each."""
    joins, sides = "", []
    for k in range(1, LEVELS + 1):
        alias, at = f"{prefix}_{k}", f"({rank} // {FAN ** (k - 1)}) % {FAN}"
        joins += f"\nLEFT JOIN {prefix}{k} {alias} ON {alias}.{tree} IS NOT DISTINCT FROM l.{tree} AND {alias}.rank = {rank} // {FAN ** k}"
        sides.append((
            f"coalesce(array_to_string({alias}.children[1:({at})], ''), '')",
            f"coalesce(array_to_string({alias}.children[({at}) + 2:], ''), '')"))
    return joins, sides


def folded_sql(own: str, present: list[tuple[str, tuple[str, str]]]) -> tuple[str, str]:
    """Views with the digest after each level, and the name of the last."""
    views, last = "", own
    for n, (children, (left, right)) in enumerate(present):
        views += f",\nf{n} AS (SELECT *, CASE WHEN {children} THEN sha256(concat({left}, {last}, {right})) ELSE {last} END AS d{n} FROM {'w' if n == 0 else f'f{n - 1}'})"
        last = f"d{n}"
    return views, last


def manifest_sql() -> str:
    def made(text):
        parts = [f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256(concat({', '.join(parts)}))"

    crc = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda acc, b: list_reduce(list_concat([xor(acc, b)], CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    joins, sides = climb_sql("s", "source", "l.rank")
    tops, top_sides = climb_sql("t", "top", "u.rank")
    every = [(f"s_{k + 1}", f"({{r}} // {FAN ** k}) % {FAN}", "rank") for k in range(LEVELS)] + [
        (f"t_{k + 1}", f"({{r}} // {FAN ** k}) % {FAN}", "top_rank") for k in range(LEVELS)]
    present, columns = [], []
    for name, at, rank in every:
        columns.append(f"{name}.children AS c_{name}")
        place = at.format(r=rank)
        present.append((f"c_{name} IS NOT NULL", (
            f"coalesce(array_to_string(c_{name}[1:({place})], ''), '')", f"coalesce(array_to_string(c_{name}[({place}) + 2:], ''), '')")))
    folds, last = folded_sql("own", present)
    proof = ", ".join(side for _, both in present for side in both)
    tops = tops.replace("l.top", "'x'")
    return f"""WITH leaf AS (SELECT doc_id, source, {made('text')} AS digest,
  CASE WHEN {crc} % 5 = 0 THEN {made(f"translate(text, '{upper}', '{upper.lower()}')")} ELSE {made('text')} END AS own FROM documents),
s0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS rank,
  count(*) OVER (PARTITION BY source) AS leaves FROM leaf){levels_sql('s', 'source')},
sub AS ({' UNION ALL '.join(f'SELECT source, digest FROM s{k} WHERE leaves = 1' for k in range(LEVELS + 1))}),
t0 AS (SELECT 'x' AS top, source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank, count(*) OVER () AS leaves FROM sub){levels_sql('t', 'top')},
root AS ({' UNION ALL '.join(f'SELECT digest FROM t{k} WHERE leaves = 1' for k in range(LEVELS + 1))}),
w AS (SELECT l.doc_id, l.digest AS leaf, l.own, l.rank, u.rank AS top_rank, u.digest AS subroot, {', '.join(columns)}
  FROM s0 l JOIN t0 u ON u.source IS NOT DISTINCT FROM l.source{joins}{tops}){folds}
SELECT doc_id, leaf, subroot, digest AS root, sha256(concat({proof})) AS proof_sha256, {last} AS folded_root, {last} = digest AS verified
FROM f{len(present) - 1}, root"""


@query("op13_manifest", manifest_sql())
def op13(spark, folder):
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    return manifest(documents(spark, folder), FIELDS, F.coalesce(tampered, F.lit(False)), lower_text(F.col("text"))).drop("source")
