"""Near copies among vectors: an exact metric range join over pivot cells.

Unit vectors with a cosine of at least LEAST are at a distance of at most sqrt(2 - 2 * LEAST), the radius. Equal vectors
collapse to one before anything moves. Pivots are vectors of the table, no two of a label within the radius, so a dense
group gets one pivot and not a share of them. A vector lives in the cell of its nearest pivot. By the triangle
inequality it can only be within the radius of vectors of another cell whose pivot is at most twice the radius further
away than its own, and at most the cell's own extent plus the radius away; it visits these cells as well. Each cell is
joined for itself, in tiles of bounded size, so a pair is counted once at either end.

Vectors within half the radius of their pivot are its core: all of them are linked, again by the triangle inequality.
They are counted, not compared, and are one node for the components. A vector that is near the pivot is linked to the
whole core in the same way, and one that is far from it to none of it. So a group of near copies of any size costs what
its members cost, and pairs are never rows: a tile gives counts per vector and a spanning forest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logquarry.llm.common import arrow_batches, extended, query
from logquarry.llm.components import components
from logquarry.staging import broadcast_if_small, stage

LEAST = 0.93
# Vectors a cell is meant to have, and the bound on what the pivots are drawn from, in rows and in bytes.
CELL, PIVOT_SAMPLE, PIVOT_BYTES = 2048, 4096, 16 << 20
# Vectors of each side of a tile, and bytes they may have.
TILE, TILE_BYTES = 2048, 8 << 20
# Distances this close to a limit are not decided by the triangle inequality, cosines this close are worked out again.
SLACK, UNSURE = 1e-7, 1e-9


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine by sums that are rounded once, the same in any order of components and of the two vectors."""
    return math.fsum(x * y) / (math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y)))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near one, so that squares neither overflow nor
    vanish and no digit is lost."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    plain = scaled(vectors)
    return plain / np.linalg.norm(plain, axis=1, keepdims=True)


def linked(rows: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Whether each of `rows` and each of `others` have at least the cosine; both are scaled, not null."""
    found = unit(rows) @ unit(others).T
    near = found >= least
    for i, j in zip(*np.nonzero(np.abs(found - least) < UNSURE), strict=True):
        near[i, j] = cosine(rows[i], others[j]) >= least
    return near


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column) that keep what a boolean matrix connects, at most one for each row and each column."""
    rows, columns = near.any(axis=1), near.any(axis=0)
    edges: list[tuple[int, int]] = []
    while rows.any():
        begin = int(np.argmax(rows))
        rows[begin] = False
        queue = [begin]
        while queue:
            row = queue.pop()
            for column in np.flatnonzero(near[row] & columns):
                columns[column] = False
                edges.append((row, int(column)))
                for other in np.flatnonzero(near[:, column] & rows):
                    rows[other] = False
                    edges.append((int(other), int(column)))
                    queue.append(int(other))
    return np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def usable(rows: DataFrame) -> DataFrame:
    """The rows whose vectors can link: label and vector not null, components finite and not all zero."""
    value = F.col("vector")
    bad = F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return rows.where(F.col("label").isNotNull() & value.isNotNull() & ~F.coalesce(bad, F.lit(True))).where(
        F.exists(value, lambda v: v != 0))


def identity() -> Column:
    """A hash of the vector and the label; -0.0 is 0.0."""
    parts = F.transform("vector", lambda v: (v.cast("double") + F.lit(0.0)).cast("string"))
    return F.unhex(F.sha2(F.concat(F.array_join(parts, ",", "null"), F.lit(":"), F.col("label").cast("string")), 256))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """One row per label and vector: hash, label, vector, weight (rows that have it), smallest (id), node (a number)."""
    plain = usable(rows).withColumn("vector", F.transform("vector", lambda v: v.cast("double") + F.lit(0.0)))
    return stage(plain.withColumn("hash", identity()).groupBy("hash").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("weight"),
        F.min("row_id").alias("smallest")).withColumn("node", F.monotonically_increasing_id()), "vectors")


def pivots(vectors: DataFrame, radius: float, cell: int, sample: int) -> dict[tuple[str, int], np.ndarray]:
    """Pivots of each (label, size), from a sample of bounded rows and bytes in the order of the hash."""
    size = vectors.agg(F.max(F.size("vector"))).first()[0] or 1
    rows = max(1, min(sample, PIVOT_BYTES // (8 * size)))
    drawn = stage(vectors.select(
        F.col("label").cast("string").alias("label"), F.size("vector").alias("size"), "hash", "vector").orderBy("hash").limit(rows), "pivot-sample")
    counts = vectors.groupBy(F.col("label").cast("string").alias("label"), F.size("vector").alias("size")).count()
    wanted = {(r["label"], r["size"]): -(-r["count"] // cell)
              for r in counts.join(F.broadcast(drawn.select("label", "size").distinct()), ["label", "size"]).collect()}
    chosen: dict[tuple[str, int], list[np.ndarray]] = {}
    for r in drawn.orderBy("hash").collect():
        of = chosen.setdefault((r["label"], r["size"]), [])
        if len(of) < wanted[r["label"], r["size"]]:
            vector = unit(np.array([r["vector"]]))[0]
            if not of or np.linalg.norm(np.array(of) - vector, axis=1).min() > radius:
                of.append(vector)
    return {k: np.array(v) for k, v in chosen.items()}


def distances(units: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (units @ points.T), 0))


def homes(vectors: DataFrame, points: dict, radius: float) -> DataFrame:
    """`vectors` with their cell (label, size, pivot), the distance to its pivot, and whether they are of its core. Labels
    without a pivot are one cell without a core each; they have about as few vectors as a cell."""
    def work(batch):
        labels, arrays = batch.column(1).to_pylist(), batch.column(2)
        sizes = arrays.value_lengths().to_numpy(zero_copy_only=False)
        pivot, away = np.full(len(labels), -1, np.int32), np.full(len(labels), 2.0)
        groups: dict = {}
        for i, k in enumerate(zip(map(str, labels), sizes.tolist(), strict=True)):
            groups.setdefault(k, []).append(i)
        for k, at in groups.items():
            if k in points:
                d = distances(unit(matrix(arrays.take(pa.array(at)), k[1])), points[k])
                pivot[at], away[at] = d.argmin(axis=1), d.min(axis=1)
        yield {
            "node": batch.column(0), "label": batch.column(1), "vector": arrays, "weight": batch.column(3), "size": pa.array(sizes, pa.int32()),
            "pivot": pa.array(pivot), "away": pa.array(away), "core": pa.array(away <= radius / 2 - SLACK)}

    source = vectors.select("node", F.col("label").cast("string").alias("label"), "vector", "weight")
    schema = extended(source, source.columns, "size int, pivot int, away double, core boolean")
    return stage(arrow_batches(source, schema, work), "homes")


# What is known of a pivot that no vector lives at.
NO_CELL = {"extent": -9.0, "core_weight": 0, "core_extent": 0.0, "core_node": -1}


def members(at_home: DataFrame, points: dict, cells: dict, radius: float) -> DataFrame:
    """Rows of cells: node, label, size, pivot, comp, vector, weight, and how the row takes part.

    home: it lives in the cell, core: in its core; meets_core: it is to be compared with the core. `wholesale` is the
    weight of the core that it is linked to without a comparison, and `tied` the core's node then.
    """
    def work(batch):
        get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        labels, sizes = get["label"].to_pylist(), get["size"].to_numpy()
        pivot, core, away = get["pivot"].to_numpy(), get["core"].to_numpy(zero_copy_only=False), get["away"].to_numpy()
        rows, where, far, roots = [], [], [], np.full(len(labels), -1, np.int64)
        weight, reach, root = [], [], []
        groups: dict = {}
        for i, k in enumerate(zip(labels, sizes.tolist(), strict=True)):
            groups.setdefault(k, []).append(i)
        for k, at in groups.items():
            at = np.array(at)
            if k not in points:
                parts = at, np.full(len(at), -1), np.full(len(at), 2.0), np.zeros(len(at), np.int64), np.zeros(len(at)), np.full(len(at), -1)
            else:
                known = [cells.get((*k, p), NO_CELL) for p in range(len(points[k]))]
                extent, core_weight, core_extent, core_node = (
                    np.array([c[f] for c in known]) for f in ("extent", "core_weight", "core_extent", "core_node"))
                d = distances(unit(matrix(get["vector"].take(pa.array(at)), k[1])), points[k])
                visits = (d <= away[at][:, None] + 2 * radius + SLACK) & (d <= extent + radius + SLACK)
                visits[np.arange(len(at)), pivot[at]] = True
                r, c = np.nonzero(visits)
                parts = at[r], c, d[r, c], core_weight[c], core_extent[c], core_node[c]
                roots[at] = core_node[pivot[at]]
            for whole, part in zip((rows, where, far, weight, reach, root), parts, strict=True):
                whole.append(part)
        if not rows:
            return
        rows, where, far, weight, reach, root = (np.concatenate(x) for x in (rows, where, far, weight, reach, root))
        nodes, home = get["node"].to_numpy()[rows], where == pivot[rows]
        own = core[rows] & home
        all_of_it = own | ((weight > 0) & (far + reach <= radius - SLACK))
        take = pa.array(rows)
        yield {
            "node": pa.array(nodes), "label": get["label"].take(take), "size": get["size"].take(take), "pivot": pa.array(where.astype(np.int32)),
            "comp": pa.array(np.where(core[rows], roots[rows], nodes)), "vector": get["vector"].take(take), "weight": get["weight"].take(take),
            "home": pa.array(home), "core": pa.array(own), "meets_core": pa.array((weight > 0) & ~all_of_it & (far - reach <= radius + SLACK)),
            "wholesale": pa.array(np.where(all_of_it, weight, 0)), "tied": pa.array(np.where(all_of_it, root, -1))}

    schema = extended(at_home, ["node", "label", "size", "pivot", "vector", "weight"],
                      "comp bigint, home boolean, core boolean, meets_core boolean, wholesale bigint, tied bigint")
    names = ["node", "label", "size", "pivot", "comp", "vector", "weight", "home", "core", "meets_core", "wholesale", "tied"]
    ordered = [next(f for f in schema.fields if f.name == n) for n in names]
    return stage(arrow_batches(at_home, type(schema)(ordered), work), "members")


def tiles(rows: DataFrame, tile: int) -> DataFrame:
    """`rows` as sides of tiles: a tile is a cell, a kind of residents (core or rest), a block of rows and a block of
    residents. A row goes to all blocks of residents and a resident to all blocks of rows."""
    def blocks(n):
        return F.greatest(F.ceil(n / tile), F.lit(1)).cast("int")

    cell = ["label", "size", "pivot"]
    counts = stage(rows.groupBy(*cell).agg(
        F.count_if(F.col("home") & ~F.col("core")).alias("rest"), F.count_if(F.col("core")).alias("cores"),
        F.count(F.lit(1)).alias("all"), F.count_if("meets_core").alias("meeting")), "cell-counts")
    sized = rows.join(broadcast_if_small(counts), cell)
    spread = F.xxhash64("node")
    sides = []
    for kind, resident, row, residents, meeting in (
            ("rest", F.col("home") & ~F.col("core"), F.lit(True), "rest", "all"), ("core", F.col("core"), F.col("meets_core"), "cores", "meeting")):
        some = sized.where((F.col(residents) > 0) & (F.col(meeting) > 0)).withColumn("kind", F.lit(kind))
        down, across = blocks(F.col(meeting)), blocks(F.col(residents))
        sides.append(some.where(row).withColumn("side", F.lit("row")).withColumn("down", F.pmod(spread, down).cast("int")).withColumn(
            "across", F.explode(F.sequence(F.lit(0), across - 1))))
        sides.append(some.where(resident).withColumn("side", F.lit("resident")).withColumn("across", F.pmod(spread, across).cast("int")).withColumn(
            "down", F.explode(F.sequence(F.lit(0), down - 1))))
    every = None
    for more in sides:
        side = more.select(*cell, "kind", "down", "across", "side", "node", "comp", "weight", "vector")
        every = side if every is None else every.union(side)
    return every


def compared(sides: DataFrame, least: float) -> DataFrame:
    """Of each tile: (node, n) links of its rows to its residents, and edges (a, b) that connect what is linked."""
    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        size = table.column("size")[0].as_py()
        is_row = np.array([s == "row" for s in table.column("side").to_pylist()])
        vectors = scaled(matrix(pa.concat_arrays(table.column("vector").chunks), size))
        nodes, comps, weights = (table.column(c).to_numpy() for c in ("node", "comp", "weight"))
        rows, others = np.flatnonzero(is_row), np.flatnonzero(~is_row)
        empty = np.zeros(0, np.int64)
        node = n = a = b = empty
        if len(rows) and len(others):
            near = linked(vectors[rows], vectors[others], least)
            near &= nodes[rows][:, None] != nodes[others]
            total = near.astype(np.int64) @ weights[others]
            some = np.flatnonzero(total)
            node, n = nodes[rows][some], total[some]
            left, right = forest(near)
            a, b = comps[rows][left], comps[others][right]
        nothing = lambda k: pa.nulls(k, pa.int64())
        return pa.table({
            "node": pa.concat_arrays([pa.array(node, pa.int64()), nothing(len(a))]), "n": pa.concat_arrays([pa.array(n, pa.int64()), nothing(len(a))]),
            "a": pa.concat_arrays([nothing(len(node)), pa.array(a, pa.int64())]), "b": pa.concat_arrays([nothing(len(node)), pa.array(b, pa.int64())])})

    return sides.groupBy("label", "size", "pivot", "kind", "down", "across").applyInArrow(work, "node bigint, n bigint, a bigint, b bigint")


def linked_classes(
    rows: DataFrame, row_id: str, vector: str, label: str, least: float = LEAST, cell: int = CELL, tile: int = TILE, sample: int = PIVOT_SAMPLE,
) -> DataFrame:
    """One row per row of `rows`: `row_id`, n_links, component_id, kept.

    n_links counts the other rows of the same label whose vector has at least the cosine; component_id is the smallest
    id reachable over such links, the row's own included; kept is whether it is the row's own id. Rows whose label is
    null and vectors that are null, empty, all zero, or hold null or non-finite components have no links and their own
    id. Vectors of different sizes do not link. Repeated vectors and repeated rows are rows of their own and link. Null
    ids are never a component's id unless all its ids are null; such rows are kept only if the component has no id. An
    empty table gives an empty result; other columns, also of clashing names, are not read.
    """
    radius = math.sqrt(2 - 2 * least)
    plain = rows.select(F.col(row_id).alias("row_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    vectors = distinct_vectors(plain)
    size = vectors.agg(F.max(F.size("vector"))).first()[0] or 1
    tile = max(1, min(tile, TILE_BYTES // (8 * size)))
    points = pivots(vectors, radius, cell, sample)
    at_home = homes(vectors, points, radius)
    # One row per pivot, at most as many as the sample has.
    cells = {
        (r["label"], r["size"], r["pivot"]): r.asDict() for r in at_home.where("pivot >= 0").groupBy("label", "size", "pivot").agg(
            F.max("away").alias("extent"), F.coalesce(F.sum(F.when(F.col("core"), F.col("weight"))), F.lit(0)).alias("core_weight"),
            F.coalesce(F.max(F.when(F.col("core"), F.col("away"))), F.lit(0.0)).alias("core_extent"),
            F.coalesce(F.min(F.when(F.col("core"), F.col("node"))), F.lit(-1)).alias("core_node")).collect()}
    taking = members(at_home, points, cells, radius)
    found = stage(compared(tiles(taking, tile), least), "compared")
    # The rows of the same vector, without the row itself; those of a core are in its weight.
    own = taking.where("home").select("node", F.when(F.col("core"), F.lit(-1)).otherwise(F.col("weight") - 1).alias("n"))
    whole = taking.where("wholesale > 0").select("node", F.col("wholesale").alias("n"))
    counts = found.where("node IS NOT NULL").select("node", "n").union(own).union(whole).groupBy("node").agg(F.sum("n").alias("n_links"))
    ties = taking.where("tied >= 0").select(F.col("comp").alias("a"), F.col("tied").alias("b")).distinct()
    rooted = components(found.where("a IS NOT NULL").select("a", "b").union(ties))
    # A core is one node of the components; its members have the core's. There are no more cores than pivots, so their
    # roots go to the members; other vectors meet theirs by their own number.
    core_nodes = [c["core_node"] for c in cells.values() if c["core_node"] >= 0]
    core_roots = stage(rooted.where(F.col("node").isin(core_nodes)), "core-roots").withColumnRenamed("node", "comp")
    inside = taking.where("home AND core").select("node", "comp").join(F.broadcast(core_roots), "comp", "left")
    outside = taking.where("home AND NOT core").select("node", F.col("node").alias("comp")).join(rooted, "node", "left")
    comps = inside.select("node", "comp", "root").union(outside.select("node", "comp", "root")).select(
        "node", F.coalesce("root", "comp").alias("root"))
    named = stage(comps.join(counts, "node").join(vectors.select("node", "hash", "smallest"), "node"), "linked")
    ids = named.groupBy("root").agg(F.min("smallest").alias("component_id"))
    known = named.join(ids, "root").select("hash", "n_links", "component_id")
    out = plain.select("row_id", identity().alias("__key")).join(known, F.col("__key") == F.col("hash"), "left")
    alone = F.col("hash").isNull()
    component = F.when(alone, F.col("row_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("row_id").alias(row_id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("row_id").eqNullSafe(component).alias("kept"))


SQL = f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_count(e) = len(e)
  AND list_bool_and(list_transform(e, lambda x: isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_cosine_similarity(a.e, b.e) >= {LEAST}),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
smallest AS (SELECT reach.a, min(v.vec_id) AS id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(id, vec_id)) AS component_id,
  vec_id IS NOT DISTINCT FROM least(vec_id, coalesce(id, vec_id)) AS kept
FROM v LEFT JOIN smallest ON smallest.a = v.r LEFT JOIN degree ON degree.a = v.r"""


@query("op11_vector_copies", SQL)
def op11(spark, folder):
    return linked_classes(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding", "label")
