"""Embedding near-dedup by an epsilon grid order join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import keep, tidy
from maskwright.llm.components import components

BLOCK = 1024  # vectors of a block at least, where there are as many
BLOCK_BYTES = 8 << 20  # bytes of a block at most: what one task holds is two of them
PARTS = 8  # intervals of a block whose boxes are compared before vectors move
LEAF = 128  # rows of an interval that is compared without being cut further
AXES = 8  # leading principal dimensions that the grid orders by
SAMPLE = 4096  # vectors, those of smallest hash, from which the axes come; they decide speed alone
SALTS = 16
_BOXES = "array<struct<low:array<double>,high:array<double>>>"
_BLOCKS = f"label string, width int, block long, n int, boxes {_BOXES}, cell_low long, cell_high long, ids binary, copies binary, vectors binary"
_FOUND = "vec_id long, links long, root long"


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(reps: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per width of vectors (at most a few): mean and leading axes of a bounded sample."""
    rows = reps.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").limit(SAMPLE).collect()
    out = {}
    for width in {len(r.vector) for r in rows}:
        x = _unit(np.array([r.vector for r in rows if len(r.vector) == width]))
        mean = x.mean(axis=0)
        _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
        out[width] = mean, axes[:AXES].T.copy()
    return out


def _project(x: np.ndarray, axes: dict, width: int) -> np.ndarray:
    mean, w = axes.get(width, (np.zeros(width), np.eye(width)[:, :AXES]))
    z = (x - mean) @ w
    return np.pad(z, ((0, 0), (0, AXES - z.shape[1])))


def _far(low_a, high_a, low_b, high_b, eps: float) -> bool:
    """Whether two boxes are further apart than eps."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float((gap * gap).sum()) > eps * eps


def _join(xa, za, xb, zb, a0, a1, b0, b1, same: bool, eps: float, cosine: float, out: list) -> None:
    """Recursive join of two intervals of the grid order: skip if distant, compare if small, else cut the longer one in half."""
    if same and b1 <= a0:
        return
    if _far(za[a0:a1].min(0), za[a0:a1].max(0), zb[b0:b1].min(0), zb[b0:b1].max(0), eps):
        return
    if max(a1 - a0, b1 - b0) <= LEAF:
        i, j = np.nonzero(xa[a0:a1] @ xb[b0:b1].T >= cosine)
        i, j = i + a0, j + b0
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            out.append((i, j))
    elif a1 - a0 >= b1 - b0:
        m = (a0 + a1) // 2
        _join(xa, za, xb, zb, a0, m, b0, b1, same, eps, cosine, out)
        _join(xa, za, xb, zb, m, a1, b0, b1, same, eps, cosine, out)
    else:
        m = (b0 + b1) // 2
        _join(xa, za, xb, zb, a0, a1, b0, m, same, eps, cosine, out)
        _join(xa, za, xb, zb, a0, a1, m, b1, same, eps, cosine, out)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is linked with, directly or not."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(cosine: float, axes: dict, kind: type):
    eps = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9

    def compare(batches):
        for batch in batches:
            for r in batch.to_pylist():
                same = r["b_vectors"] is None
                xa = _unit(np.frombuffer(r["a_vectors"], kind).reshape(-1, r["width"]))
                xb = xa if same else _unit(np.frombuffer(r["b_vectors"], kind).reshape(-1, r["width"]))
                za = _project(xa, axes, r["width"])
                zb = za if same else _project(xb, axes, r["width"])
                found: list = []
                _join(xa, za, xb, zb, 0, len(xa), 0, len(xb), same, eps, cosine, found)
                if not found:
                    continue
                i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                ids, copies = (np.concatenate([np.frombuffer(r[f"a_{n}"], np.int64), np.zeros(0, np.int64) if same else np.frombuffer(r[f"b_{n}"], np.int64)]) for n in ("ids", "copies"))
                if not same:
                    j = j + len(xa)
                links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                hit = np.flatnonzero(links)
                root = local_roots(len(ids), i, j)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(ids[root[hit]])], names=["vec_id", "links", "root"])

    return compare


def _blocks(axes: dict, eps: float, kind: type, rows: int):
    schema = pa.schema([("label", pa.string()), ("width", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("boxes", pa.list_(pa.struct([("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))), ("cell_low", pa.int64()), ("cell_high", pa.int64()), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary())])

    def cut(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list = []
        at, n = None, 0

        def closed():
            nonlocal number, held, n
            number += 1
            vectors, ids, copies = (np.concatenate([h[k] for h in held]) for k in range(3))
            held, n = [], 0
            z = _project(_unit(vectors), axes, at[1])
            cells = np.floor(z[:, 0] / eps).astype(np.int64)
            size = max(1, -(-len(z) // PARTS))
            boxes = [{"low": z[a : a + size].min(0).tolist(), "high": z[a : a + size].max(0).tolist()} for a in range(0, len(z), size)]
            return pa.RecordBatch.from_pylist([{
                "label": at[0], "width": at[1], "block": number, "n": len(ids), "boxes": boxes, "cell_low": int(cells.min()), "cell_high": int(cells.max()), "ids": ids.tobytes(), "copies": copies.tobytes(), "vectors": vectors.tobytes(),
            }], schema=schema)

        for batch in batches:
            labels, widths = batch.column("label").to_pylist(), batch.column("width").to_pylist()
            ids, copies = (batch.column(c).to_numpy() for c in ("vec_id", "copies"))
            vectors = batch.column("vector")
            a = 0
            while a < batch.num_rows:
                here = labels[a], widths[a]
                if held and (here != at or n >= most):
                    yield closed()
                at, most = here, max(BLOCK, min(rows, BLOCK_BYTES // (here[1] * np.dtype(kind).itemsize)))
                b = a + 1
                while b < min(batch.num_rows, a + most - n) and (labels[b], widths[b]) == here:
                    b += 1
                held.append((vectors.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, here[1]), ids[a:b], copies[a:b]))
                n += b - a
                a = b
        if held:
            yield closed()

    return cut


def _gridded(axes: dict, eps: float):
    """Rows with the cells of their projections."""

    def place(batches):
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            cells = np.zeros((len(vectors), AXES), np.int64)
            widths = np.array([len(v) for v in vectors])
            for width in set(widths.tolist()):
                at = np.flatnonzero(widths == width)
                cells[at] = np.floor(_project(_unit(np.array([vectors[i] for i in at], np.float64)), axes, width) / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cells[:, k]) for k in range(AXES))], names=[*batch.schema.names, *(f"c{k}" for k in range(AXES))])

    return place


def near_links(reps: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, links, root) rows: per compared pair of blocks, each linked vector's number of linked vectors (copies counted) and the smallest one it is connected with there."""
    spark = reps.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9)
    axes = principal_axes(reps)
    cells = [f"c{k}" for k in range(AXES)]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = np.float32 if "float" in dict(reps.dtypes)["vector"] else np.float64  # vectors travel as they came; the work is in double precision
    rows = max(BLOCK, reps.count() // parts)  # larger blocks are sent to fewer partners
    grid = reps.mapInArrow(tidy(_gridded(axes, eps)), f"label string, width int, vec_id long, copies long, vector {dict(reps.dtypes)['vector']}, " + ", ".join(f"{c} long" for c in cells))
    ordered = grid.repartitionByRange(parts, "label", "width", *cells, "vec_id").sortWithinPartitions("label", "width", *cells, "vec_id")
    blocks = keep(ordered.select("label", "width", "vec_id", "copies", "vector").mapInArrow(tidy(_blocks(axes, eps, kind, rows)), _BLOCKS), "blocks")
    side = lambda s, around: blocks.select(
        "label", "width", *[F.col(c).alias(f"{s}_{c}") for c in ("block", "boxes", "cell_low", "cell_high")], F.explode(F.sequence(F.col("cell_low") - around, F.col("cell_high") + around)).alias("cell")
    )
    pairs = side("a", 0).join(side("b", 1), ["label", "width", "cell"])
    gaps = lambda x, y: F.zip_with(F.zip_with(x["low"], y["high"], lambda p, q: p - q), F.zip_with(y["low"], x["high"], lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    close = lambda x, y: F.aggregate(gaps(x, y), F.lit(0.0), lambda s, g: s + g * g) <= eps * eps
    near = (F.col("a_block") == F.col("b_block")) | F.exists("a_boxes", lambda x: F.exists("b_boxes", lambda y: close(x, y)))
    once = F.col("cell") == F.greatest(F.col("a_cell_low"), F.col("b_cell_low") - 1)  # blocks may meet in several cells
    pairs = pairs.where((F.col("a_block") <= F.col("b_block")) & once & near).select("width", "a_block", F.when(F.col("a_block") != F.col("b_block"), F.col("b_block")).alias("b_block"))
    data = lambda s: blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in ("block", "ids", "copies", "vectors")])
    joined = keep(pairs, "pairs").join(data("a"), "a_block").join(data("b"), "b_block", "left")
    joined = joined.repartition(4 * parts, "a_block", "b_block")
    return keep(joined.mapInArrow(tidy(_links(cosine, axes, kind)), _FOUND), "found", 8)


def near_dedup(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Every row of ``vectors`` with n_links, component_id and kept.

    Vectors of equal label and width link when their cosine, in double
    precision, is at least ``cosine``. Rows with a null label or id, a null,
    empty or zero vector or one with a null or non-finite component link with
    nothing. Rows with equal vectors are compared once: they link with each
    other and share what their first one links with, so a vector that a third
    of all rows repeat costs one row. Rows that share an identifier are taken
    for one vector and share links and component. A row with a null id has a
    null component and is not kept. An empty table gives no rows; columns of
    the new names are replaced.

    The grid order join: unit vectors at cosine c lie within sqrt(2 - 2c), the
    grid's cell. Vectors are sorted by label and by their cells on the leading
    principal axes, a range partitioning, so a hot label spreads over tasks,
    and cut into blocks. Blocks whose boxes are further apart than a cell are
    never paired (equi-join on label and first cell, then the boxes); a task
    joins one pair of blocks by recursion over intervals and gives counts and
    a forest, never all pairs.
    """
    rest = [c for c in vectors.columns if c not in ("n_links", "component_id", "kept")]
    floats = "float" in dict(vectors.dtypes)[vec_col]
    number = F.col(vec_col) if floats else F.transform(F.col(vec_col), lambda x: x.cast("double"))
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec_col, lambda x: x != 0)
    rows = vectors.select(*rest, F.coalesce(sound, F.lit(False)).alias("_sound"))
    code = F.when(F.col("_sound"), F.struct(F.xxhash64(vec_col), F.xxhash64(F.lit(1), vec_col), F.size(vec_col), F.col(label_col).cast("string").alias("l")))
    rows = rows.withColumn("_code", F.to_json(code))
    reps = rows.where("_sound").groupBy("_code").agg(F.min(F.col(id_col).cast("long")).alias("vec_id"), F.count("*").alias("copies"), F.first(F.col(label_col).cast("string")).alias("label"), F.first(number).alias("vector"))
    reps = keep(reps.select("label", F.size("vector").alias("width"), "vec_id", "copies", "vector", "_code"), "vectors")
    found = near_links(reps.drop("_code"), cosine)
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    known = reps.select("_code", "vec_id", "copies").join(totals, "vec_id", "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    known = keep(known.select("_code", "vec_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "vec_id").alias("component")), "known")
    many = known.where("copies > 1").select("_code", (F.col("links") + F.col("copies") - 1).alias("_links_m"), F.col("component").alias("_component_m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    single = known.where("copies = 1").groupBy("vec_id").agg(F.sum("links").alias("_links_s"), F.min("component").alias("_component_s")).withColumnRenamed("vec_id", "_own")
    own = F.col(id_col).cast("long")
    rows = rows.withColumns({"_salt": F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int"), "_own": F.when(F.col("_sound"), own)})
    out = rows.join(many, ["_code", "_salt"], "left").join(single, "_own", "left")
    component = F.coalesce("_component_m", "_component_s", own)
    return out.select(*rest, F.coalesce("_links_m", "_links_s", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(own == component, F.lit(False)).alias("kept"))
