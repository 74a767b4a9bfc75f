"""Exact dedup by a tree-merge of sorted digest runs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import keep, string_bytes, tidy

RUN_ROWS = 1 << 17  # rows that a task holds before it closes a sorted run
CHUNK_ROWS = 1 << 12  # digests of a chunk; a merge holds a few chunks of each run
SALTS = 16
_CHUNK = "run long, slice int, low binary, digests binary, ids binary, counts binary"
_GROUP = "digest binary, n_bytes long, keep_id long, group_size long"
_NEW = ("keep_id", "group_size", "kept", "text_sha256")


class DigestError(ValueError):
    """Two texts of one digest that are not equal."""


class Run:
    """Digests in rising order, each once: four words, then length and check hash of the text, the identifier that stays, rows with an identifier, rows."""

    def __init__(self, key: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.key, self.ids, self.counts = key, ids, counts  # n x 6 words, n, n x 2

    def __len__(self) -> int:
        return len(self.ids)

    def slice(self, a: int, b: int) -> Run:
        return Run(self.key[a:b], self.ids[a:b], self.counts[a:b])

    def below(self, low: np.ndarray) -> int:
        """How many digests come before one."""
        a, b = 0, len(self)
        while a < b:
            m = (a + b) // 2
            if tuple(self.key[m, :4].tolist()) < tuple(low.tolist()):
                a = m + 1
            else:
                b = m
        return a


def merged(runs: list[Run], largest: bool) -> Run:
    """One run out of several sorted ones (or of one that is not): a stable merge by digest; of equal digests, whose texts must agree in length and check hash, the smallest (or largest) identifier stays."""
    key, ids, counts = (np.concatenate([getattr(r, n) for r in runs]) for n in ("key", "ids", "counts"))
    # the runs are sorted, which a stable sort uses; words beyond the first are looked at only where it ties
    order = np.argsort(key[:, 0], kind="stable")
    first = key[order, 0]
    if (first[1:] == first[:-1]).any():
        order = np.lexsort((key[:, 3], key[:, 2], key[:, 1], key[:, 0]))
    key, ids, counts = key[order], ids[order], counts[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:, :4] != key[:-1, :4]).any(axis=1)
    if (key[1:, 4:][~new[1:]] != key[:-1, 4:][~new[1:]]).any():
        raise DigestError("texts of one digest differ")
    at = np.flatnonzero(new)
    if len(at) == len(key):
        return Run(key, ids, counts)
    none = counts[:, 0] == 0
    rank = np.where(none, np.iinfo(np.int64).min if largest else np.iinfo(np.int64).max, ids)
    return Run(key[at], (np.maximum if largest else np.minimum).reduceat(rank, at), np.add.reduceat(counts, at, axis=0))


def _packed(run: int, slice_: int, x: Run) -> pa.RecordBatch:
    """The chunks of a run of a slice."""
    cuts = [x.slice(a, a + CHUNK_ROWS) for a in range(0, len(x), CHUNK_ROWS)]
    low = [c.key[0, :4].astype(">u8").tobytes() for c in cuts]
    columns = [pa.array([run] * len(cuts), pa.int64()), pa.array([slice_] * len(cuts), pa.int32()), pa.array(low, pa.binary()), *(pa.array([getattr(c, n).tobytes() for c in cuts], pa.binary()) for n in ("key", "ids", "counts"))]
    return pa.RecordBatch.from_arrays(columns, names=["run", "slice", "low", "digests", "ids", "counts"])


def _unpacked(row: dict) -> Run:
    return Run(np.frombuffer(row["digests"], np.uint64).reshape(-1, 6), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int64).reshape(-1, 2))


def _grouped(x: Run) -> pa.RecordBatch:
    """The groups of a run."""
    digest = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, 32 * len(x) + 1, 32, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(x.key[:, :4]).astype(">u8").tobytes())])
    keep_id = pa.array(x.ids, mask=x.counts[:, 0] == 0)
    return pa.RecordBatch.from_arrays([digest, pa.array(x.key[:, 4].astype(np.int64)), keep_id, pa.array(np.ascontiguousarray(x.counts[:, 1]))], names=["digest", "n_bytes", "keep_id", "group_size"])


def _first_runs(largest: bool, slices: int):
    def sort_out(batches):
        from pyspark import TaskContext

        part, held, n = TaskContext.get().partitionId(), [], 0

        def closed():
            run = merged(held, largest)
            cut = np.searchsorted((run.key[:, 0] >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32), np.arange(slices + 1))
            for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                if a < b:
                    yield _packed(part, s, run.slice(a, b))

        for batch in batches:
            if not batch.num_rows:
                continue
            raw, _ = string_bytes(batch.column("digest"))
            words = raw.reshape(-1, 32).view(">u8").astype(np.uint64)
            key = np.concatenate([words, np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("n_bytes", "check")], axis=1)], axis=1)
            named = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            counts = np.stack([named.astype(np.int64), np.ones(len(named), np.int64)], axis=1)
            held.append(merged([Run(key, batch.column("id").fill_null(0).to_numpy(), counts)], largest))
            n += batch.num_rows
            if n >= RUN_ROWS:
                yield from closed()
                held, n = [], 0
        if n:
            yield from closed()

    return sort_out


def _merging(largest: bool, last: bool):
    """Chunks sorted by run, slice and first digest, to the chunks of merged runs, in the last round to groups. All that comes before the next chunk's first digest is settled, so a few chunks of each run are held at a time."""

    packed = (lambda run, slice_, x: _grouped(x)) if last else _packed

    def merge(batches):
        at, held = None, []

        def settled(low: np.ndarray | None):
            nonlocal held
            run = merged(held, largest)
            done = len(run) if low is None else run.below(low)
            held = [run.slice(done, len(run))] if done < len(run) else []
            return run.slice(0, done)

        for batch in batches:
            for row in batch.to_pylist():
                here = row["run"], row["slice"]
                if held and here != at:
                    yield packed(*at, settled(None))
                elif sum(map(len, held)) >= 4 * CHUNK_ROWS and len(held) > 1:
                    out = settled(np.frombuffer(row["low"], ">u8").astype(np.uint64))
                    if len(out):
                        yield packed(*at, out)
                at = here
                held.append(_unpacked(row))
        if held:
            yield packed(*at, settled(None))

    return merge


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n_bytes, check) of every row: SHA-256, length and another hash of the text; null counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("check"))


def digest_groups(digested: DataFrame, largest: bool = False, fan_in: int = 4) -> DataFrame:
    """One row for each distinct text of ``digests``: digest, n_bytes, keep_id, group_size.

    Each input partition sorts its digests into runs in which a digest occurs
    once, cut into slices of the digests' range and these into chunks. Then
    come binomial rounds: in round r the runs whose numbers agree after
    division by ``fan_in ** (r + 1)`` exchange their chunks, and a task per
    run and slice merges them, chunk by chunk. At every level, of digests that
    agree the smallest (or largest) identifier is retained, after length and a
    second hash of the texts have been compared; a difference is an error.
    After log(runs) rounds one run is left. A group of copies of any size is
    one row of each run from the first round on.
    """
    spark = digested.sparkSession
    runs, slices = max(1, digested.rdd.getNumPartitions()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = digested.mapInArrow(tidy(_first_runs(largest, slices)), _CHUNK)
    rounds = max(1, math.ceil(math.log(runs, fan_in) - 1e-9))
    for r in range(rounds):
        left = max(1, math.ceil(runs / fan_in ** (r + 1)))
        level = (
            level.withColumn("run", F.floor(F.col("run") / F.lit(fan_in)).cast("long"))
            .repartition(min(slices * left, 4 * slices), F.col("run"), F.col("slice"))
            .sortWithinPartitions("run", "slice", "low")
            .mapInArrow(tidy(_merging(largest, r == rounds - 1)), _GROUP if r == rounds - 1 else _CHUNK)
        )
    return level


def _decided(digested: DataFrame, largest: bool, fan_in: int) -> DataFrame:
    """``digests`` with keep_id, group_size, kept and text_sha256; groups of two or more are joined back, salted, so that one with a third of all rows meets in many tasks."""
    groups = digest_groups(digested, largest, fan_in).where("group_size > 1").select(F.col("digest").alias("_digest"), "keep_id", "group_size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    rows = digested.withColumn("_salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS)).cast("int"))
    joined = rows.join(groups, (F.col("digest") == F.col("_digest")) & (F.col("_salt") == F.col("_s")), "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.withColumns({"keep_id": keep_id, "group_size": F.coalesce("group_size", F.lit(1).cast("long")), "kept": F.coalesce(F.col("id") == keep_id, F.lit(False)), "text_sha256": F.lower(F.hex("digest"))})


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False, fan_in: int = 4) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row, as ``exact_dedup``; texts are hashed once and do not travel."""
    digested = keep(digests(docs, id_col, text_col), "digests")
    return _decided(digested, largest, fan_in).select(F.col("id").alias(id_col), *_NEW)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False, fan_in: int = 4) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical; a null text counts as empty, an empty one
    is a text like others. The smallest identifier of a group stays
    (``largest``: the largest one). A null identifier loses against any other
    and is never kept (``kept`` false, ``keep_id`` null if all are null). Rows
    that repeat identifier and text are one document and share ``kept``. An
    empty table gives no rows. Columns of ``docs`` that have the names of the
    new ones are replaced.
    """
    rest = [c for c in docs.columns if c not in _NEW]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digested = keep(digests(docs, id_col, text_col), "digests")
    groups = digest_groups(digested, largest, fan_in).where("group_size > 1")
    groups = groups.select(F.lower(F.hex("digest")).alias("_sha"), F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    rows = docs.select(*rest, F.sha2(text, 256).alias("text_sha256"), F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(SALTS)).cast("int").alias("_salt"))
    joined = rows.join(groups, (F.col("text_sha256") == F.col("_sha")) & (F.col("_salt") == F.col("_s")), "left")
    own = F.col(id_col).cast("long")
    keep_id = F.when(F.col("_size").isNull(), own).otherwise(F.col("_keep"))
    out = joined.withColumns({"keep_id": keep_id, "group_size": F.coalesce("_size", F.lit(1).cast("long")), "kept": F.coalesce(own == keep_id, F.lit(False))})
    return out.select(*rest, *_NEW)
