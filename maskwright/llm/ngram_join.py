"""N-gram Jaccard join by parity sketches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import drop, keep, mix64, string_bytes, text_slices, tidy
from maskwright.llm.components import widened
from maskwright.llm.embedding_dedup import local_roots
from maskwright.llm.shingles import shingle_sets

SLICE = 1 << 19  # bytes of text that are worked on at once
HELD = 500_000  # signatures that a task holds before it passes them on
MERGED = 2_000_000  # signatures of a bucket that a task sorts at once
BUCKET = 1_000_000  # signatures that a bucket shall have
CROWDED = 64  # members from which a list is thinned where that loses no link
CHUNK = 1024  # members of a list that are compared in one task
FEW = 4  # candidate pairs of a member up to which all are checked; twice as many in each further round
WIDE = 500  # rows with whole sets that a worker gets at once
TEXTS = 2000  # rows with texts
SALTS = 16
MANY = 2_000_000  # rows up to which identifiers are broadcast; beyond, they are joined by a shuffle
_TEXTS = "doc_id long, n long, code long, code2 long, spare long, sketch binary"
_PARTS = "bucket int, low binary, counts binary, codes binary"
_LISTS = "list long, code long, weight long"


def _words64(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the parity sketch of a set of n: a power of two, 2 n at least and 64 at least."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))


def sketches(value: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Parity sketches: each hash flips one bit. The Hamming distance of two sketches is at most the size of the sets' symmetric difference; halves folded by XOR give the sketch of half the bits."""
    n = np.diff(first)
    bits = sketch_bits(n)
    at = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(n)), n)
    bit = (mix64(value ^ np.uint64(0xC2B2AE3D27D4EB4F)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at[owner] + bit, minlength=int(at[-1])) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _codes(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit codes of each set (0 for an empty one)."""
    some = np.flatnonzero(np.diff(first) > 0)
    code, code2 = np.zeros(len(first) - 1, np.uint64), np.zeros(len(first) - 1, np.uint64)
    if len(some):
        with np.errstate(over="ignore"):
            code[some] = np.add.reduceat(mix64(value ^ mix64(np.full(1, 1, np.uint64))), first[some])
            code2[some] = np.add.reduceat(mix64(value ^ mix64(np.full(1, 2, np.uint64))), first[some])
        code, code2 = mix64(code), mix64(code2)
        code[np.diff(first) == 0] = 0
    return code, code2


def segments(group: int) -> int:
    """Segments of the sketches of size band ``group`` (sizes 2**group up to the next power): over a quarter of the largest size, beyond the segments that stay empty."""
    return math.ceil(0.27 * 2 ** (group + 1)) + 8


def _bands(n: np.ndarray):
    """(band, sets): the band of each set's size, and the one below where a linked set may be."""
    own = np.where(n > 0, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64), -1)
    for group in np.unique(own[n >= 4]).tolist():
        for band, member in ((group, own == group), (group - 1, (own == group) & (4 * n <= 5 * (2**group - 1)))):
            who = np.flatnonzero(member & (n >= 4))
            if band >= 2 and len(who):
                yield band, who


def _parts(value: np.ndarray, first: np.ndarray, who: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, their sets, their segments, first hash of each non-empty segment) of some sets in a band."""
    size = np.diff(first)[who]
    place = np.concatenate([[0], np.cumsum(size)])
    h = value[np.arange(int(place[-1])) + np.repeat(first[who] - place[:-1], size)]
    ref = np.repeat(who, size)
    part = ((h >> np.uint64(32)) * np.uint64(segments(band))) >> np.uint64(32)
    new = np.ones(len(h), bool)
    new[1:] = (part[1:] != part[:-1]) | (ref[1:] != ref[:-1])
    return h, ref, part, np.flatnonzero(new)


def _most_apart(n: np.ndarray) -> np.ndarray:
    """The most elements in which a set of n and a linked one may differ."""
    return (n + (5 * n) // 4) // 9


def spare_segments(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many non-empty segments a set has at least in common with any linked one, in each of its bands."""
    n = np.diff(first)
    out = np.full(len(n), np.iinfo(np.int64).max)
    for band, who in _bands(n):
        _, ref, _, at = _parts(value, first, who, band)
        out[who] = np.minimum(out[who], np.bincount(ref[at], minlength=len(n))[who] - _most_apart(n[who]))
    return np.where(n >= 4, out, 0)


def signatures(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) pairs such that two linked sets share one.

    Sets at Jaccard 0.8 differ in at most (a + b) / 9 elements, and in at most
    a quarter of the smaller set's size. The virtual parity sketch of a band
    is cut into more segments than that, so some non-empty segment is alike in
    both. A segment holds the hashes of one range, its content is the XOR of
    their words. A set joins its own band, and the one below if a linked set
    may be there. Sets with no more non-empty segments than they may differ in
    (vanishingly few) also share one common signature of their band.
    """
    n = np.diff(first)
    out_sig, out_ref = [], []
    for band, who in _bands(n):
        h, ref, part, at = _parts(value, first, who, band)
        with np.errstate(over="ignore"):
            word = np.bitwise_xor.reduceat(mix64(h ^ np.uint64(0x27D4EB2F165667C5)), at)
            out_sig.append(mix64(word ^ mix64(part[at] + np.uint64(band << 40) + np.uint64(1))))
        out_ref.append(ref[at])
        filled = np.bincount(ref[at], minlength=len(n))[who]
        few = who[filled <= _most_apart(n[who])]
        if len(few):
            out_sig.append(np.full(len(few), mix64(np.full(1, (band << 40) + (1 << 39), np.uint64))[0]))
            out_ref.append(few)
    if not out_sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_ref)


def text_codes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, code, code2, spare, sketch) of each text's shingle set."""

    def run(batches):
        for batch in batches:
            for a, b in text_slices(batch.column(1), SLICE):
                value, first = shingle_sets(batch.column(1).slice(a, b - a))
                code, code2 = _codes(value, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(code.view(np.int64)), pa.array(code2.view(np.int64)), pa.array(spare_segments(value, first)), pa.array(sketches(value, first), pa.binary())], names=["doc_id", "n", "code", "code2", "spare", "sketch"]
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), _TEXTS)


def _dealt(buckets: int):
    """Signatures of texts, packed: per bucket their low halves, how many come from each set, and the sets' codes."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        codes = [np.zeros(0, np.uint64)]
        n_held = n_sets = 0
        seen: set[int] = set()

        def passed():
            sig, ref = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            code = np.concatenate(codes)
            rise = np.argsort(ref, kind="stable")  # a set of two bands comes twice
            sig, ref = sig[rise], ref[rise]
            bucket = ((sig >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            bucket, low, ref = bucket[order], sig[order].astype(np.uint32), ref[order]
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                used, count = np.unique(ref[a:b], return_counts=True)  # refs rise within a bucket: counts say whose each signature is
                yield int(bucket[a]), low[a:b].tobytes(), count.astype(np.uint32).tobytes(), code[used].tobytes()

        def rows():
            found = list(zip(*passed(), strict=True))
            for i in range(0, len(found[0]), 256):
                yield pa.RecordBatch.from_arrays([pa.array(found[0][i : i + 256], pa.int32()), *(pa.array(c[i : i + 256], pa.binary()) for c in found[1:])], names=["bucket", "low", "counts", "codes"])

        for batch in batches:
            for a, b in text_slices(batch.column(0), SLICE):
                value, first = shingle_sets(batch.column(0).slice(a, b - a))
                code, _ = _codes(value, first)
                sig, ref = signatures(value, first)
                _, at = np.unique(code, return_index=True)
                fresh = np.zeros(len(code), bool)
                fresh[[i for i in at.tolist() if int(code[i]) not in seen]] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.update(code[fresh].tolist())
                ok = fresh[ref]
                held.append((sig[ok], ref[ok] + n_sets))
                codes.append(code)
                n_held, n_sets = n_held + int(ok.sum()), n_sets + len(code)
                if n_held >= HELD:
                    yield from rows()
                    held, codes, n_held, n_sets = [], [np.zeros(0, np.uint64)], 0, 0
        if n_held:
            yield from rows()

    return run


def _lists(batches):
    """Per bucket: the lists of sets that share a signature, each list of members once, with how many signatures it stands for.

    Rows come sorted by bucket. A bucket beyond the usual size is worked
    through in parts that carry one set of every signature along; its lists
    go by the signature, so that their parts make one list.
    """
    bucket, held, n_held = None, [], 0
    carried: tuple[np.ndarray, np.ndarray] | None = None

    def close(last: bool):
        nonlocal held, n_held, carried
        low, code = [], []
        for r in held:
            low.append(np.frombuffer(r[1], np.uint32))
            code.append(np.repeat(_words64(r[3]), np.frombuffer(r[2], np.uint32)))
        by_signature = carried is not None or not last
        if carried is not None:
            low.append(carried[0])
            code.append(carried[1])
        low, code = np.concatenate(low), np.concatenate(code)
        names, which = np.unique(code, return_inverse=True)
        key = np.unique((low.astype(np.uint64) << np.uint64(32)) | which.astype(np.uint64))
        run, who = (key >> np.uint64(32)).astype(np.uint32), names[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        size = np.diff(np.append(start, len(run)))
        carried = None if last else (run[start], who[start])
        held, n_held = [], 0
        many = np.flatnonzero(size > 1)
        if not len(many):
            return
        if by_signature:
            name = mix64(run[start[many]].astype(np.uint64) + np.uint64((bucket + 1) << 32))
            chosen, count = np.arange(len(many)), np.ones(len(many), np.int64)
        else:
            with np.errstate(over="ignore"):
                total = np.add.reduceat(mix64(who), start)[many]
            name, chosen, count = np.unique(mix64(total + size[many].astype(np.uint64)), return_index=True, return_counts=True)
        begin, length = start[many[chosen]], size[many[chosen]]
        take = np.arange(int(length.sum())) + np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        lists, members, weight = np.repeat(name, length).view(np.int64), who[take].view(np.int64), np.repeat(count, length)
        for i in range(0, len(lists), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (lists, members, weight)], names=["list", "code", "weight"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "low", "counts", "codes")), strict=True):
            if bucket is not None and row[0] != bucket and held:
                yield from close(True)
            if row[0] != bucket:
                bucket, carried = row[0], None
            held.append(row)
            n_held += len(row[1]) // 4
            if n_held >= MERGED:
                yield from close(False)
    if held or carried is not None:
        if held:
            yield from close(True)


def _folded(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sketches (by first byte and length) as rows of words, folded to the shortest."""
    width = int(size.min()) // 8
    out = np.empty((len(size), width), np.uint64)
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        step = max(1, (1 << 20) // length)
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            w = raw[start[some][:, None] + np.arange(length)].view(np.uint64)
            while w.shape[1] > width:
                w = w[:, : w.shape[1] // 2] ^ w[:, w.shape[1] // 2 :]
            out[some] = w
    return out


def near_pairs(n: np.ndarray, sketch: np.ndarray, comp: np.ndarray, ours: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (of members of which one at least is in ``ours``) of different components whose sizes and sketches allow a link, with their Hamming distances."""
    found, every = [], np.arange(len(n))
    rows = np.flatnonzero(ours)
    step = max(1, (1 << 20) // max(1, len(n) * sketch.shape[1]))
    for a in range(0, len(rows), step):
        i = rows[a : a + step]
        x, y = n[i][:, None], n[None]
        ok = (comp[i][:, None] != comp[None]) & (5 * np.minimum(x, y) >= 4 * np.maximum(x, y)) & (~ours[None] | (i[:, None] < every[None]))
        r, c = np.nonzero(ok)
        d = np.bitwise_count(sketch[i[r]] ^ sketch[c]).sum(axis=1, dtype=np.int64)
        near = d <= (n[i[r]] + n[c]) // 9
        found.append((i[r[near]], c[near], d[near]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


def spanning(comp: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which pairs make a forest over the components, nearest first (each component takes its nearest pair, until none joins two)."""
    names, label = np.unique(comp, return_inverse=True)
    rank = np.argsort(d, kind="stable")
    i, j = label[i[rank]], label[j[rank]]
    chosen = np.zeros(len(rank), bool)
    root, left = np.arange(len(names)), np.arange(len(rank))
    while True:
        left = left[root[i[left]] != root[j[left]]]
        if not len(left):
            return rank[chosen]
        best = np.full(len(names), len(rank))
        np.minimum.at(best, root[i[left]], left)
        np.minimum.at(best, root[j[left]], left)
        pick = np.unique(best[best < len(rank)])
        chosen[pick] = True
        root = local_roots(len(names), root[i[pick]], root[j[pick]])[root]


_FIELDS = ("list", "part", "code", "n", "comp", "few", "other", "failed")


def _groups(batches):
    """(columns, bytes of the sketches, length of each) of the rows of every list and part; rows come sorted by them."""
    held: list = []
    at = None

    def whole():
        if len(held) == 1:
            return held[0]
        return {c: np.concatenate([h[0][c] for h in held]) for c in _FIELDS}, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])

    for batch in batches:
        if not batch.num_rows:
            continue
        col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _FIELDS}
        raw, place = string_bytes(batch.column("sketch"))
        name, part = col["list"], col["part"]
        cut = (np.flatnonzero((name[1:] != name[:-1]) | (part[1:] != part[:-1])) + 1).tolist()
        for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            here = name[a], part[a]
            if held and here != at:
                yield whole()
                held = []
            at = here
            held.append(({c: v[a:b] for c, v in col.items()}, raw[place[a] : place[b]], np.diff(place[a : b + 1])))
    if held:
        yield whole()


def _compared(few: int):
    """Members (and failed pairs) of lists, sorted by list and part, to pairs worth verifying."""

    def close(col, raw, size):
        m = np.flatnonzero(~col["failed"])
        if len(m) < 2:
            return None
        code, at = np.unique(col["code"][m], return_index=True)
        comp = col["comp"][m[at]]
        if len(code) < 2 or (comp == comp[0]).all():
            return None
        ours = np.isin(code, col["code"][m][col["few"][m]])
        if not ours.any():
            return None
        start = np.cumsum(size) - size
        i, j, d = near_pairs(col["n"][m[at]], _folded(raw, start[m[at]], size[m[at]]), comp, ours)
        lost = np.flatnonzero(col["failed"])
        if len(lost) and len(i):
            a, b = col["code"][lost], col["other"][lost]
            p, q = (np.minimum(np.searchsorted(code, x), len(code) - 1) for x in (a, b))
            here = (code[p] == a) & (code[q] == b)
            known = np.minimum(p, q)[here] * len(code) + np.maximum(p, q)[here]
            new = ~np.isin(np.minimum(i, j) * len(code) + np.maximum(i, j), known)
            i, j, d = i[new], j[new], d[new]
        if not len(i):
            return None
        # All pairs of members that have few, and of a list that has few; of the others, among themselves, a forest.
        degree = np.bincount(i, minlength=len(code)) + np.bincount(j, minlength=len(code))
        low = (np.minimum(degree[i], degree[j]) <= few) | (2 * len(i) <= few * len(code))
        dense = np.flatnonzero(~low)
        pick = np.concatenate([np.flatnonzero(low), dense[spanning(comp, i[dense], j[dense], d[dense])]])
        forest = np.arange(len(pick)) >= int(low.sum())
        x, y = code[i[pick]], code[j[pick]]
        return np.where(forest, col["list"][0], 0), np.minimum(x, y), np.maximum(x, y), forest

    def run(batches):
        out: list = []
        n = 0

        def passed():
            whole = np.unique(np.rec.fromarrays([np.concatenate([o[k] for o in out]) for k in range(4)]))
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(whole[f])) for f in whole.dtype.names], names=["list", "a", "b", "forest"])

        for group in _groups(batches):
            found = close(*group)
            if found is None:
                continue
            out.append(found)
            n += len(found[0])
            if n > 50_000:
                yield passed()
                out, n = [], 0
        if n:
            yield passed()

    return run


def _sets(batches):
    for batch in batches:
        for a, b in text_slices(batch.column(0), SLICE):
            value, first = shingle_sets(batch.column(0).slice(a, b - a))
            code, _ = _codes(value, first)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array([value[s:e].tobytes() for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())], names=["code", "hashes"])


def _verified(batches):
    """Exact Jaccard of pairs of sets."""
    for batch in batches:
        ok = np.empty(batch.num_rows, bool)
        (x, at_x), (y, at_y) = (string_bytes(batch.column(c)) for c in ("x", "y"))
        for k in range(batch.num_rows):
            p, q = _words64(x[at_x[k] : at_x[k + 1]]), _words64(y[at_y[k] : at_y[k + 1]])
            both = np.sort(np.concatenate([p, q]))
            same = int((both[1:] == both[:-1]).sum())
            ok[k] = 100 * same >= 80 * (len(p) + len(q) - same)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok)], names=["a", "b", "linked"])


class _Sets:
    """Hash sets of classes, made from one text of each when a pair needs them and kept for later rounds."""

    def __init__(self, docs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> None:
        self.texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
        self.reps, self.made, self.parts = reps, None, []

    def of(self, pairs: DataFrame) -> DataFrame:
        """(code, hashes) of all classes in ``pairs`` (and more)."""
        need = pairs.select(F.col("a").alias("code")).union(pairs.select(F.col("b").alias("code"))).distinct()
        if self.made is not None:
            need = need.join(self.made.select("code"), "code", "left_anti")
        need = keep(need.join(self.reps.select("code", "first_id"), "code").select(F.col("first_id").alias("_need")), "need")
        n = need.count()
        if n:
            texts = self.texts.join(F.broadcast(need) if n <= MANY else need, F.col("_id") == F.col("_need"), "left_semi")
            new = keep(texts.select("_text").mapInArrow(tidy(_sets), "code long, hashes binary").dropDuplicates(["code"]), "sets", TEXTS)
            self.made = new if self.made is None else self.made.unionByName(new)
            self.parts.append(new)
        drop(need)
        return self.made

    def verify(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b) with linked, by the sets themselves."""
        sets = self.of(pairs)
        both = pairs.join(sets.select(F.col("code").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("code").alias("b"), F.col("hashes").alias("y")), "b")
        return keep(both.mapInArrow(tidy(_verified), "a long, b long, linked boolean"), "checked", WIDE)


def _chunk(code: str, salt: int, n: str) -> Column:
    """Which of the chunks of a list of n a class falls into."""
    return F.pmod(F.xxhash64(code, F.lit(salt)), F.ceil(F.col(n) / CHUNK)).cast("long")


def _pieces(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col(n) / CHUNK) - 1).cast("long")))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((doc_id, n, code) per document, (code, component code) of linked sets): see ``jaccard_join``."""
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = keep(text_codes(docs, id_col, text_col), "texts", TEXTS)
    reps = texts.where("n >= 4 and doc_id is not null").groupBy("code").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("spare").alias("spare"), F.first("sketch").alias("sketch"), (F.min("code2") != F.max("code2")).alias("clash"))
    reps = keep(reps, "reps")
    total = reps.agg(F.sum("n").alias("n"), F.max("clash").alias("clash")).first()
    if total.clash:
        raise ValueError("two sets have one code")  # one in 2**64 for any two sets
    buckets = max(shuffles, math.ceil(0.45 * (total.n or 0) / BUCKET))
    parts = docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).cast("string")).mapInArrow(tidy(_dealt(buckets)), _PARTS)
    lists = parts.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_lists), _LISTS)
    dealt = keep(lists.groupBy("list", "code").agg(F.sum("weight").alias("weight")), "lists", TEXTS)
    lists = keep(dealt.join(dealt.groupBy("list").agg(F.count("*").alias("g")), "list"), "lists")
    drop(dealt)
    crowded = F.col("g") > CROWDED
    # A class with fewer signatures in crowded lists than it must share with any linked one meets each of those in another list too.
    load = lists.where(crowded).groupBy("code").agg(F.sum("weight").alias("load"))
    light = load.join(reps.select("code", "spare"), "code").where("load < spare").select("code", F.lit(True).alias("light"))
    whole, lists = lists, keep(lists.join(light, "code", "left").where(~(crowded & F.col("light").isNotNull())).select("list", "code", "g"), "lists")
    drop(whole)
    large = keep(lists.where(F.col("g") > CHUNK).select("list").distinct(), "large")
    none = spark.range(0)
    comps = none.select(F.col("id").alias("code"), F.col("id").alias("comp"))
    failed = none.select(F.col("id").alias("a"), F.col("id").alias("b"))
    lost = none.select(F.col("id").alias("list"), F.col("id").alias("a"), F.col("id").alias("b"))  # by list, the forest pairs that failed
    sets = _Sets(docs, reps, id_col, text_col)
    blank = {"other": F.lit(0).cast("long"), "failed": F.lit(False)}
    # at first every chunk of a list by itself; what that leaves open comes in the next rounds
    members = lists.withColumn("part", _chunk("code", 1, "g")).select("list", "part", "code", F.col("code").alias("comp"), F.lit(True).alias("few"))
    misses = known = main = None
    few, first = FEW, True
    while True:
        rows = members.join(reps.select("code", "n", "sketch"), "code").withColumns(blank).select(*_FIELDS, "sketch")
        rows = rows if misses is None else rows.unionByName(misses)
        pairs = rows.repartition(4 * shuffles, "list", "part").sortWithinPartitions("list", "part").mapInArrow(tidy(_compared(few)), "list long, a long, b long, forest boolean")
        pairs = keep(pairs, "pairs")
        drop(known, main)
        if pairs.isEmpty() and not (first and not large.isEmpty()):
            drop(pairs, reps, lists, large, failed, lost, *sets.parts)
            return texts.select("doc_id", "n", "code"), comps
        checked = sets.verify(pairs.select("a", "b").distinct().join(failed, ["a", "b"], "left_anti"))
        last, failed = failed, keep(failed.unionByName(checked.where("not linked").select("a", "b")), "failed")
        comps = widened(comps, checked.where("linked").select("a", "b"))
        drop(last, checked)
        # A list is settled when each pair of its forest is a link: its other pairs were all checked, or lie in one component.
        missed = keep(pairs.where("forest").join(failed, ["a", "b"], "left_semi").select("list", "a", "b"), "missed")
        drop(pairs)
        open_lists = missed.select("list").union(large) if first else missed.select("list")
        known = keep(lists.join(open_lists.distinct(), "list", "left_semi").join(comps, "code", "left").withColumn("comp", F.coalesce("comp", "code")), "open-members")
        shares = known.groupBy("list", "comp").agg(F.count("*").alias("k"), F.first("g").alias("g"))
        main = shares.groupBy("list").agg(F.sum("k").alias("n"), F.max(F.struct("k", "comp")).alias("m"), F.first("g").alias("g")).where("n > m.k")
        main = keep(main.select("list", F.col("m.comp").alias("main"), (F.col("n") - F.col("m.k")).alias("rest"), "g"), "open-lists")
        opened = known.drop("g").join(main, "list")
        # Classes outside a list's main component, in chunks, meet every chunk of the list.
        every = opened.select("list", "code", "comp", "g", F.lit(False).alias("few"), _pieces("rest").alias("r")).withColumn("part", F.col("r") * 1_000_000_000 + _chunk("code", 1, "g"))
        minor = opened.where("comp <> main").select("list", "code", "comp", "rest", F.lit(True).alias("few"), _pieces("g").alias("r")).withColumn("part", _chunk("code", 2, "rest") * 1_000_000_000 + F.col("r"))
        members = every.select("list", "part", "code", "comp", "few").unionByName(minor.select("list", "part", "code", "comp", "few"))
        last, lost = lost, keep(lost.join(main, "list", "left_semi").unionByName(missed), "lost")
        drop(last, missed)
        both = lost.unionByName(lost.select("list", F.col("b").alias("a"), F.col("a").alias("b"))).join(main, "list")
        zero = {"n": F.lit(0).cast("long"), "comp": F.lit(0).cast("long"), "few": F.lit(False), "failed": F.lit(True), "sketch": F.lit(b"")}
        misses = both.select("list", (_chunk("a", 2, "rest") * 1_000_000_000 + _chunk("b", 1, "g")).alias("part"), F.col("a").alias("code"), F.col("b").alias("other")).withColumns(zero).select(*_FIELDS, "sketch")
        few, first = 2 * few, False


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with n_shingles and component_id.

    A document's set is its distinct shingles of five words (A-Z in lower
    case; fewer words: the whole sequence; none or null: empty, linked with
    nothing). Documents link when 100 x intersection >= 80 x union; the
    component is the smallest id that links reach. Rows of equal id and text
    are one document. A row with a null id has a null component and takes no
    part. An empty table gives no rows; columns of the new names are replaced.

    1. Per text one row: size, code and parity sketch of its set. Equal sets
       are one class; only classes go on.
    2. Each class deals signatures, one per non-empty segment of its band's
       sketch; by the pigeonhole principle linked classes share one. They
       travel packed, by bucket; a bucket gives the lists of classes that
       share a signature. A class leaves the crowded lists (of a passage that many
       texts quote, say) if it must share more signatures with every linked
       class than it has in crowded lists.
    3. In each list, pairs that the sizes and the sketches' Hamming distance
       allow are taken whole for members that have few of them, and reduced to
       a forest over the components known so far, nearest first, for the rest;
       these pairs are verified exactly on sets made again from the texts.
       Links merge components; a pair that fails is not tried again.
       This goes on until no list has a pair of different components that is
       still open, so every link is found, or both its ends are connected
       otherwise. A list beyond ``CHUNK`` members is dealt out in chunks. What
       counts as few doubles in each round, and a member has fewer than
       2 x ``CHUNK`` partners in a task, so there are at most
       2 + log2(2 x CHUNK / FEW) rounds; only lists with a failed forest pair
       go into the next one, and sets made once are used again.
    """
    rest = [c for c in docs.columns if c not in ("n_shingles", "component_id")]
    texts, comps = jaccard_classes(docs, id_col, text_col)
    classes = texts.where("n > 0 and doc_id is not null").groupBy("code").agg(F.min("doc_id").alias("low"), F.count("*").alias("k")).join(comps, "code", "left")
    classes = keep(classes.withColumn("comp", F.coalesce("comp", "code")), "classes")
    roots = classes.groupBy("comp").agg(F.min("low").alias("component"), F.sum("k").alias("k")).where("k > 1").select("comp", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    known = classes.withColumn("salt", salt("code")).join(roots, ["comp", "salt"]).select("code", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = texts.withColumn("salt", salt("doc_id")).join(known, ["code", "salt"], "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component_id"))
    if rest == [id_col]:
        return found.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    per_id = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id"))
    return docs.select(*rest).join(per_id.withColumnRenamed("doc_id", "_id"), F.col(id_col).cast("long") == F.col("_id"), "left").select(*rest, F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), "component_id")
