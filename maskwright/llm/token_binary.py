"""Token ids in Arrow files of fixed-size lists."""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import fresh_path, keep, tidy
from maskwright.llm.storage import new_file, open_random

SEQUENCE = 2048  # ids in each fixed-size list
ROWS = 256  # lists in each record batch
CACHED = 1_000_000  # pieces of text whose ids a worker remembers; changes speed alone
_MANIFEST = "shard long, ids_uri string, docs_uri string, shard_docs long, shard_tokens long"
_CUT = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[!-&(-/:-@\[-`{-~])")
_SPACE_RUN = re.compile(r"[\s\x00] ")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


class Encoder:
    """A tokenizer file with a memory of pieces.

    A byte-level pre-tokenizer always ends a piece before a space that follows
    a non-space and between a letter and punctuation other than an apostrophe.
    Cut there, a text gives pieces that encode apart to the same ids, and most
    pieces come again and again. Other tokenizers encode whole texts. With
    ``added`` an added token (<|endoftext|>, say) in a text gives its own id, as
    the library does by default, and such a text is encoded whole; else it is
    text like any other.
    """

    _own: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, added: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if not added:
            self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        self.splits = not kind.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        contents = [re.escape(x["content"]) for x in kind.get("added_tokens") or [] if x["content"]]
        self.added = re.compile("|".join(contents)) if added and contents else None
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.ids: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, added: bool = False) -> Encoder:
        """The encoder of this worker for a file."""
        if (path, added) not in cls._own:
            cls._own[path, added] = cls(path, added)
        return cls._own[path, added]

    def pieces(self, text: str) -> list[str]:
        if not self.splits or "\0" in text:
            return [text]
        text = _CUT.sub("\0", text)
        return (_BEFORE_SPACE.sub("\0", text) if _SPACE_RUN.search(text) else text.replace(" ", "\0 ")).split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native unsigned 32-bit integers."""
        whole = {i for i, x in enumerate(texts) if self.splits and self.added and self.added.search(x)}
        cut = [[] if i in whole else self.pieces(x) for i, x in enumerate(texts)]
        new = set().union(*cut).difference(self.ids) if cut else set()
        if len(new) + len(self.ids) > CACHED:
            self.ids.clear()
            new = set().union(*cut)
        names = list(new)
        for i in range(0, len(names), 50_000):
            some = names[i : i + 50_000]
            self.ids.update(zip(some, (array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        get = self.ids.__getitem__
        out = [b"".join(map(get, x)) for x in cut]
        for i in whole:  # not remembered: such texts are long and few
            out[i] = array("I", self.tokenizer.encode(texts[i], add_special_tokens=False).ids).tobytes()
        return out


def _write(folder: str, path: str, end_id: int, sequence: int, added: bool):
    def write(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        encoder = Encoder.of(path, added)
        shard = TaskContext.get().partitionId()
        kind = np.uint16 if encoder.vocabulary <= 1 << 16 else np.uint32
        schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        index = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
        end = array("I", [end_id]).tobytes()
        docs, total, rest = 0, 0, np.zeros(0, kind)
        with new_file(folder, f"shard-{shard:06d}", ".ids.arrow") as (ids_to, ids_uri), new_file(folder, f"shard-{shard:06d}", ".docs.arrow") as (docs_to, docs_uri):
            with pa.ipc.new_file(ids_to, schema) as ids_out, pa.ipc.new_file(docs_to, index) as docs_out:

                def put(flat: np.ndarray, real: int) -> None:
                    mask = np.zeros(len(flat), bool)
                    mask[:real] = True
                    ids_out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), sequence)], schema=schema))

                for batch in batches:
                    names, texts = batch.column(0), batch.column(1)
                    for i in range(0, batch.num_rows, 64):
                        coded = [x + end for x in encoder.encode([t or "" for t in texts.slice(i, 64).to_pylist()])]
                        n = np.array([len(x) // 4 for x in coded], np.int64)
                        docs_out.write_batch(pa.RecordBatch.from_arrays([names.slice(i, 64), pa.array(total + np.cumsum(n) - n), pa.array(n)], schema=index))
                        docs, total = docs + len(n), total + int(n.sum())
                        rest = np.concatenate([rest, np.frombuffer(b"".join(coded), np.uint32).astype(kind)])
                        while len(rest) >= ROWS * sequence:
                            put(rest[: ROWS * sequence], ROWS * sequence)
                            rest = rest[ROWS * sequence :]
                if len(rest):
                    put(np.concatenate([rest, np.zeros(-len(rest) % sequence, kind)]), len(rest))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "ids_uri": [ids_uri], "docs_uri": [docs_uri], "shard_docs": [docs], "shard_tokens": [total]})

    return write


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, sequence: int = SEQUENCE, folder: str | None = None, added: bool = False) -> DataFrame:
    """Encode every text, append ``end_id``, and write the ids in ascending order of ``id_col``.

    Each shard is an Arrow IPC file whose record batches hold two fixed-size
    lists of ``sequence`` items, ``ids`` (16 bits where the vocabulary allows,
    else 32) and ``mask`` (false on the padding after a shard's last id), so
    sequence k of a shard lies at a computable place and is read without a
    copy; a second file lists its documents with their first id and length.
    Returns the manifest, a row per shard with ``shard_start``, the ids in
    the shards before it. Only files that the manifest names count: what a
    lost or repeated task wrote is never read.

    A null text counts as empty (its ids are the end id alone); null
    identifiers come first; rows of equal identifier stay apart, in no set
    order among them; an empty table gives shards without sequences. Other
    columns are not read. ``added``: added tokens in a text give their own ids.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.repartitionByRange(shards, "doc_id", "_row").sortWithinPartitions("doc_id", "_row").select("doc_id", "text")
    manifest = keep(rows.mapInArrow(tidy(_write(folder, tokenizer, end_id, sequence, added)), _MANIFEST), "manifest")
    from pyspark.sql import Window

    return manifest.withColumn("shard_start", F.sum("shard_tokens").over(Window.orderBy("shard")) - F.col("shard_tokens"))


def read_documents(manifest: DataFrame) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids_crc32 (of 32-bit little-endian ids)."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_shard(row["ids_uri"], row["docs_uri"], row["shard_start"])

    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chosen = manifest.select("shard", "ids_uri", "docs_uri", "shard_start").repartition(parts, "shard")
    return chosen.mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read_shard(ids_uri: str, docs_uri: str, shard_start: int):
    with open_random(docs_uri) as f, open_random(ids_uri) as g:
        index, ids = pa.ipc.open_file(f), pa.ipc.open_file(g)
        loaded, held, base = 0, np.zeros(0, np.uint32), 0  # held: the ids from place base on
        for b in range(index.num_record_batches):
            docs = index.get_batch(b)
            first, n = docs.column(1).to_numpy(), docs.column(2).to_numpy()
            sums = np.empty(len(n), np.int64)
            for i, (at, count) in enumerate(zip(first.tolist(), n.tolist(), strict=True)):
                parts = []
                while base + len(held) < at + count:
                    parts.append(held[max(0, at - base) :])
                    base += len(held)
                    got = ids.get_batch(loaded)
                    flat, mask = got.column(0).flatten().to_numpy(), got.column(1).flatten().to_numpy(zero_copy_only=False)
                    held, loaded = flat[mask], loaded + 1
                parts.append(held[max(0, at - base) : at + count - base])
                crc = 0
                for p in parts:
                    crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                sums[i] = crc
            yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(first + shard_start), pa.array(n), pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def sequence_at(ids_uri: str, k: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ``k`` of a shard as (ids, mask); the ids are a view of the mapped file."""
    batch = pa.ipc.open_file(open_random(ids_uri)).get_batch(k // rows)
    ids, mask = batch.column(0), batch.column(1)
    width = ids.type.list_size
    at = (k % rows) * width
    return ids.flatten().to_numpy()[at : at + width], mask.flatten().slice(at, width).to_numpy(zero_copy_only=False)
