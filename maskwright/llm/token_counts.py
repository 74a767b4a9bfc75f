"""Token counts of texts: a broadcast table of frequent pre-tokens, then each worker's cache."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import mix64, string_bytes, text_slices, tidy

SLOTS = 1 << 17  # of the broadcast table: 17 bytes each, 2.2 MB in all
FREQUENT = SLOTS // 2  # pieces in it at most
PROBES = 8  # slots that a lookup looks at
WIDE = 16  # bytes of a piece in the table at most
SAMPLE = 4096  # texts that the table is chosen from; it changes speed alone
WHOLE = 1 << 14  # bytes of such a text at most
CACHED = 1 << 20  # pieces whose length a worker remembers
_SHORT = 64  # bytes of a piece that a worker remembers


class Counting:
    """A tokenizer file as a function from texts to token counts, and whether its texts may be cut.

    ``.json`` files are read by the tokenizers library, ``.model`` files by
    sentencepiece. Texts are encoded without truncation, padding or begin and end tokens.
    """

    def __init__(self, path: str) -> None:
        self.cuts, self.added = False, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1, add_bos=False, add_eos=False)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.lengths = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        self.cuts = not kind.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        contents = [re.escape(x["content"].encode()) for x in kind.get("added_tokens") or [] if x["content"]]
        self.added = re.compile(b"|".join(contents)) if contents else None

    @staticmethod
    @functools.cache
    def of(path: str) -> Counting:
        """The one of this worker for a file."""
        return Counting(path)


def piece_starts(raw: np.ndarray) -> np.ndarray:
    """Whether a pre-token of the byte-level pattern is sure to start at each byte, whatever stands around it.

    It does at white space after a byte that is none, between an ASCII letter
    and ASCII punctuation, and at a letter or digit after a line feed that
    stands alone. Bytes of two-byte characters from U+00C0 on are no white
    space; other characters are never cut at.
    """
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    digit = (raw >= 48) & (raw <= 57)
    solid = (raw > 32) & (raw < 127)
    two = np.zeros(len(raw), bool)
    two[1:] = (raw[1:] >= 128) & (raw[1:] < 192) & (raw[:-1] >= 0xC3) & (raw[:-1] <= 0xDF)
    known = solid | two
    cut = np.zeros(len(raw), bool)
    cut[1:] = known[:-1] & ((raw[1:] == 32) | (raw[1:] == 10))
    cut[1:] |= letter[:-1] & solid[1:] & ~letter[1:] & ~digit[1:] & (raw[1:] != 39)
    cut[2:] |= (letter | digit)[2:] & (raw[1:-1] == 10) & known[:-2]
    return cut


def _keys(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of pieces of at most 16 bytes as two integers; ``raw`` has 16 bytes more than its texts."""
    words = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    bits = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    low = words[start] & bits[np.minimum(size, 8)]
    high = words[start + 8] & bits[np.clip(size - 8, 0, 8)]
    return low, high


def _slot(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (mix64(low ^ mix64(high + size.astype(np.uint64))) & np.uint64(SLOTS - 1)).astype(np.int64)


def build_table(counts: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, tokens): an open-addressing table of the token counts of pieces of at most 16 bytes and 255 tokens; a piece that finds no slot within ``PROBES`` is left to the caches."""
    low, high, tokens = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint8)
    pieces = [x for x in counts if 0 < len(x) <= WIDE and 0 < counts[x] < 256 and not x.endswith(b"\0")][:FREQUENT]
    raw = np.frombuffer(b"".join(x.ljust(WIDE, b"\0") for x in pieces) + bytes(16), np.uint8)
    size = np.array([len(x) for x in pieces], np.int64)
    a, b = _keys(raw, np.arange(len(pieces)) * WIDE, size)
    for at, x, y, piece in zip(_slot(a, b, size).tolist(), a, b, pieces, strict=True):
        for k in range(PROBES):
            i = (at + k) % SLOTS
            if not tokens[i]:
                low[i], high[i], tokens[i] = x, y, counts[piece]
                break
    return low, high, tokens


def look_up(table: tuple[np.ndarray, np.ndarray, np.ndarray], raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The tokens of each piece by the table, 0 where it is not there. Whole pieces are compared, no hashes."""
    low, high, tokens = table
    out = np.zeros(len(start), np.int64)
    todo = np.flatnonzero(size <= WIDE)
    a, b = _keys(raw, start[todo], size[todo])
    todo_size = size[todo]
    at = _slot(a, b, todo_size)
    ends = raw[start[todo] + todo_size - 1] != 0  # else its padding looks like its bytes
    todo, a, b, at = todo[ends], a[ends], b[ends], at[ends]
    for _ in range(PROBES):
        if not len(todo):
            break
        found = (low[at] == a) & (high[at] == b)
        out[todo[found]] = tokens[at[found]]
        more = ~found & (tokens[at] > 0)  # an empty slot ends the search
        todo, a, b, at = todo[more], a[more], b[more], (at[more] + 1) % SLOTS
    return out


def _pieces(texts: pa.Array):
    """(padded bytes, text starts, piece starts, piece sizes) of a binary array."""
    body, at = string_bytes(texts)
    raw = np.concatenate([body, np.zeros(WIDE, np.uint8)])
    cut = piece_starts(body)
    edges = at[:-1][np.diff(at) > 0]
    cut[edges] = True
    start = np.flatnonzero(cut)
    return raw, at, start, np.diff(start, append=len(body))


class TwoTier:
    """Token counts of Arrow batches of texts: the broadcast table first, then a cache of other pieces, then the tokenizer."""

    def __init__(self, path: str, table) -> None:
        self.counting, self.table = Counting.of(path), table
        self.known: dict[bytes, int] = {}

    def encoded(self, pieces: list[bytes]) -> None:
        for i in range(0, len(pieces), 1 << 16):
            some = pieces[i : i + (1 << 16)]
            self.known.update(zip(some, self.counting.lengths([x.decode() for x in some]), strict=True))

    def counts(self, texts: pa.Array) -> np.ndarray:
        if not self.counting.cuts:
            return np.array([self.counting.lengths([x.decode()])[0] if x else 0 for x in texts.to_pylist()], np.int64)
        raw, at, start, size = _pieces(texts)
        tokens = look_up(self.table, raw, start, size)
        rest = np.flatnonzero((tokens == 0) & (size <= _SHORT))
        data = raw.tobytes()
        missed = [data[i:j] for i, j in zip(start[rest].tolist(), (start + size)[rest].tolist(), strict=True)]
        new = set(missed).difference(self.known)
        if len(new) + len(self.known) > CACHED:
            self.known.clear()
            new = set(missed)
        self.encoded(list(new))
        tokens[rest] = list(map(self.known.__getitem__, missed))
        for i in np.flatnonzero(size > _SHORT).tolist():  # long pieces are rare and seldom come again
            tokens[i] = self.counting.lengths([data[start[i] : start[i] + size[i]].decode()])[0]
        sums = np.concatenate([[0], np.cumsum(tokens)])[np.searchsorted(start, at)]
        out = np.diff(sums)
        if self.counting.added and self.counting.added.search(data):  # an added token in a text is no pre-token: such texts are encoded whole
            for i, (a, b) in enumerate(itertools.pairwise(at.tolist())):
                if self.counting.added.search(data[a:b]):
                    out[i] = self.counting.lengths([data[a:b].decode()])[0]
        return out


def frequent_lengths(docs: DataFrame, tokenizer: str, text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of the most frequent pieces in ``SAMPLE`` of the texts of ``WHOLE`` bytes at most.

    These are 64 MB at most and come from the first partitions that have
    enough of them; no others are read for it.
    """
    counting = Counting.of(tokenizer)
    if not counting.cuts:
        return build_table({})
    some = docs.select(F.col(text_col).cast("string").cast("binary").alias("text")).where(F.octet_length("text") <= WHOLE).take(SAMPLE)
    seen: Counter[bytes] = Counter()
    for i in range(0, len(some), 256):
        raw, _, start, size = _pieces(pa.array([bytes(x.text) for x in some[i : i + 256]], pa.binary()))
        data, short = raw.tobytes(), size <= WIDE
        seen.update(data[i:j] for i, j in zip(start[short].tolist(), (start + size)[short].tolist(), strict=True))
    best = [x for x, _ in seen.most_common(FREQUENT)]
    return build_table(dict(zip(best, counting.lengths([x.decode() for x in best]), strict=True)))


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    One pass without a shuffle: texts are cut where a pre-token is sure to
    start, the length of a piece comes from the broadcast table if it is
    there, else from the worker's cache, else from the tokenizer. Texts of
    tokenizers other than byte-level ones are encoded whole, as are texts
    with an added token in them, which gets its own id. A null text counts as
    empty: no bytes, no tokens. Rows of equal identifier or text are counted apart, null identifiers too; an empty table
    gives no rows. Other columns are not read. Memory: the table, the cache, and 8 MB
    of texts at once or one text.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer, text_col))

    def count(batches):
        state = TwoTier(tokenizer, shared.value)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for first, last in text_slices(texts):
                some = texts.slice(first, last - first)
                tokens, (_, at) = state.counts(some), string_bytes(some)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(np.diff(at)), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(tidy(count), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
