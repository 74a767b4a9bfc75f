"""Language ID by hyperdimensional profiles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import text_slices, tidy

DIMENSIONS = 1024
ORDER = 3  # letters in an n-gram
DENSE = 1 << 22  # codes up to which n-grams are counted by a table, beyond by sorting
_CELLS = 1 << 20  # cells of a count matrix that a block of documents may take
SLICE = 1 << 20  # bytes and rows of text that are worked on at once
ROWS = 256

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether a code point is a letter, for all of them."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


class Space:
    """Random +1/-1 letter vectors, made from the code point and the seed alone, and their bindings."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.known: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            bits = np.random.Generator(np.random.Philox(key=[self.seed, code])).integers(0, 2, self.dimensions, dtype=np.int8)
            self.known[code] = bits * 2 - 1
        return self.known[code]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of n-grams (rows of code points): the letter k places before the last is rotated k times, then all are multiplied."""
        codes, at = np.unique(grams, return_inverse=True)
        table = np.stack([self.letter(int(c)) for c in codes]) if len(codes) else np.zeros((0, self.dimensions), np.int8)
        at = at.reshape(grams.shape)
        out = np.ones((len(grams), self.dimensions), np.int8)
        for k in range(grams.shape[1]):
            out *= np.roll(table, grams.shape[1] - 1 - k, axis=1)[at[:, k]]
        return out


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, document of each) of lower-cased texts: each run of other characters is one blank, a blank at either end; texts without a letter give nothing."""
    lower = [("" if t is None else t).lower() for t in texts.to_pylist()]
    raw = np.frombuffer("".join(f" {t} " for t in lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lower)), np.fromiter((len(t) + 2 for t in lower), np.int64, len(lower)))
    codes = np.where(_letters()[raw], raw, np.uint32(32))
    blank = codes == 32
    stay = np.ones(len(codes), bool)
    stay[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
    return codes[stay], owner[stay]


def _grams(codes: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-grams, index of each occurrence, its document); none reaches from one text into another."""
    if len(codes) < order:
        return np.zeros((0, order), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.bincount(codes) > 0
    letters, small = np.flatnonzero(seen), (np.cumsum(seen) - 1)[codes]
    base = len(letters)
    n = len(codes) - order + 1
    first = owner[:n]
    inside = first == owner[order - 1 :]
    if base**order <= DENSE:
        key = np.zeros(n, np.int64)
        for k in range(order):
            key = key * base + small[k : k + n]
        key, doc = key[inside], first[inside]
        used = np.bincount(key, minlength=base**order) > 0
        rank = np.cumsum(used) - 1
        distinct, index = np.flatnonzero(used), rank[key]
    else:
        key = np.zeros(n, np.uint64)
        for k in range(order):
            key = key * np.uint64(base) + small[k : k + n].astype(np.uint64)
        key, doc = key[inside], first[inside]
        distinct, index = np.unique(key, return_inverse=True)
        distinct = distinct.astype(np.int64)
    grams = np.empty((len(distinct), order), np.uint32)
    rest = distinct
    for k in range(order - 1, -1, -1):
        grams[:, k] = letters[rest % base]
        rest = rest // base
    return grams, index, doc


def encode(texts: pa.Array, space: Space, order: int = ORDER) -> np.ndarray:
    """The bundle (sum of n-gram vectors, a row per text) in double precision; texts without a letter give zeros."""
    codes, owner = _codes(texts)
    grams, index, doc = _grams(codes, owner, order)
    out = np.zeros((len(texts), space.dimensions), np.float64)
    step = 2048
    docs_per_block = max(1, _CELLS // step)
    block = index // step
    if len(grams) > step:  # 16-bit keys are sorted by radix
        cut = np.argsort(block.astype(np.uint16) if len(grams) <= step << 16 else block, kind="stable")
        index, doc, block = index[cut], doc[cut], block[cut]
    edges = np.searchsorted(block, np.arange(len(grams) // step + 2)) if len(grams) else [0]
    for b in range(len(edges) - 1):
        i, d = index[edges[b] : edges[b + 1]] - b * step, doc[edges[b] : edges[b + 1]]
        if not len(i):
            continue
        vectors = space.bind(grams[b * step : (b + 1) * step]).astype(np.float32)
        width = len(vectors)
        for low in range(0, len(texts), docs_per_block):
            high = min(low + docs_per_block, len(texts))
            a, z = np.searchsorted(d, [low, high])
            counts = np.bincount((d[a:z] - low) * width + i[a:z], minlength=(high - low) * width).reshape(-1, width)
            out[low:high] += counts.astype(np.float32) @ vectors
    return out


@dataclass(frozen=True)
class Profiles:
    """Languages and their prototype vectors of length one."""

    languages: list[str]
    vectors: np.ndarray
    order: int
    seed: int

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The nearest language and the cosine (0 below 0); ``und`` with 0 where a text has no letter."""
        return self.of(encode(texts, Space(self.vectors.shape[1], self.seed), self.order))

    def of(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        length = np.sqrt((x * x).sum(axis=1))
        none = length == 0
        if not self.languages:
            return ["und"] * len(x), np.zeros(len(x))
        cosine = (x @ self.vectors.T) / np.where(none, 1, length)[:, None]
        best = cosine.argmax(axis=1)
        names = ["und" if n else self.languages[b] for n, b in zip(none.tolist(), best.tolist(), strict=True)]
        return names, np.where(none, 0.0, np.clip(cosine[np.arange(len(x)), best], 0.0, 1.0))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = 7) -> Profiles:
    """Prototypes from all rows with a text and a language.

    Each task adds up, per language, the documents' bundles scaled to length
    one, so that long texts weigh as much as short ones; the sums of the tasks
    are added by Spark per language and dimension (map-side first). What comes
    to the driver is languages x dimensions numbers.
    """

    def bundle(batches):
        space, sums = Space(dimensions, seed), {}
        for batch in batches:
            for a, b in text_slices(batch.column(0), SLICE, ROWS):
                x = encode(batch.column(0).slice(a, b - a), space, order)
                length = np.sqrt((x * x).sum(axis=1, keepdims=True))
                x /= np.where(length == 0, 1, length)
                names = np.array(batch.column(1).slice(a, b - a).to_pylist(), object)
                for name in set(names):
                    sums[name] = sums.get(name, 0) + x[names == name].sum(axis=0)
        for name, v in sums.items():
            fixed = np.rint(v * 2**20).astype(np.int64)  # whole numbers add up alike in any order
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(fixed)], names=["lang", "dim", "value"])

    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    found = rows.mapInArrow(tidy(bundle), "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    languages = sorted({r.lang for r in found})
    vectors = np.zeros((len(languages), dimensions))
    for r in found:
        vectors[languages.index(r.lang), r.dim] = r.value
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    keep = length[:, 0] > 0
    return Profiles([x for x, k in zip(languages, keep, strict=True) if k], (vectors / np.where(length == 0, 1, length))[keep], order, seed)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; no other column than the text is an input.

    A null text or one without a letter gets ``und`` and 0; so does every text
    where no language was learned. Long texts are counted in one piece, ties
    go to the first language by name, an empty table stays empty; columns of
    the two names are replaced.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    own = text_col in rest and dict(docs.dtypes)[text_col] == "string"  # then the text travels once
    named = docs.select(*rest) if own else docs.select(*rest, F.col(text_col).cast("string").alias("_text"))
    place = rest.index(text_col) if own else len(rest)
    schema = named.select(*rest, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def predict(batches):
        space = Space(profiles.vectors.shape[1], profiles.seed)
        for batch in batches:
            text = batch.column(place)
            for a, b in text_slices(text, SLICE, ROWS):
                names, score = profiles.of(encode(text.slice(a, b - a), space, profiles.order))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[: len(rest)], pa.array(names, pa.string()), pa.array(score)], names=[*rest, "lang_pred", "score"])

    return named.mapInArrow(tidy(predict), schema)


def told(score: Column, lang_pred: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a prediction says more than chance: unrelated vectors have a cosine of 0 with a standard deviation of 1 / sqrt(dimensions), so two of them at least."""
    return (lang_pred != "und") & (score >= 2 / dimensions**0.5)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
