"""SentencePiece encoding by Gumbel top-k without replacement, and decoding."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import mix64, text_slices, tidy

SLICE = 1 << 17  # bytes of text whose lattice is held at once; a longer text has its own
SPACE = "▁"
_SIDES = 0x110000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 18)
        base, inverse = int(_MULT), pow(int(_MULT), -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (base, inverse)]
    return _powers[0][:n], _powers[1][:n]


class Vocabulary:
    """The pieces of a model file as a trie over letters, with log weights.

    The log weight of a piece is ``alpha`` times its score; the scores of a
    merge model are ranks, for which a Zipf law stands: -log(2 + rank).
    """

    _own: dict[tuple[str, float], Vocabulary] = {}

    def __init__(self, path: str, alpha: float = 1.0) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names, scores = [sp.id_to_piece(i) for i in range(n)], np.array([sp.get_score(i) for i in range(n)])
        self.processor, self.size = sp, n
        self.prefix = sp.encode("a", out_type=str)[0].startswith(SPACE)
        self.plain = all(sp.normalize(x).strip(SPACE) == x for x in ("ﬁ", "Ⅷ", "Ａ", "é"))
        bytes_at = {int(names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_id = np.array([bytes_at.get(b, sp.unk_id()) for b in range(256)], np.int32)
        usual = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ranked = all(float(scores[i]).is_integer() for i in usual)
        weight = -np.log(2 + np.minimum(-scores, n)) if ranked else scores
        self.weight = alpha * weight
        self.least = float(self.weight[usual].min()) if usual else 0.0
        letters = sorted({c for i in usual for c in names[i]})
        self.letter = np.zeros(_SIDES, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.blank = int(self.letter[ord(SPACE)])
        self.letter[ord(SPACE)] = 0  # a text's own U+2581 is spelled in bytes, so that it comes back
        self.letter[32] = self.blank
        self.base = len(letters) + 1
        self.longest = max((len(names[i]) for i in usual), default=1)
        states: dict[str, int] = {"": 0}
        moves: dict[int, int] = {}
        ends: list[int] = [-1]
        number = {c: k + 1 for k, c in enumerate(letters)}
        pairs = set()
        for i in usual:
            pairs.update(zip(names[i], names[i][1:], strict=False))
            for k in range(1, len(names[i]) + 1):
                head = names[i][:k]
                if head not in states:
                    states[head] = len(ends)
                    ends.append(-1)
                    moves[states[head[:-1]] * self.base + number[head[-1]]] = states[head]
            ends[states[names[i]]] = i
        self._hash(np.array(list(moves), np.int64), np.array(list(moves.values()), np.int32))
        self.ends = np.array(ends, np.int32)
        joined = sorted({c for p in pairs for c in p})
        self.joint = np.zeros(self.base, np.int32)
        self.joint[[number[c] for c in joined]] = np.arange(1, len(joined) + 1)
        self.joins = np.zeros((len(joined) + 1,) * 2, bool)
        for a, b in pairs:
            self.joins[self.joint[number[a]], self.joint[number[b]]] = True
        self.spelled = [bytes([int(names[i][1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]

    def _hash(self, keys: np.ndarray, to: np.ndarray) -> None:
        """Moves of the trie by hash; keys that share a slot are also in a sorted list."""
        self.bits = max(8, int(np.ceil(np.log2(8 * len(keys) + 1))))
        slot = self._slot(keys)
        self.slot_key, self.slot_to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        self.slot_key[slot], self.slot_to[slot] = keys, to
        crowded = np.bincount(slot, minlength=1 << self.bits) > 1
        self.crowded = crowded
        over = np.flatnonzero(crowded[slot])
        over = over[np.argsort(keys[over])]
        self.over_key, self.over_to = np.append(keys[over], np.iinfo(np.int64).max), np.append(to[over], 0)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def move(self, keys: np.ndarray) -> np.ndarray:
        """The states that keys (state times letters plus letter) lead to; -1 where none."""
        slot = self._slot(keys)
        hit = self.slot_key[slot] == keys
        out = np.where(hit, self.slot_to[slot], np.int32(-1))
        look = np.flatnonzero(~hit & self.crowded[slot])
        if len(look):
            at = np.searchsorted(self.over_key, keys[look])
            out[look] = np.where(self.over_key[at] == keys[look], self.over_to[at], -1)
        return out

    @classmethod
    def of(cls, path: str, alpha: float) -> Vocabulary:
        """The vocabulary of this worker for a file."""
        if (path, alpha) not in cls._own:
            cls._own[path, alpha] = cls(path, alpha)
        return cls._own[path, alpha]

    def mixed(self, code: np.ndarray) -> np.ndarray:
        """A random 64-bit number for each code point."""
        if not hasattr(self, "_mixed"):
            self._mixed = mix64(np.arange(1, _SIDES + 1, dtype=np.uint64))
        return self._mixed[code]

    def normal(self, text: str) -> str:
        """What is segmented: the text, after the model's normaliser where it has one."""
        return text if self.plain else self.processor.normalize(text).removeprefix(SPACE if self.prefix else "").replace(SPACE, " ")

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what the pieces spell, one after the other; first byte of each and the end)."""
        if not hasattr(self, "_spelled"):
            size = np.fromiter(map(len, self.spelled), np.int64, self.size)
            self._spelled = np.frombuffer(b"".join(self.spelled), np.uint8), np.cumsum(size) - size, size
        raw, start, size = self._spelled
        at = np.concatenate([[0], np.cumsum(size[ids])])
        return raw[np.arange(at[-1]) + np.repeat(start[ids] - at[:-1], size[ids])], at

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the blank that the model puts in front is taken off."""
        raw = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if self.prefix and raw[:1] == " " else raw


@dataclass
class Lattice:
    """All segmentations of the distinct stretches of a block of texts.

    No piece crosses from one stretch into the next, so a text's lattice is
    the chain of its stretches'. ``cum`` has, for each node (letter of a
    stretch), the running probabilities of the edges by their length, weighted
    by all that may follow (backward sums), so that walks need no lookahead.
    """

    node: np.ndarray  # node of each letter of the block
    begins: np.ndarray  # whether a letter is the first of a stretch; one more at the end
    first: np.ndarray  # first letter of each text; one more at the end
    piece: np.ndarray  # node x length: piece id, -1 none, -2 bytes
    log_prob: np.ndarray
    cum: np.ndarray
    rest: np.ndarray  # per node: what the likeliest edge leaves to the others
    code: np.ndarray


def lattice(v: Vocabulary, texts: list[str]) -> Lattice:
    """The lattice of a block of texts, each distinct stretch worked out once."""
    full = [(" " + t if v.prefix and t else t) for t in texts]
    code = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, full), np.int64, len(full)))])
    letter = v.letter[code]
    n = len(code)
    if not n:
        none = np.zeros((0, 1))
        return Lattice(np.zeros(0, np.int32), np.ones(1, bool), first, none.astype(np.int32), none, none, np.zeros(0), code)
    joint = v.joint[letter]
    begins = np.ones(n + 1, bool)
    begins[1:-1] = ~v.joins[joint[:-1], joint[1:]]
    begins[first] = True
    start = np.flatnonzero(begins[:-1])
    end = np.append(start[1:], n)
    up, down = _power(n)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v.mixed(code) * up)])
        name = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    _, sample, which = np.unique(name, return_index=True, return_inverse=True)
    size = (end - start)[sample]
    offset = np.concatenate([[0], np.cumsum(size)])
    nodes = int(offset[-1])
    within = np.arange(nodes) - offset[:-1].repeat(size)
    own = letter[start[sample].repeat(size) + within].astype(np.int64)
    left = size.repeat(size) - within  # letters up to the stretch's end
    columns = []
    at, state = np.arange(nodes), np.zeros(nodes, np.int64)
    for k in range(v.longest):
        next_letter = own[at + k]
        state = v.move(state * v.base + next_letter)
        ok = (state >= 0) & (next_letter > 0)
        at, state = at[ok], state[ok].astype(np.int64)
        if not len(at) and k:
            break
        column = np.full(nodes, -1, np.int32)
        column[at] = v.ends[state]
        columns.append(column)
        going = left[at] > k + 1
        at, state = at[going], state[going]
        if not len(at):
            break
    columns[0][columns[0] == -1] = -2
    order = np.argsort(left.astype(np.uint16) if int(left.max()) < 1 << 16 else left, kind="stable")
    # nodes nearest to their stretch's end first: their rows lie together and each group needs only earlier ones
    place = np.empty(nodes, np.int64)
    place[order] = np.arange(nodes)
    piece = np.stack(columns, axis=1)[order]
    del columns
    width = piece.shape[1]
    log_prob = np.append(v.weight, [v.least, -np.inf])[piece]  # -2: bytes, -1: none
    beta, prob = np.zeros(nodes + width + 1), np.zeros(log_prob.shape)
    left = left[order]
    edges = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1], [True]]))
    reach = np.arange(1, width + 1)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        span = min(width, int(left[a]))
        x = log_prob[a:b, :span] + beta[order[a:b, None] + reach[:span]] if left[a] > span else np.concatenate([log_prob[a:b, : span - 1] + beta[order[a:b, None] + reach[: span - 1]], log_prob[a:b, span - 1 : span]], axis=1)
        top = x.max(axis=1)
        e = np.exp(x - top[:, None])
        mass = e.sum(axis=1)
        beta[order[a:b]] = sums = top + np.log(mass)
        log_prob[a:b, :span] = x - sums[:, None]
        prob[a:b, :span] = e / mass[:, None]
    likeliest = np.arange(nodes), prob.argmax(axis=1)
    top = prob[likeliest]
    prob[likeliest] = 0
    rest = prob.sum(axis=1)
    prob[likeliest] = top
    cum = np.cumsum(prob, axis=1, out=prob)
    cum[:, -1] = np.maximum(cum[:, -1], 1.0)
    node = place[offset[:-1][which].repeat(end - start) + np.arange(n) - start.repeat(end - start)].astype(np.int32)
    return Lattice(node, begins, first, piece, log_prob, cum, rest, code)


def _salted(key: np.ndarray, salt: int) -> np.ndarray:
    return mix64(key ^ mix64(np.full(1, salt + 1, np.uint64)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from random bits that are not yet mixed."""
    out = (mix64(x) >> np.uint64(11)).astype(np.float64)
    out *= 2.0**-53
    out += 2.0**-54
    return out


def _gumbel_below(log_mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers at ``log_mass``, conditioned on being at most ``bound``."""
    with np.errstate(divide="ignore", over="ignore"):
        return log_mass - np.log(np.exp(log_mass - bound) - np.log(u))


@dataclass
class Sample:
    """One segmentation per text of a block: step (edge length, 0 off the path) by place, its log probability and perturbed value."""

    step: np.ndarray
    on: np.ndarray  # the places on the path
    edge: np.ndarray  # and their edges, as places in the flattened lattice
    log_p: np.ndarray
    value: np.ndarray
    alive: np.ndarray


@dataclass
class _Walk:
    """The nodes of a block's walks in order, and at each the set of segmentations that turn off there."""

    on: np.ndarray
    begin: np.ndarray  # first node of each text; one more at the end
    owner: np.ndarray
    best: np.ndarray  # best perturbed value of the set
    mask: np.ndarray  # edges that are not in the set, as bits


def sample_top_k(lat: Lattice, key: np.ndarray, k: int) -> tuple[list[Sample], np.ndarray]:
    """The k segmentations of each text with the largest Gumbel-perturbed log probabilities.

    That is a sample without replacement. The search is best-first over sets
    of segmentations: the root set has all of them and a Gumbel number as its
    best value; by the backward sums a walk draws the member that has it. What
    is left of the set splits, at each node of the walk, into the members that
    turn off there; the best value of each such set is a Gumbel number at its
    log mass, conditioned on being below the parent's. The next segmentation
    is drawn from the set with the best value over all walks so far. Returns
    the samples in falling order of value and the best value of what is left
    (minus infinity where nothing is).
    """
    texts, n = len(lat.first) - 1, len(lat.node)
    sizes = np.diff(lat.first)
    text_of = np.arange(texts, dtype=np.int32).repeat(sizes)
    root = -np.log(-np.log(_uniform(_salted(key, 0))))
    with np.errstate(over="ignore"):
        place = (np.arange(n) - lat.first[text_of]).astype(np.uint64) * _MULT
    width = lat.cum.shape[1] if n else 1
    log_prob, steps = lat.log_prob.ravel(), lat.cum
    begins = lat.begins
    samples: list[Sample] = []
    walks: list[_Walk] = []

    def uniform(at: np.ndarray, salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _uniform(_salted(key, salt)[text_of[at]] + place[at])

    def walk(at: np.ndarray, step: np.ndarray, number: int) -> None:
        while len(at):
            length = np.count_nonzero(steps[lat.node[at]] < uniform(at, 2 * number + 1)[:, None], axis=1) + 1
            step[at] = length
            at = at + length
            at = at[~begins[at]]

    def others(rows: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The probabilities of the edges of nodes, but for those in the masks."""
        x = np.exp(lat.log_prob[rows])
        x[(mask[:, None] >> np.arange(1, x.shape[1] + 1)) & 1 == 1] = 0
        return x

    def settle(step: np.ndarray, value: np.ndarray, turn: np.ndarray | None, old: np.ndarray | None, number: int) -> None:
        """Log probability, and the sets left at the nodes of a walk from ``turn`` on."""
        on = np.flatnonzero(step)
        rows, length = lat.node[on], step[on].astype(np.int64)
        edge = rows.astype(np.int64) * width + length - 1
        log_p = log_prob[edge]
        owner = text_of[on]
        begin = np.searchsorted(on, lat.first)
        running = np.concatenate([[0.0], np.cumsum(log_p)])
        before = running[:-1] - running[begin[:-1]].repeat(np.diff(begin))
        mask = np.left_shift(np.int32(1), length.astype(np.int32))
        rest = np.where(log_p > -0.69, lat.rest[rows], -np.expm1(log_p))
        keep = rest > 0
        if turn is not None:
            t = turn[owner]
            here = np.flatnonzero(on == t)
            mask[here] |= old[owner[here]]
            rest[here] = others(rows[here], mask[here]).sum(axis=1)
            keep = (on >= t) & (rest > 0)
        best = np.full(len(on), -np.inf)
        at = np.flatnonzero(keep)
        best[at] = _gumbel_below(before[at] + np.log(rest[at]), value[owner[at]], uniform(on[at], 2 * number + 2))
        walks.append(_Walk(on, begin, owner, best, mask))
        samples.append(Sample(step, on, edge, running[begin[1:]] - running[begin[:-1]], value, np.isfinite(value)))

    def best_left() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: the best value of a set that is left, its place in its walk, the walk."""
        value, node, of = np.full(texts, -np.inf), np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        for w, walked in enumerate(walks):
            some = np.flatnonzero(np.diff(walked.begin) > 0)
            if not len(some):
                continue
            m = np.full(texts, -np.inf)
            m[some] = np.maximum.reduceat(walked.best, walked.begin[some])
            hit = np.flatnonzero((walked.best == m[walked.owner]) & np.isfinite(walked.best))[::-1]
            spot = np.zeros(texts, np.int64)
            spot[walked.owner[hit]] = hit
            better = m > value
            value, node, of = np.where(better, m, value), np.where(better, spot, node), np.where(better, w, of)
        return value, node, of

    everywhere = np.flatnonzero(begins[:-1])
    step = np.zeros(n, np.int8)
    walk(everywhere, step, 0)
    settle(step, root, None, None, 0)
    for number in range(1, k):
        value, node, of = best_left()
        live = np.flatnonzero(np.isfinite(value))
        step, old, turn = np.zeros(n, np.int8), np.zeros(texts, np.int32), np.full(texts, -1, np.int64)
        for w in range(number):
            own = live[of[live] == w]
            turn[own] = walks[w].on[node[own]]
            old[own] = walks[w].mask[node[own]]
            walks[w].best[node[own]] = -np.inf
            use = (of == w) & (turn >= 0)
            t = np.where(use, turn, -1)[walks[w].owner]
            head = walks[w].on[walks[w].on < t]
            step[head] = samples[w].step[head]
        spots = turn[live]
        c = np.cumsum(others(lat.node[spots], old[live]), axis=1)
        length = (c < (uniform(spots, 2 * number + 1) * c[:, -1])[:, None]).sum(axis=1) + 1
        step[spots] = length
        onward = spots + length
        after = np.where(turn >= 0, turn, n)[text_of[everywhere]]
        walk(np.concatenate([onward[~begins[onward]], everywhere[everywhere > after]]), step, number)
        settle(step, value, turn, old, number)
    return samples, best_left()[0]


@dataclass
class Sampled:
    """A sample of each text of a block: the texts that have one, and for these ids, first id (and the end), log probability, log inclusion, and whether the ids spell the text."""

    texts: np.ndarray
    ids: np.ndarray
    at: np.ndarray
    log_p: np.ndarray
    log_q: np.ndarray
    exact: np.ndarray


def sampled(v: Vocabulary, texts: list[str], key: np.ndarray, k: int):
    """Yields the samples of a block of texts, first to last."""
    texts = [v.normal(t) for t in texts]
    raw = [(" " + t if v.prefix and t else t).encode("utf-8", "replace") for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    want = np.frombuffer(b"".join(raw), np.uint8)
    lat = lattice(v, texts)
    samples, rest = sample_top_k(lat, key, k)
    for sample in samples:
        on, piece = sample.on, lat.piece.ravel()[sample.edge]
        odd = np.flatnonzero(piece == -2)
        if len(odd):
            spelt = [chr(c).encode("utf-8", "replace") for c in lat.code[on[odd]].tolist()]
            count = np.ones(len(on), np.int64)
            count[odd] = [len(x) for x in spelt]
            ids = np.repeat(piece, count)
            ids[ids == -2] = v.byte_id[np.frombuffer(b"".join(spelt), np.uint8)]
            at = np.concatenate([[0], np.cumsum(count)])
        else:
            ids, at = piece, np.arange(len(on) + 1)
        cut = at[np.searchsorted(on, lat.first)]
        got, byte = v.bytes_of(ids)
        live = np.flatnonzero(sample.alive)
        exact = np.diff(byte[cut]) == size
        if exact[live].all() and len(live) == len(texts):
            wrong = np.flatnonzero(got != want)
            exact[np.searchsorted(np.cumsum(size), wrong, "right")] = False
        else:
            begin = np.cumsum(size) - size
            for t in live[exact[live]].tolist():
                exact[t] = np.array_equal(got[byte[cut[t]] : byte[cut[t + 1]]], want[begin[t] : begin[t] + size[t]])
        with np.errstate(over="ignore", under="ignore", divide="ignore"):
            x = sample.log_p - rest
            inclusion = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 40)))))
        yield Sampled(live, np.ascontiguousarray(ids, np.int32), np.append(cut[live], cut[-1]), sample.log_p[live], np.minimum(0.0, inclusion[live]), exact[live])


def segmentations(v: Vocabulary, texts: list[str], key: np.ndarray, k: int):
    """Yields (text, sample, ids, log_prob, log_inclusion) for a block of texts."""
    for s, x in enumerate(sampled(v, texts, key, k)):
        for i, t in enumerate(x.texts.tolist()):
            yield t, s + 1, x.ids[x.at[i] : x.at[i + 1]], float(x.log_p[i]), float(x.log_q[i])


def sample_segmentations(docs: DataFrame, model: str, k: int = 2, alpha: float = 1.0, seed: int = 23, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, pass_col: str | None = None) -> DataFrame:
    """Up to k distinct segmentations per text: id [, pass], sample, n_pieces, ids_crc32, log_prob, log_inclusion, exact [, ids].

    A text's segmentations into the model's pieces have probability in
    proportion to the product of their weights; ``sample`` 1..k is a sample
    without replacement in order of perturbed value. ``log_inclusion`` is the
    log of the probability of being in such a sample given the best value
    outside it. The random numbers come from the id and the seed alone (and
    from ``pass_col``, where a document comes several times), so a row gets
    the same samples wherever and whenever it is computed. ``exact``
    tells whether the ids decode to the text (after the model's normaliser).

    A null or empty text has one segmentation, of no piece. Fewer rows than k
    come where fewer segmentations exist. Letters that the model lacks are
    spelled in bytes, as is U+2581, so decoding brings them back. Repeated
    rows get equal samples; a null id is a key like others; an empty table
    gives no rows. Other columns are not read.
    """
    passes = [F.col(pass_col).cast("long")] if pass_col else []
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(id_col).cast("string"), F.lit(seed), *passes).alias("_key"), F.col(text_col).cast("string").alias("_text"), *passes)
    schema = f"{id_col} long, " + (f"{pass_col} long, " if pass_col else "") + "sample int, n_pieces long, ids_crc32 long, log_prob double, log_inclusion double, exact boolean" + (", ids array<int>" if with_ids else "")
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        v = Vocabulary.of(model, alpha)
        for batch in batches:
            for a, b in text_slices(batch.column(2), SLICE):
                own = batch.slice(a, b - a)
                texts = [t or "" for t in own.column(2).to_pylist()]
                keys = own.column(1).to_numpy().view(np.uint64)
                for number, x in enumerate(sampled(v, texts, keys, k)):
                    which, n = pa.array(x.texts), np.diff(x.at)
                    raw, at = memoryview(x.ids.astype("<u4", copy=False)).cast("B"), (4 * x.at).tolist()
                    sums = [zlib.crc32(raw[c:d]) for c, d in zip(at[:-1], at[1:], strict=True)]
                    arrays = [own.column(i).take(which) for i in (0, *range(3, own.num_columns))]
                    arrays += [pa.array(np.full(len(n), number + 1, np.int32)), pa.array(n), pa.array(sums, pa.int64()), pa.array(x.log_p), pa.array(x.log_q), pa.array(x.exact)]
                    if with_ids:
                        arrays.append(pa.ListArray.from_arrays(pa.array(x.at.astype(np.int32)), pa.array(x.ids)))
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(tidy(run), schema)
