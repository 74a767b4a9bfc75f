"""Temperature mixing of sources, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import keep

LEVELS = 4  # halvings that one pass over the sources decides
HALVINGS = 48
BLOCK_TOKENS = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _key(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts]))


def source_tokens(docs: DataFrame, source_col: str, tokens_col: str) -> DataFrame:
    """A row per source (null is one) with its tokens; summed before the shuffle."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(tokens_col).alias("tokens"))


def _bisect(sources: DataFrame, measure, ok) -> float:
    """The least exponent in 0..1 whose ``measure`` is ``ok``, which is monotone; a pass tries the 15 cuts of four halvings."""
    low, high = 0.0, 1.0
    if ok(sources.agg(measure(F.lit(0.0)).alias("m")).first().m):
        return 0.0
    for _ in range(HALVINGS // LEVELS):
        cuts = [low + (high - low) * i / 2**LEVELS for i in range(1, 2**LEVELS)]
        found = sources.agg(*[measure(F.lit(c)).alias(f"m{i}") for i, c in enumerate(cuts)]).first()
        good = next((i for i in range(len(cuts)) if ok(found[i])), len(cuts))
        low, high = cuts[good - 1] if good else low, cuts[good] if good < len(cuts) else high
    return round(high, 6)


def exponent(sources: DataFrame, entropy: float | None = None, repetitions: float | None = None, budget: float | None = None) -> float:
    """The exponent of the token shares.

    With ``repetitions``, the least one (the most even mix) under which no
    source is passed more often than that, given the budget in passes over all
    tokens (without one: the largest source is passed once); 1 where the
    budget asks for more passes of every source. With ``entropy`` (nats), the
    largest one whose weights have that entropy at least, or 0 where none has.
    """
    if (entropy is None) == (repetitions is None):
        raise ValueError("give a target entropy or a repetition limit")
    found = sources.agg(F.max("tokens").alias("most"), F.sum("tokens").alias("total")).first()
    if not found.most:
        return 1.0
    ratio = F.col("tokens") / F.lit(float(found.most))
    live = sources.where("tokens > 0")
    if repetitions is not None:
        if repetitions < 1:
            raise ValueError("a repetition limit is 1 at least")
        passes = lambda a: F.max(F.pow(ratio, a - 1))  # noqa: E731  of the smallest source, for one of the largest
        if budget is None:
            return _bisect(live, passes, lambda m: m <= repetitions)
        share = float(budget) * float(found.total) / float(found.most)
        return _bisect(live, lambda a: passes(a) / F.sum(F.pow(ratio, a)) * F.lit(share), lambda m: m <= repetitions)

    def spread(a: Column) -> Column:  # of weights w: log(sum w) - sum(w log w) / sum w
        w = F.pow(ratio, a)
        return F.log(F.sum(w)) - F.sum(w * a * F.log(ratio)) / F.sum(w)

    # entropy falls with the exponent: the least exponent whose entropy is below the target, less one step
    if live.agg(spread(F.lit(1.0)).alias("m")).first().m >= entropy:
        return 1.0
    return _bisect(live, spread, lambda m: m < entropy)


def mixture(sources: DataFrame, alpha: float, budget: float | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per source: tokens, weight (they add up to 1), epochs, n_blocks.

    A source gets its weight's share of the budget, which is so many passes
    over all tokens; without one it is the least budget that passes the
    largest source, and with it every document, once.
    """
    found = sources.where("tokens > 0").agg(F.max("tokens").alias("most"), F.sum("tokens").alias("total")).first()
    most, total = float(found.most or 1), float(found.total or 0)
    power = F.pow(F.col("tokens") / F.lit(most), F.lit(alpha))
    z = float(sources.where("tokens > 0").agg(F.sum(power).alias("z")).first().z or 1)
    budget_tokens = most * z if budget is None else float(budget) * total
    live = F.col("tokens") > 0
    weight = F.when(live, power / F.lit(z)).otherwise(0.0)
    epochs = F.when(live, F.round(weight * F.lit(budget_tokens) / F.col("tokens"), 6)).otherwise(1.0)
    return sources.select("source", "tokens", weight.alias("weight"), epochs.alias("epochs"), F.greatest(F.ceil(F.col("tokens") / F.lit(block_tokens)), F.lit(1)).cast("long").alias("n_blocks"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", entropy: float | None = None, repetitions: float | None = None,
    budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 17, carry: list[str] | None = None,
) -> DataFrame:
    """The documents, each as often as its source's weight asks, with mix_epoch, mix_block, mix_position and mix_key.

    A source's documents fall by hash into blocks of about ``block_tokens``
    words. Every block is passed ``floor(epochs)`` times; of one more pass it
    gives the head of its permutation, up to the document at which its share
    of the budget is nearest. In each epoch a block is permuted anew, in order
    of ``mix_key``; ``mix_position`` is a document's place in that pass (1 is
    the first), and the rows of a partition come in this order. A hot source
    has many blocks, so no task sees more than a few.

    ``budget`` is in passes over all tokens: 1.25 gives a quarter more tokens
    than there are. Below one, and where a source's weight is small, documents
    are left out: that is what the weights ask. Without it none is.

    A null source is a source; a null or empty text has no tokens and goes
    along in the head of every pass; null ids hash by their texts; repeated
    rows are documents of their own (among them ties are open, their columns
    being equal). A source without tokens is passed once. An empty table gives
    no rows. ``carry`` names the columns kept (all by default); columns with
    the names of the new ones are replaced.
    """
    new = ("mix_epoch", "mix_block", "mix_position", "mix_key")
    names = [c for c in (carry or docs.columns) if c not in new]
    number = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    rows = docs.select(*names, number.alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_tokens"))
    sources = keep(source_tokens(rows, "_source", "_tokens"), "sources")
    plan = mixture(sources, exponent(sources, entropy, repetitions, budget), budget, block_tokens)
    plan = plan.select(F.col("source").alias("_of"), "epochs", "n_blocks")
    rows = rows.join(plan, F.col("_source").eqNullSafe(F.col("_of")), "left")
    rows = rows.withColumn("_whole", F.floor("epochs").cast("int"))
    number = F.conv(F.substring(_key(str(seed), F.col("_id")), 1, 12), 16, 10).cast("long")
    rows = rows.withColumns({"mix_block": F.pmod(number, F.col("n_blocks")), "_last": _key(str(seed), (F.col("_whole") + 1), F.col("_id"))})
    block = Window.partitionBy("_source", "mix_block")
    running = F.sum("_tokens").over(block.orderBy("_last", "_id").rowsBetween(Window.unboundedPreceding, 0))
    whole_block = F.sum("_tokens").over(block)
    part = F.col("epochs") - F.col("_whole")
    more = (part > 0) & (2 * running - F.col("_tokens") <= 2 * part * whole_block)
    rows = rows.withColumn("_times", F.col("_whole") + more.cast("int"))
    rows = rows.where("_times > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    rows = rows.withColumn("mix_key", _key(str(seed), F.col("mix_epoch"), F.col("_id")))
    # the blocks are together already: no further shuffle
    place = F.row_number().over(Window.partitionBy("_source", "mix_block", "mix_epoch").orderBy("mix_key", "_id"))
    return rows.withColumn("mix_position", place).select(*names, *new)
