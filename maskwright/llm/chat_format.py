"""Chat formatting with a grammar round trip, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, COLON, TAIL = "### ", ": ", "\n</turn>\n"
_CONTROL = r"(\\*)(### |</turn>)"
_ESCAPED = r"\\(\\*)(### |</turn>)"
_ROLE = (("%", "%25"), (":", "%3A"), ("\n", "%0A"), ("#", "%23"), ("<", "%3C"))


def escape(text: Column) -> Column:
    """One more backslash before every control string; ``unescape`` takes it away again."""
    return F.regexp_replace(text, _CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    """One backslash less before every control string that has any."""
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def _role_out(role: Column) -> Column:
    for plain, coded in _ROLE:
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def _role_in(role: Column) -> Column:
    for plain, coded in reversed(_ROLE):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def render_turn(role: Column, body: Column) -> Column:
    """A turn in the template; ``body`` is the text, escaped or as it is."""
    return F.concat(F.lit(HEAD), _role_out(role), F.lit(COLON), body, F.lit(TAIL))


def parts(rendered: Column) -> Column:
    """The turns of a rendered conversation, between the end marks."""
    cut = F.split(rendered, TAIL, -1)
    return F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))


def parse(rendered: Column) -> Column:
    """The deterministic parser: rendered text to array<struct<role, text>>.

    Every end mark closes a turn; a turn is head, role up to the first colon
    and blank, and the body, from which one backslash before each control
    string goes. A turn without head or colon is no turn: it is null.
    """

    def turn(part: Column) -> Column:
        colon = F.instr(part, COLON)
        role = F.substring(part, F.lit(len(HEAD) + 1), colon - F.lit(len(HEAD) + 1))
        body = F.substring(part, colon + F.lit(len(COLON)), F.length(part))
        return F.when(F.startswith(part, F.lit(HEAD)) & (colon > 0), F.struct(_role_in(role).alias("role"), unescape(body).alias("text")))

    return F.transform(parts(rendered), turn)


def conflicts(role: Column, text: Column) -> Column:
    """Whether a turn, rendered as it is, reparses to anything but itself."""
    return parse(render_turn(role, text)) != F.array(F.struct(role.alias("role"), text.alias("text")))


def format_chats(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_runs, turns, escaped_turns.

    Turns go in ascending order of ``turn`` (null first); rows of equal turn
    by role, then text; repeated rows are turns of their own. A null role or
    text counts as empty; null conv_ids are one conversation. An empty table
    gives no rows; other columns are not read.

    Each turn is rendered as it is and reparsed. A turn that does not come
    back identical is escaped. Then the whole conversation is reparsed and
    compared with its source; if it still differs, all its turns are escaped,
    which always comes back identical: no unescaped control string is left
    inside a text. ``turns`` is what the parser recovers from ``formatted``.
    ``loss_runs`` masks ``formatted`` as runs of (length in code points, loss):
    loss is true on the texts of ``learn`` and false on the template.
    """
    source = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    source = source.withColumn("_escape", conflicts(F.col("_role"), F.col("_text")))
    turns = F.array_sort(F.collect_list(F.struct("_turn", "_role", "_text", "_escape")))
    whole = source.groupBy("conv_id").agg(turns.alias("_turns"))

    def rendered(force: bool) -> Column:
        body = (lambda t: escape(t["_text"])) if force else (lambda t: F.when(t["_escape"], escape(t["_text"])).otherwise(t["_text"]))
        return F.array_join(F.transform("_turns", lambda t: render_turn(t["_role"], body(t))), "")

    plain = F.transform("_turns", lambda t: F.struct(t["_role"].alias("role"), t["_text"].alias("text")))
    whole = whole.withColumn("_first", rendered(False))
    whole = whole.withColumn("_same", parse(F.col("_first")) == plain)
    whole = whole.withColumn("formatted", F.when(F.col("_same"), F.col("_first")).otherwise(rendered(True)))
    escaped = F.when(F.col("_same"), F.size(F.filter("_turns", lambda t: t["_escape"]))).otherwise(F.size("_turns"))
    whole = whole.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), escaped.cast("long").alias("escaped_turns"))

    def runs(part: Column) -> Column:
        head = F.instr(part, COLON) + F.lit(len(COLON) - 1)
        said = _role_in(F.substring(part, F.lit(len(HEAD) + 1), F.instr(part, COLON) - F.lit(len(HEAD) + 1)))
        run = lambda n, loss: F.struct(n.cast("long").alias("length"), loss.alias("loss"))
        return F.array(run(head, F.lit(False)), run(F.length(part) - head, said == learn), run(F.lit(len(TAIL)), F.lit(False)))

    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "formatted", F.flatten(F.transform(parts(F.col("formatted")), runs)).alias("loss_runs"), "turns", "escaped_turns")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what ``format_chats`` gives, read back from its output.

    The text under the loss mask is cut from ``formatted``: its parts in
    order, each with the run that masks it.
    """
    loss_of = F.transform(F.filter("loss_runs", lambda r, i: i % 3 == 1), lambda r: r["loss"])
    bodies = F.transform(parts(F.col("formatted")), lambda p: F.substring(p, F.instr(p, COLON) + F.lit(len(COLON)), F.length(p)))
    pairs = F.filter(F.zip_with(bodies, loss_of, lambda b, m: F.struct(b.alias("body"), m.alias("loss"))), lambda x: x["loss"])
    learned = F.array_join(F.transform(pairs, lambda x: unescape(x["body"])), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = formatted.withColumn("_learned", learned)
    return out.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length("_learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("_learned"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
