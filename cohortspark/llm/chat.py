"""Chat formatting with prefix targets, with DataFrame functions only.

Every assistant turn is exploded into an example of its own: all preceding turns are its context and only its reply is
trainable. A row holds the whole context, so the output is as long as all prefixes together; it is cut from the formatted
conversation as rows are made, one at a time, so a task holds a conversation, not its prefixes. A last row without a target
has the whole conversation as its context, with the turns after the last reply. ``read_back`` tells conversations from these rows.

Template: ``<turn role="R">`` text ``</turn>`` and a line end. In roles and texts, ``&``, ``<`` and ``"`` are written
``&amp;``, ``&lt;`` and ``&quot;``, so no text can hold a mark, and reading back gives every text as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = '<turn role="', '">', "</turn>\n"


def escape(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in (('"', "&quot;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows to examples: conv_id, example, trainable, n_context, context, target, start, length.

    ``example`` counts a conversation's rows from 0. ``context`` is all that is formatted before the reply, up to where it begins; ``target`` the
    formatted reply, ``n_context`` how many turns precede it. In context and target together, the loss mask covers ``length`` characters
    from ``start``. The last row of a conversation is not ``trainable``: its context is the whole conversation.
    Turns are taken in order of turn, then role, then text; null role or text counts as empty; a null conv_id is a
    conversation too. An empty table gives an empty table; repeated rows are repeated turns; other columns are ignored.
    """
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).select("conv_id", F.struct("turn", "role", "text", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t")).alias("x"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    marked = lambda x: F.concat(F.lit(OPEN), x["r"], F.lit(MIDDLE), x["t"], F.lit(CLOSE))
    size = lambda x: F.length(x["r"]) + F.length(x["t"]) + (len(OPEN) + len(MIDDLE) + len(CLOSE))
    # Places where turns begin, by running sums; the last is the end.
    none = F.array(F.lit(0))
    begins = F.aggregate("xs", none, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + size(x))))
    placed = whole.select("conv_id", "xs", F.array_join(F.transform("xs", marked), "").alias("formatted"), begins.alias("begins"))
    place = lambda i: F.struct(
        F.lit(True).alias("trainable"),
        i.alias("n_context"),
        (F.get("begins", i) + F.length(F.get("xs", i)["r"]) + (len(OPEN) + len(MIDDLE))).alias("start"),
        F.length(F.get("xs", i)["t"]).alias("length"),
    )
    replies = F.filter(F.sequence(F.lit(0), F.size("xs") - 1), lambda i: F.get("xs", i)["role"] == "assistant")
    rest = F.struct(F.lit(False).alias("trainable"), F.size("xs").alias("n_context"), F.length("formatted").alias("start"), F.lit(0).alias("length"))
    examples = placed.select("conv_id", "formatted", F.posexplode(F.concat(F.transform(replies, place), F.array(rest))).alias("example", "e")).select("conv_id", "formatted", "example", "e.*")
    return examples.select(
        "conv_id", "example", "trainable", "n_context",
        F.substring("formatted", F.lit(1), F.col("start")).alias("context"), F.substring("formatted", F.col("start") + 1, F.col("length")).alias("target"),
        F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"),
    )


def example_texts(examples: DataFrame) -> DataFrame:
    """The trainable examples: conv_id, example, context, target (both as formatted), start and length of the loss mask."""
    return examples.where("trainable").select("conv_id", "example", "context", "target", "start", "length")


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: turns (array of role, text), the unescaped text under the loss mask, formatted_chars.

    Of a conversation's contexts, each of which begins the next, the greatest is the whole.
    """
    masked = F.substring(F.concat("context", "target"), (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    rows = F.sort_array(F.collect_list(F.struct("example", unescape(masked).alias("text")))).alias("es")
    whole = examples.groupBy("conv_id").agg(rows, F.max("context").alias("formatted"))
    cut = F.split("formatted", CLOSE)
    parts = F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))
    role = lambda x: F.substring_index(F.substring(x, len(OPEN) + 1, 2_000_000_000), MIDDLE, 1)
    turn = lambda x: F.struct(
        unescape(role(x)).alias("role"),
        unescape(F.substring(x, F.length(role(x)) + (len(OPEN) + len(MIDDLE) + 1), F.lit(2_000_000_000))).alias("text"),
    )
    loss = F.array_join(F.transform("es", lambda e: e["text"]), "")
    return whole.select("conv_id", F.transform(parts, turn).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
