r"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes its own example: all turns up to it as context, and only its text under
the loss. Turns after the last assistant turn become one more example without loss, so no turn is
lost. A turn is written ``<turn:ROLE>\nTEXT</turn>\n``; in roles and texts ``\`` is written ``\b``,
``<`` as ``\l`` and ``>`` as ``\g``, so markers never occur in them and reading back is exact.

Defined cases: null texts and roles count as empty; null turns come first, equal turns in the order
of role and text; repeated rows are turns of their own; rows of a null conv_id form one conversation; a text of
any length is one turn; other columns are ignored; an empty table gives an empty table. A conversation is one
row by design (each example holds all of its prefix), so it must fit into a task, as must all rows of null
conv_id; output grows with turns squared in one conversation, as prefixes are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What control characters are written as, in the order of escaping.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
OPEN, MIDDLE, CLOSE = "<turn:", ">\n", "</turn>\n"


def escape(c: Column) -> Column:
    for plain, written in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(c: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def expand(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, example, n_context, text, loss_start, loss_end) with offsets in characters of text;
    loss_start = loss_end where nothing is trained."""
    role, body = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.select("conv_id", F.struct("turn", role.alias("role"), body.alias("text")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = F.transform("turns", lambda t: F.struct((t["role"] == trained_role).alias("trained"), F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"), escape(t["text"]).alias("body")))
    turns = turns.select("conv_id", written.alias("turns"))
    n = F.size("turns")
    last = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("turns", i)["trained"] | (i == n))
    examples = turns.select("conv_id", "turns", F.posexplode(last).alias("example", "target"))
    whole = lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))
    context = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("target") - 1), whole), "")
    examples = examples.select("conv_id", "example", (F.col("target") - 1).alias("n_context"), context.alias("context"), F.element_at("turns", F.col("target")).alias("t"))
    start = F.length("context") + F.length("t.head")
    return examples.select("conv_id", "example", "n_context", F.concat("context", whole(F.col("t"))).alias("text"), start.alias("loss_start"), (start + F.when(F.col("t.trained"), F.length("t.body")).otherwise(0)).alias("loss_end"), F.col("t.trained").alias("trained"))


def parse(text: Column) -> Column:
    """The turns of a formatted text, as array<struct<role, text>>."""
    parts = F.filter(F.split(text, CLOSE), lambda p: p != "")
    at = lambda p: F.instr(p, MIDDLE)
    return F.transform(parts, lambda p: F.struct(unescape(F.substr(p, F.lit(len(OPEN) + 1), at(p) - len(OPEN) - 1)).alias("role"), unescape(F.substr(p, at(p) + len(MIDDLE))).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, from the formatted examples alone."""
    loss = unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    found = examples.select("conv_id", "example", "text", loss.alias("loss"))
    found = found.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("full"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"),
    )
    found = found.select("conv_id", parse(F.col("full")).alias("turns"), "loss", "formatted_chars")
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
