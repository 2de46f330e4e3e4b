"""Chat formatting: a finite-state machine over roles and text segments with loss flags.

The template is declared as data: the marks around role and text, the reserved strings, the roles whose text is
learned, and the allowed role after each role. A turn becomes segments (mark, role, mark, text, mark); only the text
segment of a learned role has loss. Reserved strings inside roles and texts are escaped by a backslash after their
first character, one more than there are already, which is undone exactly on reading.

Null texts and null roles count as empty. Turns are ordered by turn, then role, then text, so ties and repeated rows
have a fixed order. Rows with a null conv_id form one conversation with id null. An out-of-order or unknown role is
formatted like any other and flagged: valid_order is false for its conversation, which stays whole. An empty table
gives an empty result; other columns are never read, whatever their names; a text of any length is escaped whole. Turns
are formatted one by one and joined in blocks before the conversation's own group, so
a conversation with a third of all turns is built from many small pieces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    open: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    reserved: tuple[str, ...] = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    learned: tuple[str, ...] = ("assistant",)
    #: role -> roles that may stand before it; "" is the start.
    after: dict = field(default_factory=lambda: {"system": ("",), "user": ("", "system", "assistant"), "assistant": ("user",)}, hash=False)

    def __post_init__(self):
        heads = {m[0] for m in self.reserved}
        if any(h in m[1:] for m in self.reserved for h in heads) or "\\" in "".join(self.reserved):
            raise ValueError("the first character of a reserved string must occur nowhere later in any, and none may hold a backslash")

    def _tails(self) -> dict[str, str]:
        out: dict[str, list[str]] = {}
        for m in self.reserved:
            out.setdefault(m[0], []).append(re.escape(m[1:]))
        return {re.escape(h): "|".join(t) for h, t in out.items()}

    def escape(self, text: Column) -> Column:
        """A backslash more after the first character of each reserved string, escaped or not."""
        pattern = "|".join(rf"(?<={h})(?=\\*+(?:{tails}))" for h, tails in self._tails().items())
        return F.regexp_replace(text, pattern, r"\\")

    def unescape(self, text: Column) -> Column:
        """One backslash less after the first character of each escaped reserved string."""
        pattern = "|".join(rf"(?<={h})\\(?=\\*+(?:{tails}))" for h, tails in self._tails().items())
        return F.regexp_replace(text, pattern, "")


TEMPLATE = Template()


def segments(conversations: DataFrame, template: Template = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, pieces array<struct<text, loss>>, row): one row per turn, in its conversation's order."""
    t = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    pieces = F.array(piece(F.lit(template.open), no), piece(template.escape(F.col("role")), no), piece(F.lit(template.middle), no), piece(template.escape(F.col("text")), F.col("role").isin(*template.learned)), piece(F.lit(template.close), no))
    return t.withColumn("pieces", pieces)


def format_blocks(conversations: DataFrame, template: Template = TEMPLATE, block_turns: int = 64, **columns: str) -> DataFrame:
    """(conv_id, block, n, formatted, loss, ahead, valid): a conversation's text in blocks of consecutive turns.

    loss: (start, end) code points in the block under loss; ahead: code points of the blocks before.
    """
    s = segments(conversations, template, **columns)
    p = F.col("pieces")
    whole = F.concat(*[p[k]["text"] for k in range(5)])
    lead = F.length(p[0]["text"]) + F.length(p[1]["text"]) + F.length(p[2]["text"])
    s = s.select("conv_id", "turn", "role", "text", whole.alias("formatted"), p[3]["loss"].alias("loss"), lead.alias("lead"), F.length(p[3]["text"]).alias("body"))
    block = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / block_turns)
    one = F.struct("turn", "role", "text", "formatted", "loss", "lead", "body")
    blocks = s.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(one)).alias("turns"))

    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("loss"))

    def add(acc: Column, t: Column) -> Column:
        start = acc["at"] + t["lead"]
        mark = F.array(F.struct(start.alias("start"), (start + t["body"]).alias("end")))
        return F.struct((acc["at"] + F.length(t["formatted"])).alias("at"), F.when(t["loss"], F.concat(acc["loss"], mark)).otherwise(acc["loss"]).alias("loss"))

    marks = F.aggregate("turns", empty, add)["loss"]
    blocks = blocks.select("conv_id", "block", F.size("turns").cast("long").alias("n"), F.array_join(F.transform("turns", lambda t: t["formatted"]), "").alias("formatted"), F.transform("turns", lambda t: t["role"]).alias("roles"), marks.alias("loss"))
    # the offset and the role before each block, from the few rows of a conversation
    order = W.partitionBy("conv_id").orderBy("block")
    blocks = blocks.withColumn("ahead", F.coalesce(F.sum(F.length("formatted").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumn("last", F.coalesce(F.lag(F.element_at("roles", -1)).over(order), F.lit("")))

    def step(acc: Column, role: Column) -> Column:
        ok = F.lit(False)
        for name, earlier in template.after.items():
            ok = ok | ((role == name) & acc["role"].isin(*earlier))
        return F.struct(role.alias("role"), (acc["ok"] & ok).alias("ok"))

    valid = F.aggregate("roles", F.struct(F.col("last").alias("role"), F.lit(True).alias("ok")), step)["ok"]
    return blocks.select("conv_id", "block", "n", "formatted", "loss", "ahead", valid.alias("valid"))


def format_chat(conversations: DataFrame, template: Template = TEMPLATE, block_turns: int = 64, **columns: str) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_mask, valid_order): one row per conversation.

    loss_mask: (start, end) code points of the stretches under loss, in order.
    """
    blocks = format_blocks(conversations, template, block_turns, **columns)
    marks = F.transform("loss", lambda m: F.struct((m["start"] + F.col("ahead")).alias("start"), (m["end"] + F.col("ahead")).alias("end")))
    out = blocks.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("block", "formatted", marks.alias("loss")))).alias("parts"), F.min("valid").alias("valid_order"))
    return out.select("conv_id", "n_turns", F.array_join(F.transform("parts", lambda p: p["formatted"]), "").alias("formatted"), F.flatten(F.transform("parts", lambda p: p["loss"])).alias("loss_mask"), "valid_order")


def read_chat(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    turns = F.split(formatted, re.escape(template.close))
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)

    def one(t: Column) -> Column:
        parts = F.split(t, re.escape(template.middle), 2)
        return F.struct(template.unescape(F.substring(parts[0], len(template.open) + 1, (1 << 31) - 1)).alias("role"), template.unescape(parts[1]).alias("text"))

    return F.transform(turns, one)
