"""Chat formatting in budgeted, turn-aligned windows; DataFrame operations only.

Template, one turn: `<s>[INST]` role `[/INST]` text `</s>`. In roles and texts every backslash is doubled, and a control
string (<s> </s> [INST] [/INST] <<SYS>> <</SYS>>) gets a backslash after its first character, so no control string stays
in them; taking each backslash away and keeping the character after it undoes both.

Prefix sums of turn tokens choose the spans: a conversation is cut before a turn with which the tokens since the last cut
would exceed what a window has for new turns. Windows after the first begin with the conversation's system turn (its first
turn, if that is one) and with the last turns before the cut that fit the history budget; these repeated turns are never
under the loss mask, so each assistant text is a target exactly once. A turn is never cut: one that is longer than the
budget has a window of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
#: Tokens that the template adds to a turn.
TURN_TOKENS = 6


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"(<(?=/?s>)|<(?=</?SYS>>)|\[(?=/?INST\]))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def windows(conversations: DataFrame, budget: int = 1024, history: int = 128) -> DataFrame:
    """conv_id, window (from 0), formatted, repeated (turns at its start that earlier windows have too), tokens, mask
    (start and end of the target texts in formatted, in code points).

    Turns are taken by (turn, role, text), repeated rows as turns of their own; a null turn comes first, a null role or
    text counts as empty, and each row whose conv_id is null is a conversation of its own. An empty table gives an empty
    result; other columns are not looked at. Turns of one conversation are gathered, as its text is one output; nothing
    else is."""
    empty = F.lit("")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = rows.withColumn("tokens", (F.regexp_count("text", F.lit(TOKEN)) + TURN_TOKENS).cast("bigint"))
    rows = rows.withColumn("head", F.concat(F.lit("<s>[INST]"), escape(F.col("role")), F.lit("[/INST]"))).withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("size", (F.length("head") + F.length("body") + 4).cast("bigint"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    named = rows.where("conv_id is not null").withColumns({"upto": F.sum("tokens").over(order), "chars": F.sum("size").over(order), "at": F.count(F.lit(1)).over(order).cast("int")})
    turn = F.struct("at", "upto", "tokens", "chars", "size", "role", "head", "body")
    alone = rows.where("conv_id is null").withColumns({"upto": F.col("tokens"), "chars": F.col("size"), "at": F.lit(1)})
    conv = named.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t")).unionByName(alone.select("conv_id", F.array(turn).alias("t")))
    system = F.when(F.get("t", F.lit(0))["role"] == "system", F.lit(1)).otherwise(0)
    conv = conv.withColumn("sys", system).withColumn("sys_tokens", F.when(F.col("sys") == 1, F.get("t", F.lit(0))["tokens"]).otherwise(0))
    later = F.greatest(F.lit(1), budget - history - F.col("sys_tokens")).cast("bigint")

    def step(s: Column, x: Column) -> Column:
        cut = (x["upto"] - s["base"] > s["room"]) & (x["at"] > s["from"])
        return F.when(cut, F.struct((x["upto"] - x["tokens"]).alias("base"), later.alias("room"), x["at"].alias("from"), F.concat(s["cuts"], F.array(x["at"])).alias("cuts"))).otherwise(s)

    start = F.struct(F.lit(0).cast("bigint").alias("base"), F.lit(budget).cast("bigint").alias("room"), F.lit(1).alias("from"), F.array(F.lit(1)).alias("cuts"))
    conv = conv.withColumn("cuts", F.aggregate("t", start, step, lambda s: s["cuts"]))
    cut = conv.select("conv_id", "t", "sys", "cuts", F.posexplode("cuts").alias("window", "from"))
    upto = F.coalesce(F.get("cuts", F.col("window") + 1), F.size("t") + 1)
    new = F.slice("t", F.col("from"), upto - F.col("from"))
    # every turn has TURN_TOKENS at least, which bounds how far back the history can reach
    back = F.greatest(F.col("sys") + 1, F.col("from") - history // TURN_TOKENS)
    before = F.get("t", F.col("from") - 2)["upto"]
    old = F.filter(F.slice("t", back, F.greatest(F.lit(0), F.col("from") - back)), lambda x: before - x["upto"] + x["tokens"] <= history)
    first = F.when(F.col("window") > 0, F.slice("t", F.lit(1), F.col("sys"))).otherwise(F.slice("t", F.lit(1), F.lit(0)))
    parts = cut.select("conv_id", "window", F.concat(first, F.when(F.col("window") > 0, old).otherwise(F.slice("t", F.lit(1), F.lit(0)))).alias("a"), new.alias("c"))

    def total(turns: str, what: str) -> Column:
        return F.aggregate(turns, F.lit(0).cast("bigint"), lambda s, x: s + x[what])

    # where a new turn stands follows from the characters of all turns up to it
    opening = F.get("c", F.lit(0))
    shift = total("a", "size") - opening["chars"] + opening["size"]
    mask = F.transform(F.filter("c", lambda x: x["role"] == "assistant"), lambda x: F.struct((shift + x["chars"] - x["size"] + F.length(x["head"])).cast("int").alias("start"), (shift + x["chars"] - 4).cast("int").alias("end")))
    text = F.array_join(F.transform(F.concat("a", "c"), lambda x: F.concat(x["head"], x["body"], F.lit("</s>"))), "")
    return parts.select("conv_id", "window", text.alias("formatted"), F.size("a").alias("repeated"), (total("a", "tokens") + total("c", "tokens")).alias("tokens"), mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From windows(): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows. Each turn counts
    where it is new; the text under the masks is taken from the formatted text and unescaped. Windows whose conv_id is null
    are conversations of their own; an empty table gives an empty result."""
    pieces = F.slice(F.split("formatted", "</s>", -1), F.col("repeated") + 1, F.size(F.split("formatted", "</s>", -1)) - 1 - F.col("repeated"))
    # the closing tag of the header is the first one: escaped strings hold none
    turns = F.transform(pieces, lambda p: F.concat(unescape(F.substring_index(F.substring(p, 10, 1 << 30), "[/INST]", 1)), F.lit("\n"), unescape(F.substring(p, F.instr(p, "[/INST]") + 7, F.lit(1 << 30))), F.lit("\n")))
    loss = F.transform("mask", lambda m: unescape(F.substring("formatted", m["start"] + 1, m["end"] - m["start"])))
    rows = formatted.select("conv_id", "window", F.size(pieces).cast("bigint").alias("k"), F.array_join(turns, "").alias("turns"), F.array_join(loss, "").alias("loss"), F.length("formatted").cast("bigint").alias("chars"))
    part = F.struct("window", "turns", "loss")
    named = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sum("k").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"), F.sort_array(F.collect_list(part)).alias("w"))
    alone = rows.where("conv_id is null").select("conv_id", F.col("k").alias("n_turns"), F.col("chars").alias("formatted_chars"), F.lit(1).cast("bigint").alias("n_windows"), F.array(part).alias("w"))
    turns_all, loss_all = (F.array_join(F.col("w").getField(c), "") for c in ("turns", "loss"))
    out = named.unionByName(alone)
    return out.select("conv_id", "n_turns", F.sha2(turns_all, 256).alias("turns_sha256"), F.length(loss_all).cast("long").alias("loss_chars"), F.sha2(loss_all, 256).alias("loss_sha256"), "formatted_chars", "n_windows")
