"""Chat formatting in budgeted windows, in DataFrame operations only.

Prefix sums of turn tokens (a window function) choose spans of whole turns: a window takes turns while the system turn,
repeated history and new turns stay within the budget; a single turn over the budget makes its own window. Each later
window repeats the system turn and, within history limits, the turns just before its first new one. The loss mask covers
assistant texts that are new in the window, so each is a target once.

Template: `<|role|>text<|end|>` and a line feed for each turn. In roles and texts a backslash doubles, `<|` becomes
`<\\|` and `|>` becomes `|\\>`; any backslash and the character after it read back as that character, so it is reversible.

Turns come by (turn, role, text), null turns first; null roles and texts are empty; rows of a null conv_id are one
conversation. A conversation is the unit of output and is put together in one row. An empty table gives no rows.

Tokens are counted by a rule (TOKEN): up to four letters in a row, a digit, or a symbol. No vocabulary is needed, texts
without spaces count by their length, and the rule can be replaced by any column of token counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a window, turns and tokens of repeated history, tokens of the template around a turn.
BUDGET, HISTORY_TURNS, HISTORY_TOKENS, TURN_TOKENS = 1024, 2, 256, 4
TOKEN = r"\p{L}{1,4}|\p{N}|[^\s\p{L}\p{N}]"
OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def token_count(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def conversation_turns(conversations: DataFrame, tokens: Column | None = None) -> DataFrame:
    """conv_id, t: the turns in order, each with its tokens (the text's and the template's) and the tokens up to its end."""
    text = F.coalesce("text", F.lit(""))
    own = token_count(text) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))
    sized = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), (own + TURN_TOKENS).alias("n"))
    up_to = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    summed = sized.withColumn("p", F.sum("n").over(up_to)).withColumn("i", F.count("*").over(up_to))
    turns = F.array_sort(F.collect_list(F.struct("i", "role", "text", "n", "p")))
    return summed.groupBy("conv_id").agg(turns.alias("t"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, tokens: Column | None = None) -> DataFrame:
    """conv_id, window, n_repeated (turns at the window's start that an earlier window has), formatted, mask.

    mask: (start, end) in code points of `formatted`, the assistant texts to be learnt. tokens: a column of the input's
    that has each turn's token count, instead of the rule's.
    """
    whole = conversation_turns(conversations, tokens).withColumn("s0", F.when(F.expr("t[0].role = 'system'"), 1).otherwise(0)).withColumn("n", F.size("t"))
    room = F.lit(budget) - F.when(F.col("s0") == 1, F.expr("t[0].n")).otherwise(0)
    turn = lambda i: F.get("t", i)
    before = lambda i: turn(i)["p"] - turn(i)["n"]

    def history_start(i: Column) -> Column:
        fits = lambda j: (before(i) - before(j) <= history_tokens) & (turn(i)["p"] - before(j) <= F.col("room"))
        return F.coalesce(F.get(F.filter(F.sequence(F.greatest(F.col("s0"), i - history), i), fits), 0), i)

    def step(done: Column, i: Column) -> Column:
        full = turn(i)["p"] - done["base"] > F.col("room")
        own = F.struct(history_start(i).alias("h"), i.alias("s"))
        return F.struct(F.when(full, F.concat(done["cuts"], F.array(own))).otherwise(done["cuts"]).alias("cuts"), F.when(full, before(own["h"])).otherwise(done["base"]).alias("base"))

    first = F.struct(F.array(F.struct(F.col("s0").alias("h"), F.col("s0").alias("s"))).alias("cuts"), F.coalesce(before(F.col("s0")), F.lit(0).cast("long")).alias("base"))
    body = F.when(F.col("n") > F.col("s0") + 1, F.sequence(F.col("s0") + 1, F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    cut = whole.withColumn("room", room).withColumn("cuts", F.aggregate(body, first, step, lambda done: done["cuts"]))
    spans = F.transform("cuts", lambda c, k: F.struct(k.alias("window"), c["h"].alias("h"), c["s"].alias("s"), F.coalesce(F.get(F.col("cuts"), k + 1)["s"], F.col("n")).alias("e")))
    rows = cut.select("conv_id", "t", "s0", F.explode(spans).alias("w")).select("conv_id", "t", "s0", "w.*")

    head = F.when(F.col("s0") == 1, F.slice("t", 1, 1)).otherwise(F.slice("t", 1, 0))
    turns = F.concat(head, F.slice("t", F.col("h") + 1, F.col("e") - F.col("h")))
    repeated = F.when(F.col("window") == 0, 0).otherwise(F.col("s0") + F.col("s") - F.col("h"))
    marked = lambda x: F.concat(F.lit(OPEN), escape(x["role"]), F.lit(CLOSE))
    parts = F.transform(turns, lambda x, k: F.struct(marked(x).alias("mark"), escape(x["text"]).alias("body"), ((x["role"] == "assistant") & (k >= F.col("n_repeated"))).alias("loss")))
    rows = rows.withColumn("n_repeated", repeated).withColumn("parts", parts)

    def place(done: Column, x: Column) -> Column:
        start = done["at"] + F.char_length(x["mark"])
        end = start + F.char_length(x["body"])
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(x["loss"], F.concat(done["mask"], own)).otherwise(done["mask"]).alias("mask"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
    formatted = F.array_join(F.transform("parts", lambda x: F.concat(x["mark"], x["body"], F.lit(END))), "")
    return rows.select("conv_id", "window", "n_repeated", formatted.alias("formatted"), F.aggregate("parts", nothing, place, lambda done: done["mask"]).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """windows() rows -> conv_id, window, turns (role, text; those new in the window), learnt (the masked texts, joined), chars."""
    cut = F.split("formatted", r"<\|end\|>\n", -1)
    own = F.slice(cut, F.col("n_repeated") + 1, F.size(cut) - 1 - F.col("n_repeated"))

    def parsed(x: Column) -> Column:
        inner = F.substr(x, F.lit(3))
        at = F.locate(CLOSE, inner)
        return F.struct(unescape(F.substr(inner, F.lit(1), at - 1)).alias("role"), unescape(F.substr(inner, at + 2)).alias("text"))

    learnt = F.array_join(F.transform("mask", lambda m: unescape(F.substr(F.col("formatted"), m["start"] + 1, m["end"] - m["start"]))), "")
    return formatted.select("conv_id", "window", F.transform(own, parsed).alias("turns"), learnt.alias("learnt"), F.char_length("formatted").cast("long").alias("chars"))


def chat_report(conversations: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Per conversation, all read back from the formatted windows: counts and digests of its turns and of what is learnt."""
    parts = F.array_sort(F.collect_list(F.struct("window", "turns", "learnt")))
    whole = read_back(windows(conversations, budget)).groupBy("conv_id").agg(parts.alias("parts"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    turns = F.flatten(F.col("parts.turns"))
    said = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learnt = F.array_join("parts.learnt", "")
    return whole.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars", "n_windows")
