"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

Events are partitioned by conversation and sorted by sequence. A message is what its events fold to: the
text of the last event that starts it anew (`message`, `edit` or `regenerate`) followed by the streamed
`delta` events after that. `delete` removes it. Messages stand in the order of their first events.

A turn is rendered as `<s>[role]text</s>`. In roles and texts the characters backslash, `<`, `[` and `]`
are written `\\e`, `\\l`, `\\b` and `\\r`, so that no control string can occur inside a text, and reading back
restores every text. The loss mask is a list of spans of the output, one per assistant turn, that hold
its escaped text and nothing else.

Null texts and roles are empty. Rows that repeat a turn are turns of their own, ordered by role, then a
hash of the text; a null turn comes first. A null conv_id is a conversation. One conversation's messages meet in one row, the result's; its
events are folded before, message by message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ANEW = ("message", "edit", "regenerate", "delete")
OPEN, ROLE_END, CLOSE = "<s>[", "]", "</s>"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\r"))
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """One `message` event per row of (conv_id, turn, role, text)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    return conversations.select(
        "conv_id", F.struct("turn", role.alias("role"), F.xxhash64(text).alias("h")).alias("seq"),
        F.monotonically_increasing_id().alias("message"), F.lit("message").alias("kind"),
        role.alias("role"), text.alias("text"))


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, times) of every message of (conv_id, seq, message, kind, role, text)."""
    log = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    per = events.groupBy("conv_id", "message").agg(log.alias("log"))
    start = F.coalesce(F.array_max(F.transform(
        "log", lambda e, k: F.when(e["kind"].isin(*ANEW), k))), F.lit(0))
    per = per.withColumn("start", start)
    tail = F.slice("log", F.col("start") + 1, F.greatest(F.size("log"), F.lit(1)))
    per = per.withColumn("tail", tail).filter(F.col("tail")[0]["kind"] != "delete")
    return per.select(
        "conv_id", F.col("log")[0]["seq"].alias("place"),
        F.coalesce(F.col("tail")[0]["role"], F.lit("")).alias("role"),
        F.array_join(F.transform("tail", lambda e: F.coalesce(e["text"], F.lit(""))), "")
        .alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_mask: for each learned turn its number from 0, the place where its
    piece begins, and start and length of its text; places in code points from 1."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(ROLE_END))
    turns = messages.select("conv_id", "place", (F.col("role") == LEARNED).alias("learned"),
                            F.length(head).alias("lead"),
                            F.concat(head, escaped(F.col("text"))).alias("piece"))
    so_far = Window.partitionBy("conv_id").orderBy("place")
    size = F.length("piece") + len(CLOSE)
    turns = turns.withColumns({
        "turn": F.row_number().over(so_far) - 1,
        "begin": F.sum(size).over(so_far.rowsBetween(Window.unboundedPreceding, 0)) - size + 1})
    per = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", "begin", "learned", "lead", "piece"))).alias("turns"))
    mask = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(
        t["turn"].alias("turn"), t["begin"].alias("begin"), (t["begin"] + t["lead"]).alias("start"),
        (F.length(t["piece"]) - t["lead"]).alias("length")))
    text = F.concat(F.array_join(F.col("turns")["piece"], CLOSE), F.lit(CLOSE))
    return per.select("conv_id", text.alias("formatted"), mask.alias("loss_mask"))


def read_back(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and loss_texts, from formatted and loss_mask alone."""
    pieces = F.split("formatted", F.lit(CLOSE), -1)
    cut = rows.select("conv_id", "formatted", "loss_mask",
                      F.slice(pieces, 1, F.size(pieces) - 1).alias("pieces"))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ROLE_END, 1)
        return F.struct(
            unescaped(F.substring(head, F.lit(len(OPEN) + 1), F.length(head))).alias("role"),
            unescaped(F.substring(piece, F.length(head) + 2, F.length(piece))).alias("text"))

    def masked(m: Column) -> Column:
        start = (m["start"] - m["begin"] + 1).cast("int")
        return unescaped(F.substring(F.col("pieces")[m["turn"]], start, m["length"]))

    return cut.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"),
                      F.transform("loss_mask", masked).alias("loss_texts"))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_mask of every conversation."""
    return rendered(folded(turns_as_events(conversations)))


def digest(conversations: DataFrame) -> DataFrame:
    """What reading the output back gives, per conversation."""
    back = read_back(formatted(conversations))
    said = F.array_join(F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
