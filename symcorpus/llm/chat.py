"""Chat formatting: conversations rebuilt from an event log, rendered with a loss mask, read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Kinds of events that begin a message's text anew; a delta adds to it.
FRESH = ("message", "edit", "regenerate")


def escaped(text: Column) -> Column:
    """Text without control strings: backslashes are doubled and "<|" becomes "<\\|"."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def messages_as_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log in which each row is a whole message."""
    return conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """A log (conv_id, turn, seq, kind, role, text) as final messages (conv_id, place, role, text).

    Within a conversation events are taken by turn, then seq (ties by kind, role and text; a
    null turn or seq comes first). A message event opens a message; deltas add to it, an edit
    or a regeneration replaces what it says so far. A delta, edit or regeneration before any
    message of its turn opens one. Null text and role are empty. A message keeps the role of
    its last fresh event. Rows of a null conv_id are one conversation; repeated rows stay; an
    empty log gives no message; other columns are not read. Only rows of one conversation
    meet, sorted and spillable.
    """
    clean = events.select(
        "conv_id", "turn", "seq",
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "delta", 2).otherwise(1)
    order = Window.partitionBy("conv_id").orderBy("turn", "seq", rank, "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("kind") == "message") | ~F.col("turn").eqNullSafe(F.lag("turn").over(order)) | (F.row_number().over(order) == 1)
    placed = clean.withColumn("at", F.row_number().over(order)).withColumn("opens", opens)
    placed = placed.withColumn("place", F.sum(F.col("opens").cast("int")).over(so_far))
    placed = placed.withColumn("fresh", F.when(F.col("opens") | F.col("kind").isin(*FRESH), F.col("at")))
    last = placed.withColumn("from", F.max("fresh").over(Window.partitionBy("conv_id", "place")))
    said = last.filter(F.col("at") >= F.col("from")).groupBy("conv_id", "place")
    parts = F.sort_array(F.collect_list(F.struct("at", "text")))
    return said.agg(F.min_by("role", "at").alias("role"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one string a conversation, and the spans (start, length) of the loss mask.

    Turns are <|im_start|>role LF text <|im_end|> LF. Control strings inside roles and texts
    are escaped reversibly. Spans count code points and cover each assistant text, escaped; an
    empty one is a span of length 0. Null roles and texts are empty; a table without messages
    gives no conversation; other columns are not read.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    body = escaped(text)
    turn = F.concat(head, body, F.lit(END + "\n"))
    pieces = messages.select("conv_id", "place", (role == "assistant").alias("lost"), F.length(head).alias("skip"), F.length(body).alias("n"), turn.alias("turn"), F.length(turn).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.when(F.col("lost"), F.struct((F.col("at") + F.col("skip")).alias("start"), F.col("n").cast("long").alias("length")))
    rows = pieces.withColumn("at", before).select("conv_id", F.struct("place", "turn", span.alias("span")).alias("x"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("x", lambda x: x["turn"]), "").alias("formatted"),
        F.filter(F.transform("x", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) parsed from the rendered string and its mask.

    turns are (role, text) in order, unescaped. Rendered rows are read one by one: repeated
    rows stay, none gives none, a null string gives nulls; other columns are not read.
    """
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)

    def parse(piece):
        at = F.locate("\n", piece)
        # the piece ends with <|im_end|> and LF
        body = F.substring(piece, at + 1, F.length(piece) - at - len(END) - 1)
        role = F.replace(F.substring(piece, F.lit(1), at - 1), F.lit(LINE), F.lit("\n"))
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    lost = F.transform("loss", lambda s: unescaped(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return rendered.select("conv_id", F.transform(pieces, parse).alias("turns"), F.array_join(lost, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
