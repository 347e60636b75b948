"""Chat formatting with typed content parts.

A visitor flattens the parts of a turn (text, image, audio, document) into one string with ordered
placeholders and records for each attachment its reference, its place and how many tokens the placeholder
expands to.  Turns are framed by control strings; control strings inside texts are escaped reversibly,
so reading the output back gives the turns unchanged and no text can open or close a turn.

Everything is DataFrame and SQL functions; no Python runs on executors.  One shuffle on conv_id brings
the turns of a conversation together, which its one output string needs.

Defined results.  NULL text, role or parts count as empty.  Turns are ordered by turn (NULL first), then
role, then text, so ties and repeated rows have one order and all stay.  NULL conv_id is one conversation
of its own.  An empty table gives no rows; extra columns are ignored; texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import pick

START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Token cost of an attachment: per image and per tile of 512 x 512, per second of audio, per page.
IMAGE_BASE, IMAGE_TILE, TILE, AUDIO_RATE, PAGE_TOKENS = 85, 170, 512, 25, 600


def escaped(text: Column) -> Column:
    """No ``<|`` is left: a backslash doubles, ``<|`` becomes ``<\\|``."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def unescaped_role(role: Column) -> Column:
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def _tiles(side: Column) -> Column:
    return F.ceil(F.coalesce(side, F.lit(TILE)) / TILE)


def part_tokens(part: Column) -> Column:
    """Expanded token count of an attachment part; 0 for text and unknown kinds."""
    image = IMAGE_BASE + IMAGE_TILE * _tiles(part["width"]) * _tiles(part["height"])
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE)
    pages = PAGE_TOKENS * F.coalesce(part["pages"], F.lit(1))
    kind = part["kind"]
    return F.when(kind == "image", image).when(kind == "audio", audio).when(kind == "document", pages).otherwise(0).cast("long")


def flattened(parts: Column) -> Column:
    """The turn's content: escaped texts and numbered placeholders, in the order of the parts."""
    parts = F.coalesce(parts, F.array().cast(PARTS))
    is_media = lambda p: p["kind"].isin("image", "audio", "document")

    def visit(part: Column, i: Column) -> Column:
        number = F.size(F.filter(F.slice(parts, F.lit(1), i + 1), is_media)).cast("string")
        text = escaped(part["text"])
        # a part may go on where the one before ended with "<": a bar that opens it is escaped as well
        text = F.when((i > 0) & text.startswith("|"), F.concat(F.lit("\\"), text)).otherwise(text)
        return F.when(is_media(part), F.concat(F.lit("<|"), part["kind"], F.lit(":"), number, F.lit("|>"))).otherwise(text)

    return F.array_join(F.transform(parts, visit), "", "")


def attachments(parts: Column) -> Column:
    media = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p["kind"].isin("image", "audio", "document"))
    return F.transform(media, lambda p, i: F.struct((i + 1).alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))


def text_parts(messages: DataFrame) -> DataFrame:
    """Plain (conv_id, turn, role, text) rows as rows with one text part."""
    rows = pick(messages, conv_id="conv_id", turn="turn", role="role", text="text")
    null = F.lit(None)
    part = F.struct(
        F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"),
        null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages"),
    )
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_chats(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) rows to one row per conversation.

    conv_id, formatted, loss_spans (start and end in code points of ``formatted``, assistant content only),
    attachments (number in the turn, kind, ref, tokens, turn index), attachment_tokens.
    """
    rows = pick(messages, conv_id="conv_id", turn="turn", role="role", parts="parts").withColumn("role", F.coalesce("role", F.lit("")))
    turns = rows.select(
        "conv_id", "turn", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "", "").alias("said"), flattened(F.col("parts")).alias("body"), attachments(F.col("parts")).alias("media"),
        F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n")).alias("head"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.coalesce("said", F.lit("")), "body")
    placed = turns.select(
        "conv_id", "role", "body", "head", "media", F.row_number().over(order).alias("at"),
        F.sum(F.char_length("head") + F.char_length("body") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"),
    )
    end = F.col("upto") - len(END)
    placed = placed.select(
        "conv_id",
        F.struct(
            "at", F.concat("head", "body", F.lit(END)).alias("piece"), (F.col("role") == LOSS_ROLE).alias("loss"),
            (end - F.char_length("body")).cast("long").alias("start"), end.cast("long").alias("end"), "media",
        ).alias("t"),
    )
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    spans = F.transform(F.filter("ts", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    media = F.flatten(
        F.transform("ts", lambda t: F.transform(t["media"], lambda m: F.struct((t["at"] - 1).alias("turn_index"), m["number"].alias("number"), m["kind"].alias("kind"), m["ref"].alias("ref"), m["tokens"].alias("tokens"))))
    )
    return whole.select(
        "conv_id", F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"), media.alias("attachments"),
        F.aggregate(media, F.lit(0).cast("long"), lambda a, m: a + m["tokens"]).alias("attachment_tokens"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans and ``turns`` (role, text), parsed from ``formatted`` alone.

    Placeholders stay as they are in the text of a turn; only texts were escaped.
    """
    segments = F.split("formatted", r"<\|im_end\|>\n", -1)
    bare = F.transform(F.slice(segments, F.lit(1), F.size(segments) - 1), lambda s: F.substring(s, len(START) + 1, 2147483647))
    turns = F.transform(
        bare,
        lambda s: F.struct(
            unescaped_role(F.substring_index(s, "\n", 1)).alias("role"),
            unescaped(F.substr(s, F.instr(s, "\n") + 1)).alias("text"),
        ),
    )
    return chats.select("conv_id", "formatted", "loss_spans", turns.alias("turns"))


def digests(chats: DataFrame) -> DataFrame:
    """What the contract asks for, from the output read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss_spans", lambda x: unescaped(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))))
    loss = F.array_join(masked, "")
    return read_back(chats).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
