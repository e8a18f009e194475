"""Chat formatting: conversations are rebuilt from an event log, then rendered.

An event is (conversation, sequence, message, kind, role, text). ``message`` starts a message or
replaces it, as ``edit`` and ``regenerate`` do; ``delta`` appends. The final text of a message is
that of its last replacing event and the deltas after it; its place is that of its first event; its
role is that of its last event with one. Everything is DataFrame code: one exchange by
conversation, two sorted groupings on it.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each message. Inside roles and texts a
backslash becomes two and ``<|`` becomes ``<\\|``, so that no text can open or close a turn; in a
role a line feed is escaped by a backslash as well. A backslash and the character behind it always
mean that character, which makes the way back one replacement.

Defined cases: NULL text is empty, NULL role is empty, NULL sequence comes first, NULL kind is
``message``. Events of a message with the same sequence are ordered by kind (``message``, ``edit``,
``regenerate``, then what appends), role and text, so a delta follows the message it came with; messages with
the same place are ordered by role and text. A kind that is not known appends. A NULL conversation id
is a conversation of its own. An empty log gives an empty table. A conversation comes out as one
row, however long; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Control strings of the template and the event kinds that replace a text.
START, END = "<|im_start|>", "<|im_end|>"
REPLACING = ("message", "edit", "regenerate")
TRAINED_ROLE = "assistant"
STEPS = 4

TURN = r"(?s)<\|im_start\|>((?:[^\n\\]|\\.)*+)\n(.*?)<\|im_end\|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """A table of whole turns as an event log: each row starts one message."""
    return conversations.select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.monotonically_increasing_id().alias("message"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )


def streamed_turns(conversations: DataFrame) -> DataFrame:
    """A table of whole turns as the log of how they may have come about.

    Each turn is a message with a draft, a delta to it, and then the final text as an edit (a regeneration for
    the trained role) and two deltas, cut at code points; the first of them has the sequence
    number of the edit. A turn without a number is one message, as its events would have no order.
    """
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.monotonically_increasing_id().alias("message"),
        "role",
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    text, third = F.col("text"), (F.length("text") / 3).cast("int")
    again = F.when(F.col("role") == TRAINED_ROLE, "regenerate").otherwise("edit")

    def event(step: int, kind: Column, said: Column, role: Column | None = None) -> Column:
        return F.struct(
            (F.col("turn") * STEPS + step).alias("seq"),
            kind.alias("kind"),
            (F.lit(None).cast("string") if role is None else role).alias("role"),
            said.alias("text"),
        )

    whole = F.array(event(0, F.lit("message"), text, F.col("role")))
    log = F.array(
        event(0, F.lit("message"), F.right(text, third), F.col("role")),
        event(1, F.lit("delta"), F.lit(" ...")),
        event(2, again, F.left(text, third)),
        event(2, F.lit("delta"), F.substring(text, third + 1, third)),
        event(3, F.lit("delta"), F.substring(text, 2 * third + 1, F.length("text"))),
    )
    return turns.select("conv_id", "message", F.inline(F.when(F.col("turn").isNull(), whole).otherwise(log)))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text): the final messages of every conversation."""
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    rank = F.array_position(F.array(*map(F.lit, REPLACING)), kind)
    log = events.repartition("conv_id").groupBy("conv_id", "message").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("seq"),
                    F.when(rank > 0, rank).otherwise(len(REPLACING) + 1).alias("rank"),
                    kind.alias("kind"),
                    F.col("role").alias("role"),
                    F.coalesce(F.col("text"), F.lit("")).alias("text"),
                )
            )
        ).alias("log")
    )
    last = F.aggregate(
        F.transform("log", lambda e, i: F.when(e["rank"] <= len(REPLACING), i).otherwise(0)),
        F.lit(0),
        lambda latest, i: F.greatest(latest, i),
    )
    placed = log.withColumn("from", last)
    kept = F.slice("log", F.col("from") + 1, F.size("log"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return placed.select(
        "conv_id",
        F.get("log", F.lit(0))["seq"].alias("seq"),
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """(conv_id, formatted, segments): the rendered string, and its pieces with the loss mask.

    ``segments`` joined is ``formatted``; ``loss`` marks the texts a model is trained on. End marks
    are not trained, so two marked pieces never touch.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    turn = F.struct(
        "seq",
        F.concat(F.lit(START), role, F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == trained_role).alias("loss"),
    )
    grouped = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                piece(t["head"], F.lit(False)),
                piece(t["body"], t["loss"]),
                piece(F.lit(END + "\n"), F.lit(False)),
            ),
        )
    )
    pieces = grouped.select("conv_id", segments.alias("segments"))
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return pieces.select("conv_id", joined.alias("formatted"), "segments")


def format_chats(events: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    return render(fold_events(events), trained_role)


def read_back(formatted: Column) -> Column:
    """The (role, text) pairs that a rendered string holds."""
    whole = F.lit(TURN)
    return F.arrays_zip(
        F.transform(F.regexp_extract_all(formatted, whole, F.lit(1)), unescape).alias("role"),
        F.transform(F.regexp_extract_all(formatted, whole, F.lit(2)), unescape).alias("text"),
    )


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted string and its mask say, as counts and hashes."""
    turns = chats.select("conv_id", "formatted", "segments", read_back(F.col("formatted")).alias("turns"))
    spoken = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    trained = F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""
    )
    read = turns.select(
        "conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"),
        spoken.alias("spoken"), unescape(trained).alias("trained"),
    )
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode("spoken", "UTF-8"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.encode("trained", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
