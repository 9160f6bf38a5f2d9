"""Chat formatting by grammar round trip, in DataFrame functions only.

A turn reads ``[INST]role`` / text / ``[/INST]``, or ``<s>role`` / text / ``</s>`` for roles whose text is learnt from;
the parts stand on lines of their own. A marker counts unless a backslash precedes it. The parser is deterministic: cut
at opening markers, take the role up to the first line end and the text up to the closing marker of the same kind, drop
one backslash before each escaped marker, and reject text with a bare marker in it.

Every turn is first rendered as it is and parsed back. Where that does not give the turn, its content conflicts with the
template and is escaped: one more backslash before each marker string. The whole conversation is parsed again at the
end; a conversation that does not come back identical raises an error, so none can pass unseen.

Null texts and roles count as empty. Line ends and backslashes in roles are escaped always. Turns go by ``turn``
(nulls first), ties by role and text, so equal rows may swap without effect; repeated rows are turns of their own. A null
conversation id is a conversation of its own. An empty table gives no rows. A conversation's text is one value by
definition, so its turns meet in one row; conversations are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEARNT = ("assistant",)
#: Marker strings of the template and its relatives; fixed values.
MARKERS = r"</?s>|\[/?INST\]|<</?SYS>>"
_BARE = rf"(?<!\\)(?:{MARKERS})"
_OPEN = r"(?<!\\)(?:\[INST\]|<s>)"


def escape(text: Column) -> Column:
    """One more backslash before every marker string."""
    return F.regexp_replace(text, rf"(\\*)({MARKERS})", r"$1\\$2")


def unescape(text: Column) -> Column:
    """One backslash less before every marker string that has one."""
    return F.regexp_replace(text, rf"\\(\\*)({MARKERS})", "$1$2")


def escape_role(role: Column) -> Column:
    return escape(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n"))


def unescape_role(line: Column) -> Column:
    """Undo ``escape_role``: a backslash pair is a backslash, a backslash and n a line end."""
    halves = F.split(unescape(line), r"\\\\", -1)
    return F.array_join(F.transform(halves, lambda x: F.regexp_replace(x, r"\\n", "\n")), "\\")


def render(role: Column, text: Column, learnt: Column) -> Column:
    """A turn with the text as it is given."""
    line = escape_role(role)
    return F.when(learnt, F.concat(F.lit("<s>"), line, F.lit("\n"), text, F.lit("\n</s>\n"))).otherwise(F.concat(F.lit("[INST]"), line, F.lit("\n"), text, F.lit("\n[/INST]\n")))


def parse(formatted: Column) -> Column:
    """Turns (role, text, learnt) of a formatted conversation; a turn that breaks the grammar is null."""
    opened = F.regexp_extract_all(formatted, F.lit(f"({_OPEN})"), F.lit(1))
    pieces = F.split(formatted, _OPEN, -1)

    def turn(piece: Column, mark: Column) -> Column:
        learnt = mark == "<s>"
        close = F.when(learnt, F.lit("\n</s>\n")).otherwise(F.lit("\n[/INST]\n"))
        line_end = F.locate("\n", piece)
        # The text lies between the end of the role's line and the closing marker.
        text = piece.substr(line_end + 1, F.char_length(piece) - line_end - F.char_length(close))
        whole = (line_end > 0) & piece.endswith(close) & (F.char_length(piece) >= line_end + F.char_length(close)) & ~F.coalesce(text.rlike(_BARE), F.lit(False))
        return F.when(whole, F.struct(unescape_role(piece.substr(F.lit(1), line_end - 1)).alias("role"), unescape(text).alias("text"), learnt.alias("learnt")))

    body = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.when(pieces[0] == "", F.zip_with(body, opened, turn))


def format_conversations(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learnt_roles: tuple[str, ...] = LEARNT) -> DataFrame:
    """One row per conversation: its id, ``formatted``, ``parsed`` turns, and ``loss_spans`` (start and length of the
    learnt texts in ``formatted``, in code points from 0)."""
    rows = turns.select(
        F.col(conversation).alias("conversation"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).withColumn("learnt", F.col("role").isin(*learnt_roles))
    source = F.struct("role", "text", "learnt")
    plain = render(F.col("role"), F.col("text"), F.col("learnt"))
    rows = rows.withColumn("same", F.coalesce(parse(plain) == F.array(source), F.lit(False)))
    rows = rows.withColumn("content", F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text"))))
    rows = rows.withColumn("rendered", render(F.col("role"), F.col("content"), F.col("learnt")))
    earlier = Window.partitionBy("conversation").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.char_length("rendered")).over(earlier), F.lit(0)))
    # The opening marker and the role's line precede the text.
    start = F.col("at") + F.char_length("rendered") - F.char_length("content") - F.when(F.col("learnt"), len("\n</s>\n")).otherwise(len("\n[/INST]\n"))
    one = F.struct("at", "turn", "role", "text", "learnt", "rendered", F.struct(start.alias("start"), F.char_length("content").cast("long").alias("length")).alias("span"))
    whole = rows.groupBy("conversation").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["rendered"]), ""))
    whole = whole.withColumn("parsed", parse(F.col("formatted")))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["learnt"].alias("learnt")))
    identical = F.coalesce(F.col("parsed") == source, F.lit(False))
    spans = F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: t["span"])
    return whole.select(
        F.col("conversation").alias(conversation),
        F.when(identical, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip"))).alias("formatted"),
        "parsed",
        spans.alias("loss_spans"),
    )


def digest(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Counts and digests read back from formatted conversations."""
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))
    loss = F.array_join(masked, "")
    return formatted.select(
        conversation,
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
