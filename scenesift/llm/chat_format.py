"""Chat formatting: a declarative template, a state machine over roles, text segments with loss flags."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are written and which order of roles is allowed.

    ``start``, ``end`` and ``gap`` surround a turn: start, role, newline, text, end, gap. ``moves`` lists the allowed
    steps (state, role, next state) from the state ``begin``; state names hold no blank. The texts of ``trained``
    roles are under the loss. ``start`` and ``end`` must begin with ``<|``, which no escaped text holds.
    """

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    gap: str = "\n"
    begin: str = "begin"
    moves: tuple[tuple[str, str, str], ...] = (
        ("begin", "system", "ready"),
        ("begin", "user", "asked"),
        ("ready", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if not (self.start.startswith("<|") and self.end.startswith("<|")):
            raise ValueError("start and end must begin with <|")
        if self.start.startswith(self.end) or self.end.startswith(self.start):
            raise ValueError("neither of start and end may begin with the other")
        if "<" in self.gap:
            raise ValueError("gap must hold no <")


CHAT = ChatTemplate()


def escape(text: Column) -> Column:
    r"""Put one backslash more between ``<`` and ``|`` wherever only backslashes stand between them."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    """Take the backslash of ``escape`` out again."""
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role on one line: newlines and percent signs are written as their percent codes."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def read_back(formatted: Column, template: ChatTemplate = CHAT) -> Column:
    """The (role, text) turns of a formatted conversation."""
    parts = F.split(formatted, re.escape(template.start), -1)
    turns = F.slice(parts, F.lit(2), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substring_index(F.substr(part, F.length(role) + 2), template.end, 1)
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def _walk(turns: Column, template: ChatTemplate) -> Column:
    """(state, step, bad_turn) after the last turn; the machine stops at the first turn that has no move."""
    table = F.create_map(*[F.lit(x) for state, role, after in template.moves for x in (f"{state} {role}", after)])
    first = F.struct(F.lit(template.begin).alias("state"), F.lit(0).alias("step"), F.lit(None).cast("int").alias("bad_turn"))

    def move(at: Column, turn: Column) -> Column:
        after = F.when(at["bad_turn"].isNull(), F.try_element_at(table, F.concat_ws(" ", at["state"], turn["role"])))
        return F.struct(
            F.coalesce(after, at["state"]).alias("state"), (at["step"] + 1).alias("step"),
            F.when(after.isNull(), F.coalesce(at["bad_turn"], at["step"])).alias("bad_turn"))

    return F.aggregate(turns, first, move)


def format_chats(turns: DataFrame, key: str = "sample_id", template: ChatTemplate = CHAT) -> DataFrame:
    """Dialogues about samples as training text with a loss flag for each segment.

    ``turns`` has one row for each turn: ``key``, ``turn`` (its place), ``role`` and ``text``; ``grounding_turns`` makes
    such rows from grounding annotations. Every turn becomes three segments, header, text and footer, as ``template``
    says; only the text of a trained role is under the loss. Texts and roles are escaped, so that no marker of the
    template can come from them, and ``read_back`` returns them unchanged.

    Returns one row for each key: key, n_turns, segments (array of text and loss), formatted (all segments joined),
    valid (every turn had a move), bad_turn (number from 0 of the first turn without one, else null) and state (where
    the machine stopped). Invalid dialogues are formatted all the same. Turns are ordered by ``turn`` (null first),
    ties by role and text; repeated rows are turns of their own. A null role or text counts as empty, a null key is a
    key. Other columns are not read. Empty input gives no rows.

    A dialogue is one row of the output and so bounded by what one text can hold; everything else is spread by key.
    """
    rows = turns.select(F.col(key).alias(key), F.struct(
        F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("_turn"))
    told = rows.groupBy(key).agg(F.sort_array(F.collect_list("_turn")).alias("turns"))

    def segments(turn: Column) -> Column:
        header = F.concat(F.lit(template.start), escape_role(turn["role"]), F.lit("\n"))
        body, footer = escape(turn["text"]), F.lit(template.end + template.gap)
        loss = turn["role"].isin(*template.trained) if template.trained else F.lit(False)
        return F.array(*[F.struct(t.alias("text"), flag.alias("loss")) for t, flag in ((header, F.lit(False)), (body, loss), (footer, F.lit(False)))])

    told = told.withColumn("walk", _walk(F.col("turns"), template)).withColumn("segments", F.flatten(F.transform("turns", segments)))
    return told.select(
        key, F.size("turns").cast("long").alias("n_turns"), "segments", F.array_join(F.col("segments.text"), "").alias("formatted"),
        F.col("walk.bad_turn").isNull().alias("valid"), F.col("walk.bad_turn").alias("bad_turn"), F.col("walk.state").alias("state"))


def grounding_turns(annotations: DataFrame, system: str = "Answer with the 3-D box of the object that the prompt describes.") -> DataFrame:
    """(sample_id, turn, role, text) from grounding annotations (sample_id, prompt, bbox3d).

    The prompt is the user's turn, the box (center, size, yaw) as JSON the assistant's; an annotation without a box
    ends with the user's turn. Repeated sample ids share one dialogue.
    """
    says = F.array(
        F.struct(F.lit(0).alias("turn"), F.lit("system").alias("role"), F.lit(system).alias("text")),
        F.struct(F.lit(1).alias("turn"), F.lit("user").alias("role"), F.col("prompt").alias("text")),
        F.struct(F.lit(2).alias("turn"), F.lit("assistant").alias("role"), F.to_json("bbox3d").alias("text")))
    rows = annotations.select("sample_id", "bbox3d", F.explode(says).alias("said"))
    return rows.filter("said.turn < 2 OR bbox3d IS NOT NULL").select("sample_id", "said.*")
