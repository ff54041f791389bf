r"""Chat formatting: turns become text segments with loss flags, by a declarative template, and a state machine checks their order.

Only DataFrame functions. Inside a text, control strings are escaped reversibly, so that no text can end its turn or begin another:
``\`` becomes ``\b``, a ``#`` before ``##`` becomes ``\h`` and the ``<`` of ``</turn>`` becomes ``\l``. In the name of a role that the
template doesn't know, ``:`` becomes ``\c`` besides.

A null text counts as empty, a null role as the empty name, null turns come first; rows of equal turn are ordered by role, then text.
A null conversation id is a conversation of its own. Repeated rows are turns of their own. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is ``head + label + colon + body + tail``; ``learned`` roles' bodies are under the loss mask."""

    head: str = "### "
    colon: str = ": "
    tail: str = "</turn>\n"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    other: str = "role="
    learned: tuple[str, ...] = ("assistant",)


#: (state, role) to the next state; what is missing leads to ``rejected``.
TRANSITIONS = {
    ("start", "system"): "opened",
    ("start", "user"): "asked",
    ("opened", "user"): "asked",
    ("asked", "assistant"): "answered",
    ("answered", "user"): "asked",
}
ACCEPTED = ("answered",)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.regexp_replace(out, r"#(?=##)", r"\\h")
    return F.regexp_replace(out, r"<(?=/turn>)", r"\\l")


def unescape(text: Column) -> Column:
    for code, char in (("\\c", ":"), ("\\h", "#"), ("\\l", "<"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def _label(role: Column, t: Template) -> Column:
    own = F.concat(F.lit(t.other), F.replace(escape(role), F.lit(":"), F.lit("\\c")))
    return F.coalesce(_lookup(t.labels, role), own)


def _role(label: Column, t: Template) -> Column:
    own = unescape(F.substring(label, len(t.other) + 1, 1 << 30))
    return F.coalesce(_lookup({v: k for k, v in t.labels.items()}, label), own)


def formatted(df: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: ``conv_id, n_turns, segments, formatted, valid, final_state, first_bad``.

    ``segments``: array of (text, loss), whose texts in order make up ``formatted``. ``first_bad``: the place (from 0) of the first turn
    that the state machine rejects, null if none. A conversation is valid if no turn is rejected and it ends in an accepted state.
    """
    t = template
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    a = df.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("_turns"))
    steps = {f"{s}\n{r}": n for (s, r), n in TRANSITIONS.items()}

    def step(z: Column, x: Column) -> Column:
        to = F.coalesce(_lookup(steps, F.concat_ws("\n", z["state"], x["role"])), F.lit("rejected"))
        bad = F.when(z["bad"].isNotNull(), z["bad"]).when(to == "rejected", z["at"])
        return F.struct(to.alias("state"), (z["at"] + 1).alias("at"), bad.alias("bad"))

    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    three = lambda x: F.array(
        segment(F.concat(F.lit(t.head), _label(x["role"], t), F.lit(t.colon)), F.lit(False)),
        segment(escape(x["text"]), x["role"].isin(*t.learned)),
        segment(F.lit(t.tail), F.lit(False)),
    )
    a = a.withColumn("segments", F.flatten(F.transform("_turns", three)))
    a = a.withColumn("_end", F.aggregate("_turns", begin, step))
    return a.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        "segments",
        F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"),
        (F.col("_end.bad").isNull() & F.col("_end.state").isin(*ACCEPTED)).alias("valid"),
        F.col("_end.state").alias("final_state"),
        F.col("_end.bad").alias("first_bad"),
    )


def parsed(formatted_text: Column, template: Template = Template()) -> Column:
    """The turns read back from a formatted text: array of (role, text)."""
    t = template
    whole = F.split(formatted_text, r"\Q" + t.tail + r"\E")
    turns = F.slice(whole, 1, F.size(whole) - 1)

    def one(x: Column) -> Column:
        at = F.instr(x, t.colon) if isinstance(t.colon, str) else t.colon
        label = x.substr(F.lit(len(t.head) + 1), at - len(t.head) - 1)
        body = x.substr(at + len(t.colon), F.char_length(x))
        return F.struct(_role(label, t).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, one)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    under = F.filter(segments, lambda x: x["loss"])
    return F.array_join(F.transform(under, lambda x: unescape(x["text"])), "")
