"""Chat formatting in DataFrame functions: a finite-state machine over roles and segments with loss flags.

A ``Template`` declares the control strings, the roles that carry loss and the allowed role transitions. Every
conversation becomes one row with its segments in order: header, text, footer for each turn, each with a loss flag.
Control strings inside texts and roles are escaped, and ``read_turns`` / ``loss_texts`` undo that exactly.

Defined results: turns are ordered by turn, then role, then text; repeated rows stay; a null text or role counts as
empty, a null turn comes first; conversations whose roles break the machine are kept and marked ``valid = false``.
A conversation with a null id is one conversation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "^"


@dataclass(frozen=True)
class Template:
    """Declarative chat template. ``moves`` maps a state (last role, or ``^``) to the roles that may follow."""

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>"
    role_end: str = "\n"
    turn_end: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    final_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant",),
        }
    )

    def __post_init__(self):
        if not (self.opening.startswith("<|") and self.closing.startswith("<|")):
            raise ValueError("control strings start with '<|', which escaping keeps out of texts")
        if self.role_end != "\n":
            raise ValueError("a role ends at a line end, which escaping keeps out of roles")


def escape(text: Column) -> Column:
    """Backslashes double and ``<|`` becomes ``<\\|``: no control string can stand in the result."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """One pass over the role's three escapes: split off ``\\\\`` first, so ``\\n`` after it stays text."""
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n"))), "\\")


def format_chat(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    template: Template = Template(),
) -> DataFrame:
    """One row per conversation: id, ``n_turns``, ``valid``, ``segments`` (array of text and loss flag).

    Partial aggregation gathers turns before the one exchange; a row holds one conversation, as its output must.
    """
    said = F.struct(
        F.col(f"`{turn}`").alias("at"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    gathered = turns.groupBy(F.col(f"`{conv_id}`").alias(conv_id)).agg(F.sort_array(F.collect_list(said)).alias("_t"))
    moves = F.create_map(*_moves(template))
    last = F.element_at(F.col("_t"), -1)["role"]

    def allowed(one: Column, i: Column) -> Column:
        state = F.when(i == 0, F.lit(START)).otherwise(F.get(F.col("_t"), i - 1)["role"])
        return F.coalesce(F.array_contains(F.element_at(moves, state), one["role"]), F.lit(False))

    def segments(one: Column) -> Column:
        seg = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
        return F.array(
            seg(F.concat(F.lit(template.opening), escape_role(one["role"]), F.lit(template.role_end)), F.lit(False)),
            seg(escape(one["text"]), one["role"].isin(*template.loss_roles)),
            seg(F.lit(template.closing + template.turn_end), F.lit(False)),
        )

    right = F.forall(F.transform(F.col("_t"), allowed), lambda ok: ok) & last.isin(*template.final_roles)
    return gathered.select(
        F.col(f"`{conv_id}`"),
        F.size("_t").cast("long").alias("n_turns"),
        right.alias("valid"),
        F.flatten(F.transform(F.col("_t"), segments)).alias("segments"),
    )


def _moves(template: Template) -> list[Column]:
    return [c for state, to in template.moves.items() for c in (F.lit(state), F.array(*[F.lit(r) for r in to]))]


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column, template: Template = Template()) -> Column:
    """Turns (role, text) parsed back from a formatted conversation, unescaped."""
    quote = lambda s: r"\Q" + s + r"\E"
    parts = F.filter(F.split(text, quote(template.closing + template.turn_end), -1), lambda p: p != "")
    bodies = F.transform(parts, lambda p: F.substr(p, F.lit(len(template.opening) + 1)))

    def parse(body: Column) -> Column:
        cut = F.instr(body, template.role_end)
        return F.struct(
            unescape_role(F.substr(body, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substr(body, cut + len(template.role_end))).alias("text"),
        )

    return F.transform(bodies, parse)


def loss_texts(segments: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"]))
