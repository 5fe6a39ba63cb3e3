"""Chat formatting: a finite-state machine over roles, a declarative template, per-segment loss flags.

The machine reads the roles of a conversation; each turn is emitted by the state that it moves the machine to: the
state's marks, and whether its text is under the loss. Moves that the template doesn't list are made too, so that every
turn is emitted, but the conversation is not valid then. Everything is DataFrame functions. One row per conversation
comes out, holding the formatted string, its segments (start and end in code points, loss flag), the last state and
whether the machine accepts the order of turns.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import running, running_sums, text_of

#: Above every state's number.
BROKEN = 1000


@dataclass(frozen=True)
class Mark:
    """What a state emits: what opens and closes a turn, and whether its text is under the loss."""

    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """States with the marks that they emit, and the state machine: (state, role) -> state.

    states: by name, the role that a turn of the state has and its marks. start: the first state, which emits nothing.
    moves: the legal ones. A role in an order that moves doesn't list goes to the state of its role all the same, but
    breaks the order; any other role goes to other, a state whose marks name the role. accepts: states in which a
    conversation whose order is kept may end.
    Every opening mark must be unlike any other mark; none may hold a backslash. A mark starts with '<' or '['
    and holds no second '<' or '[' that starts another mark.
    """

    states: Mapping[str, tuple[str, Mark]] = field(
        default_factory=lambda: {
            "told": ("system", Mark("<<SYS>>", "<</SYS>>")),
            "asked": ("user", Mark("[INST]", "[/INST]")),
            "answered": ("assistant", Mark("<s>", "</s>", loss=True)),
        }
    )
    other: str = "other"
    other_opens: str = "<<ROLE>>"
    other_text: str = "<<TEXT>>"
    other_closes: str = "<</ROLE>>"
    start: str = "start"
    accepts: tuple[str, ...] = ("answered",)
    moves: Mapping[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )

    @property
    def marks(self) -> dict[str, Mark]:
        """Marks by role."""
        return {role: m for role, m in self.states.values()}

    @property
    def controls(self) -> list[str]:
        return [x for m in self.marks.values() for x in (m.opens, m.closes)] + [self.other_opens, self.other_text, self.other_closes]


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in "\\[](){}.*+?^$|/<>" and c not in "<>/" else c for c in s)


def escape(text: Column, t: Template) -> Column:
    """text with each backslash doubled and a backslash put behind the first character of each control string."""
    firsts = "|".join(f"{_quoted(c[0])}(?={_quoted(c[1:])})" for c in t.controls)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({firsts})", "$1\\\\")


def unescape(text: Column) -> Column:
    """Undoes escape: a doubled backslash is one, a single one is nothing."""
    return F.regexp_replace(text, "\\\\(\\\\?)", "$1")


def format_chats(turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as formatted strings with loss segments.

    Returns conv_id, formatted, segments array<struct<start,end,loss,role>> (of texts, in code points of
    formatted, end exclusive), n_turns, valid, end_state ("error" once the order is broken).
    Null role or text: empty. A null conv_id is a conversation of its own. Ties in turn order: by role, then text;
    repeated rows stay repeated; a null turn comes first. An order the state machine doesn't know gives valid =
    false and keeps every turn. Extra columns are not read. An empty table gives no rows. A conversation is one
    output string, so its turns meet in one row.
    """
    t = template or Template()
    src = turns.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), text_of(F.col(role)).alias("role"), text_of(F.col(text)).alias("text")).alias("t"))
    g = src.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    names = [t.start, *t.states, t.other]
    number = {name: i for i, name in enumerate(names)}
    # A state's number; what breaks the order adds BROKEN to it and to all later ones.
    legal = F.create_map(*[F.lit(x) for (s, r), to in t.moves.items() for x in (f"{number[s]} {r}", number[to])])
    by_role = F.create_map(*[F.lit(x) for name, (r, _) in t.states.items() for x in (r, number[name])])

    def move(state: Column, r: Column) -> Column:
        forced = F.coalesce(F.try_element_at(by_role, r), F.lit(number[t.other])) + BROKEN
        return F.when(state >= BROKEN, forced).otherwise(F.coalesce(F.try_element_at(legal, F.concat_ws(" ", state.cast("string"), r)), forced))

    emits = F.array(*[F.struct(F.lit(m.opens).alias("o"), F.lit(m.closes).alias("c"), F.lit(m.loss).alias("loss")) for m in (Mark("", ""), *(m for _, m in t.states.values()), Mark("", t.other_closes))])

    def piece(x: Column, state: Column) -> Column:
        m = F.get(emits, state % BROKEN)
        named = F.concat(F.lit(t.other_opens), escape(x["role"], t), F.lit(t.other_text))
        opens = F.when(state % BROKEN == number[t.other], named).otherwise(m["o"])
        return F.struct(x["role"].alias("role"), opens.alias("o"), escape(x["text"], t).alias("x"), m["c"].alias("c"), m["loss"].alias("loss"))

    g = g.withColumn("states", running(F.transform("ts", lambda x: x["role"]), F.lit(number[t.start]), move, "int"))
    g = g.withColumn("ps", F.zip_with("ts", "states", piece))
    g = g.withColumn("ends", running_sums(F.transform("ps", lambda p: F.length(p["o"]) + F.length(p["x"]) + F.length(p["c"]))))
    last = F.element_at("states", -1)
    return g.select(
        "conv_id",
        F.array_join(F.transform("ps", lambda p: F.concat(p["o"], p["x"], p["c"])), "").alias("formatted"),
        F.zip_with(
            "ps",
            "ends",
            lambda p, e: F.struct((e - F.length(p["c"]) - F.length(p["x"])).alias("start"), (e - F.length(p["c"])).alias("end"), p["loss"].alias("loss"), p["role"].alias("role")),
        ).alias("segments"),
        F.size("ts").cast("long").alias("n_turns"),
        F.when(last >= BROKEN, F.lit("error")).otherwise(F.get(F.array(*[F.lit(x) for x in names]), last)).alias("end_state"),
    ).withColumn("valid", F.col("end_state").isin(*t.accepts))


def parse_chats(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Reads formatted strings back: adds turns array<struct<role,text>>, unescaped."""
    t = template or Template()
    opens = "|".join(_quoted(x) for x in [*(m.opens for m in t.marks.values()), t.other_opens])
    closes = "|".join(_quoted(x) for x in [*(m.closes for m in t.marks.values()), t.other_closes])
    pattern = f"(?s)({opens})(.*?)({closes})"

    def back(whole: Column) -> Column:
        out = None
        for name, m in t.marks.items():
            one = F.struct(F.lit(name).alias("role"), unescape(F.substring(whole, F.lit(len(m.opens) + 1), F.length(whole) - len(m.opens) - len(m.closes))).alias("text"))
            hit = F.startswith(whole, F.lit(m.opens))
            out = F.when(hit, one) if out is None else out.when(hit, one)
        inner = F.substring(whole, F.lit(len(t.other_opens) + 1), F.length(whole) - len(t.other_opens) - len(t.other_closes))
        other = F.struct(unescape(F.substring_index(inner, t.other_text, 1)).alias("role"), unescape(F.substring(inner, F.length(F.substring_index(inner, t.other_text, 1)) + len(t.other_text) + 1, F.length(inner))).alias("text"))
        return other if out is None else out.otherwise(other)

    return formatted.withColumn("turns", F.transform(F.regexp_extract_all("formatted", F.lit(pattern), F.lit(0)), back))


def loss_text(formatted: Column, segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
