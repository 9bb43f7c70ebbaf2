"""Chat formatting by a finite-state machine over roles, in DataFrame functions only.

A declarative template gives the marks around a turn, the roles whose text counts
for the loss and the role that may follow which. A conversation's turns, in order,
run through the machine; the first turn without a transition makes the conversation
invalid. The output is one string and, for each of its segments, its text and loss
flag: a turn is three segments, the opening mark with the role, the text, and the
closing mark.

Escapes keep texts from holding marks, are made from the template's marks and are
reversible: between the two characters that open a turn (``<`` and ``|`` by default) one
backslash more than there are is put; in roles ``%``, the first of these characters and the
first one of what follows a role are written as percent signs and hexadecimal digits
(%25, %3C and %0A by default). Templates for which this would not hold are refused.

How Spark runs it: one aggregation of turns to conversations; all else is per row,
on the JVM. A conversation is a unit of the output and is held whole, as a document.

Defined cases: null text and null role are empty strings; turns with equal numbers
are ordered by role and text, and null numbers come first; repeated rows are turns
of their own; rows with a null conv_id form one conversation; an empty table gives
no rows; other columns are ignored; unknown roles, and conversations that do not
follow the machine, are formatted all the same, with valid = false.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    open_turn: str = "<|im_start|>"
    after_role: str = "\n"
    close_turn: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    train_close: bool = False
    #: Roles that may follow a role; '' stands for the start.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        a, b = self.open_turn[:1], self.open_turn[1:2]
        if not b or a == b or "\\" in (a, b) or "%" in (a, self.after_role[:1]):
            raise ValueError("open_turn must begin with two different characters, neither of which is a backslash, nor the first a percent sign")
        if not self.after_role or not self.close_turn or self.close_turn[0] in (b, "\\") or self.open_turn in self.after_role:
            raise ValueError("after_role and close_turn must not be empty, hold open_turn, or end one that a text begins")
        if any(self.open_turn.startswith(self.after_role[i:]) for i in range(len(self.after_role))):
            raise ValueError("after_role must not end with what open_turn begins with, as a text could go on with the rest")
        if (self.close_turn + self.open_turn).index(self.open_turn) < len(self.close_turn):
            raise ValueError("open_turn must not begin within close_turn where a turn follows")
        if any(x in "0123456789ABCDEF" for x in (a, self.after_role[0])):
            raise ValueError("open_turn and after_role must not begin with a sign of the escapes in roles")


def quoted(x: str) -> str:
    """A pattern for the characters of x as they are."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in x)


def escape_text(text: Column, template: Template) -> Column:
    a, b = template.open_turn[:2]
    return F.regexp_replace(text, rf"({quoted(a)})(\\*)({quoted(b)})", r"$1$2\\$3")


def unescape_text(text: Column, template: Template) -> Column:
    a, b = template.open_turn[:2]
    return F.regexp_replace(text, rf"({quoted(a)})(\\*)\\({quoted(b)})", "$1$2$3")


def role_signs(template: Template) -> list[str]:
    return list(dict.fromkeys(["%", template.after_role[0], template.open_turn[0]]))


def percent_sign(sign: str) -> str:
    return "".join(f"%{byte:02X}" for byte in sign.encode())


def escape_role(role: Column, template: Template) -> Column:
    for sign in role_signs(template):
        role = F.replace(role, F.lit(sign), F.lit(percent_sign(sign)))
    return role


def unescape_role(role: Column, template: Template) -> Column:
    for sign in reversed(role_signs(template)):
        role = F.replace(role, F.lit(percent_sign(sign)), F.lit(sign))
    return role


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, formatted, segments (array of text, loss), valid, first_bad_turn (place from 0, -1 if none), complete."""
    t = template or Template()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    allowed = F.create_map(*(x for a, bs in t.follows.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))))
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))

    def step(s: Column, x: Column) -> Column:
        fine = F.coalesce(F.array_contains(F.try_element_at(allowed, s["state"]), x["role"]), F.lit(False))
        bad = F.when((s["bad"] < 0) & ~fine, s["at"]).otherwise(s["bad"])
        return F.struct(x["role"].alias("state"), (s["at"] + 1).alias("at"), bad.alias("bad"))

    def segments(x: Column) -> Column:
        loss = x["role"].isin(*t.loss_roles) if t.loss_roles else F.lit(False)
        part = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(
            part(F.concat(F.lit(t.open_turn), escape_role(x["role"], t), F.lit(t.after_role)), F.lit(False)),
            part(escape_text(x["text"], t), loss),
            part(F.lit(t.close_turn), loss & F.lit(t.train_close)),
        )

    ran = whole.select("conv_id", F.aggregate("turns", start, step).alias("end"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return ran.select(
        "conv_id", F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"), "segments",
        (F.col("end.bad") < 0).alias("valid"), F.col("end.bad").alias("first_bad_turn"), F.col("end.state").isin(*t.ends).alias("complete"),
    )


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """Turns (array of role, text) of a formatted string. Texts hold no marks, so that splitting at these is exact."""
    t = template or Template()
    parts = F.slice(F.split(formatted, F.lit(quoted(t.open_turn))), 2, 1 << 30)

    def one(x: Column) -> Column:
        role_end = F.locate(t.after_role, x)
        text = x.substr(role_end + len(t.after_role), F.length(x) - role_end - (len(t.after_role) - 1) - len(t.close_turn))
        return F.struct(unescape_role(x.substr(F.lit(1), role_end - 1), t).alias("role"), unescape_text(text, t).alias("text"))

    return F.transform(parts, one)


def digest_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Figures read back from the formatted output and its segments."""
    done = format_conversations(turns, template)
    read = done.withColumn("turns", read_turns(F.col("formatted"), template))
    all_turns = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    learned = F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape_text(s["text"], template or Template())))
    read = read.withColumn("learned", learned)
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "first_bad_turn", "complete",
    )
