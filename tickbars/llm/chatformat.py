"""Conversations as one formatted text each, with a loss mask, and back again.

The turns of a conversation are collected as structs and sorted, neighbouring turns of one role
become one block, and blocks are joined to the text; all with Spark expressions.

Templates mark turns with control strings. Where a text holds such a string itself, a backslash goes
behind its first character (``</s>`` becomes ``<\\/s>``); a text that has backslashes in that very place
gets one more, so taking one away gives the text again, whatever it was.

A formatted conversation is one value, so it must fit in a Spark string (2 GB).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARK = "\\"


@dataclass(frozen=True)
class Template:
    """Control strings of a chat format.

    ``roles`` gives the strings around the turns of a role. A role of another name is written out between
    the strings of ``named``. ``joint`` stands between turns that were merged. ``foreign`` holds further
    strings that must not appear inside a text. ``trained`` are the roles whose texts count for the loss.
    """

    roles: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
    )
    named: tuple[str, str, str] = ("[ROLE]", "[SAYS]", "[/ROLE]")
    joint: str = "[AND]"
    foreign: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>")
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        all_ = self.controls
        if len(set(all_)) < len(all_):
            raise ValueError("control strings must differ")
        for a in all_:
            if len(a) < 2 or _MARK in a:
                raise ValueError(f"a control string needs two characters and no backslash: {a!r}")
            for b in all_:
                meet = any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)) + (a != b)))
                if meet or (a != b and a in b):
                    raise ValueError(f"control strings overlap: {a!r}, {b!r}")

    @property
    def controls(self) -> list[str]:
        return [s for pair in self.roles.values() for s in pair] + [*self.named, self.joint, *self.foreign]

    @property
    def closing(self) -> list[str]:
        return [close for _, close in self.roles.values()] + [self.named[2]]

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._places(""), r"$1\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._places(r"\\"), "$1")

    def _places(self, mark: str) -> str:
        """Where a control string's first character stands before backslashes and the rest of it."""
        rests = {}
        for c in self.controls:
            rests.setdefault(c[0], []).append(re.escape(c[1:]))
        begins = "".join(map(re.escape, rests))
        ends = (rf"(?<={re.escape(first)}{mark})(?=\\*(?:{'|'.join(rest)}))" for first, rest in rests.items())
        return f"([{begins}]){mark}(?:{'|'.join(ends)})"

    def before(self, role: Column) -> Column:
        """What stands before a block's first text."""
        return self._by_role(role, 0, F.concat(F.lit(self.named[0]), self.escape(role), F.lit(self.named[1])))

    def after(self, role: Column) -> Column:
        return self._by_role(role, 1, F.lit(self.named[2]))

    def _by_role(self, role: Column, side: int, other: Column) -> Column:
        found = F
        for name, pair in self.roles.items():
            found = found.when(role == name, F.lit(pair[side]))
        return found.otherwise(other)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that lambdas which use them do not compute them again per element."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def running_sums(numbers: Column) -> Column:
    """Sums of an array up to each element. Arrays grow within spans of about the root of the length only."""

    def sums(of: Column, start: Column) -> Column:
        grown = F.aggregate(
            of,
            F.struct(start.alias("sum"), F.array().cast("array<bigint>").alias("all")),
            lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"] + x)).alias("all")),
        )
        return grown["all"]

    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    zero = F.lit(0).cast("bigint")
    span = F.ceil(F.sqrt(F.size(numbers))).cast("int")
    starts = F.sequence(F.lit(1), F.size(numbers), F.greatest(span, F.lit(1)))
    spans = F.transform(starts, lambda s: F.slice(numbers, s, span))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: a + x))
        return F.flatten(F.zip_with(parts, sums(totals, zero), lambda p, upto: sums(p, upto - F.aggregate(p, zero, lambda a, x: a + x))))

    return F.when(F.size(numbers) == 0, F.array().cast("array<bigint>")).otherwise(let(spans, joined))


def format_conversations(
    turns: DataFrame,
    template: Template = Template(),
    *,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: its id, ``formatted``, ``loss``, ``n_blocks``.

    ``loss`` is the loss mask: the spans (``start`` from 0, ``length``, in bytes of UTF-8) of the texts of trained
    roles, without anything of the template. Further columns of ``turns`` do not matter, whatever their names.

    Rows without a conversation form one conversation. A null turn sorts first, ties go by role and text, and
    repeated rows are repeated turns. Null roles and texts count as empty; an empty text is a turn as well.
    """
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    groups = turns.select(F.col(conversation).alias(conversation), one.alias("_turn")).groupBy(conversation)
    sorted_ = _once(groups.agg(F.collect_list("_turn").alias("_rows")), _turns=F.sort_array("_rows")).drop("_rows")

    def at(i: Column) -> Column:
        return F.element_at("_turns", i)

    n = F.size("_turns")
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: F.when(i > 1, at(i)["role"] != at(F.greatest(i - 1, F.lit(1)))["role"]).otherwise(F.lit(True)))
    runs = _once(sorted_, _begins=begins)

    def block(begin: Column, i: Column) -> Column:
        end = F.coalesce(F.try_element_at("_begins", i + 2), n + 1)
        texts = F.transform(F.slice("_turns", begin, end - begin), lambda t: template.escape(t["text"]))
        return F.struct(at(begin)["role"].alias("role"), texts.alias("texts"))

    blocks = _once(runs, _blocks=F.transform("_begins", block)).drop("_turns", "_begins")

    def written(b: Column) -> Column:
        return F.concat(template.before(b["role"]), F.array_join(b["texts"], template.joint), template.after(b["role"]))

    def pieces(b: Column) -> Column:
        """Bytes before, of and after each text of a block."""
        last = F.size(b["texts"]) - 1
        return F.transform(
            b["texts"],
            lambda t, i: F.struct(
                F.octet_length(F.when(i == 0, template.before(b["role"])).otherwise(F.lit(template.joint))).cast("bigint").alias("before"),
                F.octet_length(t).cast("bigint").alias("length"),
                F.when(i == last, F.octet_length(template.after(b["role"]))).otherwise(F.lit(0)).cast("bigint").alias("after"),
                b["role"].isin(*template.trained).alias("trained"),
            ),
        )

    pieced = _once(blocks, _pieces=F.flatten(F.transform("_blocks", pieces)))
    sized = _once(pieced, _sizes=F.transform("_pieces", lambda p: p["before"] + p["length"] + p["after"]))
    summed = _once(sized, _ends=running_sums(F.col("_sizes")))
    spans = F.zip_with(
        "_pieces",
        "_ends",
        lambda p, end: F.when(p["trained"], F.struct((end - p["after"] - p["length"]).alias("start"), p["length"].alias("length"))),
    )
    return summed.select(
        conversation,
        F.array_join(F.transform("_blocks", written), "").alias("formatted"),
        F.array_compact(spans).alias("loss"),
        F.size("_blocks").alias("n_blocks"),
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Add ``turns`` (role and text of every turn, from the formatted text alone) and ``loss_text`` (what the loss
    mask covers, unescaped span by span, nothing between)."""
    last = "".join(re.escape(c[-1]) for c in template.closing)
    written = F.split("formatted", f"(?<=[{last}])(?<=" + "|".join(re.escape(c) for c in template.closing) + ")", -1)
    split = _once(formatted, _written=F.filter(written, lambda b: b != ""))
    begin, says, end = template.named
    other = f"(?s)^{re.escape(begin)}(.*?){re.escape(says)}(.*){re.escape(end)}$"

    def role_and_body(b: Column) -> Column:
        found = F
        for name, (before, after) in template.roles.items():
            inner = F.substring(b, F.lit(len(before) + 1), F.char_length(b) - (len(before) + len(after)))
            found = found.when(F.startswith(b, F.lit(before)), F.struct(F.lit(name).alias("role"), inner.alias("body")))
        named = F.struct(
            template.unescape(F.regexp_extract(b, other, 1)).alias("role"), F.regexp_extract(b, other, 2).alias("body")
        )
        return found.otherwise(named)

    parted = _once(split, _blocks=F.transform("_written", role_and_body)).drop("_written")

    def block_turns(b: Column) -> Column:
        texts = F.split(b["body"], re.escape(template.joint), -1)
        return F.transform(texts, lambda t: F.struct(b["role"].alias("role"), template.unescape(t).alias("text")))

    coded = _once(parted, _bytes=F.encode("formatted", "UTF-8"))
    covered = F.transform(
        "loss",
        lambda s: template.unescape(F.decode(F.substring("_bytes", (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8")),
    )
    return coded.select(
        *formatted.columns,
        F.flatten(F.transform("_blocks", block_turns)).alias("turns"),
        F.array_join(covered, "").alias("loss_text"),
    )
