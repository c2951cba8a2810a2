"""Graders and table functions under names, for SQL and for benchmarks that are told by name."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quaymark.functions import grading as G

Grader = Callable[[Column, Column], Column]


def _letter(last: str) -> Grader:
    return partial(_letters, last=last)


def _letters(text: Column, gold: Column, last: str) -> Column:
    return G.grade_choice_text(text, gold, last)


GRADERS: dict[str, Grader] = {
    "mmlupro": _letter("J"), "gpqa": _letter("D"), "medqa": _letter("D"), "arcc": _letter("D"), "winogrande": _letter("B"), "meld": _letter("G"), "emorynlp": _letter("G"), "dailydialog": _letter("G"),
    "brainteaser": _letter("D"), "truthfulqa": _letter("J"), "aime": G.grade_math, "math500": G.grade_math, "finqa": G.grade_finance, "arc_agi": G.grade_grid, "k_and_k": G.grade_statements,
}


def grade(name: str, text: Column, gold: Column) -> Column:
    """The grade of a text by a benchmark's rule; an unknown name stops."""
    if name.lower() not in GRADERS:
        raise KeyError(f"no grader {name}; there are {', '.join(sorted(GRADERS))}")
    return GRADERS[name.lower()](text, gold)


def grade_by_name(name: Column, text: Column, gold: Column) -> Column:
    """The grade by the rule that a column names; null for a name without one."""
    out = F.when(F.lit(False), F.lit(0.0))
    for key, fn in GRADERS.items():
        out = out.when(F.lower(name) == key, fn(text, gold))
    return out


@F.udtf(returnType="place int, event string, data string")
class ServerEvents:
    """The events of a server-sent stream: place, name, data; data lines of one event are joined."""

    def eval(self, body: str) -> Iterator[tuple[int, str, str]]:
        place = 0
        for block in re.split(r"\r?\n\r?\n", body or ""):
            lines = block.splitlines()
            data = [x[5:].removeprefix(" ") for x in lines if x.startswith("data:")]
            if data:
                name = next((x[6:].strip() for x in lines if x.startswith("event:")), "message")
                yield place, name, "\n".join(data)
                place += 1


@F.udtf(returnType="i int, variant string")
class Variants:
    """Surface changes of a text that should not change its treatment."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate((f"  {text}\n", text.lower(), text.upper(), f"{text}?", f"Please: {text}"))


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL as server_events and text_variants."""
    spark.udtf.register("server_events", ServerEvents)
    spark.udtf.register("text_variants", Variants)
