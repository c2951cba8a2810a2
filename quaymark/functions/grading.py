"""Graders of model answers as column functions.

A null text is graded like an empty one; a grade is 1.0 or 0.0 unless said otherwise.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quaymark.functions.text import last_match

# fixed values: what an answer line looks like, by kind of question
LETTER_ANSWER = r"(?i)Answer\s*:\s*\$?([A-{last}])[.\s\n]?"
LINE_ANSWER = r"(?i)Answer\s*:\s*([^\n]+)"
# fixed values: points of a judge's label for the second answer of a round
ARENA_POINTS = {"B>>A": 3, "B>A": 1, "A=B": 0, "B=A": 0, "A>B": -1, "A>>B": -3}
ARENA_LABEL = r"\[\[([AB<>=]+)\]\]"


def letter_pattern(last: str) -> str:
    """The pattern of an answer that is a letter from A to ``last``."""
    return LETTER_ANSWER.replace("{last}", last)


def boxed(text: Column) -> Column:
    r"""What the first \boxed{...} of a text holds, with balanced braces; what follows an unclosed one; empty without one."""
    at = F.instr(text, F.lit("\\boxed{"))
    rest = F.substring(text, at + 7, F.length(text))
    # characters until the brace that closes it: depth and length are folded over the text
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    step = lambda s, c: F.when(s["depth"] == 0, s).otherwise(F.struct((s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"), (s["n"] + 1).alias("n")))
    end = F.aggregate(F.split(rest, ""), start, step)
    inside = F.substring(rest, F.lit(1), end["n"] - F.when(end["depth"] == 0, 1).otherwise(0))
    return F.when(F.coalesce(at, F.lit(0)) == 0, "").otherwise(F.trim(inside))


def normal_answer(text: Column, pattern: str) -> Column:
    r"""The answer in a text: short texts whole, then the pattern's last match, a 'Final Answer' paragraph, what is boxed."""
    t = F.coalesce(text, F.lit(""))
    short = (F.length(t) <= 10) & ~F.contains(t, F.lit("Answer")) & ~F.contains(t, F.lit("box"))
    final = F.nullif(F.trim(F.regexp_extract(t, r"(?i)Final Answer\s*\n+\s*([^\n]+)", 1)), F.lit(""))
    return F.when(short, F.ltrim(t)).otherwise(F.coalesce(F.trim(last_match(t, pattern)), final, boxed(t)))


def exact(got: Column, gold: Column) -> Column:
    return F.coalesce((got == gold).cast("double"), F.lit(0.0))


def grade_choice_text(text: Column, gold: Column, last: str) -> Column:
    """Whether the answer letter of a text is the right one."""
    return exact(F.upper(normal_answer(text, letter_pattern(last))), F.upper(F.trim(gold)))


def math_normal(text: Column) -> Column:
    """One spelling of a short mathematical answer: no white space, text marks, degrees, units of money or percent; fractions with braces."""
    t = F.trim(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, r"^\\text\{(.+?)\}$", "$1")
    t = F.regexp_replace(t, r"\\(?:left|right|!|,|;|:|\s)|\^\{?\\circ\}?|\\?\$|\\?%|\s+", "")
    t = F.regexp_replace(t, r"\\[dt]frac", r"\\frac")
    t = F.regexp_replace(t, r"\\frac([0-9a-z])([0-9a-z])", r"\\frac{$1}{$2}")
    t = F.regexp_replace(t, r"^(-?\d+)/(\d+)$", r"\\frac{$1}{$2}")
    t = F.regexp_replace(t, r"^[a-zA-Z]{1,2}=", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(^|[^\d])\.(\d)", "$1" + "0.$2"), r"(\d),(\d{3})(?!\d)", "$1$2")
    return F.regexp_replace(t, r"\.$", "")


def as_number(normal: Column) -> Column:
    """The value of a normal answer that is a number or a plain fraction."""
    frac = F.try_divide(F.regexp_extract(normal, r"^(-?)\\frac\{(-?\d+)\}\{(\d+)\}$", 2).try_cast("double"), F.regexp_extract(normal, r"^(-?)\\frac\{(-?\d+)\}\{(\d+)\}$", 3).try_cast("double"))
    return F.coalesce(normal.try_cast("double"), F.when(F.startswith(normal, F.lit("-")), -frac).otherwise(frac))


def grade_math(text: Column, gold: Column) -> Column:
    """Equal spelling, or numbers of one value; symbolic equality is not tried."""
    a, b = math_normal(normal_answer(text, LINE_ANSWER)), math_normal(F.when(F.contains(gold, F.lit("\\boxed{")), boxed(gold)).otherwise(gold))
    same = (a != "") & ((a == b) | F.coalesce(F.abs(as_number(a) - as_number(b)) < 1e-9, F.lit(False)))
    return F.coalesce(same.cast("double"), F.lit(0.0))


def rounded_number(text: Column) -> Column:
    """The first number of a text, rounded half to even to a whole one; the text where there is none."""
    first = F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0)
    return F.coalesce(F.bround(F.nullif(first, F.lit("")).cast("double")).cast("string"), text)


def grade_finance(text: Column, gold: Column) -> Column:
    """As grade_math on what is boxed, or first numbers that round to the same whole one."""
    got, want = boxed(F.coalesce(text, F.lit(""))), F.when(F.contains(gold, F.lit("\\boxed{")), boxed(gold)).otherwise(gold)
    a, b = math_normal(got), math_normal(want)
    same = (got != "") & ((a == b) | F.coalesce(F.abs(as_number(a) - as_number(b)) < 1e-9, F.lit(False)))
    return F.coalesce((F.coalesce(same, F.lit(False)) | (rounded_number(got) == rounded_number(want))).cast("double"), F.lit(0.0))


def grid(text: Column) -> Column:
    """The last grid of whole numbers in a text: rows of equal length, at least one; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"\[\s*\[[\d\s,\-]*\](?:\s*,\s*\[[\d\s,\-]*\])*\s*\]"), F.lit(0))
    grids = F.transform(found, lambda g: F.from_json(g, "array<array<int>>"))
    good = F.filter(grids, lambda g: g.isNotNull() & (F.size(g) > 0) & F.forall(g, lambda r: r.isNotNull() & (F.size(r) == F.size(g[0])) & F.forall(r, lambda c: c.isNotNull())))
    return F.try_element_at(good, F.lit(-1))


def grade_grid(text: Column, gold: Column) -> Column:
    return F.coalesce((grid(text) == grid(gold)).cast("double"), F.lit(0.0))


def arena_label(judgment: Column) -> Column:
    """The last label of a judgement such as [[A>>B]]; null without one."""
    return last_match(F.upper(judgment), ARENA_LABEL)


def arena_score(first: Column, second: Column) -> Column:
    """1, 0.5 or 0 by the points of two rounds, in the second of which the answers have changed places; 0 without both labels."""
    points = F.create_map(*[F.lit(x) for pair in ARENA_POINTS.items() for x in pair])
    at = lambda label: F.coalesce(F.try_element_at(points, label), F.lit(0))
    total = at(first) - at(second)
    return F.when(first.isNull() | second.isNull(), 0.0).when(total > 0, 1.0).when(total == 0, 0.5).otherwise(0.0)


def node_text_similarity(a: Column, b: Column) -> Column:
    """Words that two lists of texts have in common over all their words; 0 where a side has under three characters."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.array_join(c, " ")), r"\s+"), lambda w: w != ""))
    enough = (F.length(F.trim(F.array_join(a, " "))) >= 3) & (F.length(F.trim(F.array_join(b, " "))) >= 3)
    return F.when(F.coalesce(enough, F.lit(False)), F.coalesce(F.try_divide(F.size(F.array_intersect(words(a), words(b))).cast("double"), F.nullif(F.size(F.array_union(words(a), words(b))), F.lit(0))), F.lit(0.0))).otherwise(0.0)


def score_onehot(difficulty: Column, reasoning: Column, domain: Column, domains: Sequence[str]) -> Column:
    """[difficulty / 10, reasoning, one column per domain]."""
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return F.array(F.coalesce(difficulty / 10.0, F.lit(0.0)), flag(reasoning), *[flag(domain == d) for d in domains])


def statements(text: Column) -> Column:
    """Sorted 'name: role' of lines such as '(1) Zoey is a knight', for puzzles of knights and knaves."""
    names = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+) is an? (?:knight|knave)"), F.lit(1))
    roles = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+ is an? (knight|knave)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.zip_with(names, roles, lambda n, r: F.concat_ws(": ", n, r))))


def grade_statements(text: Column, gold: Column) -> Column:
    """Whether the conclusion of a text names every person with the right role and no other."""
    said = F.regexp_extract(text, r"(?is)conclusion:?(.*)$", 1)
    got = statements(F.when(said != "", said).otherwise(text))
    return F.coalesce(((F.size(got) > 0) & (got == statements(gold))).cast("double"), F.lit(0.0))


def knobs_hash(alphas: Column, speed_weight: Column, output_cost_ratio: Column, expected_tokens: Column, verbosity: Column) -> Column:
    """The first 64 bits of the sha256 of the knobs in little-endian form, as 16 hexadecimal digits; bytes need Python, by Arrow batches."""

    @F.pandas_udf("string")
    def packed(a: pd.Series, s: pd.Series, r: pd.Series, n: pd.Series, v: pd.Series) -> pd.Series:
        rows = (struct.pack(f"<I{len(x)}ddd", len(x), *x, y, z) + struct.pack("<I?", int(k), bool(b)) for x, y, z, k, b in zip(a, s, r, n, v))
        return pd.Series([hashlib.sha256(x).digest()[:8][::-1].hex() for x in rows])

    return packed(alphas, speed_weight, output_cost_ratio, expected_tokens, verbosity)
