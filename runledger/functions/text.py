"""Text functions: bracketed number lists, parsing of generated text, input decks."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger.functions.derive import COMMAND

# ---- fixed values ---------------------------------------------------------------------------
UNSIGNED_TOKEN = r"([\d.]+)"
SIGNED_TOKEN = r"(-?\d+\.?\d*)"
LOOSE_SIGNED_TOKEN = r"([-\d.]+)"
EXPONENT_TOKEN = r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"
FLOAT_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
FIELD_WORDS = ["pos", "time", "speed", "b1", "b2", "initial", "final", "power", "bank"]
# ---------------------------------------------------------------------------------------------


def fixed(x: Column, decimals: int) -> Column:
    """Fixed decimals, ties to even on the exact binary value (like C printf), no thousands commas."""
    return F.regexp_replace(F.format_number(x.cast("double"), decimals), ",", "")


def plain_number(x: Column) -> Column:
    """Shortest decimal text of a double without an exponent for 1e-4 <= |x| < 1e16."""
    size = F.abs(x)
    short = x.cast("string")
    trimmed = F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1")
    spelled = F.regexp_replace(trimmed, r"\.$", ".0")
    needs_spelling = (size > 0) & (size < 1e16) & (size >= 1e-4) & ((size < 1e-3) | (size >= 1e7))
    return F.when(needs_spelling, spelled).otherwise(short)


def to_number_list(cols: list[Column], decimals: list[int] | None = None) -> Column:
    """"[a, b, ...]"; integers as is, doubles in shortest form or with the given fixed decimals."""
    parts = [fixed(c, d) for c, d in zip(cols, decimals)] if decimals else cols
    return F.concat(F.lit("["), *_joined(parts), F.lit("]"))


def _joined(parts: list[Column]) -> list[Column]:
    out: list[Column] = []
    for i, part in enumerate(parts):
        out += [F.lit(", "), part] if i else [part]
    return out


def prompt(cols: list[Column], decimals: list[int] | None = None) -> Column:
    """Open list to be completed: "[a, b,"."""
    parts = [fixed(c, d) for c, d in zip(cols, decimals)] if decimals else cols
    return F.concat(F.lit("["), *_joined(parts), F.lit(","))


def prompt_part(text: Column, k: int) -> Column:
    """The first k comma fields with a closing comma: the part that carries no loss."""
    return F.concat(F.substring_index(text, ",", k), F.lit(","))


def completion_part(text: Column, k: int) -> Column:
    return F.substring(text, F.length(prompt_part(text, k)) + 1, F.length(text))


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once per row however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_float(token: Column) -> Column:
    """Strict decimal text to double, white space around it aside; anything else is null, "nan" and "inf" too: they are no command."""
    t = F.regexp_replace(token, r"^\s+|\s+$", "")
    return F.when(t.rlike(FLOAT_TEXT), t.try_cast("double"))


def _all_numbers(values: Column) -> Column:
    return let(values, lambda v: F.when(~F.exists(v, lambda x: x.isNull()), v))


def _last_six(tokens: Column, min_count: int) -> Column:
    return let(tokens, lambda t: F.when(
        F.size(t) >= min_count, _all_numbers(F.transform(F.slice(t, -6, 6), to_float))))


def as_command(values: Column) -> Column:
    """Array of six doubles to a command struct; null stays null."""
    return let(values, lambda v: F.when(
        v.isNotNull(), F.struct(*[F.get(v, F.lit(i)).alias(p) for i, p in enumerate(COMMAND)])))


def parse_last6(text: Column, min_count: int = 8) -> Column:
    """Last six of the unsigned number tokens; null if too few or if any of them is not a number."""
    return _last_six(F.regexp_extract_all(text, F.lit(UNSIGNED_TOKEN), 1), min_count)


def parse_signed_last6(text: Column, min_count: int = 8) -> Column:
    return _last_six(F.regexp_extract_all(text, F.lit(SIGNED_TOKEN), 1), min_count)


def parse_bracket6(text: Column) -> Column:
    """Six numbers between the last "[" and the first "]" after it."""
    tail = F.element_at(F.split(text, r"\["), -1)
    body = F.split(F.get(F.split(tail, r"\]"), F.lit(0)), ",")
    return let(body, lambda b: F.when(F.size(b) == 6, _all_numbers(F.transform(b, to_float))))


def _pair(first: Column, second: Column, signed: bool = True) -> Column:
    numbers = F.struct(to_float(first).alias("reactivity"), to_float(second).alias("duration"))
    if signed:
        return let(numbers, lambda n: F.when((n["reactivity"] < 0) & (n["duration"] > 0), n))
    return let(numbers, lambda n: F.when(n["reactivity"].isNotNull() & n["duration"].isNotNull(), n))


def parse_pair_signed(text: Column) -> Column:
    """(reactivity < 0, duration > 0): third and fourth number, else the last two, else null."""
    def pick(t: Column) -> Column:
        n = F.size(t)
        third = F.when(n >= 4, _pair(F.get(t, F.lit(2)), F.get(t, F.lit(3))))
        return F.coalesce(third, F.when(n >= 2, _pair(F.get(t, n - 2), F.get(t, n - 1))))

    return let(F.regexp_extract_all(text, F.lit(EXPONENT_TOKEN), 1), pick)


def parse_pair_loose(text: Column) -> Column:
    """Third and fourth token of the looser pattern, without a sign check."""
    return let(F.regexp_extract_all(text, F.lit(LOOSE_SIGNED_TOKEN), 1), lambda t: F.when(
        F.size(t) >= 4, _pair(F.get(t, F.lit(2)), F.get(t, F.lit(3)), signed=False)))


def format_problem(text: Column, min_numbers: int = 6) -> Column:
    """First rule the text breaks, or null when the format is valid."""
    lower = F.lower(text)
    expr = F.when(F.size(F.regexp_extract_all(text, F.lit(UNSIGNED_TOKEN), 1)) < min_numbers, "too few numbers")
    expr = expr.when(~F.contains(text, F.lit("[")), "no bracket")
    for word in FIELD_WORDS:
        expr = expr.when(F.contains(lower, F.lit(word)), f"field name: {word}")
    return expr


def render_deck(template: str, values: dict[str, Column]) -> Column:
    """Fill the {name} slots of an input deck; an unknown slot is an error when the plan is built."""
    pieces = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if slot is not None:
            if slot not in values:
                raise KeyError(slot)
            pieces.append(values[slot].cast("string"))
    return F.concat(*pieces)


def run_name(prefix: str, number: Column, width: int) -> Column:
    """Prefix and zero-padded number; a longer number keeps all its digits."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")))
