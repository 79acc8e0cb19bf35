"""Text helpers shared by the token, shrink and detection functions.

Everything here builds Spark columns.  Blank space means what Python's
``str.split``/``str.strip`` mean by it, which is Unicode white space plus the
four separators U+001C..U+001F that Java's ``\\s`` leaves out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inside a character class, together with the (?U) flag.
WS = r"\s\x1c-\x1f"

# The same characters one by one, for translate().
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
) + "\u2028\u2029\u202f\u205f\u3000"

# Code points per block when a long text is cut up for slicing.
BLOCK = 4096


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_div(numerator: Column, divisor: int) -> Column:
    """Exact 64-bit floor division by a positive constant."""
    d = F.lit(divisor).cast("long")
    return F.call_function("div", numerator - F.pmod(numerator, d), d)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Spark does not share sub-expressions across conditional branches, so an
    expensive expression that is mentioned twice would run twice.
    """
    return F.transform(F.array(value), body)[0]


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text; stops at the first ink."""
    return ~F.coalesce(c.rlike(f"(?U)[^{WS}]"), F.lit(False))


def _any_in(c: Column, chars: str) -> Column:
    test = c.contains(chars[0])
    for x in chars[1:]:
        test = test | c.contains(x)
    return test


def word_count(c: Column) -> Column:
    """Words separated by Unicode white space.

    ``translate`` plus a one-character split avoids the regex engine: about nine
    times faster than extracting ``\\S+`` on the test documents.
    """
    spaced = F.translate(c, WS_CHARS, " " * len(WS_CHARS))
    return F.size(F.array_remove(F.split(spaced, " "), ""))


# Letters that match an ASCII letter when case is ignored: long s, the Kelvin
# sign, capital i with a dot, small i without.
ODD_LETTERS = "\u017f\u212a\u0130\u0131"


def fold_case(c: Column) -> Column:
    """Lower case in the sense of a case-insensitive search."""
    plain = F.when(_any_in(c, ODD_LETTERS), F.translate(c, ODD_LETTERS, "skii")).otherwise(c)
    return F.lower(plain)


def text_blocks(c: Column) -> Column:
    """The text as an array of blocks of ``BLOCK`` code points.

    ``substring`` walks from the start of a UTF-8 string; slicing many spans
    out of one long text through its blocks keeps each slice cheap.
    """
    return F.when(F.length(c) <= BLOCK, F.array(c)).otherwise(
        F.regexp_extract_all(c, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    )


def slice_text(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` (inclusive) to ``end`` (exclusive), zero based."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor(F.greatest(end - 1, start) / BLOCK).cast("int")
    joined = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(joined, start - first * BLOCK + 1, end - start)).otherwise("")


def running(values: Column, step: Callable[[Column, Column], Column], zero: Column, kind: str = "int") -> Column:
    """Running values of an associative ``step`` over an array, in time close to its length.

    A fold that appends to its result copies the result at each element.  So
    blocks of about the square root of the length are folded, then the blocks'
    last values, and the latter are added to the former.
    """
    many = f"array<{kind}>"
    state = F.struct(zero.cast(kind).alias("v"), F.array().cast(many).alias("out")).cast(f"struct<v:{kind},out:{many}>")

    def folded(block: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            return let(step(acc["v"], x).cast(kind), lambda v: F.struct(v.alias("v"), F.concat(acc["out"], F.array(v)).alias("out")))

        return F.aggregate(block, state, add, lambda acc: acc["out"])

    def before(acc: Column, block: Column) -> Column:
        total = step(acc["v"], F.element_at(block, -1)).cast(kind)
        return F.struct(total.alias("v"), F.concat(acc["out"], F.array(acc["v"])).alias("out"))

    def cut(held: Column) -> Column:
        n = F.size(held)
        width = F.ceil(F.sqrt(n)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda b: F.slice(held, b * width + 1, width)
        )

    def joined(blocks: Column) -> Column:
        offsets = F.aggregate(blocks, state, before, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, offsets, lambda block, off: F.transform(block, lambda x: step(off, x).cast(kind))))

    whole = let(values, lambda held: let(F.transform(cut(held), folded), joined))
    return F.when(F.size(values) > 0, whole).otherwise(F.array().cast(many))
