"""Column expressions shared by the operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The separators of words, as a class of Java's regular expressions.
BLANKS = "[ \\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row, also where body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text in order; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def run_hashes(words: Column, width: int) -> Column:
    """64-bit hashes of all runs of `width` words; empty where there are fewer words.

    Each word is hashed once. Runs are put together from runs of half their length, so a run of 8 costs three pairs
    a word, not eight words. `words` is used once."""

    def pairs(a: Column, b: Column, shift: int) -> Column:
        """Hashes of runs that begin in a and go on in b, `shift` words later; past the end they mean nothing."""
        return F.zip_with(a, F.slice(b, shift + 1, F.greatest(F.size(b) - shift, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    def grown(part: Column, have: int, out: Column | None, out_width: int) -> Column:
        if width & have:
            out, out_width = (part, have) if out is None else (pairs(out, part, out_width), out_width + have)
        if 2 * have > width:
            return out
        return let(pairs(part, part, have), lambda p: grown(p, 2 * have, out, out_width))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.slice(grown(h, 1, None, 0), 1, F.greatest(F.size(h) - (width - 1), F.lit(0))))
