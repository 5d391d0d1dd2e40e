"""Scalar text expressions, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


# every character Python's str.strip() removes
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shannon_entropy(text: Column) -> Column:
    """Shannon entropy (log2) over the characters of ``text``; 0 for ''.

    Uses H = log2(n) - sum(c * log2 c) / n over the distinct characters, so each
    character is counted with one replace instead of a growing count map.
    """

    def body(s: Column) -> Column:
        n = F.length(s).cast("double")
        weighted = F.aggregate(
            F.array_distinct(F.split(s, "")),
            F.lit(0.0),
            lambda acc, ch: acc + let(
                (F.length(s) - F.length(F.replace(s, ch, F.lit("")))).cast("double"),
                lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0)),
            ),
        )
        return F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n) - weighted / n)).otherwise(F.lit(0.0))

    return let(F.coalesce(text, F.lit("")), body)


def py_round(value: Column, digits: int) -> Column:
    """Round half even on the exact binary value, like Python's ``round(x, digits)``.

    Spark's own rounding goes through the shortest decimal text, which turns
    2.675 (a binary value below the tie) into 2.68. The value is split into a high
    and a low part so that both products with the power of ten are exact.
    """
    scale = float(10 ** digits)
    cut = float(2 ** 20)

    def body(x: Column) -> Column:
        a = F.abs(x)
        high = F.floor(a * cut).cast("double") / cut
        q = F.floor(high * scale).cast("double")
        rest = (high * scale - q - 0.5) + (a - high) * scale
        up = (rest > 0) | ((rest == 0) & (q % 2 == 1))
        whole = q + F.when(up, 1.0).otherwise(0.0)
        return F.signum(x) * whole / scale

    return let(value.cast("double"), body)


def round_int(value: Column) -> Column:
    """Round half even to an int (Python's one-argument ``round``)."""
    return F.rint(value).cast("int")


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def strip(text: Column) -> Column:
    """Trim all leading and trailing white space."""
    return F.trim(text, F.lit(WHITE_SPACE))


def count_of(text: Column, needle: str) -> Column:
    """Number of occurrences of a one-character ASCII needle (byte lengths are free to read)."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(needle), F.lit("")))


def count_text(text: Column, needle: str) -> Column:
    """Number of non-overlapping occurrences of a fixed text."""
    rest = F.octet_length(F.replace(text, F.lit(needle), F.lit("")))
    return ((F.octet_length(text) - rest) / F.lit(len(needle.encode()))).cast("int")


def count_chars(text: Column, chars: str) -> Column:
    """Number of characters of ``text`` that belong to the ASCII set ``chars``."""
    return F.octet_length(text) - F.octet_length(F.translate(text, chars, ""))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True when one of a fixed list of words occurs in ``text``."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def count_contained(text: Column, words: Sequence[str]) -> Column:
    """How many words of a fixed list occur in ``text``."""
    total = F.lit(0)
    for word in words:
        total = total + text.contains(word).cast("int")
    return total


def non_empty_parts(text: Column, separator: str) -> Column:
    return F.filter(F.split(text, separator), lambda p: p != "")


def anchors(pattern: str) -> list[str]:
    """Leading literal of every alternative of a pattern.

    No alternative can match a text that lacks its literal, so a few plain substring
    searches decide whether the regular expression has to run at all. Most texts hit
    none of them, and a substring search is far cheaper than an alternation that is
    tried at every position.
    """
    body = pattern
    if body.startswith(r"\b(") and body.endswith(r")\b"):
        body = body[3:-3]
    branches, depth, current, i = [], 0, "", 0
    while i < len(body):
        step = 2 if body[i] == "\\" else 1
        piece = body[i:i + step]
        depth += (piece in "([") - (piece in ")]") if step == 1 else 0
        if piece == "|" and depth == 0:
            branches.append(current)
            current = ""
        else:
            current += piece
        i += step
    branches.append(current)
    return list(dict.fromkeys(_leading_literal(b) for b in branches))


def _leading_literal(branch: str) -> str:
    out, i = "", 0
    while i < len(branch):
        if branch[i] == "\\":
            if branch[i + 1].isalnum():
                break
            out, i = out + branch[i + 1], i + 2
        elif branch[i] in "?*{":
            return out[:-1]  # the quantifier makes the character before it optional
        elif branch[i] in "([.+|^$":
            break
        else:
            out, i = out + branch[i], i + 1
    return out


def matches(text: Column, pattern: str) -> Column:
    """``rlike`` behind a check for the pattern's literals (text already lower-cased)."""
    return F.when(contains_any(text, anchors(pattern)), text.rlike("(?U)" + pattern)).otherwise(F.lit(False))


def pattern_hits(text: Column, pattern: str) -> Column:
    """Number of non-overlapping matches, with Unicode word boundaries (lower-cased text)."""
    return F.when(
        contains_any(text, anchors(pattern)), F.regexp_count(text, F.lit("(?U)" + pattern))
    ).otherwise(F.lit(0))


def digit_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Nd}"))


def uppercase_ratio(text: Column) -> Column:
    """Upper-case letters over letters; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    upper = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))
    return F.when(letters > 0, upper.cast("double") / letters).otherwise(F.lit(0.0))


def all_caps_tokens(text: Column) -> Column:
    """ASCII words of three or more letters that are entirely upper case."""
    return F.regexp_count(text, F.lit("[A-Z](?<![A-Za-z].)[A-Z]{2,}(?![A-Za-z])"))


def rank_of(value: Column, ordered: Sequence[str]) -> Column:
    """Position of ``value`` in an ordered list of names, 0 when unknown."""
    return F.greatest(
        F.array_position(F.array(*[F.lit(v) for v in ordered]), value).cast("int") - 1, F.lit(0)
    )


def lookup(value: Column, table: dict, default=None) -> Column:
    """Constant map lookup; ``default`` when the key is unknown."""
    expr = None
    for key, result in table.items():
        expr = F.when(value == key, F.lit(result)) if expr is None else expr.when(value == key, F.lit(result))
    return expr if default is None else expr.otherwise(F.lit(default))


def string_array(values: Sequence[str]) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])
