"""Text functions that give what JavaScript's string functions give, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the language's regular expressions call white space, and the token-dividing characters.
# Single characters of Latin-1 are one table lookup in Java's classes, and \p{Z} is one more for all other spaces.
SPACE = r"\x09\x0A\x0B\x0C\x0D\x20\xA0\x{FEFF}\p{Z}"
DIVIDERS = SPACE + r".,;:!?(){}\[\]<>'\"/\\|`~@#$%^&*+=\-"

_SPACE_RE = re.compile("[\x09-\x0d\x20\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
_PLAIN_WORD = re.compile(r"[\w'\-]+\Z")
#: A word's edge, where only ASCII letters, digits and _ are of a word.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def utf16_length(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def words_of(question: str) -> list[str]:
    """The question's words in lower case, those of more than two UTF-16 units, in order and with repetitions."""
    return [w for w in _SPACE_RE.split(question.lower()) if utf16_length(w) > 2]


def question_words(question: Column) -> Column:
    """``words_of`` as a Column."""
    units = lambda w: F.length(F.encode(w, "UTF-16BE")) / 2
    return F.filter(F.split(F.lower(question), f"[{SPACE}]+", -1), lambda w: units(w) > 2)


class BadWord(ValueError):
    """A word of a question that is no regular expression."""


def checked_word(word: str) -> str:
    """``word`` as a Java regular expression with the meaning it has in JavaScript.

    Words count as expressions, as they come. Those that JavaScript rejects (nothing to repeat, open groups) and those
    that only Java knows (possessive quantifiers, inline flags, quoting, class operators) raise ``BadWord``.
    """
    if _PLAIN_WORD.match(word):
        return word
    if re.search(r"[*+?}]\+|\(\?[^:=!<]|\\[QEGAZzhHRX]|&&|\[[^\]]*\[", word):
        raise BadWord(f"not a regular expression: {word!r}")
    try:
        re.compile(word)
    except re.error as e:
        raise BadWord(f"not a regular expression: {word!r} ({e})") from None
    # lone brackets are literals in JavaScript and errors in Java
    return re.sub(r"(?<!\\)\{(?!\d+(?:,\d*)?\})", r"\\{", word)


def match_count(text: Column, word: str) -> Column:
    """Matches of ``word`` in ``text`` that don't overlap."""
    return F.regexp_count(text, F.lit(checked_word(word)))


def whole_word_count(text: Column, word: str) -> Column:
    """Matches of ``word`` between ASCII word edges.

    A plain word comes first in the expression and its edges are looked at behind it, so most places fail at once.
    """
    if _PLAIN_WORD.match(word):
        inside = "[A-Za-z0-9_]"
        own = lambda c: c.isascii() and (c.isalnum() or c == "_")
        before = "(?<!" if own(word[0]) else "(?<="
        after = "(?!" if own(word[-1]) else "(?="
        return F.regexp_count(text, F.lit(f"{word}{before}{inside}{word}){after}{inside})"))
    return F.regexp_count(text, F.lit(f"{EDGE}(?:{checked_word(word)}){EDGE}"))


def token_count(text: Column) -> Column:
    """Runs of characters that are neither white space nor dividers; null: none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{DIVIDERS}]+")), F.lit(0)).cast("long")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def rounded(x: Column) -> Column:
    """To the nearest integer, halves upwards."""
    return F.floor(x + F.lit(0.5))


def one_decimal(x: Column) -> Column:
    """``x`` of 1 or more with one decimal, rounded by its exact binary value, halves upwards.

    A double of 1 or more is a multiple of 2 ** -52, so its fraction times 2 ** 52 is an integer.
    """
    whole = F.floor(x)
    tenths = F.shiftright(((x - whole) * float(1 << 52)).cast("long") * 10 + (1 << 51), 52)
    return F.concat((whole + F.when(tenths > 9, 1).otherwise(0)).cast("string"), F.lit("."), F.when(tenths > 9, 0).otherwise(tenths).cast("string"))


def utf8_text(data: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(data.cast("string"))


def reduction_percent(before: Column, after: Column) -> Column:
    """By how many percent ``after`` is below ``before``; 0 for nothing."""
    return F.when(before > 0, (before - after) / before * 100).otherwise(F.lit(0.0))
