"""Text functions as Column expressions: CJK spacing, radical variants, trimming, line joining, tokens."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the ranges that count as CJK, inside a regex class
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
#: Unicode white space, inside a regex class.
SPACE = r"\p{Z}\t-\r\x1c-\x1f"
#: Letters and digits outside the CJK ranges; astral letters are taken in UTF-16 halves elsewhere and are none.
_LETTER_DIGIT = rf"[\p{{L}}\p{{Nd}}&&[^{CJK}]&&[\x{{0}}-\x{{FFFF}}]]"

# fixed values: simplified radicals of the supplement block and the characters they stand for
_RADICALS = "⻋⻓⻔⻅⻉⻙⻚⻛⻜⻢⻥⻦⻧⻨⻩⻬⻮⻰⻳"
_CHARACTERS = "车长门见贝韦页风飞马鱼鸟卤麦黄齐齿龙龟"
_KANGXI = [chr(c) for c in range(0x2F00, 0x2FE0) if unicodedata.normalize("NFKC", chr(c)) != chr(c)]


def trim_space(text: Column) -> Column:
    """Takes Unicode white space off both ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return trim_space(text) == ""


def fix_radicals(text: Column) -> Column:
    """Radical code points become the characters they look like; nothing else is normalised."""
    folded = "".join(unicodedata.normalize("NFKC", c) for c in _KANGXI)
    return F.translate(text, "".join(_KANGXI) + _RADICALS, folded + _CHARACTERS)


def cjk_spacing(text: Column) -> Column:
    """No space between CJK characters, one between CJK and letters or digits, runs of white space become one."""
    t = F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " "))
    tight = F.regexp_replace(t, rf"(?<=[{CJK}]) (?=[{CJK}])", "")
    spaced = F.regexp_replace(tight, rf"(?<=[{CJK}])(?={_LETTER_DIGIT})|(?<={_LETTER_DIGIT})(?=[{CJK}])", " ")
    # most texts of other scripts are done after the first step
    return F.when(text.rlike(f"[{CJK}]"), spaced).otherwise(t)


def join_lines(texts: Column) -> Column:
    """An array of lines as one text: a space between two, unless either side of the seam is CJK; empty lines add nothing.

    Each seam is told from the last character before it and the first after it, and all parts are joined at once.
    """
    lines = F.filter(texts, lambda x: x != "")
    before = F.concat(F.array(F.lit("")), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))))

    def with_seam(line: Column, last: Column) -> Column:
        ends = F.concat(F.substring(last, -1, 1), F.substring(line, 1, 1))
        return F.when((last == "") | ends.rlike(f"[{CJK}]"), line).otherwise(F.concat(F.lit(" "), line))

    return F.array_join(F.zip_with(lines, before, with_seam), "")


def tokens(text: Column) -> Column:
    """CJK characters one by one (U+3000 is one), runs of white space, runs of anything else."""
    return F.regexp_extract_all(text, F.lit(rf"[{CJK}]|[{SPACE}&&[^{CJK}]]+|[^{CJK}{SPACE}]+"), 0)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def indent_label(title: Column, depth: Column) -> Column:
    """A title after one ideographic space per level."""
    return F.concat(F.repeat(F.lit("　"), depth), title)


# fixed values: what counts as a line of noise
URL_LINE = r"^https?://\S+$"
DATE_LINE = r"^\d{4}/\d{1,2}/\d{1,2}\s+\d{1,2}:\d{2}(:\d{2})?$"
URL_COUNTER_LINE = r"^https?://\S+\s+\d+/\d+$"
COUNTER_LINE = r"^\d+/\d+$"
