"""Column functions on recognised text: script classes, the Japanese-text test, clean-up and prompts.

Character classes are tried in order: hiragana, katakana, kanji, ASCII letters, punctuation, other. The long mark and
the middle dot stand in the punctuation list too but count as katakana, as their range is tried first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .layout import let

# Code point ranges and marks that results depend on.
HIRAGANA = "\\u3040-\\u309F"
KATAKANA = "\\u30A0-\\u30FF\\u31F0-\\u31FF\\uFF65-\\uFF9F"
KANJI = "\\u4E00-\\u9FFF\\u3400-\\u4DBF"
JP_MARKS = "。、！？「」『』（）・ー〜…"
JOINED = "\\u3040-\\u309F\\u30A0-\\u30FF\\u4E00-\\u9FFF\\u3400-\\u4DBF"
END_TOKENS = ("<|im_end|>", "<|im_end>", "</s>", "<|eot_id|>")
MIN_RATIO, MAX_KATAKANA, MAX_AREA_PER_CHAR = 0.5, 6, 6000


def strip(t: Column) -> Column:
    """Without white space at the ends, in the sense of Unicode."""
    return F.regexp_replace(t, "(?U)^\\s+|\\s+$", "")


def count_of(t: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(t, f"[^{chars}]", ""))


def profile(t: Column) -> Column:
    """Counts of each class."""
    known = f"{HIRAGANA}{KATAKANA}{KANJI}A-Za-z"
    rest = F.regexp_replace(t, f"[{known}]", "")
    # what is no letter or number is punctuation, as are the listed marks
    other = F.length(F.regexp_replace(F.regexp_replace(rest, f"[{JP_MARKS}]", ""), "[^\\p{L}\\p{N}]", ""))
    return F.struct(F.length(t).alias("total"), count_of(t, HIRAGANA).alias("hiragana"), count_of(t, KATAKANA).alias("katakana"), count_of(t, KANJI).alias("kanji"), count_of(t, "A-Za-z").alias("ascii_alpha"), (F.length(rest) - other).alias("punctuation"), other.alias("other"))


def japanese(p: Column) -> Column:
    return p["hiragana"] + p["katakana"] + p["kanji"]


def japanese_ratio(p: Column) -> Column:
    n = p["total"] - p["punctuation"]
    return F.when(n == 0, F.lit(0.0)).otherwise(japanese(p) / n)


def katakana_ratio(p: Column) -> Column:
    return F.when(japanese(p) == 0, F.lit(0.0)).otherwise(p["katakana"] / japanese(p))


def is_repeated(t: Column) -> Column:
    """One character over and over, or two characters over and over; marks and spaces don't count."""

    def test(c):
        n = F.length(c)
        one = F.replace(c, F.left(c, F.lit(1)), F.lit("")) == ""
        two = F.replace(c, F.left(c, F.lit(2)), F.lit("")) == ""
        return F.when(n < 2, F.lit(False)).otherwise(one | ((n >= 4) & (n % 2 == 0) & two))

    return let(F.regexp_replace(F.regexp_replace(t, f"[{JP_MARKS}]", ""), "(?U)\\s", ""), test)


def is_japanese(t: Column, ratio: float = MIN_RATIO, longest: int = MAX_KATAKANA) -> Column:

    def test(s, p):
        plain = (katakana_ratio(p) < 1.0) | (p["katakana"] <= longest) | is_repeated(s)
        return (F.length(s) >= 1) & (japanese(p) > 0) & (japanese_ratio(p) >= ratio) & plain

    return let(strip(t), lambda s: let(profile(s), lambda p: test(s, p)))


def join_spaced(t: Column) -> Column:
    """Without the white space between Japanese characters, then stripped."""
    return strip(F.regexp_replace(t, f"(?U)(?<=[{JOINED}])\\s+(?=[{JOINED}])", ""))


def clean_output(t: Column) -> Column:
    """A model's answer without its prefix and end tokens."""
    s = strip(t)
    s = F.when(F.startswith(s, F.lit("Assistant:")), strip(F.substring(s, 11, 1 << 30))).otherwise(s)
    for token in END_TOKENS:
        s = F.replace(s, F.lit(token), F.lit(""))
    return strip(s)


def prompt(t: Column, language: str) -> Column:
    """The translation prompt; blank text has none (and needs no model)."""
    full = F.concat(F.lit(f"<|im_start|>user\nTranslate the following segment into {language}, without additional explanation.\n\n"), t, F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    return F.when(strip(t) == "", F.lit("")).otherwise(full)


def numbered_prompt(lines: Column) -> Column:
    """Texts as a numbered list."""
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def numbered_reply(reply: Column, n: Column) -> Column:
    """The first n lines of a numbered answer; of each, what follows its first ". ", if there is one. Blank lines count."""
    lines = F.transform(F.split(strip(reply), "\n"), lambda x: F.regexp_replace(x, "^(?s:.*?)\\. ", ""))
    return F.slice(lines, F.lit(1), n)


def drop_sound(area: Column, t: Column) -> Column:
    """A sound effect: few characters on a large area."""
    return area / F.length(t) > MAX_AREA_PER_CHAR
