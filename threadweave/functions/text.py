"""Text functions as column expressions: tokens, patterns, counts, redaction."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points of the letters that make up words, as first-last (or one).
_RANGES = """
40-5a 61-7a a3 a9 b0-b2 b5 bd c0-d6 d8-f6 f8-ff 101-103 105-107 10c-10f 111 119-11b 11e-11f 123 129 12b 12d 130-131
139 13d-13e 141-142 144 147-148 14c-14d 151-153 155 158-159 15b 15e-161 163-165 169 16b 16e-16f 171 17b-17e 180-1bf
1c4-24f 25f 268 282 301 361 37b-37d 386 388-38a 38c 38e-3a1 3a3-3ce 3d0-482 488-527 5d0-5ea 621-624 626-628 62a-63a
641-648 64a-64b 64e-651 654 67e 686 698 6a9 6af 6cc 1e02-1e03 1e0a-1e0b 1e0f 1e1e-1e1f 1e25 1e40-1e41 1e56-1e57
1e60-1e61 1e6a-1e6b 1e80-1e85 1e92 1e9b 1ea3 1ebf 1ec5 1ecb 1ed1 1ed9 1edd 1edf 1ee7 1ef1-1ef3 1f00-1f15 1f18-1f1d
1f20-1f45 1f48-1f4d 1f50-1f57 1f59 1f5b 1f5d 1f5f-1f7d 1f80-1fb4 1fb6-1fc4 1fc6-1fd3 1fd6-1fdb 1fdd-1fef 1ff2-1ff4
1ff6-1ffe 200c 2020 2082 30aa 30c9 30ea 30fc 4e0a 4e2d 4e59 4e95 4ecb 4f0e 5247 53f7 56db 5b89 5f81 614e 697d 706b
7384 7bad 7c89 80e1 85e9 898f a640-a697 a69f
"""


def letter_class(ranges: str = _RANGES) -> str:
    """The word letters as the inside of a character class, for Java and RE2."""
    ends = (r.split("-") for r in ranges.split())
    return "".join(rf"\x{{{e[0]}}}-\x{{{e[-1]}}}" if len(e) > 1 else rf"\x{{{e[0]}}}" for e in ends)


LETTERS = letter_class()
WORD_PATTERN = f"[0-9{LETTERS}'-]+|[^0-9{LETTERS}'-]"
#: The same for Java's engine, which tries the parts of a large class one by one: ASCII is decided first, so only other characters are looked up there.
_ASCII_MARK = r"[\x00-\x26\x28-\x2c\x2e\x2f\x3a-\x3f\x5b-\x60\x7b-\x7f]"
_FAST = r"(?s)%s|(?:[0-9@A-Za-z'-]++|(?![\x00-\x7f])[%s])++|."


def _word_pattern(letters: str | None) -> str:
    return _FAST % (_ASCII_MARK, LETTERS) if letters is None else f"[0-9{letters}'-]+|[^0-9{letters}'-]"

HASHTAG = r"(?U)\B#[a-zA-Z]+\b"
URL = r"\b(?:file|ftp|https?)://[A-Za-z0-9+&@#/%?=~_|!:,.;-]+[A-Za-z0-9+&@#/%=~_|-]"
#: Platform to (pattern, group of the name for redaction; None: only the author is redacted).
MENTIONS = {
    "Twitter": (r"(?U)(^|[^\w@])@(\w{1,15})\b", 2),
    "Reddit": (r"(?U)(^|\W)/?u/([0-9A-Z_a-z-]+)\b", 2),
    "4chan": (r">>(\d+)", None),
}
_PICTURE = (
    r"\x{1F300}-\x{1FAFF}\x{1F004}\x{1F0CF}\x{1F170}-\x{1F19A}\x{1F201}-\x{1F251}\x{2600}-\x{27BF}\x{231A}\x{231B}\x{2328}\x{23CF}"
    r"\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2934}\x{2935}\x{2B05}-\x{2B07}"
    r"\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}"
)
_ONE = rf"[{_PICTURE}][\x{{1F3FB}}-\x{{1F3FF}}]?\x{{FE0F}}?"
EMOJI = rf"[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|[0-9#*]\x{{FE0F}}?\x{{20E3}}|{_ONE}(?:\x{{200D}}{_ONE})*"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, whole (or one group of each)."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def partition_tokens(text: Column, space: bool = True, charset: str | None = None) -> Column:
    """Runs of word letters, digits, apostrophes and hyphens; every other character by itself.

    ``charset`` replaces the word letters (the inside of a character class, '' for none);
    ``space=False`` leaves spaces out. Case is kept.
    """
    found = matches(text, _word_pattern(charset))
    return found if space else F.filter(found, lambda t: t != " ")


def default_tokens(text: Column) -> Column:
    """Split at white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def treebank_tokens(text: Column) -> Column:
    """Words, contractions' endings and single marks, an approximation of Treebank tokens."""
    return matches(text, r"(?U)\w+(?=n't\b)|n't\b|'(?:s|re|ve|ll|d|m)\b|\w+(?:[-.]\w+)*|\.\.\.|``|''|--|[^\s\w]")


def custom_tokens(function: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A tokenizer from a Python function of one text, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else list(function(t)))

    return run


TOKENIZERS = {"default": default_tokens, "NLTK": treebank_tokens, "partitioner": partition_tokens}


def tokenizer(key: str | Callable) -> Callable[[Column], Column]:
    """A tokenizer by name, or from a function of a text. Unknown names raise KeyError, other kinds ValueError."""
    if isinstance(key, str):
        return TOKENIZERS[key]
    if callable(key):
        return custom_tokens(key)
    raise ValueError(f"neither a tokenizer's name nor a function: {key!r}")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def hashtags(text: Column) -> Column:
    return matches(text, HASHTAG)


def urls(text: Column) -> Column:
    return matches(text, URL)


def emojis(text: Column) -> Column:
    """Emoji sequences in order, with repeats."""
    return matches(text, EMOJI)


def mentions(text: Column, platform: Column) -> Column:
    """Mentions as they stand in the text (with the character before them); none for Facebook."""
    out = F.array().cast("array<string>")
    for name, (pattern, _) in MENTIONS.items():
        out = F.when(platform == name, matches(text, pattern)).otherwise(out)
    return out


def private_names(text: Column, platform: Column, author: Column) -> Column:
    """What redaction replaces: the author first, then mentioned names in order of their place, each once."""
    out = F.array().cast("array<string>")
    for name, (pattern, group) in MENTIONS.items():
        if group is not None:
            out = F.when(platform == name, matches(text, pattern, group)).otherwise(out)
    return F.array_distinct(F.filter(F.concat(F.array(author), out), lambda x: x.isNotNull() & (x != "")))


def replace_names(text: Column, names: Column) -> Column:
    """Replace, in order, each struct (name, alias) of an array; names are taken literally."""
    return F.aggregate(names, text, lambda t, n: F.replace(t, n["name"], n["alias"]))


def html_unescape(text: Column) -> Column:
    """HTML5 entities as characters."""
    import html

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else html.unescape(t))

    return run(text)


def clean_chan(text: Column) -> Column:
    """A 4chan comment: entities, then breaks as line ends, no break hints; what is cited stays."""
    plain = F.regexp_replace(F.regexp_replace(html_unescape(text), r"<br/?>", "\n"), r"<wbr/?>", "")
    return F.regexp_replace(plain, r"(?U)^\s+|\s+$", "")


def detected(lang: Column, text: Column, guess: Column, certainty: Column, least: float = 0.5) -> Column:
    """The language, or if it is missing or 'und' and there is text, the guess if it is certain enough, else 'und'."""
    open_ = lang.isNull() | (lang == "und")
    return F.when(open_ & (F.length(text) > 0), F.when(certainty >= least, guess).otherwise("und")).otherwise(lang)


def display_number(n: Column) -> Column:
    """A number with K, M, B or T."""
    out = F.format_number(n, 0)
    for size, sign in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        out = F.when(n >= size, F.concat(F.format_number(n / size, 2), F.lit(sign))).otherwise(out)
    return out
