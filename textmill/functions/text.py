"""Scalar text functions (Column in, Column out).

Every function but ``unescape`` is a built-in Spark expression (regexp_replace,
regexp_extract_all, higher-order array functions), so it stays inside
whole-stage code generation and runs the same on batch and streaming
DataFrames.  Null in gives null out.

Regex dialect: Java.  Python's Unicode ``\\w`` is letters, numbers and the
underscore, written here as ``[\\p{L}\\p{N}_]`` so that it means the same in
Java and in RE2; ``(?U)`` makes ``\\b``, ``\\W`` and case folding Unicode
aware, ``(?d)`` keeps ``^`` to line starts after ``\\n`` only, as in Python.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Patterns that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
# Emoji ranges removed by the cleaner: emoticons 1F600-1F64F, symbols and
# pictographs 1F300-1F5FF, transport and map symbols 1F680-1F6FF, flags
# 1F1E0-1F1FF.
EMOJI_RANGES = [(0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF)]
# ASCII punctuation set (Python's string.punctuation).
ASCII_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Link: scheme http, ftp or https, host of dotted word parts, optional path
# whose last character is not one of . , :
URL_PATTERN = (r"(http|ftp|https)://([\w_-]+(?:(?:\.[\w_-]+)+))"
               r"([\w.,@?^=%&:/~+#-]*[\w@?^=%&/~+#-])?")
# Mention: at text start or after a non-word character, optional rt / ht /
# cc / "." / ". " prefix, then @word or MENTION<digits>; case-insensitive.
MENTION_PATTERN = r"(^|\W)((rt|ht|cc|[.] ?)?(@\w+|MENTION\d+))(\b|[{punct}])"
# Hashtag: at text start or after a non-word character, # and word characters.
HASHTAG_PATTERN = r"(^|\W)(#\w+)(\b|[{punct}])"
# Token patterns: default word tokens (two or more word characters) and the
# social variant that also keeps @word and #word not preceded by a word char.
WORD_TOKEN_PATTERN = r"\b\w\w+\b"
SOCIAL_TOKEN_PATTERN = r"\b\w\w+\b|(?<!\w)@\w+|(?<!\w)#\w+"
# Plain extraction patterns for value counts.
HASHTAG_EXTRACT = r"#\w+"
MENTION_EXTRACT = r"@\w+"
MASK_TOKEN = "<MASK>"
# ---------------------------------------------------------------------------

WORD = r"[\p{L}\p{N}_]"          # Python's Unicode \w
NON_WORD = r"[^\p{L}\p{N}_]"     # Python's Unicode \W


def _java(pattern: str) -> str:
    """Python-style pattern -> Java pattern with Python's \\w meaning."""
    out = (pattern.replace(r"\W", NON_WORD)
           .replace(r"[\w", r"[\p{L}\p{N}_")   # \w inside a class
           .replace(r"\w", WORD))
    return out


def _punct_class() -> str:
    return "".join("\\" + c if c in "\\[]^-&" else c for c in ASCII_PUNCT)


def emoji_regex() -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in EMOJI_RANGES) + "]+"


def url_regex() -> str:
    return "(?U)" + _java(URL_PATTERN)


def mention_regex() -> str:
    return "(?imsdU)" + _java(MENTION_PATTERN.format(punct=_punct_class()))


def hashtag_regex() -> str:
    return "(?imsdU)" + _java(HASHTAG_PATTERN.format(punct=_punct_class()))


def strip_emoji(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(emoji_regex()), F.lit(""))


def strip_hashtags(c: Column) -> Column:
    # delete only the hashtag group, keep the leading and trailing characters
    return F.regexp_replace(c, F.lit(hashtag_regex()), F.lit("$1$3"))


def strip_mentions(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(mention_regex()), F.lit("$1$5"))


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(url_regex()), F.lit(""))


def remove_spans(c: Column, pattern: str, keep: str) -> Column:
    """Delete the parts of every match that are not listed in ``keep``
    (a Java replacement such as ``'$1$3'``)."""
    return F.regexp_replace(c, F.lit(pattern), F.lit(keep))


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, F.lit(r"(?U)\s+"), F.lit(" ")))


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """Character references as HTML5 reads them: all names, decimal and
    hexadecimal numbers, with and without the semicolon, decoded once (the
    table of names is the standard library's).  Texts without ``&`` stay in
    the JVM."""
    return F.when(F.contains(c, F.lit("&")), _unescaped(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)


def strip_markup(c: Column) -> Column:
    """Drop script / style bodies and tags, then decode character references."""
    t = F.regexp_replace(c, F.lit(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>"), F.lit(""))
    t = F.regexp_replace(t, F.lit(r"(?s)<!--.*?-->"), F.lit(""))
    return unescape(F.regexp_replace(t, F.lit(r"(?s)<[^>]*>"), F.lit("")))


def clean_text(c: Column, fix_encoding: bool = False) -> Column:
    """Emoji, hashtags, mentions, links, then whitespace (optional markup first).
    A text without the characters that every match of a pattern has is not
    searched for it; each step sees the text as the step before left it."""
    t = strip_markup(c) if fix_encoding else c
    steps = [(strip_hashtags, lambda x: F.contains(x, F.lit("#"))),
             (strip_mentions, lambda x: F.contains(x, F.lit("@")) | x.rlike(r"(?iU)mention\d")),
             (strip_urls, lambda x: F.contains(x, F.lit("://")))]
    one = F.array(strip_emoji(t))
    for strip, may in steps:
        one = F.transform(one, lambda x: F.when(may(x), strip(x)).otherwise(x))
    return normalize_space(F.get(one, F.lit(0)))


def clean_text_light(c: Column, fix_encoding: bool = False) -> Column:
    t = strip_markup(c) if fix_encoding else c
    return normalize_space(strip_urls(t))


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(r"\p{P}"), F.lit(""))


def word_tokens(c: Column, lowercase: bool = True) -> Column:
    """Default vectoriser analyser: tokens of two or more word characters."""
    t = F.lower(c) if lowercase else c
    return F.regexp_extract_all(t, F.lit(WORD + "{2,}"), F.lit(0))


def social_tokens(c: Column) -> Column:
    """Words plus @word and #word not preceded by a word character."""
    pat = "(?U)" + _java(SOCIAL_TOKEN_PATTERN)
    return F.regexp_extract_all(F.lower(c), F.lit(pat), F.lit(0))


def ngram_text(c: Column) -> Column:
    """The lower-cased text, runs of two or more whitespace characters as one space."""
    return F.regexp_replace(F.lower(c), F.lit(r"(?U)\s\s+"), F.lit(" "))


def char_ngrams(c: Column, lo: int, hi: int) -> Column:
    """Character n-grams for n in [lo, hi] of the lower-cased text after
    collapsing runs of two or more whitespace characters to one space."""
    t = ngram_text(c)
    def grams(n: int) -> Column:
        # one left-to-right pass: a zero-width match at every position
        # captures the next n characters (substring by index would rescan
        # the text from its start for every position: quadratic)
        return F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))

    per_n = [grams(n) for n in range(lo, hi + 1)]
    return F.flatten(F.array(*per_n)) if len(per_n) > 1 else per_n[0]


def extract_hashtags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_java(HASHTAG_EXTRACT)), F.lit(0))


def extract_mentions(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_java(MENTION_EXTRACT)), F.lit(0))


def count_hashtags(c: Column) -> Column:
    return F.regexp_count(c, F.lit(hashtag_regex()))


def count_mentions(c: Column) -> Column:
    return F.regexp_count(c, F.lit(mention_regex()))


def _quote(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def mask_regex(terms: list[str]) -> str:
    alts = sorted({t.strip() for t in terms if t and t.strip()}, key=lambda s: (-len(s), s))
    return r"(?U)(\b|^)(" + "|".join(_quote(t) for t in alts) + r")(\b|$)"


def mask_terms(c: Column, terms: list[str], mask: str = MASK_TOKEN) -> Column:
    """Replace whole-word lexicon terms by ``mask``; case-sensitive."""
    return F.regexp_replace(c, F.lit(mask_regex(terms)), F.lit("$1" + mask.replace("$", "\\$") + "$3"))


def zero_pad(c: Column, width: int = 6) -> Column:
    """Pad an integer id to ``width`` digits; never shorten it."""
    return F.format_string(f"%0{width}d", c.cast("long"))


def canonical_array(c: Column) -> Column:
    return F.array_sort(c)


def compose_key(*cols: Column, sep: str = "_") -> Column:
    return F.concat_ws(sep, *cols)
