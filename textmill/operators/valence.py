"""Lexicon valence scoring.

Re-aimed from a per-text library call to column code: a token's score looks at
the three tokens before it in the document's array, so a document is scored in
its row (no join, no window, no shuffle).

Rules after Hutto and Gilbert (2014), for a token of the lexicon:
a token in capitals among mixed case, and a booster so written, count 0.733 more;
each of three tokens before, if not of the lexicon itself, shifts it as a booster
away from zero (damped 1, 0.95, 0.9), then negates it (-0.74) if it is a negation,
where "never so" and "never this" strengthen (1.5, a word further off 1.25);
"least" before it, but not "at least" or "very least", negates it too.
Of a text, tokens before the first contrast word count half and those after it
1.5 times; up to four ``!`` (0.292 each) and two ``?`` or more (0.18 each, over
three 0.96) amplify the sum, which is normalised as s / sqrt(s^2 + 15).
Idioms are no part of it.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as T

# Fixed values of the scoring rule.
NEGATION_SCALAR = -0.74
NORMALISATION_ALPHA = 15.0
BOOSTER_DAMPING = [1.0, 0.95, 0.9]
CAPITALS = 0.733
NEVER, NEVER_SO, NEVER_FACTORS = "never", ["so", "this"], {2: 1.5, 3: 1.25}
LEAST, NOT_LEAST = "least", ["at", "very"]
CONTRAST_BEFORE, CONTRAST_AFTER = 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS, MOST_QUESTIONS = 0.18, 0.96, 3

#: Entries that a lexicon may have (it is a literal of the plan), and of a look-up's bucket.
MAX_TERMS, BUCKET = 200_000, 8


def lexicon(terms: DataFrame, term: str = "term", value: str = "valence") -> list[tuple[str, float]]:
    """The pairs of a lexicon table (a file of at most ``MAX_TERMS`` terms), in
    lower case; of a term's several rows the largest value."""
    rows = (terms.where(F.col(term).isNotNull() & F.col(value).isNotNull()).groupBy(F.lower(F.trim(term)).alias("t"))
            .agg(F.max(F.col(value).cast("double")).alias("v")).orderBy("t").limit(MAX_TERMS + 1).collect())
    if len(rows) > MAX_TERMS:
        raise ValueError(f"the lexicon has over {MAX_TERMS} terms")
    return [(r["t"], r["v"]) for r in rows]


def _lookup(pairs: list[tuple[str, float]], t: Column) -> Column:
    """The value of a term, or 0, from buckets of a few terms each (a map is read
    from its start)."""
    size = len(pairs) // BUCKET
    if size <= BUCKET:
        return F.coalesce(F.from_json(F.lit(json.dumps(dict(pairs))), "map<string,double>")[t], F.lit(0.0))
    buckets: list[dict] = [{} for _ in range(size)]
    for k, v in pairs:
        buckets[zlib.crc32(k.encode()) % size][k] = float(v)
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,double>>")
    return F.coalesce(F.get(table, (F.crc32(t.cast("binary")) % size).cast("int"))[t], F.lit(0.0))


def _words(tokens: Column, valence, negations: list[str], boosters, contrasts: list[str]) -> Column:
    """The tokens with what the rules ask of each alone."""
    cased = F.transform(tokens, lambda t: F.struct(F.lower(t).alias("t"), ((t == F.upper(t)) & (t != F.lower(t))).alias("caps")))
    return F.transform(cased, lambda w: F.struct(
        w["t"].alias("t"), w["caps"].alias("caps"), _lookup(valence, w["t"]).alias("v"), _lookup(boosters, w["t"]).alias("b"),
        w["t"].isin(negations).alias("neg"), w["t"].isin(contrasts).alias("but")))


def token_scores(words: Column, mixed: Column, contrast: Column) -> Column:
    """Array of per-token scores (0 for tokens outside the lexicon); ``contrast``
    is the position of the first contrast word, from 0."""
    loud = lambda x, sign: F.when(mixed & x["caps"], sign * F.lit(CAPITALS)).otherwise(F.lit(0.0))

    def score(w, i):
        before = {k: F.get(words, i - k) for k in range(1, 4)}  # null before the first
        s = w["v"] + loud(w, F.signum(w["v"]))
        for k, damp in enumerate(BOOSTER_DAMPING, start=1):
            p = before[k]
            boost = F.when(p["b"] != 0, (p["b"] + loud(p, F.lit(1.0))) * F.lit(damp)).otherwise(F.lit(0.0))
            factor = F.when(p["neg"], F.lit(NEGATION_SCALAR)).otherwise(F.lit(1.0))
            if k in NEVER_FACTORS:
                so = F.lit(False)
                for j in range(1, k):
                    so = so | F.coalesce(before[j]["t"].isin(NEVER_SO), F.lit(False))
                factor = F.when((p["t"] == NEVER) & so, F.lit(NEVER_FACTORS[k])).otherwise(factor)
            acts = (p["v"] == 0) & ((p["b"] != 0) | p["neg"] | (p["t"] == NEVER))
            s = F.when(acts, (s + F.signum(s) * boost) * factor).otherwise(s)
        least = (before[1]["t"] == LEAST) & (before[1]["v"] == 0) & ~F.coalesce(before[2]["t"].isin(NOT_LEAST), F.lit(False))
        s = F.when(least, s * F.lit(NEGATION_SCALAR)).otherwise(s)
        weight = F.when(i < contrast, F.lit(CONTRAST_BEFORE)).when(i > contrast, F.lit(CONTRAST_AFTER)).otherwise(F.lit(1.0))
        return F.when(w["v"] != 0, s * weight).otherwise(F.lit(0.0))

    return F.transform(words, score)


def amplification(text: Column) -> Column:
    """What a text's ``!`` and ``?`` add to its sum."""
    marks = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c)))
    many = F.when(marks("?") > MOST_QUESTIONS, MANY_QUESTIONS).when(marks("?") > 1, marks("?") * F.lit(QUESTION)).otherwise(0.0)
    return F.coalesce(F.least(marks("!"), F.lit(MOST_EXCLAMATIONS)) * F.lit(EXCLAMATION) + many, F.lit(0.0))


def polarity(scores: Column, amplified: Column) -> Column:
    """Struct of neg / neu / pos shares and compound, each rounded to 4
    places, by one pass over the scores."""
    add = lambda a, x: F.struct((a["total"] + x).alias("total"), (a["up"] + F.when(x > 0, x + 1).otherwise(0.0)).alias("up"),
                                (a["down"] + F.when(x < 0, x - 1).otherwise(0.0)).alias("down"), (a["neu"] + F.when(x == 0, 1.0).otherwise(0.0)).alias("neu"),
                                a["amp"].alias("amp"))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("total", "up", "down", "neu")], amplified.alias("amp"))

    def shares(s):
        up, down = s["up"], s["down"]
        up, down = up + F.when(up > -down, s["amp"]).otherwise(0.0), down - F.when(up < -down, s["amp"]).otherwise(0.0)
        denom = up + F.abs(down) + s["neu"]
        safe = F.when(denom > 0, denom)
        part = lambda x: F.round(F.coalesce(F.abs(x / safe), F.lit(0.0)), 4) + F.lit(0.0)
        total = s["total"] + F.signum(s["total"]) * s["amp"]
        compound = F.round(total / F.sqrt(total * total + F.lit(NORMALISATION_ALPHA)), 4) + F.lit(0.0)
        return F.struct(part(down).alias("neg"), part(s["neu"]).alias("neu"), part(up).alias("pos"), compound.alias("compound"))

    # the final function sees the sums once, so the scores are worked out once
    return F.aggregate(scores, zero, add, shares)


def valence_scores(df: DataFrame, text: str, valence, negations: list[str], boosters, contrasts: list[str] = ("but",), key: str = "id") -> DataFrame:
    """(key, neg, neu, pos, compound) of every text, in its own case and with
    its marks; a null or empty text has zeros."""
    tokens = T.word_tokens(F.coalesce(F.col(text), F.lit("")), lowercase=False)
    words = _words(tokens, valence, list(negations), boosters, list(contrasts))
    d = df.select(key, amplification(F.col(text)).alias("__amp"), words.alias("__words"))
    caps = lambda loud: F.exists("__words", lambda w: w["caps"] == F.lit(loud))
    first = F.array_position(F.transform("__words", lambda w: w["but"]), True)
    d = d.withColumns({"__mixed": caps(True) & caps(False), "__but": F.when(first > 0, first - 1)})
    scores = token_scores(F.col("__words"), F.col("__mixed"), F.col("__but"))
    return d.select(key, F.inline(F.array(polarity(scores, F.col("__amp")))))
