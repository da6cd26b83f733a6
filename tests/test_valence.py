"""Rules of the valence scorer by hand, against a scorer in plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from textmill.operators import valence as VL

LEXICON = [("good", 1.9), ("bad", -2.5), ("great", 3.1)]
NEGATIONS, BOOSTERS, CONTRASTS = ["not", "never"], [("very", 0.293), ("hardly", -0.293)], ["but"]


def scored(text):
    """Compound score, rule by rule."""
    tokens = re.findall(r"\w{2,}", text or "")
    caps, low = [t.isupper() for t in tokens], [t.lower() for t in tokens]
    mixed, lex, boost = any(caps) and not all(caps), dict(LEXICON), dict(BOOSTERS)
    sign = lambda x: (x > 0) - (x < 0)
    total, but = 0.0, low.index("but") if "but" in low else None
    for i, t in enumerate(low):
        if t not in lex:
            continue
        s = lex[t] + (0.733 * sign(lex[t]) if mixed and caps[i] else 0)
        for k, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i < k or low[i - k] in lex:
                continue
            p = low[i - k]
            if p in boost:
                s += sign(s) * (boost[p] + (0.733 if mixed and caps[i - k] else 0)) * damp
            if k > 1 and p == "never" and {"so", "this"} & set(low[i - k + 1:i]):
                s *= {2: 1.5, 3: 1.25}[k]
            elif p in NEGATIONS:
                s *= -0.74
        if i and low[i - 1] == "least" and not (i > 1 and low[i - 2] in ("at", "very")):
            s *= -0.74
        if but is not None:
            s *= 0.5 if i < but else 1.5
        total += s
    marks = (text or "").count("?")
    total += sign(total) * (min((text or "").count("!"), 4) * 0.292 + (0.96 if marks > 3 else marks * 0.18 if marks > 1 else 0))
    return round(total / math.sqrt(total * total + 15), 4)


TEXTS = ["it is good", "it is GOOD", "IT IS GOOD", "it is VERY good", "it is very good", "very much so good", "it is hardly bad", "it is not good", "not so very good",
         "never so good", "never was so good", "never good", "not never good", "the least good", "at least good", "very least good",
         "good but bad", "bad, but GOOD! but great", "but good", "good!", "good!!!!!!", "good?", "good??", "bad?????", "bad but !?!?", "good bad great",
         "very good bad not", "", None, "nothing here at all", "ÉTÉ was good", "GOOD"]


def test_rules(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").withColumn("neg", F.lit(9))
    got = {r["id"]: r for r in VL.valence_scores(df, "text", LEXICON, NEGATIONS, BOOSTERS, CONTRASTS).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert got[i]["compound"] == pytest.approx(scored(text), abs=1.1e-4), text
        assert sum(got[i][k] for k in ("neg", "neu", "pos")) == pytest.approx(1.0 if text else 0.0, abs=2e-4), text


def test_lexicon_from_a_file(spark, tmp_path):
    """A lexicon of thousands of terms finds each of them."""
    terms = [(f"word{i}", round((i % 80 - 39.5) / 10, 2)) for i in range(3000)]
    spark.createDataFrame(terms + [("Word7", -4.0), (None, 1.0)], "term string, valence double").write.option("sep", "\t").csv(f"{tmp_path}/lex")
    pairs = VL.lexicon(spark.read.schema("term string, valence double").option("sep", "\t").csv(f"{tmp_path}/lex"))
    assert dict(pairs) == dict(terms)
    df = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(terms)], "id long, text string")
    got = {r["id"]: r["compound"] for r in VL.valence_scores(df, "text", pairs, [], BOOSTERS).collect()}
    assert all(got[i] == pytest.approx(v / math.sqrt(v * v + 15), abs=1e-4) for i, (_, v) in enumerate(terms))
