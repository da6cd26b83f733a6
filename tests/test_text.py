"""Golden strings for the cleaning functions and hand fixtures for the
scalar functions."""

from pyspark.sql import functions as F

from textmill.functions import text as T

GOLDEN = [
    ("@ann hi #Yes", "hi", 1, 1),
    ("RT@bob: .@cy x@y.com MENTION12, #a#b", ": x@y.com , #b", 1, 3),
    ("hey\n#tag_é @ü1! http://a.b/c?d=1#z end", "hey ! end", 1, 1),
    ("no", "no", 0, 0),
    ("😀 ok   &amp; <b>x</b>", "ok &amp; <b>x</b>", 0, 0),
    ("mail a.19@mail5.example.com", "mail a.19@mail5.example.com", 0, 0),
    ("cc@z @q @r", "", 0, 3),
]


def test_clean_text_golden(spark):
    df = spark.createDataFrame(GOLDEN, "t string, want string, h int, m int")
    out = df.select("want", "h", "m", T.clean_text(F.col("t")).alias("got"),
                    T.count_hashtags(F.col("t")).alias("gh"), T.count_mentions(F.col("t")).alias("gm")).collect()
    for r in out:
        assert r.got == r.want
        assert r.gh == r.h
        assert r.gm == r.m


def test_null_in_null_out(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(T.clean_text(F.col("t"))).first()[0] is None


def test_zero_pad_never_shortens(spark):
    df = spark.createDataFrame([(42,), (123456,), (1234567,)], "i long")
    got = [r[0] for r in df.select(T.zero_pad(F.col("i"))).collect()]
    assert got == ["000042", "123456", "1234567"]


def test_mask_whole_words_case_sensitive(spark):
    df = spark.createDataFrame([("he hero He",)], "t string")
    assert df.select(T.mask_terms(F.col("t"), ["he"])).first()[0] == "<MASK> hero He"


def test_mask_quotes_terms(spark):
    df = spark.createDataFrame([("a.b axb",)], "t string")
    assert df.select(T.mask_terms(F.col("t"), ["a.b"])).first()[0] == "<MASK> axb"


def test_char_ngrams_collapse_whitespace(spark):
    df = spark.createDataFrame([("Ab  c",), ("ab",)], "t string")
    got = [r[0] for r in df.select(T.char_ngrams(F.col("t"), 3, 4)).collect()]
    assert got[0] == ["ab ", "b c", "ab c"]
    assert got[1] == []


def test_word_tokens_unicode(spark):
    df = spark.createDataFrame([("Héllo wörld a ab_c 12",)], "t string")
    assert df.select(T.word_tokens(F.col("t"))).first()[0] == ["héllo", "wörld", "ab_c", "12"]


def test_strip_markup(spark):
    html = '<html><script>var t="</p>";</script><p>a &amp;lt; b &copy;</p></html>'
    df = spark.createDataFrame([(html,)], "t string")
    assert df.select(T.strip_markup(F.col("t"))).first()[0] == "a &lt; b ©"


def test_character_references(spark):
    from textmill.functions.text import strip_markup
    cases = {"caf&eacute; &#8217; &#x41;&#X42 &copy &notit; &amp;lt; &nosuch; & &#0; <b>x</b>": "café ’ AB © ¬it; &lt; &nosuch; & \ufffd x", "plain": "plain", None: None, "&NotEqualTilde;&lt;b&gt;": "\u2242\u0338<b>"}
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "id long, t string")
    assert [r.t for r in rows.select("id", strip_markup(F.col("t")).alias("t")).orderBy("id").collect()] == list(cases.values())
