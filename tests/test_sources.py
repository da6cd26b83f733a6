"""Files written from the driver tables, read back with the scanners."""

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from textmill.plans.q_relational import reference_items
from textmill.sources import files as S
from textmill.sources import quoted as Q


def test_scan_posts(spark, tmp_path):
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    posts = d.select(F.col("doc_id").alias("id"), F.lit("t").alias("test_case"), "source", F.col("lang").alias("language"),
                     F.lit("a").alias("task1"), F.lit(None).cast("string").alias("task2"), "text",
                     F.concat(F.lit('say "'), F.substring("text", 1, 9), F.lit('"')).alias("translated_text"))
    posts.write.option("header", True).option("sep", "\t").option("escape", '"').csv(f"{tmp_path}/many")
    many = S.scan_posts(spark, f"{tmp_path}/many", multi_line=True)
    assert many.schema == S.POST_SCHEMA
    assert many.exceptAll(posts).count() == 0 and many.count() == posts.count() > 0
    lines = posts.withColumn("text", F.regexp_replace("text", r"\s+", " ")).withColumn("translated_text", F.regexp_replace("translated_text", r"\s+", " "))
    lines.write.option("header", True).option("sep", "\t").option("escape", '"').csv(f"{tmp_path}/one")
    one = S.scan_posts(spark, f"{tmp_path}/one", ["id", "text"])
    assert one.exceptAll(lines.select("id", F.trim("text"))).count() == 0 and one.count() == posts.count()


def test_scan_lexicon(spark, tmp_path):
    part = spark.read.parquet(f"{SF001}/part.parquet").select("p_name", "p_brand")
    part.write.option("sep", "\t").csv(f"{tmp_path}/terms")
    want = {r.term for r in S.flatten_terms(part).collect()}
    got = [r.term for r in S.scan_lexicon(spark, f"{tmp_path}/terms").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    spark.createDataFrame([("first", "# note"), ("first", "last")], "a string, b string").write.option("sep", "\t").csv(f"{tmp_path}/notes")
    assert sorted(r.term for r in S.scan_lexicon(spark, f"{tmp_path}/notes", skip_comments=True).collect()) == ["first", "last"]


def test_scan_reference_items(spark, tmp_path):
    items = reference_items(spark, SF001)
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in S.REFERENCE_ITEM_SCHEMA if f.name not in items.columns]
    items.select("*", *rest).select(*S.REFERENCE_ITEM_SCHEMA.names).write.option("header", True).option("escape", '"').csv(f"{tmp_path}/items")
    got = S.scan_reference_items(spark, f"{tmp_path}/items", with_modifications=True, multi_line=True).select(*items.columns)
    assert got.exceptAll(items).count() == 0 and got.count() == items.count() > 0
    assert {r.of_id for r in S.scan_reference_items(spark, f"{tmp_path}/items", multi_line=True).select("of_id").distinct().collect()} == {-1}


def _python_records(path):
    """Records of a file by one walk over its characters."""
    out, now, inside = [], [], False
    for c in open(path, encoding="utf-8", newline="").read():
        if c == "\n" and not inside:
            out.append("".join(now))
            now = []
            continue
        inside ^= c == '"'
        now.append(c)
    return out + (["".join(now)] if now else [])


def test_quoted_records_by_blocks(spark, tmp_path, monkeypatch):
    """Blocks smaller than records: some start in quotes, some hold no record's end."""
    cells = ["plain", "", 'say ""so""', "two\nlines", "a\n\n\nb", "tail \r\n of two", "x" * 700, "é☃\n" * 90]
    body = "".join(f'{i},"{cells[i % len(cells)]}","{cells[i * 5 % 7]}"\n' for i in range(400))
    for name, text in (("a", "id,x,\"y\"\n" + body), ("b", "id,x,y\n" + body.rstrip("\n")), ("c", "id,x,y"), ("d", "")):
        with open(f"{tmp_path}/{name}.csv", "w", encoding="utf-8", newline="") as f:
            f.write(text)
    want = sorted(r for name in "abcd" for r in _python_records(f"{tmp_path}/{name}.csv"))
    schema = S.T.StructType([S.T.StructField(n, t) for n, t in (("id", S.T.LongType()), ("x", S.T.StringType()), ("y", S.T.StringType()))])
    plain = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path)).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for limit in (Q.BROADCAST_BLOCKS, 0):
            monkeypatch.setattr(Q, "BROADCAST_BLOCKS", limit)
            states = Q.block_states(Q._lines(spark, str(tmp_path))).collect()
            assert len(states) > 100 and {s.start for s in states} == {0, 1} and any(s.owner not in (None, 0) for s in states)
            got = Q.quoted_records(spark, str(tmp_path)).collect()
            assert sorted(r.record for r in got) == want and sum(r["first"] for r in got) == 3
            rows = Q.scan_quoted(spark, str(tmp_path), schema).collect()
            assert len(rows) == len(plain) == 800
            assert sorted(map(repr, rows)) == sorted(map(repr, plain))
        with pytest.raises(Exception, match="header does not match"):
            Q.scan_quoted(spark, str(tmp_path), S.T.StructType(schema.fields[::-1])).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
