"""Linear spans, redaction and suppression against plain Python."""

import random
import re

from pyspark.sql import functions as F

from stagewise.llm import licenses, secrets, spans


def test_matches_and_replaced(spark):
    rng = random.Random(8)
    texts = ["", "x", "aé7" * 700, "7" * 300, *("".join(rng.choice("aé7 😀") for _ in range(n)) for n in (5, 100, 1000, 20_000))]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = frame.select("i", "text", spans.matches(F.col("text"), F.lit("(7)7*a?"), 1).alias("m"))
    rows = {r.i: r for r in found.withColumn("clean", spans.replaced(F.col("text"), F.col("m"), "#")).where("size(m) > 0").collect()}
    for i, t in enumerate(texts):
        expected = [(m.start(), m.end(), 1) for m in re.finditer("(7)7*a?", t)]
        assert [tuple(x) for x in rows[i].m] == expected if expected else i not in rows
        if expected:
            assert rows[i].clean == re.sub("(7)7*a?", "#", t)


def test_many_matches(spark):
    frame = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("repeat('token=abcdef ', 50000)").alias("text"), F.lit(0).alias("n_chars"))
    row = secrets.scan_secrets(frame).select(F.size("secrets").alias("n"), F.element_at("secrets", -1).alias("last")).first()
    assert row.n == 50_000 and (row.last.start, row.last.end) == (13 * 49_999, 13 * 49_999 + 12)
    clean = secrets.redact_secrets(frame).select(F.md5("text").alias("d"), "n_chars").first()
    assert clean.d == spark.sql("SELECT md5(repeat('[secret] ', 50000)) AS d").first().d and clean.n_chars == 450_000


def test_redaction_with_clashing_columns_and_repeats(spark):
    rows = [(1, "token=abcdef12 x", 16, "s", "t", 5, "k", "d")] * 2 + [(None, None, None, None, None, None, None, None), (3, "clean", 5, "s", "t", 6, "k", "d")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int, secrets string, _text string, mask int, key string, doc string")
    got = secrets.redact_secrets(frame)
    assert got.columns == frame.columns and [t for _, t in got.dtypes] == [t for _, t in frame.dtypes]
    out = sorted(map(tuple, got.collect()), key=str)
    assert out == sorted([(1, "[secret] x", 10, "s", "t", 5, "k", "d")] * 2 + [(None,) * 8, rows[3]], key=str)


def test_suppression(spark):
    rng = random.Random(9)
    levels = sorted({r[3] for r in licenses.signature_rules()})
    rows = []
    for row in range(30):
        for _ in range(rng.randint(1, 25)):
            start = rng.randint(0, 12)
            rows.append((row, rng.randint(0, 5), "x", rng.choice(levels), 0.5, start, start + rng.randint(1, 8)))
    rows = list({(r[0], r[1], r[5], r[6]): r for r in rows}.values())
    strong = lambda x: (x[3], x[6] - x[5], -x[1])
    expected = sorted((x[0], x[5], x[6]) for x in rows if not any(y[0] == x[0] and y[5] <= x[5] and y[6] >= x[6] and strong(y) > strong(x) for y in rows))
    frame = spark.createDataFrame(rows, "row bigint, rule int, label string, priority int, confidence double, start bigint, end bigint")
    assert sorted((r.row, r.start, r.end) for r in licenses.unsuppressed(frame).collect()) == expected
    assert licenses.unsuppressed(frame.where("false")).isEmpty() and licenses.scan_licenses(spark.createDataFrame([], "doc_id bigint, text string")).isEmpty()
