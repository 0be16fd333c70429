"""Verdicts on answers, as given in the design's fixtures."""

import pytest
from pyspark.sql import functions as F

from kgspark.functions import judges, text
from kgspark.operators import harness

SETS = [
    ("- BMP4\n- CHD7\n- COCH", ["BMP4", "CHD7", "COCH"], True, 1.0, "set", 1.0),
    ("- BMP4\n- CHD7", ["BMP4", "CHD7", "COCH"], False, 0.6667, "set", 1.0),
    ("- BMP4\n- CHD7\n- FAKE1", ["BMP4", "CHD7"], False, 1.0, "set", 0.6667),
    ("# Genes Expressed in Canal\n- BMP4\n- CHD7\n- COCH", ["BMP4", "CHD7", "COCH"], True, 1.0, "set", 1.0),
    ("The genes are:\n- BMP4\n- CHD7", ["BMP4", "CHD7"], True, 1.0, "set", 1.0),
    ("The genes are BMP4, CHD7 and COCH.", ["BMP4", "CHD7", "COCH"], True, 1.0, "recall_only", None),
]


def one(spark, expression, **columns):
    row = spark.range(1).select(*[(F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")).alias(k) if isinstance(v, list) else F.lit(v).alias(k) for k, v in columns.items()])
    return row.select(expression.alias("r")).first().r


@pytest.mark.parametrize("answer, truth, passed, recall, basis, precision", SETS)
def test_set_match(spark, answer, truth, passed, recall, basis, precision):
    r = one(spark, judges.set_match(F.col("a"), F.col("t")), a=answer, t=truth)
    assert (r.passed, r.recall, r.basis, r.precision) == (passed, recall, basis, precision)


def test_labels_with_commas(spark):
    labels = {"a": "Obesity, Abdominal\nOverweight", "t": ["Obesity, Abdominal", "Overweight"]}
    assert not one(spark, judges.set_match(F.col("a"), F.col("t")), **labels).passed
    assert one(spark, judges.set_match_v2(F.col("a"), F.col("t")), **labels).passed


@pytest.mark.parametrize("judge, answer, truth, passed", [
    (judges.string_match, "The gene HTR3B is located on chromosome 11.", "11", True),
    (judges.string_match, "It sits on chromosome 111.", "11", False),
    (judges.numerical, "Galantamine causes 184 side effects across studies.", "184", True),
    (judges.numerical, "about 1,184 effects", "1184", True),
    (judges.numerical, "around 200 effects", "184", False),
    (judges.numerical, "184", "many", False),
    (judges.binary, "Testolactone does not treat any diseases.", [], True),
    (judges.binary, "Testolactone treats breast cancer and prostate cancer.", [], False),
    (judges.binary, "I don't have specific context", [], True),
    (judges.binary, "I don’t have specific context", [], True),
    (judges.boolean, "Yes, there is a path.", "true", True),
    (judges.boolean, "No, no such path exists.", "false", True),
    (judges.boolean, "Yes, definitely.", "false", False),
    (judges.boolean, "It is unclear.", "true", False),
])
def test_judges(spark, judge, answer, truth, passed):
    assert one(spark, judge(F.col("a"), F.col("t")), a=answer, t=truth).passed is passed


@pytest.mark.parametrize("answer, negated", [("que noñ arr", True), ("ñno que", True), ("no\u0301", True), ("NOTHİNG", True), ("UN\u212aNOWN", True), ("noun", False), ("no_1", False), ("2no", False), (None, None)])
def test_negation_stands_between_signs_that_are_not_ascii_words(spark, answer, negated):
    """As in the twins, where an accented letter bounds a word (jd10, jd11, jd13)."""
    import duckdb

    assert one(spark, judges.has_negation(F.col("a")), a=answer) is negated
    if answer is not None:
        pattern = judges.NEGATION.replace("'", "''")
        assert duckdb.execute(f"SELECT regexp_matches(lower(?), '{pattern}')", [answer]).fetchone()[0] is negated


@pytest.mark.parametrize("answer, verdict, passed", [("x", "EQUIVALENT\nsame", True), ("x", "DIFFERENT\nno", False), ("x", "NOT EQUIVALENT / DIFFERENT", False), (" ", "EQUIVALENT", False), ("x", "\n\nequivalent", True), ("x", None, False)])
def test_semantic(spark, answer, verdict, passed):
    assert one(spark, judges.semantic(F.col("a"), F.col("v").cast("string")), a=answer, v=verdict).passed is passed


def test_normalize_and_references(spark):
    assert one(spark, text.normalize(F.col("a")), a="Non-Small  Cell!") == "non small cell"
    assert one(spark, judges.semantic_reference(F.col("a")), a=["TP53", "tumor protein p53"]) == "TP53 OR tumor protein p53"


def test_chunks(spark):
    words = " ".join(f"w{i}" for i in range(400))
    own = lambda x: one(spark, text.chunk_windows(F.col("a")), a=x)
    assert own("a few short words") == ["a few short words"] and own("") == own("   ") == []
    out = own(words)
    assert len(out) > 1 and all(len(c.split()) <= 180 for c in out) and out[1].startswith("w150 ") and out[0].split()[-30:] == out[1].split()[:30]


def test_selection(spark):
    rows = spark.createDataFrame([(0, "t1", "set_match"), (1, "t1", "set_match"), (2, "t2", "numerical"), (3, "t3", "semantic")], "pos int, type_id string, scoring string")
    assert [r.type_id for r in harness.select_questions(rows, 9).collect()] == ["t1", "t2", "t1"]
    assert [r.type_id for r in harness.select_questions(rows, 2).collect()] == ["t1", "t2"]
    assert [r.type_id for r in harness.select_questions(rows, 9, types=["t3"]).collect()] == ["t3"]


def test_report(spark):
    rows = spark.createDataFrame([("q1", "01", True, 1.0, None, True, 5), ("q|2", "01", None, None, "boom", False, 0)], "question_id string, type_id string, passed boolean, score double, error string, judged boolean, input_tokens int")
    out = harness.report(rows, {"run_id": "r1", "judge": "x"})
    assert "# Run r1" in out and "q\\|2" in out and "| 01 | 1 | 1 |" in out
