"""Golden cases for parsing, clinical text and cleaning."""

import pytest
from pyspark.sql import functions as F

from curatrix.functions import clinical, semi, text

NAMES = ("Drug-Drug Interaction Risk", "Dosage Risk", "Allergy Risk")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("said", "mg", "n"), [("75 mcg daily", 0.075, 1.0), ("0.2 mg/kg IV every 3 hours", 14.0, 8.0), ("1 g twice daily", 1000.0, 2.0), ("apply as needed", None, None)])
def test_dose(spark, said, mg, n):
    got = value(spark, F.struct(clinical.dose_mg(F.lit(said), F.lit(70.0)).alias("mg"), clinical.per_day(F.lit(said)).alias("n")))
    assert (got.mg, got.n) == (pytest.approx(mg) if mg else None, n)


def test_organs(spark):
    assert value(spark, clinical.renal(F.lit("Mild (CrCl 70 mL/min)"))).asDict() == {"status": "mild", "crcl": 70.0, "egfr": None}
    heart = value(spark, clinical.cardiac(F.lit("None (ECG normal, QTc < 440 ms)")))
    assert (heart.present, heart.qtc) == (False, 440.0)
    assert value(spark, clinical.pregnancy(F.lit("Pregnant, 30 weeks"))).trimester == 3


def test_lists_and_words(spark):
    assert value(spark, text.split_list(F.lit("Penicillin (rash, tolerates NSAIDs)"))) == ["Penicillin (rash, tolerates NSAIDs)"]
    assert value(spark, text.split_list(F.lit("a; b, c"))) == ["a", "b", "c"]
    from curatrix.operators import match

    assert value(spark, match.all_hits(F.lit("Valacyclovir 1 g"), ["Acyclovir", "Valacyclovir"])) == ["Valacyclovir"]


def test_category_key(spark):
    for said, want in (("Drug–Drug Interaction Risk", NAMES[0]), ("dosage", NAMES[1]), ("other", None)):
        assert value(spark, text.canonical(F.lit(said), NAMES)) == want


@pytest.mark.parametrize(
    ("said", "strict", "want"),
    [
        ('x {"Is_Safe": true, "risk": {"Dosage Risk": false}} y', False, (True, [], "json")),
        ('{"Is_Safe": false, "risk": {"Dosage Risk": true, "Aller', True, (None, [], "none")),
        ('{"Is_Safe": false, "risk": {"Dosage Risk": true, "Aller', False, (False, ["Dosage Risk"], "partial")),
        ("audit ... Final Verdict: UNSAFE", False, (False, [], "prose")),
        (None, False, (None, [], "none")),
    ],
)
def test_completion(said, strict, want):
    assert semi.parse_completion(said, NAMES, strict)[:3] == want


def test_flip_and_bullets(spark):
    assert value(spark, text.flip_word(F.lit("x: true, y: false"), "true", "false")) == "x: false, y: true"
    assert value(spark, text.bullets(F.lit("- Age: 3\n- Sex: f\n- Age: 4"))) == {"Age": "3", "Sex": "f"}
