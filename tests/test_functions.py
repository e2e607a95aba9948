import math

import pytest
from pyspark.sql import functions as F

from cathlight.functions import answers as A
from cathlight.functions import text as T
from cathlight.functions import values as D
from cathlight.functions import vectors as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize("raw, want", [(None, "NO"), ("Yes", "YES"), ("positive", "YES"), ("Not visible", "NO"), ("maybe", "NO"), ("not present", "YES")])
def test_truth_answer(spark, raw, want):
    assert one(spark, raw, A.truth_answer) == want


@pytest.mark.parametrize("raw, want", [(None, "NO"), ("Yes.", "YES"), ("Unclear, cannot determine", "NO"), ("no, but yes", "YES")])
def test_model_answer(spark, raw, want):
    assert one(spark, raw, A.model_answer) == want


@pytest.mark.parametrize("raw, want", [("YES", 1), ("no", 0), ("1.0", 1), ("2", 0), ("stenosis", 1), ("positive finding", 0), (None, 0)])
def test_binary(spark, raw, want):
    assert one(spark, raw, A.binary) == want


@pytest.mark.parametrize("raw, want", [("Yes.", "yes"), ("No - x", "no"), ("unclear", None), ("1", "yes"), (None, None)])
def test_first_token(spark, raw, want):
    assert one(spark, raw, A.first_token) == want


def test_questions(spark):
    assert one(spark, " Is the  stent patent? Please state yes or no.", A.question_key) == "is the stent patent?"
    assert one(spark, "Where is the catheter tip?", A.question_group) == "LOCATION"
    assert one(spark, "Is there a stent?", A.question_group) == "DEVICE"
    assert one(spark, "google/medsiglip-448", A.model_label) == "MedSigLIP-zs"


@pytest.mark.parametrize("raw, want", [("20240231", 20240231), ("20241301", None), ("2024-03-05", 20240305), (None, None)])
def test_date_key(spark, raw, want):
    assert one(spark, raw, D.date_key) == want


@pytest.mark.parametrize("raw, want", [("09", 32400000000), ("0930", 34200000000), ("093015.5", 34215500000), ("09:30:15", 34215000000), ("2460", None), ("093", None)])
def test_time_key(spark, raw, want):
    assert one(spark, raw, D.time_key) == want


def test_numbers(spark):
    assert one(spark, " ", D.number) is None and one(spark, "3.7", D.whole) == 3 and one(spark, "12abc", D.whole) is None
    assert one(spark, "12345.0", T.key_text) == "12345" and one(spark, " ", T.key_text) is None
    assert one(spark, 10, lambda c: D.uniform_indices(c, 4), "int") == [0, 3, 6, 9]
    assert one(spark, 5, lambda c: D.uniform_indices(c, 4), "int") == [0, 1, 3, 4]
    assert one(spark, 5, lambda c: D.uniform_indices(c, 4, rounded=False), "int") == [0, 1, 2, 4]
    assert tuple(one(spark, 7, D.grid, "int")) == (3, 3)
    assert one(spark, "2", D.index0) == 1 and one(spark, "x", D.index0) == -1


def test_report_cleaning(spark):
    text = "Name: X\nFINDINGS: mild – disease..\n- one\n- two\nElectronically signed by Dr A\nrest"
    assert one(spark, text, T.clean_report) == "FINDINGS: mild - disease.\none\ntwo"
    assert one(spark, "mail a.b@c.org, DOB: 1/2/1990", T.mask_personal) == "mail [EMAIL], [DOB]"


def test_slicing(spark):
    text = "INDICATION: pain\nx\nFINDINGS: a\nb\nPLAN: go\nIMPRESSION: c. Informed consent was obtained. d."
    assert one(spark, text, T.slice_sections) == "FINDINGS: a\nb\nIMPRESSION: c.d."  # a removed sentence takes the space before it along


def test_lists(spark):
    assert one(spark, "['1.2', \"3.4\"]", T.uid_list) == ["1.2", "3.4"]
    assert one(spark, "a; nan|b , ", T.tokens) == ["a", "b"]
    assert one(spark, "/x/Y.DCM", T.stem) == "Y"
    assert one(spark, "0.91 (0.02)", T.metric_value) == 0.91 and one(spark, "91% ± 2", T.metric_value) == 91.0


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], V.unit, "array<double>") == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], V.unit, "array<double>") == [0.0, 0.0]
    assert abs(one(spark, [1.0, 2.0], V.log_sum_exp, "array<double>") - math.log(math.e + math.e**2)) < 1e-12
    assert one(spark, [1.0, 1.0, 0.0], V.entropy, "array<double>") == 1.0
    assert len(one(spark, 3, lambda c: V.position_code(c, 8), "int")) == 8


@pytest.mark.parametrize("raw, want", [('"No evidence of stenosis"', "no"), ("stent visible", "yes"), ("not visible", "n/a"), ("", "n/a"), (None, "n/a"), ("y", "yes"), ("blah", "n/a"), ("no obvious stent", "no")])
def test_strict_label(spark, raw, want):
    assert one(spark, raw, A.strict_label) == want


def test_generated_and_years(spark):
    original = F.lit("a b c d e f g h i j k l m n o p q r s t")
    assert [one(spark, x, lambda c: A.generated_reason(original, c)) for x in (None, "Sure", "Here is it a b c d e f g", "one two three four five six seven")] == ["empty", "short", "lead-in", "OK"]
    assert one(spark, "in 2019 and 1850, 2021", D.years_in) == [2019, 2021]
    assert one(spark, "Abc ", lambda c: D.institution(c, "abc")) == "ABC" and one(spark, "x", lambda c: D.institution(c, "abc")) == "Non-ABC"


@pytest.mark.parametrize("raw, want", [
    ("Accession #: 12345", "[ACCESSION]"), ("Accession: A-12345", "[ACCESSION]"), ("ACC # 123", "[ACCESSION]"), ("MRN #: 123456", "[MRN]"), ("(415)555-1234", "[PHONE]"), ("DOB: 1.2.1990", "[DOB]"),
    ("at Saint Mary Medical Center", "at [FACILITY]"), ("according to the accession", "according to the accession"),
])
def test_personal_data(spark, raw, want):
    assert one(spark, raw, T.mask_personal) == want


def test_white_space_of_any_kind_goes(spark):
    assert one(spark, "\t12345.0\n", T.key_text) == "12345" and one(spark, "\t", T.key_text) is None
    assert one(spark, "['1.2',\n '3.4']", T.uid_list) == ["1.2", "3.4"]
    assert one(spark, "\tNA\n", A.unified_na) == "n/a" and one(spark, "\n yes", A.first_token) == "yes"


def test_paths_and_names(spark):
    assert one(spark, "/a/b/c.dcm", T.basename) == "c.dcm" and one(spark, "/a/b/c.dcm", T.parent) == "/a/b" and one(spark, "c", T.parent) is None
    assert one(spark, "\ufeff1.2\u200b.3 ", T.plain_uid) == "1.2.3"
    assert one(spark, "U-Net+  attention / LSTM", T.tidy_architecture) == "U-Net + attention/LSTM"


def test_sentence_case(spark):
    assert one(spark, "LAD Is Patent. no Stenosis in The [SSN] segment.\nthe End", T.lower_sentences) == "LAD is patent. No stenosis in the [SSN] segment.\nThe end"
    for raw, want in (("FINDINGS: The lesion", "FINDINGS: the lesion"), ("I-A lead A1B", "I-A lead A1B"), ('x "No." Then', 'X "no." then'), ("[phone] a\n\n  b! c", "[PHONE] a\n\n  B! C"), ("", ""), (" iT", " It"), ("Éa éB. éc", "éa éb. éc")):
        assert one(spark, raw, T.lower_sentences) == want
