"""Files of unlike shape: forms, aliases, status codes."""

from cathlight.sources import unlike as U

FILES = {
    "a/metadata.csv": "Information,Value\nAccessionNumber,A1\nSOPInstanceUID,1.2\nAccessionNumber,A2\n\n",
    "b/metadata.csv": "﻿information , x,VALUE\nAccession Number,1,B1\nsop_instance_uid,2,2.3\n",
    "c/metadata.csv": "k,v\naccession,C1\nSOP instance uid,3.4\n",
    "d/metadata.csv": "SOPInstanceUID,AccessionNumber,SeriesDate\n5.1,D1,20200101\n5.1,D1,20200101\n,D2,\n5.2,D3,\n",
    "e/metadata.csv": "", "f/metadata.csv": "Information,Value\n", "g/metadata.csv": "only\nx\n", "h/metadata.csv": "a,b\n1,2,3\n",
    "i/metadata.csv": "Information,Value\nAccessionNumber,\nAccession,I1\nSOPInstanceUID,9\n", "j/metadata.csv": "Information,Value\nAccession,J1\nother,x\n", "k/metadata.csv": b"\xff\xfe\x00bad",
    "l/metadata.csv": 'Information,Value\nAccession,"L,1\nline"\nSOPInstanceUid,8.8\n',
}


def made(spark, folder):
    for name, text in FILES.items():
        path = folder / name
        path.parent.mkdir()
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return U.read_each(spark, str(folder))


def short(path):
    return path.rstrip("/").split("/")[-2 if path.endswith(".csv") else -1]


def test_status_of_each_file(spark, tmp_path):
    got = {short(r.path): (r.status, r.rows) for r in U.file_status(made(spark, tmp_path)).collect()}
    assert got == {"a": ("ok", 3), "b": ("ok", 2), "c": ("ok", 2), "d": ("ok", 4), "e": ("read_error:EmptyDataError", 0), "f": ("ok", 0), "g": ("ok", 1), "h": ("read_error:ParserError", 0), "i": ("ok", 3), "j": ("ok", 2), "k": ("read_error:UnicodeDecodeError", 0), "l": ("ok", 2)}


def test_keys_by_any_spelling(spark, tmp_path):
    folders = spark.createDataFrame([(f"file:{tmp_path}/{x}",) for x in "adz"], "folder string")
    got = {short(r.folder): (r.accession, r.sop, r.status) for r in U.metadata_keys(made(spark, tmp_path), folders).collect()}
    assert got["a"] == ("A2", "1.2", "ok") and got["b"] == ("B1", "2.3", "ok") and got["c"] == ("C1", "3.4", "ok") and got["l"] == ("L,1\nline", "8.8", "ok")
    assert got["e"][2] == "metadata_read_error:EmptyDataError" and got["f"][2] == got["g"][2] == "metadata_empty_or_bad_format" and got["h"][2] == "metadata_read_error:ParserError"
    assert got["i"] == (None, None, "metadata_missing_accession(keys=['AccessionNumber', 'Accession', 'SOPInstanceUID'])") and got["j"][2] == "metadata_missing_sop(keys=['Accession', 'other'])"
    assert got["z"] == (None, None, "missing_metadata_csv") and got["k"][2] == "metadata_read_error:UnicodeDecodeError" and len(got) == 13


def test_records_of_both_forms(spark, tmp_path):
    got = sorted((short(r.path), r.SOPInstanceUID, r.AccessionNumber, r.SeriesDate) for r in U.metadata_records(made(spark, tmp_path)).collect())
    assert got == [("a", "1.2", "A2", ""), ("b", "2.3", "", ""), ("d", "5.1", "D1", "20200101"), ("d", "5.2", "D3", ""), ("i", "9", "", "")]


def test_union_by_name(spark, tmp_path):
    df = U.united(made(spark, tmp_path))
    assert {"SOPInstanceUID", "k", "v", "only", "Value", "VALUE"} <= set(df.columns) and df.count() == 19
    assert U.united(made_rows(df, spark), ["v"]).columns == ["path", "place", "v"]


def made_rows(df, spark):
    return spark.createDataFrame([], U.PARSED)
