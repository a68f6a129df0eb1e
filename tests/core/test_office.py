"""DOCX and XLSX round trips."""

from weftline.sources import files, office


def test_docx():
    raw = office.new_docx(["Hello <world>", "", "two lines"])
    assert files.docx_paragraphs(raw) == [("document", 0, "Hello <world>"), ("document", 2, "two lines")]
    new, n = office.replace_text(raw, "l", "L")
    assert n == 4 and files.docx_paragraphs(new)[0][2] == "HeLLo <worLd>"


def test_xlsx(spark):
    raw = office.new_xlsx({"Data": {"B2": "42", "C2": "=B2*2", "D2": "text", "AA1": "true"}, "Other": {}})
    assert files.xlsx_cells(raw) == [("Data", "AA1", "1", "boolean"), ("Data", "B2", "42", "number"), ("Data", "C2", "=B2*2", "formula"), ("Data", "D2", "text", "text")]
    again = {(s, c): (v, k) for s, c, v, k in files.xlsx_cells(office.set_cells(raw, "Data", {"B2": "7", "E2": "x & y"}))}
    assert again["Data", "B2"] == ("7", "number") and again["Data", "E2"] == ("x & y", "text") and again["Data", "AA1"] == ("1", "boolean")
    df = spark.createDataFrame([("a.xlsx", raw), ("b.docx", office.new_docx(["p"]))], "path string, content binary")
    assert files.office_view(df).count() == 5
