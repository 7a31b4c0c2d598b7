import io
import json
import zipfile

import numpy as np
import pytest

from sparkweft.sources import files as S
from sparkweft.streaming import ingest


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def xlsx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="x"><sheets><sheet name="One"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>a\tb</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="x"><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello é")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe bad")
    (tmp_path / "c.txt").write_text("  ")
    (tmp_path / "d.docx").write_bytes(docx("<w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>x\\y</w:t></w:p></w:tc><w:tc><w:p><w:t>z</w:t></w:p></w:tc></w:tr></w:tbl>"))
    (tmp_path / "e.xlsx").write_bytes(xlsx())
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    (tmp_path / "g.exe").write_bytes(b"no")
    (tmp_path / "h.docx").write_bytes(b"broken")
    found = S.new_files(spark, f"file://{tmp_path}")
    got = {r.path.rsplit("/", 1)[-1]: (r.content, r.error) for r in S.decoded(found).collect()}
    assert got.keys() == {"a.txt", "b.md", "c.txt", "d.docx", "e.xlsx", "f.pdf", "h.docx"}
    assert got["a.txt"] == ("hello é", None) and got["b.md"] == (None, "not UTF-8") and got["c.txt"] == (None, "empty")
    assert got["d.docx"] == ("One\nx\\\\y\tz", None) and got["e.xlsx"] == ("==== Sheet: One ====\na\\tb\t5", None)
    assert got["f.pdf"] == (None, "no text") and got["h.docx"][1].startswith("BadZipFile")
    assert S.new_files(spark, f"file://{tmp_path}", found.where("path like '%a.txt'")).count() == 6


def test_kv_and_graphml(spark, tmp_path):
    (tmp_path / "kv.json").write_text(json.dumps({"a": {"x": 1}, "b": "t"}))
    assert {r.id: r.value for r in S.read_kv(spark, f"file://{tmp_path}/kv.json").collect()} == {"a": '{"x":1}', "b": "t"}
    g = '<graphml><key id="d0"/><graph><node id="n&amp;1"><data key="d1">person</data></node><node id="a"/><edge source="n&amp;1" target="a"><data key="d0">2.0</data></edge></graph></graphml>'
    (tmp_path / "g.graphml").write_text(g)
    nodes, edges = S.read_graphml(spark, f"file://{tmp_path}/g.graphml")
    assert {r.name: r.data for r in nodes.collect()} == {"n&1": {"d1": "person"}, "a": {}}
    assert [(r.src, r.tgt, r.data) for r in edges.collect()] == [("a", "n&1", {"d0": "2.0"})]
    e = spark.createDataFrame([("a", 'b"', 1.5)], "src string, tgt string, weight double")
    assert [r.value for r in S.graphml_lines(e.selectExpr("src as name"), e).collect()] == ['<node id="a"/>', '<edge source="a" target="b&quot;"><data key="d0">1.5</data></edge>']


def test_contexts_export_codec(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"context": "b"}\nnot json\n{"context": "a"}\n{"context": "b"}\n{"other": 1}\n')
    assert [(r.pos, r.context) for r in sorted(S.unique_contexts(spark, f"file://{tmp_path}/c.jsonl").collect())] == [(1, "b"), (2, "a")]
    e = spark.createDataFrame([("a", [1.0, 0.5])], "name string, v array<float>")
    for kind in S.EXPORTS:
        S.export(e, e, f"file://{tmp_path}/out-{kind}", kind)
    assert spark.read.csv(f"file://{tmp_path}/out-csv/entities", header=True).first().name == "a"
    with pytest.raises(ValueError):
        S.export(e, e, "x", "xls")
    assert np.allclose(S.decode_vectors(S.encode_vectors(e)).first().v, [1.0, 0.5])


def test_streaming(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.txt").write_text("one two three")
    (src / "b.txt").write_text("one two three")
    ingest.start(spark, f"file://{src}", f"file://{out}", 2, 1).awaitTermination(120)
    (src / "c.txt").write_text("one two three")
    (src / "d.txt").write_text("four five")
    ingest.start(spark, f"file://{src}", f"file://{out}", 2, 1).awaitTermination(120)
    status = spark.read.parquet(f"file://{out}/status").collect()
    assert sorted((r.file_path[-5:], r.status) for r in status) == [("a.txt", "processed"), ("d.txt", "processed")]
    chunks = sorted((r.chunk_order_index, r.content) for r in spark.read.parquet(f"file://{out}/chunks").collect())
    assert chunks == [(0, "four five"), (0, "one two"), (1, "five"), (1, "two three"), (2, "three")]
    again = spark.createDataFrame([("x", "one two three")], "file_path string, content string")
    ingest.ingest_batch(spark, again, f"file://{out}", 99)
    assert spark.read.parquet(f"file://{out}/status").count() == 2


def pdf(content, compress=True):
    import zlib

    body = zlib.compress(content) if compress else content
    return b"%PDF-1.4\n1 0 obj <</Type/Page/Resources<</Font<<>>>>>> endobj\n2 0 obj\n<< /Length 9 " + (b"/Filter /FlateDecode " if compress else b"") + b">>\nstream\n" + body + b"\nendstream endobj\n%%EOF"


def test_pdf():
    page = rb"BT /F1 12 Tf 72 700 Td (Hello \(world\) \351) Tj 0 -14 Td [(Two) -300 (wo) 20 (rds)] TJ T* <48690a> Tj (next) ' ET"
    for compress in (True, False):
        assert S.pdf_text(pdf(page, compress)) == ("Hello (world) é\nTwo words\nHi\n\nnext", None)
    assert S.pdf_text(b"%PDF-1.4 <</Encrypt 1 0 R>>") == (None, "encrypted") and S.pdf_text(b"%PDF") == (None, "no text") and S.pdf_text(None) == (None, "no PDF")


def test_workbook(spark, tmp_path):
    e = spark.createDataFrame([("a<b", 1, ["x"]), (None, 2, [])], "name string, n int, sources array<string>")
    r = spark.createDataFrame([("a", "b", 1.5)], "src string, tgt string, weight double")
    S.export(e, r, f"file://{tmp_path}/kg", "xlsx")
    got = S.office_text("kg.xlsx", (tmp_path / "kg.xlsx").read_bytes())
    assert got == ('==== Sheet: entities ====\nname\tn\tsources\na<b\t1\t["x"]\n\t2\t[]\n==== Sheet: relations ====\nsrc\ttgt\tweight\na\tb\t1.5', None)


def test_jdbc(spark, tmp_path):
    """Over the embedded database that comes with Spark."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    t = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "ID int, VALUE string")
    S.write_jdbc(t, url, "kv", "overwrite", driver=driver)
    S.write_jdbc(t.where("ID < 3"), url, "kv", driver=driver)
    got = S.read_jdbc(spark, url, "kv", "ID", 4, driver=driver)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == sorted([tuple(r) for r in t.collect()] + [(i, f"v{i}") for i in range(3)])
    assert S.read_jdbc(spark, url, "kv", driver=driver).where("ID = 7").count() == 1
