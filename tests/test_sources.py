"""Formats, mapping files, command line and streams."""

import io
import zipfile

from inkveil import cli
from inkveil.sources import files, formats, mappings
from inkveil.streaming import batches

TEXT = "田中太郎部長、03-1234-5678"
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


DOCX = zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>田中太郎</w:t></w:r><w:r><w:t>部長</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>03-1234-5678</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
S, R = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
XLSX = zipped({
    "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets><sheet name="a" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>{TEXT}</t></si></sst>',
    "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S}"><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>',
})
P, A = "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main"
PPTX = zipped({"ppt/slides/slide1.xml": f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>{TEXT}</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>'})


def test_units_of_formats():
    assert formats.units(".txt", b"\xef\xbb\xbfab") == ["ab"] and formats.rebuilt(".txt", b"\xef\xbb\xbfab", ["x"]) == b"\xef\xbb\xbfx"
    page = b"a<p>one</p><script>var b='<i>no</i>'</script> two <b>three</b>z"
    assert formats.units(".html", page) == ["one", "%%SKIP0%% two ", "three"]
    assert formats.rebuilt(".html", page, ["1", "%%SKIP0%%2", "3"]) == b"a<p>1</p><script>var b='<i>no</i>'</script>2<b>3</b>z"
    picture = b'<?xml version="1.0"?><svg xmlns="http://www.w3.org/2000/svg"><text>a<tspan>b</tspan>c</text></svg>'
    assert formats.units(".svg", picture) == ["a", "b", "c"] and formats.rebuilt(".svg", picture, ["x", "y", "z"]).startswith(b"<?xml")
    assert formats.units(".docx", DOCX) == ["田中太郎部長", "03-1234-5678"]
    assert formats.units(".docx", formats.rebuilt(".docx", DOCX, ["x", "y"])) == ["x", "y"]
    assert formats.units(".xlsx", XLSX) == [TEXT] and formats.units(".xlsx", formats.rebuilt(".xlsx", XLSX, ["x"])) == ["x"]
    assert formats.units(".pptx", PPTX) == [TEXT] and formats.units(".pptx", formats.rebuilt(".pptx", PPTX, ["x"])) == ["x"]
    assert formats.markdown([" a ", "b"]) == "# ページ 1\n\na\n\n---\n\n# ページ 2\n\nb"


def test_mapping_files(spark, tmp_path):
    rows = [("", "人物", "a\tb\\n\nc\r", "12345678", "A"), ("", "電話", "1", "87654321", "AB")]
    table, path = spark.createDataFrame(rows, mappings.SCHEMA), str(tmp_path / "m.tsv")
    mappings.save(table, path)
    assert not (tmp_path / "m.tsv.bak").exists()
    mappings.save(table, path)
    assert (tmp_path / "m.tsv.bak").exists()
    lines = (tmp_path / "m.tsv").read_text().split("\n")
    assert lines[0] == mappings.HEADER and all(len(line.split("\t")) == 4 for line in lines[:-1])
    assert sorted(map(tuple, mappings.load(spark, path).collect())) == sorted(rows)


def test_command_line_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    (tmp_path / "b.docx").write_bytes(DOCX)
    table = str(tmp_path / "m.tsv")
    assert cli.main(["mask", str(tmp_path / "*.txt"), str(tmp_path / "b.docx"), "-m", table], spark) == 0
    assert (tmp_path / "a_masked.txt").read_text() == "【人物A】部長、【電話A】"
    assert formats.units(".docx", (tmp_path / "b_masked.docx").read_bytes()) == ["【人物A】部長", "【電話A】"]
    assert cli.main(["unmask", str(tmp_path / "a_masked.txt"), "-m", table], spark) == 0
    assert (tmp_path / "a_restored.txt").read_text() == TEXT
    (tmp_path / "c.csv").write_text("")
    assert cli.main(["mask", str(tmp_path / "c.csv")], spark) == 1 and cli.main(["mask", str(tmp_path / "none.txt")], spark) == 1


def test_stream_carries_labels_on(spark, tmp_path):
    spark.createDataFrame([(0, "03-1111-0001")], "id long, text string").write.parquet(str(tmp_path / "in/1"))
    spark.createDataFrame([(1, "03-2222-0002と03-1111-0001")], "id long, text string").write.parquet(str(tmp_path / "in/2"))
    out = {}
    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    keep = lambda df, n: out.update({r["id"]: r["masked"] for r in df.collect()})
    writer = batches.mask_stream(stream, "id", str(tmp_path / "mapping"), keep, only_rules=True)
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(240)
    assert sorted(out) == [0, 1]
    assert {out[0], out[1]} in ({"【電話A】", "【電話B】と【電話A】"}, {"【電話B】", "【電話A】と【電話B】"})


def test_files_of_unknown_formats_are_left_out(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"1")
    assert files.read(spark, [str(tmp_path)]).count() == 0
