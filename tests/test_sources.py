import zipfile

import pytest

from exactdiff.errors import HardFail
from exactdiff.sources import delimited, options, xlsx
from exactdiff.sources.load import check_sheets, source


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def load(spark, path, **k):
    side = source(path, "A", **k).load(spark)
    return list(side.headers), [tuple(r) for r in side.frame.collect()]


def test_quotes_bom_short_and_blank_rows(spark, tmp_path):
    p = write(tmp_path / "a.csv", b'\xef\xbb\xbfid,val,x\r\n1,"a\r\n""b"" c",z\r\n\r\n2\r\n,,\r\n')
    assert load(spark, p) == (["id", "val", "x"], [("1", 'a\r\n"b" c', "z"), ("2", "", "")])


@pytest.mark.parametrize("data", [b"id,val\n1,a,b\n", b'id,val\n1,"a\n', b"id,val\n1,\xff\n", b'id,val\n1,"a"b\n', b""])
def test_strictness(spark, tmp_path, data):
    with pytest.raises(HardFail):
        load(spark, write(tmp_path / "a.csv", data))


def test_encodings_and_delimiters(spark, tmp_path):
    p = write(tmp_path / "a.txt", "id~val\n1~€\n".encode("cp1252"))
    assert load(spark, p, delimiter="TILDE", encoding="windows-1252")[1] == [("1", "€")]
    assert load(spark, p, delimiter="~", encoding="utf8-lossy")[1] == [("1", "�")]
    for bad in ({"delimiter": ";"}, {}, {"delimiter": "~", "encoding": "latin1"}, {"delimiter": "~", "sheet": "s"}):
        with pytest.raises(HardFail):
            source(p, "A", **bad)
    assert options.delimiter("\\t", "--a-delim") == options.delimiter("Tab", "--a-delim") == "\t"


def test_duplicate_headers_are_renamed(spark, tmp_path):
    assert load(spark, write(tmp_path / "a.csv", "id,val,val\n1,a,b\n")) == (["id", "val", "val_duplicated_0"], [("1", "a", "b")])


def test_ranges_read_every_record_once(spark, tmp_path, monkeypatch):
    quoted = lambda v: f'"{v.replace(chr(34), chr(34) * 2)}"'
    rows = [(str(i), 'q"\n' * (i % 4) + "x" * (i % 7)) for i in range(200)]
    text = "id,val\n" + "".join(f"{i},{quoted(v)}\n" for i, v in rows)
    # quotes within plain fields are text, however many there are and whatever stands beside them
    odd = [(str(i), ['3,5" pipe', '6" x 4"', "", '"', '""', 'a\nb"', 'é""""z', '",\n"'][i % 8]) for i in range(120)]
    plain = lambda v: v if v and "," not in v and "\n" not in v and v[0] != '"' else quoted(v)
    stray = '\ufeffid,val\n' + "".join(f"{i},{plain(v)}\r\n" for i, v in odd)
    for name, data, want in (("a", text, rows), ("b", stray, odd), ("c", stray.replace("\r", ""), odd)):
        p = write(tmp_path / f"{name}.csv", data)
        for size in (7, 64, 1000):
            monkeypatch.setattr(delimited, "RANGE", size)
            inside = delimited.beginnings(spark, p, "utf8", ",")
            r = delimited.StrictReader({"path": p, "delimiter": ",", "encoding": "utf8", "inside": inside, "range": size}, 2)
            parts = r.partitions()
            assert len(parts) > 1
            assert [tuple(x.values()) for part in parts for b in r.read(part) for x in b.to_pylist()] == want
        assert load(spark, p)[1] == want


def book(path, sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>val</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        for i, cells in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return str(path)


HEAD = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'


def test_workbook(spark, tmp_path):
    body = '<row r="3"><c r="A3"><v>12.0</v></c><c r="B3" t="s"><v>2</v></c></row><row r="4"><c r="B4" t="str"><f>A1</f><v>made</v></c></row><row r="5"><c r="A5" t="b"><v>1</v></c><c r="B5" t="inlineStr"><is><t>in</t></is></c></row>'
    p = book(tmp_path / "a.XLSX", {"data1": HEAD + body, "data2": HEAD})
    assert load(spark, p, sheet="data1") == (["id", "val"], [("12", "rich"), ("", "made"), ("true", "in")])
    assert xlsx.sheet_names(p) == ["data1", "data2"]
    with pytest.raises(HardFail, match="Missing sheet 'x'.*data1, data2"):
        load(spark, p, sheet="x")
    with pytest.raises(HardFail, match="say which sheet with --a-sheet"):
        source(p, "A")
    check_sheets({"A": p, "B": p}, ["data1", "data2"])
    with pytest.raises(HardFail, match="lacks sheet 'data3'"):
        check_sheets({"A": p, "B": p}, ["data3"])


def test_sheet_sets():
    assert options.sheets("data{1-3, 7}") == ["data1", "data2", "data3", "data7"] and options.sheets("Jan, Feb") == ["Jan", "Feb"] and options.sheets("x{-1}") == ["x-1"]
    for bad in ("", " ", "a,", "a{1}b", "a{1", "{2-1}", "a{x}", "a,a", "a{1,1-2}", "a{}", "a{1},b"):
        with pytest.raises(HardFail, match="--sheets"):
            options.sheets(bad)


def test_keys_option():
    assert options.keys(" id , year ") == ["id", "year"]
    for bad in ("", " , ", "a,,b", "a,a"):
        with pytest.raises(HardFail):
            options.keys(bad)
