import zipfile

import pytest

from colprism.sources import readers
from colprism.sources.readers import ReadError, read_any
from sample_tables import TREES


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def lines(*rows):
    return "".join(row + "\n" for row in rows)


@pytest.mark.parametrize("sep, suffix", [(",", "csv"), (";", "csv"), ("|", "txt"), ("\t", "tsv")])
def test_a_table_reads_back_from_delimited_text(spark, trees, tmp_path, sep, suffix):
    trees.to_csv(tmp_path / f"orchard.{suffix}", sep=sep, index=False)
    df, meta = read_any(spark, str(tmp_path / f"orchard.{suffix}"))
    told = meta.first()
    assert (told["rows"], told["separator"], told["truncated"]) == (TREES, sep, False) and told["format"] in ("csv", suffix)
    kinds = dict(df.dtypes)
    assert {kinds[c] for c in ("height", "harvest")} == {"double"} and {kinds[c] for c in ("tree", "age", "sweet")} == {"bigint"}
    assert kinds["picked"] == "timestamp" and df.where("buyer IS NOT NULL").isEmpty()
    read = df.orderBy("tree").toPandas()
    assert read["remark"].tolist() == trees["remark"].tolist() and read["harvest"].to_numpy() == pytest.approx(trees["harvest"].to_numpy())


@pytest.mark.parametrize("name, write_to", [
    ("t.parquet", lambda t, p: t.to_parquet(p)), ("t.ndjson", lambda t, p: t.to_json(p, orient="records", lines=True)),
    ("t.json", lambda t, p: t.to_json(p, orient="records"))])
def test_other_formats_give_the_same_rows(spark, trees, tmp_path, name, write_to):
    part = trees[["tree", "variety", "height"]]
    write_to(part, tmp_path / name)
    df, meta = read_any(spark, str(tmp_path / name))
    assert sorted(df.columns) == ["height", "tree", "variety"] and meta.first()["rows"] == TREES
    assert df.agg({"tree": "sum"}).first()[0] == part["tree"].sum()


def test_a_strange_suffix_is_refused_with_those_that_are_read(spark, tmp_path):
    with pytest.raises(ReadError, match="supported.*parquet"):
        read_any(spark, write(tmp_path, "drawing.svg", "<svg/>"))


def test_a_row_limit_is_kept_and_told(spark, trees, tmp_path):
    trees.to_csv(tmp_path / "orchard.csv", index=False)
    for wanted, cut in ((7, True), (TREES + 1, False)):
        df, meta = read_any(spark, str(tmp_path / "orchard.csv"), nrows=wanted)
        assert (meta.first()["rows"], meta.first()["truncated"]) == (min(wanted, TREES), cut) and df.count() == min(wanted, TREES)


def test_headers_are_named_apart_and_hollow_columns_go(spark, tmp_path):
    df, _ = read_any(spark, write(tmp_path, "h.csv", lines("k, k ,Unnamed: 2,,k", "1,x,,p,7", "2,y,,q,8", "3,z,,r,9")))
    assert df.columns == ["k", "k_2", "column_2", "k_3"]
    assert [tuple(r) for r in df.orderBy("k").collect()] == [(1, "x", "p", 7), (2, "y", "q", 8), (3, "z", "r", 9)]


def test_a_quoted_header_may_hold_the_separator(spark, tmp_path):
    df, _ = read_any(spark, write(tmp_path, "q.csv", lines('"north; upper";"yield, kg"', "2;31.5", "4;28.25")))
    assert df.columns == ["north; upper", "yield, kg"]
    assert sorted(map(tuple, df.collect())) == [(2, 31.5), (4, 28.25)]


def test_cells_decide_whether_a_text_column_is_a_number(spark, tmp_path):
    rows = [f"{k}.5,{'' if k % 9 == 0 else k},{k:05d},{'n/a' if k == 3 else k}" for k in range(60)]
    kinds = dict(read_any(spark, write(tmp_path, "n.csv", lines("plain,holes,padded,words", *rows)))[0].dtypes)
    assert kinds == {"plain": "double", "holes": "bigint", "padded": "string", "words": "bigint"}


def test_days_become_moments_only_if_all_of_them_are(spark, tmp_path):
    rows = [f"2019-{k % 12 + 1:02d}-{k % 27 + 1:02d},{'later' if k == 5 else f'2019-05-{k % 27 + 1:02d}'}" for k in range(50)]
    kinds = dict(read_any(spark, write(tmp_path, "d.csv", lines("all,most", *rows)))[0].dtypes)
    assert (kinds["all"], kinds["most"]) == ("timestamp", "string")


def test_quoted_line_breaks_are_kept(spark, tmp_path):
    df, _ = read_any(spark, write(tmp_path, "q.csv", 'a,b\n1,"two\nlines ""quoted"""\n2,plain\n'))
    assert df.count() == 2 and df.where("a = 1").first()["b"] == 'two\nlines "quoted"'


def test_headers_of_a_folder_are_aligned_by_name(spark, tmp_path):
    folder = tmp_path / "a folder.csv"
    folder.mkdir()
    (folder / "1.csv").write_text("id,v\n1,x\n2,y\n")
    (folder / "2.csv").write_text('v,id,more\n"z\nz",3,0.5\n')
    (folder / "3.csv").write_text("id,v\n4,5\" pipe\n")
    df = readers.read_csv(spark, str(folder))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "x", None), (2, "y", None), (3, "z\nz", 0.5), (4, '5" pipe', None)]


def test_rows_wider_than_the_header_are_refused(spark, tmp_path):
    with pytest.raises(ReadError, match="1 rows with more cells"):
        readers.read_csv(spark, write(tmp_path, "wide.csv", "a,b\n1,2,3\n4,5\n6\n"))
    short = readers.read_csv(spark, write(tmp_path, "short.csv", "a,b\n6\n4,5\n"))
    assert [tuple(r) for r in short.orderBy("a").collect()] == [(4, 5), (6, None)]


def test_a_header_may_break_its_line(spark, tmp_path):
    df = readers.read_csv(spark, write(tmp_path, "h.csv", '"one\nname",b\n1,2\n'))
    assert df.columns == ["one\nname", "b"] and tuple(df.first()) == (1, 2)


def test_long_integers_stay_exact(spark, tmp_path):
    text = "id,big\n9223372036854775806,10000000000000000000\n9223372036854775807,10000000000000000001\n"
    df = readers.read_csv(spark, write(tmp_path, "ids.csv", text))
    assert df.dtypes == [("id", "bigint"), ("big", "decimal(38,0)")]
    assert df.select("id").distinct().count() == 2 and df.select("big").distinct().count() == 2


def test_preview_is_safe_to_show(spark, frame):
    head = readers.preview(frame, 5, ["tree"])
    assert head.count() == 5 and dict(head.dtypes)["picked"] == "string"
    nan = spark.createDataFrame([(float("nan"),), (float("inf"),)], "x double")
    assert [r["x"] for r in readers.preview(nan).collect()] == [None, None]


def test_empty_tables_are_refused(spark):
    with pytest.raises(ReadError, match="no rows"):
        readers.require_rows(spark.createDataFrame([], "a int"), "x.csv")


SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>total</t></is></c><c r="C1" t="str"><v>day</v></c></row>
<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>1.5</v></c><c r="C2" s="1"><v>45292</v></c></row>
<row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3" s="1"><v>45293.5</v></c></row></sheetData></worksheet>"""


def workbook(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                                      '<sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><t>pune</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", SHEET)


def test_workbooks_of_a_folder(spark, tmp_path):
    for name in ("a.xlsx", "b.xlsx"):
        workbook(tmp_path / name)
    df, meta = read_any(spark, str(tmp_path / "*.xlsx"))
    assert meta.first()["rows"] == 4
    assert df.dtypes == [("name", "string"), ("total", "double"), ("day", "timestamp")]
    assert str(df.where("total is null").first()["day"]) == "2024-01-02 12:00:00"
    assert read_any(spark, str(tmp_path / "a.xlsx"), sheet="data")[1].first()["rows"] == 2
