"""Zip members as partitions: what is not asked for is not unpacked, sheets come as they are stored."""

import zipfile

import pytest

from reachgrid.operators import census
from reachgrid.sources import archives, feeds

TRIPS = "﻿ Trip_ID ,service_id\r\nt1,\"A,1\"\r\n, \r\nt2\r\n"


@pytest.fixture()
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("sub/Trips.TXT", TRIPS)
        z.writestr("sub/stops.txt", "stop_id\n" + "s\n" * 1000)
        z.writestr("readme.md", "x")
        z.writestr("empty.txt", "")
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("trips.txt", "service_id,trip_id,extra\nB,t1,e\n")
    data = bytearray((tmp_path / "one.zip").read_bytes())
    at = data.index(b"stops.txt") + 20  # the packed stops are broken
    data[at:at + 4] = b"\xff\xff\xff\xff"
    (tmp_path / "one.zip").write_bytes(bytes(data))
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    (tmp_path / "other.csv").write_text("not an archive")
    return str(tmp_path)


def test_one_table_leaves_the_others_packed(spark, folder):
    got = feeds.read_table(spark, folder, "trips.txt", ["trip_id", "service_id", "shape_id"])
    assert sorted((r.feed, r.row_no, r.trip_id, r.service_id, r.shape_id) for r in got.collect()) == [
        ("one", 1, "t1", "A,1", None), ("one", 3, "t2", None, None), ("two", 1, "t1", "B", None)]
    rows = archives.read_feeds(spark, folder, "trips.txt")
    assert sorted((r.feed, r.row_no) for r in rows.collect()) == [("broken", -1), ("one", 0), ("one", 1), ("one", 3), ("two", 0), ("two", 1)]
    assert rows.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="(?i)zip|crc|zlib|decompress"):
        archives.read_feeds(spark, folder, "stops.txt").collect()


def test_files_are_listed_without_unpacking(spark, folder):
    rows = archives.read_feeds(spark, folder, files_only=True)
    assert rows.rdd.getNumPartitions() == 6  # four members, one, and the broken archive
    assert sorted((r.feed, r.file) for r in feeds.feed_files(rows).collect()) == [
        ("one", "empty.txt"), ("one", "readme.md"), ("one", "stops.txt"), ("one", "trips.txt"), ("two", "trips.txt")]
    assert [r.feed for r in feeds.unreadable(rows).collect()] == ["broken"]


def test_no_archives_and_wrong_options(spark, tmp_path):
    assert feeds.read_table(spark, str(tmp_path), "trips.txt", ["a"]).count() == 0
    with pytest.raises(Exception, match="name it"):
        archives.read_feeds(spark, str(tmp_path), None, ["a"])
    with pytest.raises(Exception, match="nowhere"):
        archives.read_feeds(spark, str(tmp_path / "nowhere")).collect()


def test_written_archives_come_back(spark, tmp_path):
    table = spark.range(50_000).selectExpr("cast(id as string) trip_id", "concat('x,\"', id % 3, '\"\\n') name").repartition(3)
    assert archives.write_feeds(table, str(tmp_path / "out"), "trips.txt") == 3
    back = feeds.read_table(spark, str(tmp_path / "out"), "trips.txt", ["trip_id", "name"])
    want = table.selectExpr("trip_id", "trim(trailing '\\n' from name) name")
    assert back.select("trip_id", "name").exceptAll(want).count() == 0 and back.count() == 50_000
    assert archives.write_feeds(table.limit(0), str(tmp_path / "none"), "trips.txt") == 0


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{OFFICE}"><sheets><sheet name="Dane &amp; opis" sheetId="1" r:id="rId2"/>'
                   '<sheet name="Wykres" sheetId="5" r:id="rId9"/><sheet name="Spis" sheetId="2" r:id="rId1"/></sheets></workbook>')
        rel = '<Relationship Id="{}" Type="' + OFFICE + '/{}" Target="{}"/>'
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + rel.format(
            "rId1", "worksheet", "/xl/worksheets/sheet7.xml") + rel.format("rId2", "worksheet", "worksheets/sheet1.xml") + rel.format("rId9", "chartsheet", "c.xml")
            + rel.format("rId3", "sharedStrings", "sharedStrings.xml") + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst {MAIN}><si><t>Symbol jednostki</t></si><si><r><t>Struk</t></r><r><t>tura</t></r><rPh sb="0" eb="1"><t>no</t></rPh></si>'
                   "<si><t>ogółem</t></si><si><t>rejon statystyczny</t></si><si><t>obwód spisowy</t></si><si><t/></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {MAIN}><sheetData><row r="2"><c r="B2" t="inlineStr"><is><t>note</t></is></c><c r="AA2"><v>1.50</v></c></row>'
                   '<row><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><f>A1</f><v>made</v></c><c><f>1+1</f></c><c t="s"><v>5</v></c><c><v>1E3</v></c><c><v>007</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet7.xml", f'<worksheet {MAIN}><sheetData><row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c></row>'
                   '<row r="5"><c r="C5" t="s"><v>2</v></c></row><row r="6"><c r="A6"><v>12345</v></c><c r="B6" t="s"><v>3</v></c></row>'
                   '<row r="8"><c r="A8"><v>7</v></c><c r="B8" t="s"><v>4</v></c><c r="C8"><v>210</v></c></row>'
                   '<row r="9"><c r="A9"><v>7</v></c><c r="B9" t="s"><v>4</v></c><c r="C9"><v>4</v></c></row></sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "Ludność.xlsx")
    first = archives.read_workbooks(spark, str(tmp_path)).collect()
    assert [(r.workbook, r.sheet, r.row_no) for r in first] == [("Ludność", "Dane & opis", 2), ("Ludność", "Dane & opis", 3)]
    assert first[0].cells == [None, "note", *[None] * 24, "1.5"]
    assert first[1].cells == ["True", "#N/A", "made", None, "", "1000.0", "7"]
    rows = archives.read_workbooks(spark, str(tmp_path / "Ludność.xlsx"), "Spis")
    header = census.find_header(rows, "ogółem")
    assert [tuple(r) for r in header.collect()] == [("Spis", 5, 0, 1, 2)]
    tracts = census.tract_population(census.sheet_records(rows.drop("workbook"), header)).collect()
    assert [tuple(r) for r in tracts] == [("Spis", "0123457", 214.0, 2)]
    every = archives.read_workbooks(spark, str(tmp_path), "*")
    assert every.rdd.getNumPartitions() == 2 and every.count() == 7
    with pytest.raises(Exception, match="Dane & opis, Spis"):
        archives.read_workbooks(spark, str(tmp_path), "Nie ma").collect()


def test_written_workbooks_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(s, n, [None if n % 3 == 0 else f"<{n}> & \"x\" ", "", s]) for s in ("a", 'b"<') for n in range(1, 30, 2)], "sheet string, row_no long, cells array<string>")
    assert archives.write_workbooks(rows.repartition(2, "sheet").sortWithinPartitions("sheet", "row_no"), str(tmp_path)) == 2
    back = archives.read_workbooks(spark, str(tmp_path), "*").drop("workbook")
    assert back.exceptAll(rows).count() == 0 and back.count() == rows.count()
