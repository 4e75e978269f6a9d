import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from sievework.sources import batches, policy


def workbook(path):
    cell = lambda r, c, v: f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if not str(v).isdigit() else f'<c r="{c}{r}"><v>{v}</v></c>'
    sheet = lambda rows: '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(f'<row r="{i}">' + "".join(cell(i, "ABC"[j], v) for j, v in enumerate(row) if v is not None) + "</row>" for i, row in enumerate(rows, 1)) + "</sheetData></worksheet>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Day_1" sheetId="1" r:id="rId1"/><sheet name="Day_2" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/a.xml"/><Relationship Id="rId2" Target="worksheets/b.xml"/></Relationships>')
        z.writestr("xl/worksheets/a.xml", sheet([["S.No ", "Name", "Niche"], [1, "Ana", "Yoga"], [2, None, "Gym"]]))
        z.writestr("xl/worksheets/b.xml", sheet([["S.No", "Name", "Niche"], [1, "Bo", "Cafe"]]))


DAYS = [batches.Batch("Day_1", 1, {"S.No": "serial", "Name": "name", "Niche": "niche"}), batches.Batch("Day_2", 2, {"S.No": "serial", "Name": "name", "Niche": "fb_category"}, {"source": "Ads"})]


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    workbook(path)
    rows = batches.xlsx_batches(spark, path, DAYS).orderBy("batch_seq", "row_no").collect()
    assert [(r.batch, r.row_no, r.name, r.niche, r.fb_category, r.source, r.source_inferred) for r in rows] == [("Day_1", 1, "Ana", "Yoga", None, None, False), ("Day_1", 2, None, "Gym", None, None, False), ("Day_2", 1, "Bo", None, "Cafe", "Ads", True)]
    with pytest.raises(batches.SchemaMismatchError):
        batches.xlsx_batches(spark, path, DAYS[:1])
    assert batches.file_hash(path) == hashlib.sha256(open(path, "rb").read()).hexdigest()


def test_schema_is_exact(spark):
    df = spark.createDataFrame([(1, "x")], "`S.No` int, Name string")
    for cols in ({"S.No": "serial"}, {"S.No": "serial", "Name": "name", "Extra": "e"}):
        with pytest.raises(batches.SchemaMismatchError):
            batches.remap(df, batches.Batch("b", 1, cols))


def test_row_hash_does_not_depend_on_column_order(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    one, two = (df.select(batches.row_hash(df, c)).first()[0] for c in (["x", "y", "z"], ["z", "y", "x"]))
    assert one == two == hashlib.sha256(b"x=a\nz=c\n").hexdigest()


def test_policies(spark):
    gaz = {"cities": [{"slug": "bangalore", "name": "Bangalore", "state": "KA", "aliases": ["Bengaluru"]}, {"slug": "delhi", "name": "Delhi", "state": "Delhi"}], "localities": [{"name": "Indiranagar", "city": "bangalore"}], "states": [{"slug": "delhi-state", "name": "Delhi"}], "address_fragments": ["Road"], "non_places": ["Online"]}
    got = {r.key: (r.match, r.slug) for r in policy.gazetteer(spark, gaz).collect()}
    assert got == {"bangalore": ("exact", "bangalore"), "bengaluru": ("alias", "bangalore"), "delhi": ("exact", "delhi"), "indiranagar": ("locality", "bangalore"), "road": ("fragment", None), "online": ("non_place", None)}
    tax = {"verticals": [{"slug": "health", "label": "Health & Care"}, {"slug": "unclassified", "label": "None"}], "aliases": {"health": ["Clinic"]}}
    assert {r.alias: r.slug for r in policy.taxonomy(spark, tax).collect()}["health care"] == "health"
    for bad in (lambda: policy.gazetteer(spark, gaz | {"localities": [{"name": "x", "city": "none"}]}), lambda: policy.taxonomy(spark, {"verticals": []}), lambda: policy.rubric({"version": 1, "factors": {}}), lambda: policy.rubric({"version": 1, "factors": {"a": {"weight": 1}}, "parameters": {"channel_kinds": ["fax"]}}), lambda: policy.taxonomy(spark, tax | {"aliases": {"unclassified": ["Clinic"], "health": ["clinic"]}})):
        with pytest.raises(policy.PolicyError):
            bad()


def test_source_rows_are_dealt_evenly(spark):
    rows = batches.source_rows(spark, "/root/testdata/sf0.01")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 1815 and max(sizes) < 0.4 * sum(sizes)  # one file's split would hold most of them
