import hashlib

import pytest

from sievework.llm import warc_store as ws

LONG = "é" * 60


def run(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload int")
    ws.write_archive(df, str(tmp_path / "a"))
    return ws.read_archive(spark, str(tmp_path / "a"))


def test_records(spark, tmp_path):
    rows = [(3, "http://a/\r\nX: y", LONG, "", 1), (1, "http://b/", LONG, "", 1), (2, None, None, "", 1), (4, "u", "", "", 1), (5, "u", "x" * 99, "", 1), (6, "u", "x" * 99, "", 1), (None, "u", LONG, "", 1), (7, "http://a/café?q=日本", "y" * 300_000, "", 1)]
    archive = run(spark, rows, tmp_path)
    got = {r.page_id: r for r in ws.parse_records(archive).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in got.items()} == {
        3: ("revisit", 1, 120), 1: ("response", None, 120), 2: ("response", None, 0), 4: ("response", None, 0), 5: ("response", None, 99), 6: ("response", None, 99), None: ("revisit", 1, 120), 7: ("response", None, 300_000)}
    assert got[3].payload_digest == hashlib.sha256(LONG.encode()).hexdigest()
    records = {bytes(r.header): bytes(r.record) for r in archive.collect()}
    for head, record in records.items():
        payload = record[len(head) : -4]
        assert record.startswith(head) and record.endswith(b"\r\n\r\n") and (b"WARC-Type: revisit" in head) <= (payload == b"")
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4


def test_empty(spark, tmp_path):
    assert ws.parse_records(run(spark, [], tmp_path)).count() == 0


def test_repeated_rows_are_all_kept(spark, tmp_path):
    out = ws.parse_records(run(spark, [(1, "u", LONG, "", 1)] * 2 + [(2, "u", LONG, "", 1)], tmp_path)).collect()
    assert sorted((r.page_id, r.record_type) for r in out) == [(1, "response"), (1, "response"), (2, "revisit")]


def test_damage_is_found(spark, tmp_path):
    archive = run(spark, [(1, "u", LONG, "", 1)], tmp_path)
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="does not match"):
        ws.parse_records(archive.withColumn("payload", F.encode(F.lit("other"), "UTF-8"))).collect()


def test_files_other_tools_read(spark, tmp_path):
    import gzip

    archive = run(spark, [(i, "u", LONG if i % 2 else f"page {i}", "", 1) for i in range(20)], tmp_path)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("warc_payloads")]
    files = ws.write_warc_files(archive, str(tmp_path / "warc"), most=500).collect()
    assert sum(f.n_records for f in files) == 20 and len(files) > 1
    whole = b"".join(gzip.decompress((tmp_path / "warc" / f.file).read_bytes()) for f in files)
    assert sorted(whole.split(b"WARC/1.1\r\n")[1:]) == sorted(bytes(r.record).removeprefix(b"WARC/1.1\r\n") for r in archive.collect())
