"""Stores, domains and spreadsheets."""

import datetime
import re
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pagelumen.operators import domains, history
from pagelumen.sources import store
from pagelumen.sources.sheets import SheetSource

AUDITS = "brand_id string, audit_id string, created_at timestamp, overall_score int"


def audits(spark, rows):
    return spark.createDataFrame([(b, a, datetime.datetime(2024, 1, d), s) for b, a, d, s in rows], AUDITS)


def test_repeated_batches_leave_one_set_of_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    first = audits(spark, [("x", "1", 1, 50), ("x", "2", 2, 70), ("y", "3", 1, 10), ("y", "3", 1, 12), (None, None, 3, 1)])
    second = audits(spark, [("x", "2", 2, 40), ("x", "4", 3, 90)]).withColumn("note", F.lit("again"))
    for _ in range(2):
        store.upsert(first, path, "audit_id", "007")
    rows = lambda: sorted((r.audit_id or "", r.overall_score) for r in store.current(spark, path, "audit_id").collect())
    assert rows() == [("", 1), ("1", 50), ("2", 70), ("3", 12)]
    for _ in range(2):
        store.upsert(second, path, "audit_id", "010")
    want = [("", 1), ("1", 50), ("2", 40), ("3", 12), ("4", 90)]
    assert rows() == want
    store.upsert(first, path, "audit_id", "007")  # an older batch once more changes nothing
    assert rows() == want
    current = store.current(spark, path, "audit_id")
    got = {r.brand_id: (r.audits, r.latest_score, r.previous_score, r.trend) for r in history.overview(current.where("brand_id is not null")).collect()}
    assert got == {"x": (3, 90, 40, "up"), "y": (1, 12, None, None)}
    assert {r.audit_id: r.delta for r in history.deltas(current.where("brand_id = 'x'")).collect()} == {"1": None, "2": -10, "4": 50}
    store.compact(spark, path, str(tmp_path / "small"), "audit_id")
    assert sorted((r.audit_id or "", r.overall_score) for r in store.current(spark, str(tmp_path / "small"), "audit_id").collect()) == want
    with pytest.raises(ValueError):
        store.upsert(first.withColumn("batch", F.lit(1)), path, "audit_id", "011")


def test_a_failed_run_leaves_the_store_as_it_was(spark, tmp_path):
    path = str(tmp_path / "store")
    store.upsert(audits(spark, [("x", "1", 1, 50)]), path, "audit_id", "1")
    broken = audits(spark, [("x", "1", 1, 99), ("x", "2", 1, 98)]).withColumn("overall_score", F.when(F.col("audit_id") == "2", F.raise_error(F.lit("lost"))).otherwise(F.col("overall_score")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.upsert(broken, path, "audit_id", "2")
    assert [(r.audit_id, r.overall_score) for r in store.current(spark, path, "audit_id").collect()] == [("1", 50)]


def test_domains_as_the_codec_writes_them(spark):
    hosts = ["Bücher.example", "www.MÜNCHEN.de", "faß.de", "пример.испытание", "例え.テスト", "a.ＦＵＬＬ.com", "xn--bcher-kva.example", "plain.example", "é" * 70 + ".com", "ü..x", "straße.www.de", "İstanbul.com"]
    frame = spark.createDataFrame([(i, f" https://user@{h}:80/p?q#f") for i, h in enumerate(hosts)] + [(100, "  "), (101, None)], "i int, typed string").withColumn("domain", F.lit("theirs")).withColumn("host", F.lit("theirs"))
    got = {r.i: r.domain for r in domains.ascii_domains(frame, "typed").collect()}
    for i, h in enumerate(hosts):
        host = re.sub(r"^www\.", "", h.lower())
        try:
            host = re.sub(r"^www\.", "", host.encode("idna").decode("ascii").lower())
        except UnicodeError:
            pass
        assert got[i] == host, h
    assert got[100] is None and got[101] is None
    assert {r.host for r in domains.ascii_domains(frame, "typed").collect()} == {"theirs"}


def test_one_workbook_a_task(spark, tmp_path):
    spark.dataSource.register(SheetSource)
    rows = [(i, f"a <b> & \"c\" {i} \x07é", i % 2 == 0, None if i == 3 else i / 4, Decimal("1.50"), datetime.date(2024, 1, 2)) for i in range(20)]
    frame = spark.createDataFrame(rows, "n long, text string, flag boolean, x double, d decimal(5,2), day date").repartition(3, "n")
    for _ in range(2):
        frame.write.format("sheets").option("title", "A & B").mode("overwrite").save(str(tmp_path / "out"))
    files = sorted((tmp_path / "out").iterdir())
    assert 1 <= len(files) <= 3 and all(f.name.startswith("part-") for f in files)
    texts = []
    for f in files:
        with zipfile.ZipFile(f) as z:
            assert 'name="A &amp; B"' in z.read("xl/workbook.xml").decode()
            body = z.read("xl/worksheets/sheet1.xml").decode()
        lines = re.findall(r"<row>(.*?)</row>", body)
        assert re.findall(r"<t[^>]*>(.*?)</t>", lines[0]) == ["n", "text", "flag", "x", "d", "day"]
        texts += lines[1:]
    assert len(texts) == 20
    assert any(t.startswith("<c><v>3</v></c>") and "a &lt;b&gt; &amp; \"c\" 3  é" in t and "<c/>" in t and "<c><v>1.50</v></c>" in t and "2024-01-02" in t for t in texts)
    frame.limit(0).write.format("sheets").mode("overwrite").save(str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []
