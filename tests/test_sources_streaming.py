import hashlib
import io
import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row

from lodestone.sources import files
from lodestone.streaming import usage


def zipped(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in entries.items():
            z.writestr(name.replace("__", "/"), content)
    return out.getvalue()


def test_archives(spark):
    inner = zipped(deep__wml=b"x" * 9)
    middle = zipped(other=b"1", box=inner)
    outer = zipped(**{"middle.zip": middle, "a": b"2"})
    assert files.nested_entry(outer, ["middle.zip", "box", "deep/wml"]) == b"x" * 9
    assert files.find_entry(zipped(**{"a__in.zip": zipped(q__main="t")}), "main") == b"t" and files.find_entry(outer, "none") is None
    df = spark.createDataFrame([("p", bytearray(outer))], "path string, content binary")
    assert files.archive_entries(df, ["a"]).first()["content"] == b"2"


def test_manifest_and_stages(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"sources": [{"name": "a", "kind": "xsd"}, {"name": "b", "sha256": "00"}]}))
    (tmp_path / "none.json").write_text(json.dumps({"sources": []}))
    assert [r.name for r in files.manifest(spark, str(tmp_path / "m.json")).collect()] == ["a", "b"]
    assert files.source(spark, str(tmp_path / "m.json"), "b")["sha256"] == "00"
    with pytest.raises(ValueError):
        files.source(spark, str(tmp_path / "m.json"), "c")
    with pytest.raises(Exception, match="no sources"):
        files.manifest(spark, str(tmp_path / "none.json")).collect()
    (tmp_path / "s.json").write_text(json.dumps([{"sectionId": "1", "title": "t", "pageStart": 3}]))
    rows = files.stage(spark, str(tmp_path / "s.json"), files.SECTIONS)
    assert rows.first()["pageStart"] == 3
    files.write_stage(rows, str(tmp_path / "out"))
    assert spark.read.schema(files.SECTIONS).json(str(tmp_path / "out")).first()["title"] == "t"
    for value, good in ((4, True), (0, False), (1.5, False), (None, False)):
        (tmp_path / "o.json").write_text(json.dumps({"pageOffset": value}))
        if good:
            assert files.page_offset(spark, str(tmp_path / "o.json")) == 4
        else:
            with pytest.raises(ValueError):
                files.page_offset(spark, str(tmp_path / "o.json"))


def test_migrations_by_name(spark, tmp_path):
    for name in ("0002_b.sql", "0001_a.sql", "README.md"):
        (tmp_path / name).write_text(name)
    assert [r.name for r in files.migrations(spark, str(tmp_path)).collect()] == ["0001_a.sql", "0002_b.sql"]


def test_migrations_written_are_not_a_file_each(spark, tmp_path):
    """Before, each was a folder with a file, made and listed one by one."""
    bodies = {f"{i:04d}_x.sql": f"-- é {i}\nSELECT {i};" if i % 7 else None for i in range(2500)} | {"README.md": "no migration"}
    files.write_migrations(spark.createDataFrame(list(bodies.items()), "name string, content string").coalesce(2), str(tmp_path / "m"))
    assert len([x for x in (tmp_path / "m").rglob("*") if x.is_file() and not x.name.startswith((".", "_"))]) <= 2
    assert spark.read.parquet(str(tmp_path / "m")).count() >= 3
    found = files.archived_migrations(spark, str(tmp_path / "m")).collect()
    assert [(r.name, r.content) for r in found] == [(k, v or "") for k, v in sorted(bodies.items()) if k.endswith(".sql")]
    assert {r.checksum for r in found} == {hashlib.sha256((v or "").encode()).hexdigest() for k, v in bodies.items() if k.endswith(".sql")}


def test_stream_equals_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, f"u{i % 3}", "search" if i % 2 else "type", t0 + timedelta(minutes=7 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, user_id string, tool string, occurred_at timestamp")
    for part in range(3):
        df.where(f"id % 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for k, form in enumerate((usage.counts, lambda e: usage.counts(e, "1 hour", slide="30 minutes"), usage.sessions)):
        q = form(usage.read(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName(f"q{k}").outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(repr, spark.table(f"q{k}").collect())) == sorted(map(repr, form(df).collect()))
    q = usage.append(usage.once(usage.read(spark, str(tmp_path / "in"), df.schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_recorder_appends(spark, tmp_path):
    record = usage.recorder(spark, str(tmp_path / "log"))
    for tool in ("search", "type"):
        record(Row(user_id="u", client_id="c", tool=tool, surface="api", occurred_at=datetime(2024, 1, 1)))
    assert sorted(r.tool for r in spark.read.parquet(str(tmp_path / "log")).collect()) == ["search", "type"]


def test_recorder_gathers_rows_before_it_writes(spark, tmp_path):
    path, row = str(tmp_path / "log"), Row(user_id="u", client_id="c", tool="type", surface="api", occurred_at=datetime(2024, 1, 1))
    with usage.recorder(spark, path, rows=3) as record:
        for _ in range(2):
            record(row)
        assert not (tmp_path / "log").exists()
        for _ in range(2):
            record(row)
        assert spark.read.parquet(path).count() == 3
    assert spark.read.parquet(path).count() == 4 and len(list((tmp_path / "log").glob("*.parquet"))) == 2
