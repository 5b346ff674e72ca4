"""Layouts and loads on disk: versions of parts, logs of streams, providers, shapes, vector codes and lookups."""

import json
import math
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.operators import embedding, lookup, migrations, prose, vector, vector_codes, versions
from lodestone.plans.storage_queries import Backwards
from lodestone.sources import files, shapes
from lodestone.sources.xmlnodes import parse
from lodestone.streaming import usage

ROWS = "id int, part_number int, t string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_part_is_replaced_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")], ROWS)
    assert versions.load(one, path) == {"1": {"deleted": 0, "inserted": 2}, "2": {"deleted": 0, "inserted": 1}}
    before = versions.read(spark, path, one.schema)
    lost = versions.stage(spark.createDataFrame([(9, 1, "lost")], ROWS), path, 1)  # a writer that ends here
    assert rows_of(versions.read(spark, path, one.schema)) == rows_of(one)
    assert versions.replace_part(spark.createDataFrame([(7, 1, "new")], ROWS), path, 1) == {"deleted": 2, "inserted": 1}
    assert rows_of(versions.read(spark, path, one.schema)) == [(3, 2, "c"), (7, 1, "new")]
    assert rows_of(before) == rows_of(one)  # a reader that came before sees what was there
    for faulty in (one.limit(0), one):
        with pytest.raises(ValueError):
            versions.replace_part(faulty, path, 1)
    assert rows_of(versions.read(spark, path, one.schema)) == [(3, 2, "c"), (7, 1, "new")]
    assert versions.vacuum(spark, path) == 0 and versions.vacuum(spark, path, older=0) == 2  # the first version of part 1, and what was lost
    assert rows_of(versions.read(spark, path, one.schema)) == [(3, 2, "c"), (7, 1, "new")] and not (tmp_path / "t" / lost["folder"]).exists()
    assert versions.read(spark, str(tmp_path / "none"), one.schema).collect() == []


def test_a_writer_that_dies_with_the_lock_holds_nobody_up_for_long(spark, tmp_path):
    path, row = str(tmp_path / "t"), spark.createDataFrame([(1, 1, "a")], ROWS)
    versions.replace_part(row, path, 1)
    (tmp_path / "t" / "log" / "1" / "000000000002").touch()  # taken, never finished
    assert rows_of(versions.read(spark, path, row.schema)) == [(1, 1, "a")]
    assert versions.replace_part(row.withColumn("t", F.lit("b")), path, 1, wait=0.2) == {"deleted": 1, "inserted": 1}
    assert rows_of(versions.read(spark, path, row.schema)) == [(1, 1, "b")]


def test_writers_of_one_part_come_one_after_the_other(spark, tmp_path):
    path, writers = str(tmp_path / "t"), 5
    versions.replace_part(spark.createDataFrame([(0, 1, "w0")], ROWS), path, 1)
    staged = [versions.stage(spark.range(n).selectExpr("CAST(id AS INT) AS id", "1 AS part_number", f"'w{n}' AS t"), path, 1) for n in range(1, writers + 1)]
    start, found = threading.Barrier(writers), [None] * writers

    def write(i):
        start.wait()
        found[i] = versions.commit(spark, path, 1, staged[i])

    threads = [threading.Thread(target=write, args=(i,)) for i in range(writers)]
    [t.start() for t in threads], [t.join() for t in threads]
    left = {r.t for r in versions.read(spark, path, spark.createDataFrame([], ROWS).schema).collect()}
    assert len(left) == 1  # the rows of one writer, all of them
    last = int(left.pop()[1:])
    # Each replaces the rows of the one before it: every version but the last was deleted once.
    assert sorted(x["inserted"] for x in found) == [1, 2, 3, 4, 5]
    assert sorted([x["deleted"] for x in found] + [last]) == sorted([1, *range(1, writers + 1)])


def test_a_batch_run_again_is_written_once(spark, tmp_path):
    schema = "id long, tool string"
    spark.range(30).selectExpr("id", "'search' AS tool").repartitionByRange(3, "id").write.parquet(str(tmp_path / "in"))
    stream = usage.read(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    for _ in range(2):
        usage.log(stream, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.id for r in usage.logged(spark, str(tmp_path / "log"), schema).collect()) == list(range(30))
    commits = sorted(x for x in (tmp_path / "ck" / "commits").iterdir() if x.name.isdigit())
    assert len(commits) == 3
    folder = tmp_path / "log" / "stream=usage" / "batch=2"
    before = sorted(x.name for x in folder.iterdir())
    for again in ("finished", "half written"):
        (commits[-1]).unlink()
        (tmp_path / "ck" / "commits" / f".{commits[-1].name}.crc").unlink()
        if again == "half written":
            (folder / "_SUCCESS").unlink()
        usage.log(stream, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
        assert (sorted(x.name for x in folder.iterdir()) == before) == (again == "finished")
        assert sorted(r.id for r in usage.logged(spark, str(tmp_path / "log"), schema).collect()) == list(range(30))
    usage.log(stream, str(tmp_path / "log"), str(tmp_path / "other"), "second").awaitTermination()
    assert usage.logged(spark, str(tmp_path / "log"), schema).count() == 60


def test_calls_are_ordered_tried_again_paced_and_checked():
    slept, now = [], [0.0]

    def sleep(x):
        slept.append(x)
        now[0] += x

    caller = embedding.Caller(embedding.Provider(Backwards(), 2, batch=5, pause=2.0, first_wait=0.25), sleep, lambda: now[0])
    for texts in (["a", "b c"], ["ddd"], ["e f g", "h"], ["i"]):
        assert caller(texts) == [[float(len(x)), float(x.count(" "))] for x in texts]
    assert 0.25 in slept and now[0] >= 2.0 * 4  # five tries, no two within two seconds

    def broken(texts):
        raise ConnectionError("down")

    waits = []
    with pytest.raises(RuntimeError, match="not embedded after 3 tries: down"):
        embedding.Caller(embedding.Provider(broken, 2, tries=3, first_wait=1.0), waits.append)(["x"])
    assert waits == [1.0, 2.0]
    for answer in ([(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (0, [1.0, 2.0])], [(0, [1.0, 2.0]), (2, [1.0, 2.0])]):
        with pytest.raises(RuntimeError):
            embedding.Caller(embedding.Provider(lambda texts, a=answer: a, 2, tries=1))(["x", "y"])
    with pytest.raises(embedding.ProviderError):
        embedding.Caller(embedding.Provider(lambda texts: [(0, [1.0])], 2))(["x"])


def test_rows_get_the_vectors_of_their_own_texts(spark):
    texts = [(i, None if i % 7 == 0 else "" if i % 11 == 0 else "w " * (i % 13) + str(i), "old") for i in range(500)]
    df = spark.createDataFrame(texts, "id int, body string, v string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")  # batches smaller than calls
    try:
        got = embedding.embed(df, embedding.Provider(Backwards(), 2, batch=40, first_wait=0.001), "body", "v").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.id, tuple(r.v) if r.v else None) for r in got} == {(i, None if x is None else (float(len(x)), float(x.count(" ")))) for i, x, _ in texts}
    assert embedding.embed(df.limit(0), embedding.hashed(8), "body", "v").collect() == []
    with pytest.raises(Exception, match="not embedded"):
        embedding.embed(df, embedding.Provider(lambda texts: 1 / 0, 2, tries=2, first_wait=0.0), "body", "v").collect()
    assert embedding.embed_query("a b", embedding.hashed(16)) == vector.embed_text("a b", 16).tolist()


class Service(BaseHTTPRequestHandler):
    calls = 0

    def do_POST(self):
        Service.calls += 1
        sent = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        texts = sent.get("input") or sent.get("texts") or [x["content"]["parts"][0]["text"] for x in sent["requests"]]
        if Service.calls % 4 == 1 or self.headers.get("Authorization", "Bearer k") != "Bearer k":
            self.send_error(503)
            return
        vectors = [[float(len(x)), 1.0] for x in texts]
        rows = [{"index": i, "embedding": v} for i, v in enumerate(vectors)]
        random.Random(len(texts)).shuffle(rows)
        body = {"/list": {"data": rows}, "/floats": {"embeddings": {"float": vectors}}, "/values": {"embeddings": [{"values": v} for v in vectors]}}[self.path]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


def test_services_over_http(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        df = spark.createDataFrame([(i, "x" * i) for i in range(1, 60)], "id int, body string").repartition(2)
        for name, path in (("openai", "/list"), ("voyage", "/list"), ("cohere", "/floats"), ("google", "/values")):
            own = embedding.service(name, at + path, "k", dimensions=2, batch=10, first_wait=0.01)
            assert own.model == embedding.MODELS[name][0]
            assert all(r.v == [float(r.id), 1.0] for r in embedding.embed(df, own, "body", "v").collect())
        with pytest.raises(RuntimeError, match="503"):
            embedding.embed_query("x", embedding.service("openai", at + "/list", "wrong", dimensions=2, tries=2, first_wait=0.01))
        with pytest.raises(ValueError):
            embedding.service("nobody", at, "k")
    finally:
        server.shutdown()


def test_shapes_keep_their_order_and_conflicts_fail(spark, tmp_path):
    listed = [("z", ["b", "a"]), ("y", []), ("z", ["b", "a"]), ("x & <q>", ["é", "a"]), ("w", ["a"])]
    shapes.write_shapes(spark.createDataFrame(listed, "name string, guides array<string>").coalesce(1), str(tmp_path / "s"))
    got = shapes.read_shapes(spark, str(tmp_path / "s")).orderBy("place").collect()
    assert [(r.name, r.guides) for r in got] == [listed[0], listed[1], listed[3], listed[4]]
    (tmp_path / "s" / "more.xml").write_text('<?xml version="1.0"?>\n<shapes><shape name="solo"/><shape><avLst/></shape><shape name="v"><avLst><gd/><gd name="g" fmla="1"/></avLst><path/></shape></shapes>')
    assert {(r.name, tuple(r.guides)) for r in shapes.read_shapes(spark, str(tmp_path / "s")).collect()} >= {("solo", ()), ("v", ("g",)), ("w", ("a",))}
    (tmp_path / "s" / "other.xml").write_text('<shapes><shape name="w"><avLst><gd name="b"/></avLst></shape></shapes>')
    with pytest.raises(Exception, match="conflicting guides for w"):
        shapes.read_shapes(spark, str(tmp_path / "s")).collect()


def test_one_large_file_of_shapes_is_many_tasks(spark, tmp_path):
    shapes.write_shapes(spark.range(5000).selectExpr("concat('s', id) AS name", "array(concat('g', id), 'h') AS guides").coalesce(1), str(tmp_path / "s"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = shapes.xml_rows(spark, str(tmp_path / "s"), "shape", shapes.ROW)
        assert rows.rdd.getNumPartitions() > 4
        got = shapes.read_shapes(spark, str(tmp_path / "s")).orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.name, r.guides) for r in got] == [(f"s{i}", [f"g{i}", "h"]) for i in range(5000)]


def test_shapes_named_by_their_elements(spark):
    xml = '<presetShapeDefinitons><b><gd name="no"/><avLst><gd name="k2"/><gd/><x name="no"/><gd name="k1"/></avLst><avLst><gd name="no"/></avLst></b><a><p/></a><b><avLst><gd name="k2"/><gd name="k1"/></avLst></b></presetShapeDefinitons>'
    nodes = lambda x: parse(spark.createDataFrame([("f", x)], "path string, xml string"))
    assert [(r.name, r.guides) for r in shapes.shapes_of(nodes(xml)).orderBy("place").collect()] == [("b", ["k2", "k1"]), ("a", [])]
    for faulty in ("<other><a/></other>", "<presetShapeDefinitons/>", xml.replace('name="k1"/></avLst></b></p', 'name="k3"/></avLst></b></p')):
        with pytest.raises(Exception, match="no presetShapeDefinitons root|no shapes|conflicting"):
            shapes.shapes_of(nodes(faulty)).collect()


def test_codes_give_what_a_scan_gives(spark, tmp_path):
    rng = np.random.default_rng(4)
    made = rng.normal(size=(600, 24))
    rows = [(i, i % 3 + 1, "text" if i % 2 else "table", [float(np.float32(x)) for x in v]) for i, v in enumerate(made)]
    rows += [(700, 1, "text", rows[5][3]), (5, 1, "text", rows[5][3]), (701, 1, "text", [0.0] * 24), (702, 1, "text", None), (703, 1, "text", [1.0, 2.0]), (704, 2, "text", [math.inf] + [0.0] * 23)]
    df = spark.createDataFrame(rows, "id int, part_number int, content_type string, embedding array<float>").repartition(3)
    folder = str(tmp_path / "codes")
    vector_codes.build(df, folder)
    show = lambda x: [(r.id, None if r.score is None else "nan" if math.isnan(r.score) else round(r.score, 9)) for r in x.collect()]
    known = df.where("embedding IS NOT NULL AND size(embedding) = 24")
    for query, limit, part in ((rows[5][3], 5, None), (rows[80][3], 20, 2), ([-x for x in rows[3][3]], 7, None), (rows[0][3], 2000, None), ([0.0] * 24, 3, None)):
        want = show(vector.search(known, query, limit, part=part))
        got = [x for x in show(vector_codes.search(spark, folder, query, limit + 5, part=part)) if x[0] != 703][:limit]
        assert got == want
    assert spark.read.parquet(f"{folder}/codes").where("_code IS NULL").count() == 3
    vector_codes.build(df.limit(0), str(tmp_path / "none"))
    assert vector_codes.search(spark, str(tmp_path / "none"), rows[0][3], 3).collect() == []


def test_codes_read_less_than_half_of_the_vectors(spark, tmp_path):
    """Bytes of the codes, and of the pages of whole vectors that hold a candidate."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    folder = str(tmp_path / "codes")
    vector_codes.build(vectors, folder, "vec_id")
    query = vectors.orderBy("vec_id").first()["embedding"]
    files = list((tmp_path / "codes").glob("*/*.parquet"))
    size = lambda kind, column: sum(pq.ParquetFile(f).metadata.row_group(g).column(c).total_compressed_size for f in files if f.parent.name == kind for g in range(pq.ParquetFile(f).metadata.num_row_groups) for c in range(pq.ParquetFile(f).metadata.num_columns) if column in pq.ParquetFile(f).metadata.row_group(g).column(c).path_in_schema)
    whole, codes = size("rows", "embedding"), size("codes", "_code")
    found = vector_codes.search(spark, folder, query, 20, id_col="vec_id")
    scanned = lookup.rows_scanned(found)
    share = (codes + whole * scanned / vectors.count()) / whole
    print(f"rows read whole: {scanned}, share of the vectors' bytes: {share:.2f}")
    assert [r.vec_id for r in found.collect()] == [r.vec_id for r in vector.search(vectors, query, 20, "vec_id").collect()]
    assert share < 0.5


def test_a_point_lookup_reads_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(60_000).selectExpr("id AS k", "(id * 7919) % 60000 AS other", "CASE WHEN id = 9 THEN NULL ELSE concat('name ', id) END AS name")
    lookup.write_sorted(df.repartition(4), path, "k", {"other": 2_000}, 16 << 10)
    groups = sum(pq.ParquetFile(f).metadata.num_row_groups for f in (tmp_path / "t").glob("*.parquet"))
    assert groups > 30
    for found in (lookup.lookup(spark, path, k=31_234), lookup.lookup(spark, path, other=31_234)):
        assert found.count() == 1 and lookup.rows_scanned(found) <= 60_000 / 10
    assert [r.k for r in lookup.lookup(spark, path, name=None).collect()] == [9]
    rows = spark.read.parquet(path)
    asked = spark.createDataFrame([(100,), (105,), (105,), (None,), (99_999_999,)], "k long")
    assert sorted(r.k for r in lookup.lookup_many(rows, asked.where("k < 60000"), "k").collect()) == [100, 105]
    assert lookup.lookup_many(rows, asked.limit(0), "k").collect() == []


def test_buckets_meet_without_a_shuffle(spark, tmp_path):
    a = lookup.write_bucketed(spark.range(5000).selectExpr("id % 700 AS k", "id"), "bucketed_a", str(tmp_path / "a"), "k", 4)
    b = lookup.write_bucketed(spark.range(700).selectExpr("id AS k", "id * 2 AS w"), "bucketed_b", str(tmp_path / "b"), "k", 4)
    joined = a.join(b.hint("merge"), "k").groupBy("k").agg(F.count("*").alias("n"), F.max("w").alias("w"))
    assert lookup.exchanges(joined) == 0 and sum(r.n for r in joined.collect()) == 5000
    plain = spark.range(700).selectExpr("id AS k").hint("merge")
    assert lookup.exchanges(a.join(plain, "k")) > 0


def test_migrations_are_tracked_locked_and_recorded_together(spark, tmp_path):
    path = str(tmp_path / "ledger")
    every = spark.createDataFrame([(f"{i:02d}.sql", f"c{i}") for i in range(4)], "name string, checksum string")
    ran = []
    with pytest.raises(migrations.Untracked):
        migrations.migrate(every, path, ran.append)
    migrations.baseline(every.where("name < '02'"), path)
    with pytest.raises(ValueError, match="already"):
        migrations.baseline(every, path)

    def fails(name):
        ran.append(name)
        if name == "03.sql":
            raise OSError("broken")

    with pytest.raises(OSError):
        migrations.migrate(every, path, fails)
    names = lambda: sorted(r["name"] for r in migrations.ledger(spark, path).collect())
    assert ran == ["02.sql", "03.sql"] and names() == ["00.sql", "01.sql"]  # the first of them ran, but nothing is recorded
    (tmp_path / "ledger" / "lock").touch()
    with pytest.raises(migrations.Locked):
        migrations.migrate(every, path, ran.append, wait=0.1)
    (tmp_path / "ledger" / "lock").unlink()
    assert migrations.migrate(every, path, ran.append) == ["02.sql", "03.sql"] and migrations.migrate(every, path, ran.append) == []
    assert names() == ["00.sql", "01.sql", "02.sql", "03.sql"] and not (tmp_path / "ledger" / "lock").exists()
    for faulty in (every.withColumn("checksum", F.lit("x")), every.where("name > '00.sql'")):
        with pytest.raises(Exception, match="has changed|is missing"):
            migrations.migrate(faulty, path, ran.append)
    assert not (tmp_path / "ledger" / "lock").exists()


def test_sources_are_verified_while_they_are_fetched(spark, tmp_path):
    import hashlib

    body = bytes(range(256)) * 9000
    (tmp_path / "a.bin").write_bytes(body)
    at, digest = f"file://{tmp_path}/a.bin", hashlib.sha256(body).hexdigest()
    manifest = lambda *rows: spark.createDataFrame(rows, "name string, url string, sha256 string")
    assert [(r["name"], r.sha256, bytes(r.content)) for r in prose.fetched(manifest(("a", at, digest.upper())), chunk=1000).collect()] == [("a", digest, body)]
    for faulty in (("a", at, "0" * 64), ("a", None, digest), ("a", at, None), ("a", at + "x", digest)):
        with pytest.raises(Exception, match="a: |No such file"):
            prose.fetched(manifest(faulty)).collect()
    assert prose.fetched(manifest(("a", at, digest)).limit(0)).collect() == []


def test_stage_documents_keep_their_records_in_order(spark, tmp_path):
    df = spark.range(40).selectExpr("id % 3 AS _file", "100 - id AS _at", "CAST(id AS STRING) AS sectionId", "'t' AS title")
    files.write_stage_documents(df.repartition(4), str(tmp_path / "s"), "_file", "_at")
    written = sorted((tmp_path / "s").glob("part-*"))
    assert len(written) == 3
    for file in written:
        ids = [int(x["sectionId"]) for x in json.loads(file.read_text())]
        assert ids == sorted(ids, reverse=True)
    assert files.stage(spark, str(tmp_path / "s"), files.SECTIONS).count() == 40


def test_search_of_many_equals_search_of_each(spark):
    rng = np.random.default_rng(8)
    vectors = [[float(np.float32(x)) for x in v] for v in rng.normal(size=(200, 8))]
    rows = [(i, i % 2 + 1, v) for i, v in enumerate(vectors)] + [(300, 1, vectors[3]), (3, 1, vectors[3]), (301, 1, [0.0] * 8), (302, 1, None), (303, 1, [1.0]), (None, 1, vectors[9])]
    df = spark.createDataFrame(rows, "id int, part_number int, embedding array<float>").repartition(4)
    asked = [(f"q{i}", vectors[i]) for i in range(12)] + [("zero", [0.0] * 8), ("none", None), ("short", [1.0])]
    queries = spark.createDataFrame(asked, "query_id string, embedding array<float>")
    for block in (1000, 5):
        found = {}
        for r in vector.search_many(df, queries, 6, part=1, block=block).collect():
            found.setdefault(r.query_id, []).append((r.place, r.id, round(r.score, 9)))
        assert set(found) == {f"q{i}" for i in range(12)} | {"short"}
        for name, v in asked[:12]:
            fine = df.where("size(embedding) = 8 AND embedding <> transform(embedding, x -> 0.0f)")
            want = [(k, r.id, round(r.score, 9)) for k, r in enumerate(vector.search(fine, v, 6, part=1).collect(), 1)]
            assert [x[2] for x in sorted(found[name])] == [x[2] for x in want]
            assert {x[1] for x in found[name]} == {x[1] for x in want} or None in {x[1] for x in want}
    assert vector.search_many(df, queries.limit(0), 3).collect() == [] == vector.search_many(df.limit(0), queries, 3).collect()


@pytest.mark.parametrize("copies", [False, True])
def test_search_of_many_holds_a_slice_of_the_pairs(copies):
    """Before, the first batch's pairs were all summed at once: a gigabyte here."""
    import tracemalloc

    rng = np.random.default_rng(9)
    n, asked, size = 4000, 500, 64
    vectors = np.repeat(rng.normal(size=(1, size)), n, axis=0) if copies else rng.normal(size=(n, size))
    q = rng.normal(size=(asked, size))
    rows = pa.table({"id": pa.array(range(n, 0, -1), pa.int64()), "v": pa.array(list(vectors))})
    queries = pa.table({"query_id": pa.array(range(asked), pa.int64()), "q": pa.array(list(q))})
    tracemalloc.start()
    found = vector._nearest(5)(rows, queries)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    near = (vectors @ q.T) / np.linalg.norm(vectors, axis=1)[:, None] / np.linalg.norm(q, axis=1)
    for k, name in enumerate(sorted(found["query_id"].unique().to_pylist())):
        ids = {i for j, i in zip(found["query_id"].to_pylist()[5 * k : 5 * k + 5], found["id"].to_pylist()[5 * k : 5 * k + 5], strict=True) if j == name}
        assert ids == (set(range(1, 6)) if copies else {n - int(i) for i in np.argsort(-near[:, name])[:5]})
