import numpy as np
import pytest

from lodestone.operators import vector, vector_index

SCHEMA = "id long, part_number int, content_type string, embedding array<float>"


def _rows(spark, vectors):
    return spark.createDataFrame([(i, i % 3, "text", None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], SCHEMA)


def _pairs(df):
    return [(r["id"], None if r["score"] is None else round(r["score"], 9)) for r in df.collect()]


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 16))
    vectors = [centres[i % 12] + draw.normal(size=16) * 0.05 for i in range(600)]
    vectors += [vectors[3]] * 4 + [None, np.zeros(16), [float("inf")] * 16, [1.0, 2.0]]
    rows, folder = _rows(spark, vectors).cache(), str(tmp_path_factory.mktemp("index"))
    vector_index.build(rows, folder, cells=24)
    return rows, folder, vectors


@pytest.mark.parametrize("limit", [1, 5, 20, 600])
@pytest.mark.parametrize("part", [None, 1])
def test_the_index_gives_what_a_scan_gives(spark, clustered, limit, part):
    rows, folder, vectors = clustered
    for k in (0, 3, 77):
        asked = [float(x) for x in vectors[k]]
        want = _pairs(vector.search(rows, asked, limit, part=part))
        assert str(_pairs(vector_index.search(spark, folder, asked, limit, part=part))) == str(want)


def test_cells_out_of_reach_are_not_read(spark, tmp_path):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(12, 16))
    vectors = [centres[i % 12] + draw.normal(size=16) * 0.02 for i in range(1200)]
    rows, folder = _rows(spark, vectors), str(tmp_path)
    vector_index.build(rows, folder, cells=24)
    asked = [float(x) for x in vectors[0]]
    assert _pairs(vector_index.search(spark, folder, asked, 5)) == _pairs(vector.search(rows, asked, 5))
    cells = spark.read.parquet(f"{folder}/rows").groupBy("cell").count().collect()
    read = vector_index.reached(spark, folder, asked, 5)
    assert sum(c["count"] for c in cells if c["cell"] in read) < 1200 / 2
    assert "PartitionFilters: [cell" in vector_index.search(spark, folder, asked, 5)._jdf.queryExecution().toString()


def test_other_dimensions_zero_queries_and_empty_tables(spark, clustered, tmp_path):
    rows, folder, _ = clustered
    assert str(_pairs(vector_index.search(spark, folder, [0.0] * 16, 3))) == str(_pairs(vector.search(rows, [0.0] * 16, 3)))
    assert len(_pairs(vector_index.search(spark, folder, [1.0, 2.0], 3))) == 3
    vector_index.build(rows.limit(0), str(tmp_path / "none"), cells=4)
    assert vector_index.search(spark, str(tmp_path / "none"), [1.0] * 16, 3).count() == 0
    with pytest.raises(ValueError, match="cell"):
        vector_index.build(rows.withColumnRenamed("part_number", "cell"), str(tmp_path / "clash"))
