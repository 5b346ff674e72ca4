from lodestone.llm.store import lean

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_the_lowest_bound_of_rows_holds(spark):
    before, texts = spark.conf.get(KEY), spark.range(1)
    try:
        for own, asked, want in (("10000", 1_000, "1000"), ("0", 2_000, "2000"), ("1000", 2_000, "1000"), ("200", 1_000, "200")):
            spark.conf.set(KEY, own)
            assert lean(texts, asked) is texts and spark.conf.get(KEY) == want
    finally:
        spark.conf.set(KEY, before)
