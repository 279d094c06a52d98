import zlib

from pyspark.sql import functions as F

from rasterloom.llm import common


def test_words_and_remainders(spark):
    texts = [None, "", " a\tb\x0bc d ", "Éa B-c_1 漢", "x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = rows.orderBy("doc_id").select(common.words(F.col("text")).alias("w"), common.strict_words(F.col("text")).alias("s"), common.remainder(F.col("doc_id"), 5).alias("r")).collect()
    assert [r.w for r in got] == [[], [], ["a", "b", "c d"], ["Éa", "B-c_1", "漢"], ["x"]]
    assert [r.s for r in got] == [[], [], ["a", "b", "c d"], ["Éa", "b", "c", "1", "漢"], ["x"]]
    assert [r.r for r in got] == [zlib.crc32(str(i).encode()) % 5 for i in range(5)]


def test_stored_tables_can_be_cleared(spark):
    df = common.stored(spark.range(5), "t")
    assert df.count() == 5 and df.columns == ["id"]
    common.clear_stored(spark)
    try:
        df.count()
        raise AssertionError("the table is still there")
    except Exception as e:
        assert "rasterloom" in str(e) or "FILE_NOT_EXIST" in str(e) or "does not exist" in str(e)


def test_labelled_sample_is_bounded_and_seeded(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(1, 0), (None, 1), (200, None)], "doc_id long, quality int")
    a = {tuple(r) for r in common.labelled_sample(labels, "quality", 30, 1).collect()}
    assert len(a) == 30 and a == {tuple(r) for r in common.labelled_sample(labels, "quality", 30, 1).collect()}
    assert {tuple(r) for r in common.labelled_sample(labels, "quality", 500, 1).collect()} == {(i, i % 2) for i in range(100)}
