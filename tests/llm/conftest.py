import pytest

from tests.llm.frames import documents


@pytest.fixture(scope="package", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="package")
def rows(spark):
    """(doc_id, text) of the smallest documents, with nulls, empty and very long texts, repeats and odd characters."""
    return documents(spark)


@pytest.fixture
def docs(spark, rows):
    """As a frame with columns whose names operators might use themselves."""
    clashing = ["key", "n", "bucket", "chunk", "size", "start", "spans", "kind", "label", "_id"]
    listed = [(i, t, *["x"] * len(clashing)) for i, t in rows]
    schema = "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in clashing)
    return spark.createDataFrame(listed, schema).repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
