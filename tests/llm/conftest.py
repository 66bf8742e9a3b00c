import pytest

TEXT_SCHEMA = "doc_id long, text string, score double, cell int, id long, t string, n_words long, cell_id string"


@pytest.fixture(scope="session", autouse=True)
def checkpoints(spark, tmp_path_factory):
    """A checkpoint folder of the test run; one table file a partition is enough."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture
def table(spark):
    """Rows of (doc_id, text) with further columns whose names the operators use inside."""

    def build(rows):
        return spark.createDataFrame([(i, t, 0.5, 1, 2, "x", 3, "y") for i, t in rows], TEXT_SCHEMA)

    return build


LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
A = " ".join(f"alpha{i}" for i in range(80))
B = " ".join(f"beta{i}" for i in range(80))


@pytest.fixture
def odd(table):
    """Nulls, empty, blank, short and very long texts, ties, repeated rows and a null id."""
    return table([
        (1, A), (2, A + " tail"), (2, A + " tail"), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "one two"),
        (8, LONG), (9, LONG), (None, A), (10, B + " " + A), (11, "x\n" * 40), (12, B), (-3, B), (13, "ÄÖ ü ß"), (14, "z" * 70_000),
    ])
