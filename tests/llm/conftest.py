import pytest
from pyspark.sql import functions as F

WORDS = "an er on the re in ti es or he nd st en ou ed ha at le".split()


def prose(seed, n):
    """n invented words."""
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(WORDS) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, null ids, and names that clash."""
    long = prose(1, 12_000)
    rows = [(1, prose(2, 80)), (2, prose(2, 80)), (2, prose(2, 80)), (3, prose(2, 80) + " end"), (4, ""), (5, None), (6, long), (None, prose(3, 50)), (7, "One."), (7, "!!! ??"), (8, "a  b\n \t c <|endoftext|> ÉÀ 日本語 ΟΔΟΣ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.withColumns({"node": F.lit("n"), "rid": F.lit(1), "_rid": F.lit(2), "_score": F.lit("s"), "_spans": F.lit(0), "rest": F.lit("r"), "score": F.lit(1.0), "_weak": F.lit(0), "sequence_id": F.lit("q")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def write(spark, tmp_path_factory):
    """A folder with the given tables, as queries read them."""

    def make(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, frame in tables.items():
            frame.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return make
