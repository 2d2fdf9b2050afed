import pytest

from keyroll.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def settings(spark):
    queries.prepare(spark)


@pytest.fixture
def docs(spark):
    """Frame of (doc_id, text[, lang, source]) rows with the columns of documents."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1",
                 len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture
def table(spark, tmp_path):
    """Folder that queries read, with the given frames as its tables."""
    def make(**frames):
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return make


def prose(rng, n, stop=("the", "of", "and", "to", "in")):
    """n words of invented prose, about a third of them function words."""
    return " ".join(rng.choice(stop) if rng.random() < 0.33 else
                    "".join(rng.choice(("an", "the", "ti", "on", "er", "sh", "ou", "re")) for _ in range(rng.randint(1, 4)))
                    for _ in range(n))
