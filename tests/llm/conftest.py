import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, bucket string, score string, kinds string, seg string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) with extra columns whose names clash with those the operators use inside."""
    def build(rows):
        return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), "a", "b", "c", "d", "e") for i, t in rows], SCHEMA)
    return build


WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper katsura larch maple nutmeg oak pine quince rowan spruce tupelo umbrella viburnum willow yew zelkova".split()


@pytest.fixture(scope="session")
def prose():
    """Texts of distinct random words."""
    import random

    def build(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))
    return build
