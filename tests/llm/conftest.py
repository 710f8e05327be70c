import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = (
    "The river ran high that spring and the mill at the bend had to stop for nine days. Nobody in the village could remember"
    " such water. Old Martha said her mother had spoken of it once, when the bridge was still made of wood and the road went"
    " round by the quarry. They carried the sacks up to the church and waited, and on the tenth day the wheel turned again."
)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names clash with results."""

    def make(pairs, extra=False):
        rows = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in pairs]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for c in ("score", "kept", "n_words", "n_tokens", "spans", "fingerprint", "epoch", "fp", "k1", "words", "label", "component_id"):
                df = df.withColumn(c, F.lit("own"))
        return df

    return make


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank, repeated, very long and non-Latin texts; a null id."""
    long_text = " ".join(f"w{i % 977} x{i}" for i in range(30000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, PROSE), (4, PROSE), (5, PROSE), (None, PROSE), (None, None), (6, long_text), (7, "中文 текст ñ é́ 😀 \x01\x02"), (8, "a")]
