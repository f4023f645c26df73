import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 60),
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 60),
        (2, None, "en", "b", None),
        (3, "", None, None, 0),
        (4, "word " * 30_000, "en", "a", 150_000),
        (5, "123 456 !!", "de", "b", 10),
        (None, "Ein Text ohne Nummer, der in keiner Klasse steht.", "de", None, 48),
        (7, "\n\n \n", "en", "c", 4),
        (8, "Released under the MIT License.\nOther words follow here.", "en", "c", 56),
        (9, "▁ é 漢字 <|endoftext|> \U0001f642\tx", "fr", "d", 27),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    # columns that operators use inside, and names that they give out
    inside = ("_key", "_path", "_own", "_dir", "_near", "_k", "_above", "_lic", "_gone", "_lt", "_id", "_text", "_at", "_sites", "_before", "_first_rank", "_n", "_first_sequence", "_order", "_bucket", "_row", "_rank", "_text_hash", "_KEY2", "x_key")
    for name in (*inside, "score", "length", "offset", "bag", "rep", "_hash", "label", "word", "lang_pred", "quality_score", "fingerprint", "piece_ids", "n_removed", "licence"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
