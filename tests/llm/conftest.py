import pytest

LONG = "lorem ipsum dolor sit amet " * 3000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, ties, repeated rows and columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. token = \"abcdefgh12345678\"", "en", 1), (2, None, "en", 2), (3, "", None, 3), (4, "   \n\t", "en", 4), (5, LONG, "en", 5), (6, LONG, "en", 5),
        (7, "été à la plage, où l'on voit 日本語 and <|endoftext|>", "fr", None), (7, "été à la plage, où l'on voit 日本語 and <|endoftext|>", "fr", None), (8, "12 34 !!", None, 0), (9, "x" * 5000, "en", 9),
    ]
    names = "doc_id long, text string, lang string, bucket int"
    extra = "rec string, key long, fp long, slot int, shard int, n_tokens int, chunk int, tile_i int, piece int, salt int, rank int, component_id long, lang_pred string, score string, log_weight string"
    return spark.createDataFrame([(*r, *[None] * len(extra.split(","))) for r in rows], f"{names}, {extra}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
