import pytest

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because long each just state those people too mr little good world make very year still see own work men day get here old life both between being under three never know same last another while us might great"


def sentence(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choices(WORDS.split(), k=n))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, equal rows, ties, and columns whose names the operators use."""
    a, b = sentence(1, 80), sentence(2, 300)
    near = a.replace(a.split()[40], "changed", 1)
    rows = [
        (1, a, "en", "s1"), (2, a, "en", "s1"), (3, near, "en", None), (4, b + "\n" + a, "de", "s2"), (5, None, None, "s2"), (6, "", "en", "s3"), (None, a, "en", "s1"),
        (7, " \n\t ", "en", None), (8, b, "fr", "s4"), (8, b, "fr", "s4"), (9, sentence(3, 4000), "en", "s1"), (10, "café naïve\n" + b[:70] + "\nx", "fr", "s2"), (11, "café naıve 😀", "fr", "s5"), (12, "short", "en", "s5"),
    ]
    x = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    x = x.selectExpr("*", "cast(length(text) as long) as n_chars", "1 as size", "'k' as key", "2 as h", "3 as removed", "4 as _row", "5 as _key", "6 as fp", "7 as root", "8 as taken", "9 as length", "10 as _id")
    return x.repartition(3).cache()


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0).cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, None), (8, 1, 0), (9, 1, 0), (None, 1, 0), (12, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
