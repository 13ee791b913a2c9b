import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, rep long, slice int, place int, p double, n long, key string, label int, score double"


def make_rows() -> list[tuple[int | None, str | None, str | None, str | None]]:
    """Copies, near copies, shared passages, nulls, empty, blank and long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(120)
    rows: list = []
    for i in range(40):
        rows.append((i, "\n".join(text(rng.randint(3, 25)) for _ in range(rng.randint(1, 9))), "en", f"s{i % 4}"))
    base = rows[3][1] + "\n" + text(150)
    rows.append((100, base, "en", "s0"))
    for i in range(6):  # near copies
        some = base.split(" ")
        some[rng.randrange(len(some))] = f"edit{i}"
        rows.append((101 + i, " ".join(some), "en", "s1"))
    for i in range(5):  # copies that differ in case and white space
        rows.append((120 + i, base.upper() if i % 2 else base.replace(" ", "  ", 1), "de", "s0"))
    for i in range(4):
        rows.append((130 + i, text(30) + "\n" + passage + "\n" + text(5) + "\n" + text(40), "fr", "s2"))
    rows += [(140, None, "en", "s0"), (141, "", None, None), (142, " \t\n ", "en", None), (143, "one two", "es", "s3"), (144, "ONE two", "es", "s3"), (145, text(9000), "en", "s1")]
    rows += [(146, "same same same same same same same", "en", "s1"), (146, "same same same same same same same", "en", "s1"), (None, "a null id with words of its own here", "en", "s0")]
    rows += [(147, "Ärger ÉÈ 漢字 😀 x", "de", "s2"), (148, "ab" * 500 + " " + "ab" * 500, "en", "s2")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(*r, None if r[1] is None else len(r[1]), 1, "x", 2, 3, 4, 0.5, 6, "k", 1, 0.1) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
