import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, h int, fp int, weight int, _src int"


def paragraph(seed, n):
    import random
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "gle", "ha", "jo") for b in ("n", "st", "ring", "mer", "lo", "x")]
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    base = paragraph(1, 80)
    texts = [
        (1, base + "\n" + paragraph(2, 60)), (2, base + "\nother tail " + paragraph(3, 70)), (3, base + "\n" + paragraph(2, 60)),
        (3, base + "\n" + paragraph(2, 60)), (4, None), (5, ""), (6, "  \n\t "), (None, paragraph(4, 90)), (None, base),
        (7, paragraph(5, 20000)), (8, "spam spam spam spam spam " * 40), (9, "é" * 120 + " ü ß " + paragraph(2, 60)),
        (10, "mail a.b@example.com or +1 (310) 555-4510 from 10.0.0.255, card 4556 7375 8689 9855\nnull\x00byte"),
        (11, "short"), (12, "A.b@@c.de x@y z@1.2"), (13, base), (14, base), (15, base[:300] + " changed " + base[320:]),
    ]
    rows = [(i, t, None if i == 2 else "en", None if i in (4, 5) else f"s{(i or 0) % 2}", None if t is None else len(t),
             "k", 1, 2, 3, 4, 5) for i, t in texts]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
