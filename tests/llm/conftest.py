import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, run int, digest string, size string, kept string, spans string"


def prose(seed, n, words=("the", "of", "and", "to", "in", "is", "that", "it", "was", "for")):
    r = random.Random(seed)
    return " ".join(r.choice(words) if r.random() < 0.4 else "".join(r.choices("abcdefghilmnoprstu", k=r.randint(3, 9))) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    return doc_id, text, lang, source, None if text is None else len(text), 1, "x", "y", "z", "w"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies, columns with clashing names."""
    base = prose(1, 120)
    long = prose(2, 40_000)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        row(1, base), row(2, base.upper()), row(3, near), row(4, "Base   text\nwith\tspaces é"), row(5, "base text with spaces É"),
        row(6, None), row(7, ""), row(8, " \n\t "), row(9, long), row(10, long + " end"), row(11, "a b c"), row(12, "A b c", None, None),
        row(13, "x" * 100_000), row(14, prose(3, 300), "de", "b"), row(14, prose(3, 300), "de", "b"), row(15, prose(4, 300), "de", None),
        row(None, base, None, "c"), row(None, None, None, None), row(16, "mail a.b@c-d.example.org, 10.0.0.1 or 300.1.1.1, +1 (555) 010-9999, 4111 1111 1111 1111"),
        row(17, "日本語のテキスト、中文 और हिन्दी 🙂 ﷽"), row(18, "\n".join(["same line here"] * 9)), row(19, "é" * 50 + " " + "ß" * 50, "de", "b"),
        row(-5, prose(5, 60), "en", "a"), row(1 << 60, prose(6, 60), "en", "é"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
