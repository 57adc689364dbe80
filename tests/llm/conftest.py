"""Documents that hold each awkward case: null and empty texts, ties, copies, near copies, long texts, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, word string, `key` long, label int, rank int, `id` string"
FIELDS = ("doc_id", "text", "lang", "source")

WORDS = {
    "en": "the and of to in that house river morning people would water without during market against letter evening under before".split(),
    "fr": "le la et les des dans maison rivière matin personnes serait eau sans pendant marché contre lettre soirée sous avant".split(),
}


def prose(rng, lang, n):
    out = []
    for k in range(n):
        w = rng.choice(WORDS[lang])
        out.append(w.capitalize() if k % 11 == 0 else w + "." if k % 11 == 10 else w)
    return "\n".join(" ".join(out[i : i + 44]) for i in range(0, n, 44))


def make_rows():
    rng = random.Random(5)
    rows, nid = [], 0

    def add(text, lang="en", source="a"):
        nonlocal nid
        rows.append((nid, text, lang, source))
        nid += 1

    for k in range(40):
        lang = ("en", "fr")[k % 3 == 2]
        add(prose(rng, lang, rng.choice([12, 60, 120, 300])), lang, rng.choice(["a", "a", "a", "b", "c", None]))
    passage = prose(rng, "en", 90)
    for k in range(6):
        add(prose(rng, "en", 50) + "\n" + passage + "\n" + prose(rng, "en", 20 + k), "en", "b")
    for text in (rows[0][1], rows[0][1] + "  ", " " + rows[0][1].replace(" ", "\t"), rows[1][1].replace("the", "THE", 1), rows[2][1] + " extra"):
        add(text, rows[0][2], "a")
    for text in (None, "", " \n\t", "!!! 123 ###", "x", "é", "日本語 の 文章 です", "a b c", "\x1c\x85 　", "<|endoftext|> it's", "spam " * 400, "0123456789abcdef" * 300, "a" * 5000):
        add(text, None if text is None else "en", "c")
    add("long " + prose(rng, "en", 12000), "en", "a")
    rows.append(rows[3])  # a row repeated in full
    return rows


ROWS = make_rows()


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(*r, 7, 1, "w", 2, 3, 4, "i") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def null_ids(spark):
    """Rows whose id is null, too."""
    return spark.createDataFrame([(None, "some words here", "en", "a", 7, 1, "w", 2, 3, 4, "i"), (1, None, None, None, None, None, None, None, None, None, None)], SCHEMA)
