"""Text functions on literals."""

import random
import re

import pytest
from pyspark.sql import functions as F

from topicweave.functions import text as T


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


def test_cut_references(spark):
    body = "x" * 100
    assert one(spark, T.cut_references, f"{body}\nReferences\nA. B.", "References\n" + body, f"{body}\n  참 고 문 헌  \nz") == [body + "\n", "References\n" + body, body + "\n"]


def test_clean_document(spark):
    text = "Title\nTable 1. Results\n- 12 -\ndoi: 10.1/x\nhttp://a.b/c\nVol. 3, 12\n-----\nsee http://a.b now, mail me@x.org\nhyphen-\nated  line\n\n\n\nend"
    assert one(spark, T.clean_document, text, None, " \n ") == ["Title\nsee now, mail \nhyphenated line\n\nend", "", ""]


def test_chunk_keeps_size_overlap_and_order(spark):
    paragraphs = [f"P{k} " + "word " * 30 for k in range(20)]
    (chunks,) = one(spark, lambda c: T.chunk(c, 400, 40), "\n\n".join(paragraphs))
    assert all(50 <= len(c) <= 400 + 160 for c in chunks) and len(chunks) > 5
    assert all(b.startswith(a[-40:].strip()) for a, b in zip(chunks, chunks[1:]))
    (long,) = one(spark, lambda c: T.chunk(c, 200, 0), " ".join(f"Sentence number {k} is here." for k in range(40)))
    assert " ".join(long) == " ".join(f"Sentence number {k} is here." for k in range(40)) and all(len(c) <= 200 for c in long)
    assert one(spark, T.chunk, "short", "") == [[], []]


def packed_by_hand(text, size, overlap, least):
    """The packing rule, unit by unit."""
    out, cur = [], ""

    def make_room(n):
        nonlocal cur
        if cur and len(cur) + n + 1 > size:
            out.append(cur.strip())
            cur = cur[-overlap:] if overlap else ""

    for p in filter(None, (x.strip() for x in re.split(r"\n\s*\n", text))):
        make_room(len(p))
        if len(p) <= size * 1.5:
            cur = f"{cur}\n{p}".strip()
            continue
        for s in re.split(r"(?<=[.!?다])\s+", p):
            make_room(len(s))
            cur = f"{cur} {s}".strip()
    return [c for c in [*out, cur.strip()] if len(c) >= least]


@pytest.mark.parametrize("size, overlap, least", [(60, 12, 5), (40, 0, 1), (90, 30, 20)])
def test_chunk_follows_the_rule(spark, size, overlap, least):
    rng = random.Random(size)
    texts = []
    for _ in range(120):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += "a" * rng.randint(1, 9) + rng.choice([" ", " ", ". ", "! ", "\n", "\n\n", "\n \n", "다 ", " \n\n  "]) if rng.random() > 0.03 else "b" * rng.randint(30, 160) + " "
        texts.append(text)
    got = one(spark, lambda c: T.chunk(c, size, overlap, least), *texts)
    assert got == [packed_by_hand(t, size, overlap, least) for t in texts]


def test_small_parsers(spark):
    assert one(spark, T.major_category, "사회>사건_사고 | 사회>여성", "a", None) == ["사회", "a", None]
    assert one(spark, lambda c: T.parse_keyphrases(c, 3), "'one', two，x\n\"three\", four") == [["one", "two", "three"]]
    assert one(spark, T.json_block, 'so [1, 2] {"a": 1}', 'so {"a": [', "none") == ["[1, 2]", None, None]
    assert one(spark, T.keyphrase_count, "a" * 29, "a" * 30, "a" * 301, "a" * 801, "a" * 2501) == [2, 3, 5, 8, 12]
    assert one(spark, T.tokens, "Ab c DEF ghi", "", None) == [["ab", "def", "ghi"], [], []]
    assert one(spark, T.strip, "　a b ") == ["a b"]
    assert one(spark, lambda c: T.theme_label(c, F.array(F.lit("p"), F.lit("q"))), 'Theme: "Water"', " ") == ["Water", "p · q"]


def test_themes_are_cleaned_alike(spark):
    answers = ["Theme: Water", " 주제: 돌봄 정책 ", "답변: '물'", "주제: Theme: x", "Theme:", "plain \"quoted\"", ""]
    got = one(spark, lambda c: T.theme_label(c, F.array(F.lit("p"), F.lit("q"))), *answers)
    assert got == [T.clean_theme(a) or "p · q" for a in answers] and got[:3] == ["Water", "돌봄 정책", "물"]


def test_json_in_answers():
    assert T.parse_json('so: {"a": [1]} end') == [1] and T.parse_json('x {"a": 1} y') == {"a": 1} and T.parse_json("none [") is None and T.parse_json("[1, 2} {") is None


def test_stopwords_and_taggers(spark, tmp_path):
    from topicweave.functions import tokens as K

    (tmp_path / "stop.txt").write_text("# words\n\n 것 \nand\n", encoding="utf-8")
    stop = K.read_stopwords(spark, f"file://{tmp_path}/stop.txt")
    assert set(stop) == {"것", "and"}

    class Tags:
        def tag(self, texts):
            return [[tuple(w.rsplit("/", 1)) for w in t.split()] for t in texts]

    docs = spark.createDataFrame([(0, "정책/NNG 것/NNG AI/SL 하다/VV 서울/NNP 12/SL 가/NNG --/NNG"), (1, " "), (2, None)], "doc_idx long, text string")
    assert [r["tokens"] for r in K.tagged_tokens(docs, Tags, stop).orderBy("doc_idx").collect()] == [["정책", "ai", "서울"], [], []]


def test_words_of_any_script(spark):
    from topicweave.plans import experiments as X
    from topicweave.sources.services import HashEmbedder

    docs = X.prepare(spark.createDataFrame([(0, "서울 Policy 가 12 x")], "doc_idx long, text string"), HashEmbedder)
    assert docs.first()["tokens"] == ["서울", "policy"]
