"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The heading after which references follow, and the lines that are noise.
REFERENCES_HEADING = r"(?m)^\s*(참\s*고\s*문\s*헌|참고자료|References?|REFERENCES?|Bibliography)\s*$"
NOISE_LINES = (
    r"(?i)^\s*[<\[(]?\s*(표|그림|Table|Figure|Fig\.?)\s*\d+[>\])]?.{0,80}$",
    r"^\s*-?\s*\d+\s*-?\s*$",
    r"^\s*(doi|DOI)\s*[:：]?\s*\S+\s*$",
    r"^\s*https?://\S+\s*$",
    r"(?i)^\s*(Vol\.?|No\.?|pp\.?)\s*[\d.,\s-]+\s*$",
    r"^\s*[·•*─—=_-]{3,}\s*$",
)
TOKEN = "[a-z]{2,}"


def strip(text: Column) -> Column:
    """Trim white space of all scripts, not only the space character."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def cut_references(text: Column) -> Column:
    """Cut at the first reference heading, if it starts beyond 30 % of the text."""
    at = F.regexp_instr(text, F.lit(REFERENCES_HEADING))
    return F.when((at > 0) & (at - 1 > F.length(text) * 0.3), F.substring(text, F.lit(1), at - 1)).otherwise(text)


def drop_noise_lines(text: Column) -> Column:
    """Drop caption, page-number, DOI, address, volume and rule lines; blank lines stay, others are trimmed."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"), strip)
    keep = lambda x: (x == "") | ~F.coalesce(*[F.when(x.rlike(p), True) for p in NOISE_LINES], F.lit(False))
    return F.array_join(F.filter(lines, keep), "\n")


def strip_addresses(text: Column) -> Column:
    """Web and mail addresses within a line become a space."""
    return F.regexp_replace(F.regexp_replace(text, r"https?://\S+", " "), r"\S+@\S+\.\S+", " ")


def normalise_space(text: Column) -> Column:
    """Join hyphenated line ends, squeeze blanks, and leave at most one empty line."""
    joined = F.regexp_replace(text, "-\n(?=[a-z가-힣])", "")
    return strip(F.regexp_replace(F.regexp_replace(joined, "[ \t]+", " "), "\n{3,}", "\n\n"))


def clean_document(text: Column) -> Column:
    """The whole cleaning chain; null and blank give an empty text."""
    cleaned = normalise_space(strip_addresses(drop_noise_lines(cut_references(text))))
    return F.coalesce(F.when(strip(text) == "", F.lit("")).otherwise(cleaned), F.lit(""))


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunk(text: Column, size: int = 900, overlap: int = 100, least: int = 50) -> Column:
    """Greedy packing of paragraphs into chunks of about `size` characters.

    A full chunk is emitted and its last `overlap` characters open the next one.
    Paragraphs longer than 1.5 times the size are packed sentence by sentence,
    after a flush as for the whole paragraph. Chunks shorter than `least` are
    dropped. One fold over an array of units (a paragraph, or a sentence of a
    long one), no Python.
    """
    unit = lambda body, glue, room, twice: F.struct(body.alias("body"), F.lit(glue).alias("glue"), room.alias("room"), twice.alias("twice"))
    sentences = lambda p: F.transform(F.split(p, r"(?<=[.!?다])(?U)\s+"), lambda s, i: unit(s, " ", F.when(i == 0, F.length(p)).otherwise(F.length(s)), i == 0))
    paragraphs = F.filter(F.transform(F.split(text, r"\n(?U)\s*\n"), strip), lambda p: p != "")
    units = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > size * 1.5, sentences(p)).otherwise(F.array(unit(p, "\n", F.length(p), F.lit(False))))))
    tail = lambda c: F.right(c, F.lit(overlap)) if overlap > 0 else F.lit("")

    def flushed(acc: Column, room: Column, when: Column | None = None) -> Column:
        """The state after a flush, if the current chunk has no room for so many characters more."""
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + room + 1 > size)
        full = full if when is None else full & when
        emitted = F.struct(F.array_append(acc["out"], strip(acc["cur"])).alias("out"), tail(acc["cur"]).alias("cur"))
        return F.when(full, emitted).otherwise(acc)

    def joined(acc: Column, u: Column) -> Column:
        # Units have no blanks at their ends, so only the front of an overlap may have some.
        text = F.regexp_replace(F.concat(acc["cur"], u["glue"], u["body"]), r"(?U)^\s+", "")
        return F.struct(acc["out"].alias("out"), F.when(acc["cur"] == "", u["body"]).otherwise(text).alias("cur"))

    def step(acc: Column, u: Column) -> Column:
        # The first sentence of a long paragraph may find the chunk that the paragraph opened too full as well.
        return bound(flushed(acc, u["room"]), lambda once: bound(flushed(once, F.length(u["body"]), u["twice"]), lambda twice: joined(twice, u)))

    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    done = bound(F.aggregate(units, state, step), lambda end: bound(strip(end["cur"]), lambda last: F.when(last != "", F.array_append(end["out"], last)).otherwise(end["out"])))
    return F.filter(done, lambda c: F.length(c) >= least)


def tokens(text: Column, pattern: str = TOKEN, stopwords: Sequence[str] = ()) -> Column:
    """Lower-case tokens in order, repeats included; null gives none."""
    found = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
    return F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found


def topic_keywords(keywords: Column, **options) -> Column:
    """Tokens of a topic's keywords, each once, in order of first occurrence."""
    return F.array_distinct(F.flatten(F.transform(keywords, lambda k: tokens(k, **options))))


def major_category(category: Column) -> Column:
    """The part before the first bar, then before the first angle, trimmed."""
    return F.trim(F.element_at(F.split(F.element_at(F.split(category, r"\|"), 1), ">"), 1))


def keyphrase_count(text: Column) -> Column:
    """How many keyphrases a text of this length is asked for."""
    n = F.length(F.trim(text))
    return F.when(n < 30, 2).when(n <= 300, 3).when(n <= 800, 5).when(n <= 2500, 8).otherwise(12)


def parse_keyphrases(answer: Column, most: Column | int) -> Column:
    """The phrases of a comma- or line-separated answer, without quotes, at most `most`."""
    parts = F.filter(F.transform(F.split(answer, "[,，\n]"), lambda p: F.trim(p)), lambda p: F.length(p) >= 2)
    bare = F.transform(parts, lambda p: F.regexp_replace(p, "^[\"'`]+|[\"'`]+$", ""))
    return F.slice(bare, 1, most if isinstance(most, int) else most)


def json_block(answer: Column) -> Column:
    """The widest [...] of an answer, else the widest {...}, else null."""
    listed, mapped = F.regexp_extract(answer, r"(?s)\[.*\]", 0), F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return F.when(listed != "", listed).when(mapped != "", mapped)


def text_hash(text: Column, size: int = 16) -> Column:
    return F.left(F.sha2(text, 256), F.lit(size))


def slug(name: Column) -> Column:
    """A name as part of a file name."""
    return F.regexp_replace(name, r"[^0-9A-Za-z_가-힣-]+", "_")


#: What a theme answer may begin with.
THEME_PREFIXES = ("주제:", "주제 :", "Theme:", "답변:", "답변 :")


def clean_theme(answer: str, most: int = 100) -> str:
    """A theme answer without prefixes, each at most once in their order, and without quotes, cut."""
    answer = answer.strip()
    for prefix in THEME_PREFIXES:
        answer = answer.removeprefix(prefix).strip()
    return answer.strip("\"'")[:most]


def theme_label(answer: Column, keyphrases: Column, most: int = 100) -> Column:
    """`clean_theme` of an answer; where nothing is left, the first three keyphrases."""
    bare = strip(answer)
    for prefix in THEME_PREFIXES:
        bare = strip(F.when(bare.startswith(prefix), F.substring(bare, len(prefix) + 1, 1 << 30)).otherwise(bare))
    bare = F.left(F.regexp_replace(bare, "^[\"']+|[\"']+$", ""), F.lit(most))
    return F.coalesce(F.when(bare != "", bare), F.array_join(F.slice(keyphrases, 1, 3), " · "))


def parse_json(answer: str):
    """The widest list or object in an answer, as Python values; None if there is none that can be read."""
    for left, right in ("[]", "{}"):
        a, b = answer.find(left), answer.rfind(right)
        if 0 <= a < b:
            try:
                return json.loads(answer[a : b + 1])
            except ValueError:
                continue
    return None
