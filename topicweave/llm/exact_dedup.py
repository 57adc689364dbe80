"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text without its white space is cut at content-defined places. Every chunk
gets a 64-bit identifier that is verified against the chunk's SHA-256: should
two chunks share an identifier, their texts are told apart by digest. A text
is then its recipe, the ordered list of chunk identifiers, and texts are equal
when their recipes are. Long texts are read and cut once where they lie; only
identifiers and digests, about 4 % of the text, are ever shuffled.

Defined results: a null text counts as empty; all empty texts form one group; a
very long text is cut into as many chunks as it takes; on a tie in length the
smallest id stays, and a row without an id only if no other of its length has
one; rows repeated in full form a group of which one row stays; an empty table
gives an empty result; other columns of the input are ignored, and come back
unchanged from `drop_exact_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, as_row, materialise

#: Smallest and largest chunk in characters, and the class sequence before a cut.
MIN_CHUNK = 256
MAX_CHUNK = 4096
#: Clashing identifiers that are sent to all tasks at most, and the tasks that each is dealt over beyond that.
MOST_SENT = 50_000
SALTS = 16
BOUNDARY = "[aehimquy258][bdgkpstz369][acegikmoqsuwy13579]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", "")


def chunks(text: Column, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> Column:
    """Content-defined chunks; joined, they are the text again.

    The first alternative ends after a boundary; where there is none within the
    largest size, or at the end of the text, the second takes what is left.
    """
    pattern = f"(?s).{{{min_chunk},{max_chunk}}}?(?<={BOUNDARY})|.{{1,{max_chunk}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: row_key, doc_id, n_cp, text_sha256, recipe array<struct<id, digest>>; written once."""
    norm = docs.select(
        F.monotonically_increasing_id().alias("row_key"), F.col(id_col).alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_cp"), normalised(F.col(text_col)).alias("norm"),
    )
    cut = norm.select("row_key", "doc_id", "n_cp", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm")).alias("parts"))
    return materialise(
        cut.select("row_key", "doc_id", "n_cp", "text_sha256", F.transform("parts", lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("digest"))).alias("recipe")),
        "recipes",
    )


def unclear_rows(recipes: DataFrame, most_sent: int = MOST_SENT) -> DataFrame | None:
    """row_key of recipes with an identifier that chunks of different digests share; None if there is none.

    Identifiers are counted with a combine in each task. Clashes of 64 bits are rare, so hardly a corpus gets
    beyond that; where one does, the clashing identifiers go to the chunks if they are few, else they meet
    them in a join that deals each identifier over SALTS tasks, as one may be in a third of all texts.
    """
    named = recipes.select("row_key", F.explode("recipe").alias("c")).select("row_key", "c.id", "c.digest")
    shared = named.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("id")
    shared = materialise(shared, "shared-identifiers")
    n = shared.count()
    if not n:
        return None
    if n <= most_sent:
        return named.join(F.broadcast(shared), "id", "left_semi").select("row_key").distinct()
    dealt = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = named.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, ["id", "salt"], "left_semi").select("row_key").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row_key, doc_id, keep_id, group_size, kept, text_sha256."""
    recipes = chunk_recipes(docs, id_col, text_col)
    unclear = unclear_rows(recipes)
    # One digest per identifier is the rule; the rest is told apart by digest.
    if unclear is None:
        told = recipes.withColumn("digests", F.array().cast("array<binary>"))
    else:
        told = recipes.join(unclear.withColumn("unclear", F.lit(True)), "row_key", "left").withColumn("digests", F.when(F.col("unclear"), F.transform("recipe", lambda c: c["digest"])).otherwise(F.array().cast("array<binary>")))
    ids = F.transform("recipe", lambda c: c["id"].cast("string"))
    # The list stands in for itself in the shuffle by a 256-bit digest of it, whatever its length.
    key = F.sha2(F.concat_ws(",", ids, F.transform("digests", F.hex)), 256)
    keyed = materialise(told.select("row_key", "doc_id", "n_cp", "text_sha256", key.alias("recipe_key")), "keyed")
    best = F.min(F.struct((-F.col("n_cp")).alias("longest"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key"))
    groups = keyed.groupBy("recipe_key").agg(F.count("*").alias("group_size"), best.alias("best")).select("recipe_key", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row_key").alias("keep_key"))
    # Read anew, both sides of the join are plain exchanges, so a hot group's rows can be split over tasks.
    return keyed.join(materialise(groups, "groups"), "recipe_key").select("row_key", "doc_id", "keep_id", "group_size", (F.col("row_key") == F.col("keep_key")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with, whatever their names and types.

    Survivors are named by id and text. Where rows repeat both, one stays: the longest, on a tie the one whose
    columns come last as JSON.
    """
    found = materialise(exact_groups(docs, id_col, text_col).select("doc_id", "kept", "text_sha256"), "exact-groups")
    named = found.groupBy(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).agg(F.max("kept").alias("kept"), F.count("*").alias("times"))
    survivors = named.filter("kept").drop("kept")
    whole = docs.select(as_row(docs), F.col(f"`{id_col}`").alias("own_id"), F.sha2(normalised(F.col(f"`{text_col}`")), 256).alias("own_sha"))
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_sha") == F.col("kept_sha"))
    once = whole.join(survivors.filter("times = 1"), same, "left_semi").select("row.*")
    again = survivors.filter("times > 1")
    if again.isEmpty():
        return once
    longest = F.struct(F.length(F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))), F.to_json("row"))
    few = whole.join(again, same, "left_semi").groupBy("own_id", "own_sha").agg(F.max_by("row", longest).alias("row"))
    return once.unionAll(few.select("row.*"))
