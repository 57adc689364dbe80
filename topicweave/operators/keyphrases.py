"""Keyphrases: extraction through a language-model client, filters, representation, votes."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from topicweave.functions import text as T
from topicweave.functions.lineage import checkpointed
from topicweave.functions.vectors import blend, cosine
from topicweave.sources.services import KeyValueCache, cache_misses

BREAKER = 8


VERSION = "v1"


def answers(rows: DataFrame, make_client: Callable, model: str, breaker: int | None = None, cache: KeyValueCache | None = None, **options) -> DataFrame:
    """rows(prompt, ...) with `answer`, blank where a request failed.

    A client is made per task; it has ping() and chat(model, prompt, **options). After `breaker` failures in a row
    the task fails. With a cache each prompt that it lacks is asked for once and its answer kept, on executors.
    """
    if cache is not None:
        salt = json.dumps([VERSION, model, options], sort_keys=True)
        keyed = checkpointed(rows.withColumn("key", F.sha2(F.concat(F.lit(salt), F.lit("\n"), "prompt"), 256)))
        missing = cache_misses(keyed.select("key", "prompt"), cache.table())
        new = checkpointed(answers(missing, make_client, model, breaker, None, **options).filter("answer <> ''"))
        cache.set_many(new.select("key", F.col("answer").alias("value")))
        return keyed.join(cache.table(), "key", "left").withColumn("answer", F.coalesce("value", F.lit(""))).drop("key", "value")
    names = [*rows.columns, "answer"]
    place = names.index("prompt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, failures = None, 0
        for batch in batches:
            found = []
            for text in batch.column(place).to_pylist():
                if client is None:
                    client = make_client()
                    if breaker and not client.ping():
                        raise RuntimeError("the language model cannot be reached")
                try:
                    found.append(client.chat(model, text, **options))
                    failures = 0
                except Exception as error:
                    failures += 1
                    if breaker and failures >= breaker:
                        raise RuntimeError(f"{failures} requests in a row failed") from error
                    found.append("")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("answer", StringType())]))


def prompt(text: Column, n: Column) -> Column:
    return F.concat(F.lit("List the "), n.cast("string"), F.lit(" keyphrases that say best what the text is about. Use words of the text. Answer with the phrases alone, separated by commas.\n\nText:\n"), F.coalesce(text, F.lit("")))


def extract(docs: DataFrame, make_client: Callable, model: str, per_doc: int | None = None, breaker: int = BREAKER, cache: KeyValueCache | None = None) -> DataFrame:
    """doc_idx, keyphrases array<string>. docs: doc_idx, text (those to be asked about). A failed document has no phrases."""
    n = (F.lit(per_doc) if per_doc else T.keyphrase_count(F.col("text"))).cast("int")
    asked = docs.select("doc_idx", "text", n.alias("n")).select("doc_idx", "n", prompt(F.col("text"), F.col("n")).alias("prompt"))
    answered = answers(asked, make_client, model, breaker, cache, temperature=0.2, max_tokens=200)
    return answered.select("doc_idx", T.parse_keyphrases(F.col("answer"), F.col("n")).alias("keyphrases"))


def exploded(found: DataFrame) -> DataFrame:
    """doc_idx, pos, kp: one row per phrase."""
    return found.select("doc_idx", F.posexplode("keyphrases").alias("pos", "kp"))


def distinct_phrases(rows: DataFrame) -> DataFrame:
    return rows.select("kp").distinct()


def with_cosine(rows: DataFrame, phrase_vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """rows(doc_idx, pos, kp) with cos to their document; null without a phrase vector."""
    kp = phrase_vectors.select("kp", F.col("embedding").alias("kp_vec"))
    joined = rows.join(kp, "kp", "left").join(docs.select("doc_idx", F.col("embedding").alias("doc_vec")), "doc_idx")
    return joined.withColumn("cos", F.when(F.col("kp_vec").isNotNull(), cosine(F.col("kp_vec"), F.col("doc_vec"))))


def keep_by_cosine(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.filter(F.col("cos").isNull() | (F.col("cos") >= threshold))


def keep_by_percentile(rows: DataFrame, share: float) -> DataFrame:
    """Drop what lies below the exact, interpolated quantile of all known cosines."""
    cut = rows.agg(F.percentile("cos", F.lit(share)).alias("cut"))
    return rows.join(F.broadcast(cut), how="cross").filter(F.col("cos").isNull() | F.col("cut").isNull() | (F.col("cos") >= F.col("cut"))).drop("cut")


def keep_by_model(found: DataFrame, make_client: Callable, model: str, cache: KeyValueCache | None = None) -> DataFrame:
    """Phrases (doc_idx, text, keyphrases) whose number the model lists; all where its answer cannot be read."""
    numbered = F.to_json(F.transform("keyphrases", lambda p, i: F.struct(i.alias("number"), p.alias("phrase"))))
    ask = F.concat(F.lit("Which phrases (numbered from 0) does the text support? Answer with a JSON list of numbers.\nPhrases: "), numbered, F.lit("\nText:\n"), F.coalesce("text", F.lit("")))
    answered = answers(found.select("doc_idx", "keyphrases", ask.alias("prompt")), make_client, model, None, cache)
    chosen = F.from_json(F.when(F.col("answer").contains("["), T.json_block(F.col("answer"))), "array<int>")
    kept = F.filter("keyphrases", lambda _, i: F.array_contains("chosen", i))
    return answered.withColumn("chosen", chosen).select("doc_idx", F.when(F.col("chosen").isNull(), F.col("keyphrases")).otherwise(kept).alias("keyphrases"))


def filter_stats(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """raw, kept, removed, removal_rate."""
    a, b = raw.agg(F.count("*").alias("raw")), kept.agg(F.count("*").alias("kept"))
    rate = F.when(F.col("raw") > 0, F.round((F.col("raw") - F.col("kept")) / F.col("raw"), 4)).otherwise(F.lit(0.0))
    return a.join(b, how="cross").select("raw", "kept", (F.col("raw") - F.col("kept")).alias("removed"), rate.alias("removal_rate"))


def represent(rows: DataFrame, kind: str, alpha: float = 0.5) -> DataFrame:
    """item_id, doc_idx, pos, kp, vec from rows with kp_vec and doc_vec: keyphrase, doc or joint."""
    if kind == "doc":
        once = rows.select("doc_idx", "doc_vec").dropDuplicates(["doc_idx"])
        return once.select(F.col("doc_idx").alias("item_id"), "doc_idx", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("kp"), F.col("doc_vec").cast("array<double>").alias("vec"))
    known = rows.filter(F.col("kp_vec").isNotNull())
    vec = blend(F.col("doc_vec"), F.col("kp_vec"), alpha) if kind == "joint" else F.col("kp_vec").cast("array<double>")
    return known.select((F.xxhash64("doc_idx", "pos")).alias("item_id"), "doc_idx", "pos", "kp", vec.alias("vec"))


def majority(items: DataFrame) -> DataFrame:
    """doc_idx, topic_id: the label most of a document's items have; the smallest on a tie; noise has no vote."""
    votes = items.filter("topic_id >= 0").groupBy("doc_idx", "topic_id").agg(F.count("*").alias("votes"))
    order = W.partitionBy("doc_idx").orderBy(F.col("votes").desc(), F.col("topic_id").asc())
    return votes.withColumn("r", F.row_number().over(order)).filter("r = 1").select("doc_idx", "topic_id")
