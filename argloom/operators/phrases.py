"""Search for many phrases in many texts, without a loop over pairs."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of phrases that every task may hold as one automaton.
AUTOMATON_CHARS = 4 << 20
#: Words of an anchor.
ANCHOR = 3
_WORD = "[^\\x20\\x09-\\x0D]+"


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _by_automaton(phrases: list[tuple]):
    """``doc_id, phrase_id, start`` (the first place, in code points from 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, of = ahocorasick.Automaton(), {}
        for phrase_id, phrase in phrases:
            of.setdefault(phrase, []).append(phrase_id)
        for phrase in of:
            automaton.add_word(phrase, phrase)
        automaton.make_automaton()
        kinds = None
        for batch in batches:
            kinds = kinds or (batch.schema.field(0).type, batch.schema.field(2).type)
            docs, found, starts = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first: dict[str, int] = {}
                for end, phrase in automaton.iter(text) if text else ():
                    first.setdefault(phrase, end + 1 - len(phrase))
                for phrase, start in first.items():
                    for phrase_id in of[phrase]:
                        docs.append(doc_id)
                        found.append(phrase_id)
                        starts.append(start)
            yield pa.RecordBatch.from_arrays([pa.array(docs, kinds[0]), pa.array(found, kinds[1]), pa.array(starts, pa.int64())], names=["doc_id", "phrase_id", "start"])

    return run


def _by_anchor(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """Phrases of enough words meet the texts that hold their rarest run of :data:`ANCHOR` inner words; a text that holds the phrase holds these words whole.  Shorter phrases meet texts by their rarest run of characters."""
    words = lambda c: F.regexp_extract_all(c, F.lit(_WORD), F.lit(0))
    runs = lambda c, n: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(c, i, F.lit(n)), " "))))
    inner = F.slice(words("phrase"), 2, F.greatest(F.size(words("phrase")) - 2, F.lit(0)))
    long = phrases.withColumn("run", F.explode(F.array_distinct(runs(inner, ANCHOR))))
    short = phrases.filter(F.size(words("phrase")) < ANCHOR + 2)
    in_docs = docs.select("doc_id", F.explode(F.array_distinct(runs(words("text"), ANCHOR))).alias("run"))
    count = in_docs.join(long.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count("*").alias("n"))
    anchor = long.join(count, "run", "left").groupBy("phrase_id", "phrase").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), "run")).alias("run"))
    met = in_docs.join(anchor, "run").select("doc_id", "phrase_id", "phrase").distinct()
    n = short.filter("phrase <> ''").agg(F.min(F.length("phrase"))).first()[0]
    if n is not None:
        grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))
        first = short.filter("phrase <> ''").withColumn("gram", F.substring("phrase", 1, n))
        met = met.unionByName(docs.select("doc_id", F.explode(grams(F.coalesce(F.col("text"), F.lit("")))).alias("gram")).join(first, "gram").select("doc_id", "phrase_id", "phrase").distinct())
    whole = docs.join(met, "doc_id").withColumn("start", F.expr("locate(phrase, text)") - 1).filter("start >= 0")
    return whole.select("doc_id", "phrase_id", F.col("start").cast("bigint").alias("start"))


def find_phrases(docs: DataFrame, phrases: DataFrame, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``doc_id, phrase_id, start``: which ``docs(doc_id, text)`` contain which ``phrases(phrase_id, phrase)``, and the first place, in code points from 0.

    Up to ``most_chars`` characters of phrases are checked for, sent to all tasks and matched at once by an automaton that
    reads each text a single time; more phrases meet the texts in a join on their rarest words.  Both give the same rows.
    Null texts and null or empty phrases match nothing; equal phrases of several ids match each; ids of documents are unique.
    """
    given = phrases.select("phrase_id", "phrase").filter("phrase IS NOT NULL AND phrase <> ''")
    texts = docs.select("doc_id", "text")
    if (given.agg(F.coalesce(F.sum(F.length("phrase")), F.lit(0))).first()[0]) > most_chars:
        return _by_anchor(texts, given)
    listed = [tuple(x) for x in given.collect()]
    kind = _kind(phrases, "phrase_id")
    schema = f"doc_id {_kind(docs, 'doc_id')}, phrase_id {kind}, start bigint"
    if not listed:
        return docs.sparkSession.createDataFrame([], schema)
    return texts.withColumn("phrase_id", F.lit(None).cast(kind)).mapInArrow(_by_automaton(listed), schema)

