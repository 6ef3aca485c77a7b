"""Texts and lists of words that come as tables: the first keyword that a text has, and what a dictionary says of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.sources.shared import shared_path

MOST_BYTES = 16 << 20  # of keywords that a broadcast automaton may hold

Trie = dict


def trie_of(keywords: list[tuple[str, int]]) -> Trie:
    """Keywords as nested tables of words; under None the order of the keyword that ends there, the first of equal ones."""
    root: Trie = {}
    for text, order in keywords:
        at = root
        for w in text.split(" "):
            at = at.setdefault(w, {})
        at[None] = min(order, at.get(None, order))
    return root


def first_in(trie: Trie, text: str) -> int | None:
    """The least order of the keywords that are runs of words of a text: one pass, and from each word as far as some
    keyword goes on."""
    words, best = text.split(" "), None
    for i in range(len(words)):
        at, k = trie, i
        while k < len(words) and (at := at.get(words[k])) is not None:
            k += 1
            if None in at and (best is None or at[None] < best):
                best = at[None]
    return best


def _ranked(keywords: DataFrame) -> DataFrame:
    """(keyword, ord): in lower case, each once with its least order."""
    return keywords.where("keyword is not null and ord is not null").groupBy(F.lower("keyword").alias("keyword")).agg(F.min(F.col("ord").cast("long")).alias("ord"))


def _by_trie(rows: DataFrame, low: Column, known: DataFrame) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(trie_of([(r.keyword, r.ord) for r in known.collect()]))

    def run(texts: pa.Array) -> pa.Array:
        trie = sent.value
        return pa.array([None if t is None else first_in(trie, t) for t in texts.to_pylist()], pa.int64())

    return rows.withColumn("first_ord", F.arrow_udf(run, "long")(low))


def _by_join(rows: DataFrame, low: Column, known: DataFrame) -> DataFrame:
    """Texts meet the keywords that begin with one of their words, each place once; nothing is broadcast."""
    texts = rows.select(low.alias("low_text")).where("low_text is not null").distinct()
    words = texts.select("low_text", F.split("low_text", " ").alias("words")).select("low_text", "words", F.posexplode("words").alias("at", "head"))
    parts = F.split("keyword", " ")
    heads = known.select(parts[0].alias("head"), parts.alias("parts"), "ord")
    found = words.join(heads, "head").where(F.slice("words", F.col("at") + 1, F.size("parts")) == F.col("parts")).groupBy("low_text").agg(F.min("ord").alias("first_ord"))
    return rows.join(found, low == found["low_text"], "left").drop("low_text")


def first_keyword(rows: DataFrame, text: str, keywords: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """rows with `keyword`: the first, by ord, of the table `keywords` (keyword, ord) that is the text, ends it or stands in
    it as a run of words, whatever the case, with capitals; null if none does, or without a text. Words are what single
    spaces part. The keywords are broadcast if they are at most most_bytes, else texts and keywords meet in a join on first
    words. Of keywords that differ in case alone the least ord counts; of different ones with one ord any."""
    known = _ranked(keywords)
    size = known.agg(F.coalesce(F.sum(F.octet_length("keyword")), F.lit(0)).alias("n")).first().n
    out = (_by_trie if size <= most_bytes else _by_join)(rows, F.lower(F.col(text)), known)
    names = known.groupBy("ord").agg(F.min("keyword").alias("keyword")).withColumnRenamed("ord", "of_ord")
    return out.drop("keyword").join(names, out["first_ord"] == names["of_ord"], "left").drop("first_ord", "of_ord").withColumn("keyword", F.initcap("keyword"))


def _maps_by_lookup(rows: DataFrame, words: Column, known: DataFrame, value: str, name: str, kind: str) -> DataFrame:
    table = known.toArrow()
    sent = rows.sparkSession.sparkContext.broadcast((table["word"].combine_chunks(), table[value].combine_chunks()))

    def run(lists: pa.Array) -> pa.Array:
        keys, values = sent.value
        at = pc.index_in(lists.flatten(), value_set=keys.cast(pa.string()))
        ends = np.concatenate(([0], np.cumsum(pc.coalesce(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
        kept = np.concatenate(([0], np.cumsum(at.is_valid().to_numpy(zero_copy_only=False))))[ends]
        at = at.drop_null()
        return pa.MapArray.from_arrays(pa.array(kept.astype(np.int32)), keys.take(at), values.take(at))

    return rows.withColumn(name, F.arrow_udf(run, f"map<string, {kind}>")(F.array_compact(F.array_distinct(words))))


def _maps_by_join(rows: DataFrame, key: str, said: DataFrame, known: DataFrame, value: str, name: str, kind: str) -> DataFrame:
    """Rows are larger than the files that they come from let Spark guess, so no side that has one for each is broadcast."""
    found = said.distinct().join(known.hint("merge"), "word").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", value))).alias(name))
    return rows.join(found.hint("merge"), key, "left").withColumn(name, F.coalesce(name, F.expr(f"cast(map() as map<string, {kind}>)")))


def with_lexicon(rows: DataFrame, key: str, words: Column, lexicon: DataFrame, value: str, name: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """rows with a map `name` from those of their words, an array, that `lexicon` (word and others) has to its `value`.
    What the lexicon has of the distinct words of all rows is broadcast if its words are at most most_bytes; then rows
    don't travel. Else words and lexicon meet in a join on the word. `key` tells rows apart; a null `value` is none."""
    said = rows.select(key, F.explode_outer(words).alias("word"))  # outer, or Spark makes the words twice, to drop empty lists first
    # One value a word is taken from what is written: with dropDuplicates here Spark leaves out a distinct() of the lexicon's own and sorts all that it was to drop.
    known = lexicon.select("word", value).where(F.col(value).isNotNull()).hint("merge").join(said.select("word").distinct(), "word")
    path = shared_path(rows.sparkSession, "known")
    known.write.parquet(path)
    known = rows.sparkSession.read.schema(known.schema).parquet(path).dropDuplicates(["word"])
    kind = lexicon.schema[value].dataType.simpleString()
    size = known.agg(F.coalesce(F.sum(F.octet_length("word") + F.octet_length(F.col(value).cast("string"))), F.lit(0)).alias("n")).first().n
    if size <= most_bytes:
        return _maps_by_lookup(rows, words, known, value, name, kind)
    return _maps_by_join(rows, key, said, known, value, name, kind)
