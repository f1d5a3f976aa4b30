"""Very many words looked for at once: an Aho-Corasick automaton a block of words, one pass over the texts."""

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.documents import blocks

#: Words of a block: each block's automaton, some 100 bytes a character, is broadcast, and the texts are read once for it.
WORD_BLOCK = 200_000


def found(df: DataFrame, key: str, text: str, words: DataFrame, word_block: int = WORD_BLOCK) -> DataFrame:
    """(key, word): each distinct word of words (word) that a row's text contains, upper and lower case alike; rows that share a key stay rows of their own.

    A text costs its length and its hits, however many words there are. Null texts and words match nothing; the empty word matches every text.
    """
    kind, spark, out = df.schema[key].dataType.simpleString(), df.sparkSession, None
    asked = words.select(F.lower("word").alias("word")).filter("word IS NOT NULL").distinct()
    rows = df.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text")).filter("text IS NOT NULL")
    for block in blocks(asked, word_block):
        automaton, every = ahocorasick.Automaton(), []
        for r in block:
            if r.word:
                automaton.add_word(r.word, r.word)
            else:
                every.append("")
        automaton.make_automaton()
        sent = spark.sparkContext.broadcast(automaton)

        def run(frames, sent=sent, every=tuple(every)):
            for f in frames:
                hits = [(k, w) for k, t in zip(f["key"], f["text"], strict=True) for w in ({w for _, w in sent.value.iter(t)} if len(sent.value) else set()) | set(every)]
                yield pd.DataFrame({"key": pd.Series([h[0] for h in hits], dtype=f["key"].dtype), "word": pd.Series([h[1] for h in hits], dtype=object)})

        part = rows.mapInPandas(run, f"key {kind}, word string")
        out = part if out is None else out.unionByName(part)
    out = out if out is not None else spark.createDataFrame([], f"key {kind}, word string")
    return out.withColumnRenamed("key", key)
