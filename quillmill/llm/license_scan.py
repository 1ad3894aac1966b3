"""License scans with a positional index of rare words, in DataFrame operations alone.

A template is a statement as words, with a key phrase that must stand in it word for word. Every text is parted into
words once; its index holds the words that occur in some template, by position. The index says in how many texts each
of these words occurs. The two rarest words of a template's key phrase are its postings, and those of a file's words
that are postings are looked up. A file's posting minus the template's gives a start; where both of the template's
postings agree on a start, the key phrase is verified, and the share of the template's words that stand at their relative
positions, weighted by rarity, is the score. Texts are read in place; only counts of the words and the few postings are
shuffled, each with the index around it.

Defined results. A null text counts as empty and has no words. Repeated rows and repeated identifiers are scanned each.
An empty table gives an empty result. Overlapping places all count. Other columns may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, text_or_empty

#: A word: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """``words`` of a statement; the key phrase is words[key : key + length]. An exact one must match as a whole."""

    label: str
    words: tuple[str, ...]
    key: int
    length: int
    exact: bool = False

    @property
    def phrase(self) -> tuple[str, ...]:
        return self.words[self.key : self.key + self.length]


def template(label: str, statement: str, phrase: str, exact: bool = False) -> Template:
    words, part = tuple(statement.split()), tuple(phrase.split())
    at = next(k for k in range(len(words)) if words[k : k + len(part)] == part)
    return Template(label, words, at, len(part), exact)


#: Phrases that decide a label alone.
BASE = (
    template("mit", "under the mit license", "under the mit license", exact=True),
    template("apache-2", "apache license version 2", "apache license version 2", exact=True),
    template("cc-by-nc", "cc by nc", "cc by nc", exact=True),
)

#: Statements as they usually stand in files.
TEMPLATES = (
    template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    template("mit", "released under the mit license", "mit license"),
    template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    template("apache-2", "you may not use this file except in compliance with the license", "use this file except in compliance"),
    template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    template("cc-by-nc", "licensed under a creative commons attribution noncommercial license", "creative commons attribution noncommercial"),
    template("cc0", "released under the cc0 public domain dedication", "cc0 public domain"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
)

POSTINGS_PER_PHRASE = 2


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def rarities(index: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of each word of ``vocabulary`` over all rows of ``index``."""
    some = index.select(F.explode(F.array_distinct(F.transform("held", lambda s: s["word"]))).alias("word"))
    found = dict(some.groupBy("word").count().collect())  # a row for each word of the vocabulary at most
    total = index.count()
    return {w: _idf(total, found.get(w, 0)) for w in vocabulary}


def _idf(total: int, found: int) -> float:
    return math.log((total + 1) / (found + 1)) + 1e-3


def postings_of(templates: tuple[Template, ...], rarity: dict[str, float]) -> list[tuple[int, str, int]]:
    """(template, word, position in the template): the rarest words of each key phrase."""
    out = []
    for k, t in enumerate(templates):
        order = sorted(range(t.length), key=lambda j: (-rarity[t.phrase[j]], j))
        out += [(k, t.phrase[j], t.key + j) for j in order[:POSTINGS_PER_PHRASE]]
    return out


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: tuple[Template, ...] = BASE,
    templates: tuple[Template, ...] = TEMPLATES,
    least_score: float = 0.6,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    places.

    ``places`` are the statements found, as (label, first word, score). A base place has the score 1.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "license-scan")
    every = (*base, *templates)
    rows = docs.select(docs[id_col].alias("doc_id"), words_of(text_or_empty(docs[text_col])).alias("words"))
    vocabulary = sorted({w for t in every for w in t.words})
    held = F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("position"), w.alias("word"))))
    index = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_compact(held).alias("held"))
    index = scratch.save(index.withColumn("rid", F.monotonically_increasing_id()), "index")
    rarity = rarities(index, vocabulary)
    postings = postings_of(every, rarity)
    rare = sorted({w for _, w, _ in postings})
    around = max(len(t.words) for t in every)

    # The postings of each text, with as many entries of its index on both sides as a statement has words.
    at = F.transform("held", lambda s, k: F.when(s["word"].isin(rare), F.struct(k.alias("k"), s["position"].alias("position"), s["word"].alias("word"))))
    hits = index.select("rid", "held", F.explode(F.array_compact(at)).alias("hit"))
    left = F.greatest(F.col("hit.k") - around, F.lit(0))
    hits = hits.select("rid", "hit.position", "hit.word", F.slice("held", left + 1, F.lit(2 * around + 1)).alias("near"))

    known = spark.createDataFrame(
        [(k, w, p, every[k].label, list(every[k].words), every[k].exact, every[k].key, every[k].length,
          [rarity[x] for x in every[k].words], min(POSTINGS_PER_PHRASE, every[k].length)) for k, w, p in postings],
        "template int, word string, offset int, label string, statement array<string>, exact boolean, key int, length int, "
        "weights array<double>, votes int",
    )
    aligned = hits.join(F.broadcast(known), "word").withColumn("start", F.col("position") - F.col("offset"))
    aligned = aligned.groupBy("rid", "template", "start").agg(
        F.count("*").alias("agreeing"), F.first("votes").alias("votes"), F.first("near").alias("near"),
        *[F.first(c).alias(c) for c in ("label", "statement", "exact", "key", "length", "weights")],
    )
    aligned = aligned.filter("agreeing >= votes")
    same = F.transform("statement", lambda w, j: F.exists("near", lambda s: (s["position"] == F.col("start") + j) & (s["word"] == w)))
    placed = aligned.withColumn("same", same)
    verified = F.forall(F.slice("same", F.col("key") + 1, F.col("length")), lambda s: s)
    weight = F.aggregate(F.zip_with("same", "weights", lambda s, w: F.when(s, w).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    total = F.aggregate("weights", F.lit(0.0), lambda a, b: a + b)
    placed = placed.filter(verified).withColumn("score", F.when(F.col("exact"), F.lit(1.0)).otherwise(F.round(weight / total, 6)))
    placed = placed.filter(F.col("exact") | (F.col("score") >= least_score))
    is_base = F.col("exact")
    found = placed.groupBy("rid").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
        F.sort_array(F.collect_list(F.struct("label", F.col("start").alias("first_word"), "score"))).alias("places"),
    )
    return index.select("rid", "doc_id", "n_words").join(found, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "places",
    )
