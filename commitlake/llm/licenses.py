"""Licence scan through a positional rare-token index, in DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words.  The index keeps, for every
file, the positions of the words that occur in some licence template.  A word's
IDF is ln(files / files that have it), over all files.  A template posts its
``posted`` words of highest IDF.  All posted words of a file are looked up in the
templates' postings, so that no notice hides another, and
(template, file position - template position) is counted: licence words in the
template's order and distance agree on that offset.  Offsets with enough words
are verified: the template's mandatory key phrase must stand there word for
word.  The score is the share of the template's words that stand at the offset.
A file's hits are in its row, so offsets are counted and verified there, by one
sort of the file's postings; no hit goes through an exchange.

Edge cases: a null or empty text has no words, no places and score 0; repeated
rows stay apart, as each is scanned by itself; ties in IDF go to
the smaller word; an empty table gives an empty result; extra columns are
neither read nor returned.  No cap limits a file's places.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .literals import ascii_lower
from .storage import materialize

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices by which public licences are applied: label, words, mandatory key phrase.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version 3", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
]
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
POSTED = 5
#: Share of the looked-up template words that must agree on an offset, and how many at least.
SHARE, LEAST = 0.5, 2


def _index(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda h: h["word"].isin(vocabulary))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"))


def _places(phrase: str) -> Column:
    """Positions in ``hits`` where the phrase's words stand consecutively; neighbours in the text are neighbours in ``hits``."""
    words = phrase.split()

    def here(h: Column, j: Column) -> Column:
        test = h["word"] == words[0]
        for k, w in enumerate(words[1:], 1):
            after = F.get(F.col("hits"), j + k)
            test = test & (after["word"] == w) & (after["pos"] == h["pos"] + k)
        return F.when(F.coalesce(test, F.lit(False)), h["pos"])

    return F.filter(F.transform("hits", here), lambda p: p.isNotNull())


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, posted: int = POSTED,
         share: float = SHARE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the matched ``notices``."""
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()} | {w for p in phrases for w in p.split()})
    index = materialize(_index(docs, vocabulary, id_col, text_col), "licence-index")

    # At most one row for each word of the templates.
    seen = index.select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").count().collect()
    files = index.count()
    idf = {r["word"]: math.log(files / r["count"]) for r in seen}
    ranked = sorted(idf, key=lambda w: (-idf[w], w))
    rare = [[w for w in ranked if w in t.split()][:posted] for _, t, _ in templates]
    looked_up = {w for words in rare for w in words}
    # Postings of the looked-up words, and of each template what is verified; as values of the plan, so that a file's row meets them where it is.
    words = {k: text.split() for k, (_, text, _) in enumerate(templates)}
    posted_at = {w: [(k, i) for k in words for i, x in enumerate(words[k]) if x == w and w in rare[k]] for w in sorted(looked_up)}
    most = max(len(x) for x in words.values())
    notice = T.StructType([T.StructField("label", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("size", "need", "key_at", "key_size")], T.StructField("words", T.ArrayType(T.StringType()))])
    table = []
    for k, (label, _, key) in enumerate(templates):
        key = key.split()
        at = next(i for i in range(len(words[k])) if words[k][i : i + len(key)] == key)
        need = max(least, math.ceil(share * sum(w in rare[k] for w in words[k])))
        table.append(F.struct(F.lit(label).alias("label"), *[F.lit(v).alias(n) for n, v in (("size", len(words[k])), ("need", need), ("key_at", at), ("key_size", len(key)))], F.array(*map(F.lit, words[k])).alias("words")))
    table = F.array(*table).cast(T.ArrayType(notice))

    def met(h: Column, j: Column) -> Column:
        """(template, offset, place in hits) of every posting of a hit's word."""
        none = F.array().cast("array<struct<template:int,offset:int,j:int>>")
        out = F.when(F.lit(False), none)
        for w, found in posted_at.items():
            out = out.when(h["word"] == w, F.array(*[F.struct(F.lit(k).alias("template"), (h["pos"] - i).alias("offset"), j.alias("j")) for k, i in found]))
        return out.otherwise(none)

    # In order, postings that agree on a template's offset are neighbours: the first of them is kept if as many as needed follow.
    index = index.withColumn("met", F.array_sort(F.flatten(F.transform("hits", met))))

    def likely(m: Column, i: Column) -> Column:
        def same(other: Column) -> Column:
            return F.coalesce((other["template"] == m["template"]) & (other["offset"] == m["offset"]), F.lit(False))

        need = F.get(table, m["template"])["need"]
        return ~same(F.get(F.col("met"), i - 1)) & same(F.get(F.col("met"), i + need - 1))

    index = index.withColumn("likely", F.filter("met", likely))

    def verified(m: Column) -> Column:
        """The template's words that stand at the offset; all of them are within its size of any one in hits."""
        n = F.get(table, m["template"])
        near = F.slice("hits", F.greatest(m["j"] + 1 - most, F.lit(1)), F.lit(2 * most))
        there = F.filter(near, lambda h: F.coalesce(F.get(n["words"], h["pos"] - m["offset"]) == h["word"], F.lit(False)))
        keys = F.filter(there, lambda h: (h["pos"] - m["offset"]).between(n["key_at"], n["key_at"] + n["key_size"] - 1))
        return F.struct(m["offset"].alias("start"), n["label"].alias("label"), (F.size(there) / n["size"]).alias("share"), (F.size(keys) == n["key_size"]).alias("whole"))

    notices = F.filter(F.transform("likely", verified), lambda v: v["whole"])
    notices = F.array_sort(F.transform(notices, lambda v: F.struct(v["start"].cast("long").alias("start"), v["label"].alias("label"), v["share"].alias("share"))))
    index = index.withColumn("found", notices)

    places = F.array_sort(F.concat(*[_places(p) for p in phrases]))
    labels = F.concat(*[F.when(F.size(_places(p)) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for p, label in phrases.items()])
    base = index.select("doc_id", "n_words", places.alias("places"), F.array_sort(F.array_distinct(labels)).alias("own"), "found")
    out = base.select("*", F.col("found.label").alias("more"), F.array_max("found.share").alias("share"), F.when(F.size("found") > 0, F.col("found")).alias("notices"))
    return out.select(
        "doc_id", "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0)).cast("long").alias("first_word"),
        F.get("places", F.size("places") - 1).cast("long").alias("last_word"),
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", "more")), ",").alias("labels"),
        F.coalesce("share", F.when(F.size("places") > 0, F.lit(0.5)), F.lit(0.0)).alias("score"),
        "notices",
    )
