"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-grams of all documents are joined to the places where templates hold them. A hit at
word p of a document and word q of a template votes for the diagonal p - q. Votes are added up by
diagonal, neighbouring diagonals are merged (words put in or left out shift a copy by a few), and the
merged spans are verified: the different k-grams of the template that they hold must be most of it, in a
stretch not much longer than the template.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bind, table

K = 3
#: Neighbouring diagonals whose votes are merged.
DRIFT = 3
#: Share of a template's k-grams that a verified span must hold.
MIN_SHARE = 0.75

#: Phrases whose words must all stand together, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Further license notices and the bodies of whole licenses; a span that holds most of one counts.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    (
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable "
        "for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
        "with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    ("licensed under the apache license version 2 0", "apache-2"),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing "
        "permissions and limitations under the license",
        "apache-2",
    ),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl",
    ),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense",
    ),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
)

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(gram, template, label, exact, at, grams): all k-grams of the given templates, a table whose size the caller fixes."""
    rows = []
    for n, (exact, (text, label)) in enumerate([(True, x) for x in phrases] + [(False, x) for x in templates]):
        words = [w for w in re.split(NO_WORD, text.translate(str.maketrans(UPPER, LOWER))) if w]
        if len(words) < k:
            raise ValueError(f"a template of fewer than {k} words: {text}")
        rows += [(" ".join(words[i : i + k]), n, label, exact, i, len(words) - k + 1) for i in range(len(words) - k + 1)]
    return spark.createDataFrame(rows, "gram string, template int, label string, exact boolean, at int, grams int")


def words_of(text: str):
    """The lower-case words of a text column; a null text has none."""
    return F.filter(F.split(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), NO_WORD), lambda w: w != "")


def _row_key(doc_id: str, text: str):
    """Names a document by id and text. Copies of a text have keys of their own, so a hot text is in no one task."""
    return F.md5(F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit("-")), F.coalesce(F.col(text).cast("string"), F.lit(""))))


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES, k: int = K, drift: int = DRIFT, min_share: float = MIN_SHARE) -> DataFrame:
    """(key, template, label, exact, first_word, last_word, share): verified places of templates in documents; `key` names
    a document by its id and text.

    A phrase counts only where every word stands in its place: all its k-grams on one diagonal, none shifted. Of
    other templates a span must hold `min_share` of the different k-grams; one that is said again counts once.
    """
    grams = template_grams(docs.sparkSession, phrases, templates, k)
    rolled = docs.select(_row_key(doc_id, text).alias("key"), words_of(text).alias("words")).select(
        "key",
        F.posexplode(
            bind(
                F.col("words"),
                lambda w: F.transform(
                    F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>")), lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(k)))
                ),
            )
        ).alias("pos", "gram"),
    )
    # the templates' k-grams are a constant of this module or of the caller's: some hundred rows
    hits = rolled.join(F.broadcast(grams), "gram").withColumn("diagonal", F.col("pos") - F.col("at"))
    one = ["key", "template", "label", "exact", "grams"]
    # a vote is a k-gram of the template: at most as many as it has
    diagonals = hits.groupBy(*one, "diagonal").agg(F.collect_set("at").alias("votes"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    place = Window.partitionBy("key", "template").orderBy("diagonal")
    banded = diagonals.withColumn("new", F.coalesce(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(place) > drift), F.lit(True)).cast("int")).withColumn(
        "band", F.sum("new").over(place.rowsBetween(Window.unboundedPreceding, 0))
    )
    voted = banded.withColumn("at", F.explode("votes")).groupBy(*one, "band", "at").agg(F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"))
    merged = voted.groupBy(*one, "band").agg(F.count("*").alias("votes"), F.min("first_pos").alias("first_word"), F.max("last_pos").alias("last_pos"))
    return (
        merged.withColumn("share", F.col("votes") / F.col("grams"))
        .filter(F.when(F.col("exact"), F.col("votes") == F.col("grams")).otherwise((F.col("share") >= min_share) & (F.col("last_pos") - F.col("first_word") + 1 <= 2 * F.col("grams"))))
        .select("key", "template", "label", "exact", "first_word", (F.col("last_pos") + k - 1).alias("last_word"), "share")
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row a document, with or without license. A null or empty text has no words and no label; documents
    with the same id or text are rows of their own; texts of any length are read whole; other columns are not read."""
    found = spans(docs, doc_id, text, **how).groupBy("key").agg(
        F.sum(F.col("exact").cast("long")).alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("first_word").cast("long"))).alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first_word").cast("long"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))).alias("base"),
        F.array_sort(F.collect_set("label")).alias("all"),
        F.max("share").alias("score"),
    )
    own = docs.select(F.col(doc_id).alias("doc_id"), _row_key(doc_id, text).alias("key"), F.size(words_of(text)).cast("long").alias("n_words"))
    joined = own.join(found.hint("merge"), "key", "left")
    return joined.select(
        "doc_id", "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce(F.concat_ws(",", "base"), F.lit("")).alias("base_labels"),
        F.coalesce(F.concat_ws(",", "all"), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
