"""License scans by a positional index of rare licence words.

Native: DataFrame functions only.

1. ``scan`` splits each text into words once and keeps, per text, the places
   of the phrases and the places of all index words of the templates.
2. Document frequencies of the index words over all texts give their IDF.  A
   template's rarest words, those of highest IDF that together carry over
   ``1 - LEAST`` of its weight, are its entries in the rare-word index.
3. Each text looks up its rarest licence words: templates are candidates where
   one of their rarest words occurs; without any of them no shift can carry
   enough.  Places of a candidate's words are intersected by relative position:
   occurrences that stand as far apart as in the template share one shift.
4. A template is found where the words of one shift carry at least ``LEAST``
   of its IDF weight, and where, checked last, its mandatory key phrase stands
   in the text.

Null and empty texts have no words, no places and no labels; an empty table
gives no rows.  Repeated rows are judged each.  Of templates with equal scores
all give their labels.  Work is linear in the length of a text; the array of
its licence words is its largest row.  Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored
from .words import word_array

#: Phrases whose places count, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices as they are commonly written, in lower-case words: label, words, mandatory key phrase.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "permission notice shall be included"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "this list of conditions"),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "alter it and redistribute it freely"),
    ("boost-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "in compliance with the license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "source code form is subject"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "related or neighboring rights"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)
#: Words too common to index.
COMMON = frozenset("a an and any all are as at be been but by can do either for form forms from has have http if in is it may must no not of on one or other out see shall so some such than that the their there they this to under use used v was we were what when which who whom will with without you your 0 1 2 3 4".split())
#: The share of a template's weight that must be met.
LEAST = 0.6


def _places(phrase: str, anchor: int) -> Column:
    """Word indexes where the phrase starts, found from its word number ``anchor``."""
    words = phrase.split()
    at = F.filter(F.transform("_w", lambda x, i: F.when(x == words[anchor], i - anchor)), lambda i: i.isNotNull() & (i >= 0))
    return F.filter(at, lambda i: F.slice("_w", i + 1, F.lit(len(words))) == F.array(*map(F.lit, words)))


def _anchor(phrase: str) -> int:
    words = phrase.split()
    return max(range(len(words)), key=lambda k: (words[k] not in COMMON, len(words[k])))


def postings(spark: SparkSession) -> DataFrame:
    """template, label, key, word, at: index words of all templates by position (a fixed, small table)."""
    rows = [(t, label, key, w, at) for t, (label, notice, key) in enumerate(TEMPLATES) for at, w in enumerate(notice.split()) if w not in COMMON]
    return spark.createDataFrame(rows, "template int, label string, key string, word string, at int")


def places(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, n_words, one array of places for each phrase (p0, p1, ...), keys (key phrases that stand in the text) and seen (index words with their places)."""
    index = sorted({w for _, notice, _ in TEMPLATES for w in notice.split() if w not in COMMON})
    keys = sorted({key for _, _, key in TEMPLATES})
    split = docs.select(*keep, word_array(F.col(text)).alias("_w"))
    seen = F.filter(F.transform("_w", lambda x, i: F.when(x.isin(index), F.struct(x.alias("word"), i.alias("at")))), lambda s: s.isNotNull())
    first = split.select(*keep, F.size("_w").alias("n_words"), seen.alias("seen"), F.when(F.exists("_w", lambda x: x.isin([*index, *(p.split()[_anchor(p)] for p in PHRASES)])), F.col("_w")).otherwise(F.array().cast("array<string>")).alias("_w"))
    stands = F.array_compact(F.array(*[F.when(F.size(_places(k, _anchor(k))) > 0, F.lit(k)) for k in keys]))
    return first.select(*keep, "n_words", "seen", *[_places(p, _anchor(p)).alias(f"p{n}") for n, p in enumerate(PHRASES)], stands.alias("keys"))


def rarest(index: DataFrame) -> DataFrame:
    """template, word: of each template the words of highest IDF, as many as carry over 1 - LEAST of its weight; index has template, word, idf, weight."""
    words = index.groupBy("template", "word").agg(F.max("idf").alias("idf"), F.sum("weight").alias("weight"))
    before = W.partitionBy("template").orderBy(F.desc("idf"), "word").rowsBetween(W.unboundedPreceding, -1)  # the words of one template
    return words.withColumn("before", F.round(F.coalesce(F.sum("weight").over(before), F.lit(0.0)), 9)).where(F.col("before") <= 1 - LEAST).select("template", "word")


def shifts_of(found: DataFrame, index: DataFrame) -> DataFrame:
    """row, label, key, keys, weight of the shifts at which words of candidate templates stand in the texts of found (row, seen, keys)."""
    rare = F.broadcast(stored(rarest(index)))
    distinct = found.select("row", F.explode(F.array_distinct(F.col("seen.word"))).alias("word"))
    candidates = distinct.join(rare, "word").groupBy("row").agg(F.collect_set("template").alias("templates"))  # at most all templates
    looked = found.join(candidates, "row").select("row", "keys", "templates", F.explode("seen").alias("s"))
    # places of one template that stand as far apart as in it share a shift
    met = looked.join(F.broadcast(index), (F.col("s.word") == F.col("word")) & F.array_contains("templates", F.col("template")))
    return met.groupBy("row", "template", "label", "key", (F.col("s.at") - F.col("at")).alias("shift")).agg(F.round(F.sum("weight"), 9).alias("weight"), F.first("keys").alias("keys"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    score is the largest share of a candidate template's weight that stands in
    one shift of a text with its key phrase.
    """
    spark = docs.sparkSession
    found = stored(places(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), ["doc_id", "row"]))
    total = found.count()
    with_words = found.where(F.size("seen") > 0)
    df = with_words.select(F.explode(F.array_distinct(F.col("seen.word"))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    index = postings(spark).join(df, "word", "left").withColumn("idf", F.log((F.lit(total) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 0.1)
    index = stored(index.withColumn("weight", F.col("idf") / F.sum("idf").over(W.partitionBy("template"))))  # as many rows as the templates have words
    shifts = shifts_of(with_words.select("row", "seen", "keys"), index).where(F.array_contains("keys", F.col("key")))
    named = shifts.groupBy("row").agg(F.collect_set(F.when(F.col("weight") >= LEAST, F.col("label"))).alias("more"), F.max("weight").alias("best"))
    joined = found.join(named, "row", "left")
    parts = [F.col(f"p{n}") for n in range(len(PHRASES))]
    everywhere = F.concat(*parts)
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(parts, PHRASES.values(), strict=True)])))
    return joined.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(everywhere).cast("long").alias("n_base"),
        F.array_min(everywhere).cast("long").alias("first_word"),
        F.array_max(everywhere).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.round("best", 6), F.lit(0.0))).alias("score"),
    )
