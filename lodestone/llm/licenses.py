"""License scans by diagonal voting, by DataFrame and SQL operations only.

The hashes of all rolling K-word windows of every text are joined to the
positions where license templates have them. Hits of one template whose text
position less template position agree lie on one diagonal; they are counted by
diagonal, diagonals within DRIFT of each other (words put in or left out) are
merged, and a merged span is verified by the share of the template that it
covers. The templates are fixed, so their windows are a bounded broadcast.

Words are extracted once: of each text the base figures, the number of the row
and the windows that some template has are written to the shared folder, and the
join works on those.

Defined cases: a null text counts as empty and has no words, labels or places
and a score of 0; repeated rows and rows without an id are returned each, with
results of their own text; an empty table gives no rows; texts are read whole;
other columns are left out.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, texts
from .spans import let

K = 3
DRIFT = 3
LEAST_COVER = 0.6
LEAST_WINDOWS = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base rule and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label and wording of public license notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("apache", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("apache", "you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications and in source or object form provided that you meet the following conditions"),
    ("gpl", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "you may convey verbatim copies of the program s source code as you receive it in any medium provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", "each contributor hereby grants you a world wide royalty free non exclusive license under intellectual property rights other than patent or trademark licensable by such contributor to use reproduce make available modify display perform distribute and otherwise exploit its contributions"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows_of(words: Column, k: int = K) -> Column:
    """Hashes of all k-word windows, by position; a word is hashed once."""

    def over(hashes):
        n = F.size(hashes)
        return F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), over)


def templates_table(spark, templates=TEMPLATES, k: int = K) -> DataFrame:
    """template, label, n_windows, position and hash of each window of each template."""
    rows = [(i, label, t) for i, (label, t) in enumerate(templates)]
    t = spark.createDataFrame(rows, "template int, label string, text string")
    return t.select("template", "label", words_of(F.col("text")).alias("words")).select("template", "label", windows_of(F.col("words"), k).alias("w")).select("template", "label", F.size("w").alias("n_windows"), F.posexplode("w").alias("t_at", "hash"))


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively."""
    parts = phrase.split()

    def stands(i):
        return reduce(and_, [F.get(words, i + j) == p for j, p in enumerate(parts)])

    return F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), stands)


def base_figures(words: Column) -> Column:
    """n_words, and the places and labels of the phrases."""
    none = F.array().cast("array<int>")
    # A phrase's last word is a cheap test.
    places = F.array(*[F.when(F.array_contains(words, p.split()[-1]) & (F.size(words) >= len(p.split())), _places(words, p)).otherwise(none) for p, _ in PHRASES])

    def over(found):
        labels = [F.when(F.size(F.get(found, F.lit(i))) > 0, label) for i, (_, label) in enumerate(PHRASES)]
        every = F.flatten(found)
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base")
        )

    return let(places, over)


def scanned(docs: DataFrame, table: list[int], id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, row (a number of its own), the base figures and hits (place and hash of the windows that are in table) of each row of docs; one pass over the texts."""
    words = texts(docs, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row"), words_of(F.col("text")).alias("words"))
    hits = F.filter(F.transform(windows_of(F.col("words"), k), lambda h, i: F.struct(i.alias("at"), h.alias("hash"))), lambda x: x["hash"].isin(table))
    return materialize(words.select("doc_id", "row", base_figures(F.col("words")).alias("figures"), hits.alias("hits")), "licenses")


def diagonal_spans(rows: DataFrame, table: DataFrame, k: int = K, drift: int = DRIFT) -> DataFrame:
    """Verified spans of the templates: row, label, first_word, last_word, cover. rows: row, hits; table: templates_table()."""
    hits = rows.select("row", F.explode("hits").alias("x")).select("row", "x.at", "x.hash").join(F.broadcast(table), "hash")
    diagonals = (
        hits.withColumn("diagonal", F.col("at") - F.col("t_at"))
        .groupBy("row", "template", "diagonal")
        .agg(F.first("label").alias("label"), F.first("n_windows").alias("n_windows"), F.collect_set("t_at").alias("held"), F.min("at").alias("first"), F.max("at").alias("last"))
    )
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(near)
    merged = (
        diagonals.withColumn("new", F.when(gap <= drift, 0).otherwise(1))
        .withColumn("run", F.sum("new").over(near))
        .groupBy("row", "template", "run")
        .agg(F.first("label").alias("label"), F.first("n_windows").alias("n_windows"), F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("held"), F.min("first").alias("first_word"), (F.max("last") + k - 1).alias("last_word"))
    )
    cover = F.col("held") / F.col("n_windows")
    return merged.filter((cover >= LEAST_COVER) & (F.col("held") >= F.least(F.lit(LEAST_WINDOWS), F.col("n_windows")))).select("row", "label", "first_word", "last_word", cover.alias("cover"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (greatest share of a template that a verified span covers) of each row of docs."""
    table = templates_table(docs.sparkSession)
    # The templates are fixed, so their windows may come to the driver.
    rows = scanned(docs, sorted({r["hash"] for r in table.select("hash").collect()}), id_col, text_col)
    method = diagonal_spans(rows, table).groupBy("row").agg(F.collect_set("label").alias("own"), F.max("cover").alias("cover"))
    both = rows.select("doc_id", "row", "figures.*").join(method, "row", "left")
    own = F.coalesce("own", F.array().cast("array<string>"))
    score = F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"), F.least(score, F.lit(1.0)).alias("score"))
