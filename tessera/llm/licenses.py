"""License scans by diagonal voting, in DataFrame operations only.

Every rolling k-gram of a text's words is hashed and joined to the places of that k-gram in license templates.
A match votes for a diagonal: its position in the text less its position in the template. Votes are summed by
diagonal; diagonals a few words apart are merged, so inserted or missing words don't break a match; spans are
verified by comparing the words themselves and by the share of the template that they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table

K = 3
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of templates that are sent to all executors at most (about 100 bytes each); more are joined by a shuffle.
TEMPLATE_WORDS = 200_000
#: Phrases that give a label wherever their words stand consecutively.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Public licenses' whole bodies (the short ones), notices and openings; matched by the share of their k-grams.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses": "gpl",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
}


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.when(text.rlike("[A-Z]"), F.translate(text, A_Z, a_z)).otherwise(text)


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), WORD_GAP), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """pos, hash and words of every rolling k-gram; a text of fewer words has none."""
    last = F.size(words) - K
    place = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    at = lambda i, j: F.get(words, i + j)
    return F.transform(place, lambda i: F.struct(i.alias("pos"), F.xxhash64(*(at(i, j) for j in range(K))).alias("h"), *(at(i, j).alias(f"w{j}") for j in range(K))))


def templates(spark: SparkSession, base: dict[str, str], texts: dict[str, str]) -> DataFrame:
    """One row per k-gram of a template: template, label, is_base, size (its k-grams), tpos, h and words."""
    rows = [(n, p, label, p in base) for n, (p, label) in enumerate([*base.items(), *texts.items()])]
    t = spark.createDataFrame(rows, "template int, phrase string, label string, is_base boolean")
    g = t.withColumn("g", F.explode(grams_of(F.split("phrase", " "))))
    size = F.size(F.split("phrase", " ")) - (K - 1)
    return g.select("template", "label", "is_base", size.alias("size"), F.col("g.pos").alias("tpos"), F.col("g.h").alias("h"), *(F.col(f"g.w{j}").alias(f"t{j}") for j in range(K)))


def scan(docs: DataFrame, base: dict[str, str] = BASE, texts: dict[str, str] = TEXTS, gap: int = 4, cover: float = 0.6) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Base phrases (of at least K words) count wherever all their words stand consecutively. Other templates add
    their label where merged diagonals, at most `gap` words from one to the next, cover the share `cover` of
    their k-grams. score is the largest share covered, 1 with a base phrase. Null text counts as empty; null
    doc_id and repeated rows are kept apart by a row number; extra columns are ignored. Labels sort by name;
    spans (label, first, last word) sort by place."""
    spark = docs.sparkSession
    short = [p for p in [*base, *texts] if len(p.split()) < K]
    if short:
        raise ValueError(f"phrases of fewer than {K} words: {short}")
    known = templates(spark, base, texts)
    if sum(len(p.split()) for p in [*base, *texts]) <= TEMPLATE_WORDS:
        known = F.broadcast(known)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.coalesce("text", F.lit(""))).alias("words"))
    # A row at place -1 stands for the text itself and carries its number of words.
    own = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("h"), *(F.lit(None).cast("string").alias(f"w{j}") for j in range(K))))
    grams = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(own, grams_of(F.col("words")))).alias("g"))
    grams = grams.select("row", "doc_id", "n_words", F.col("g.pos").alias("pos"), F.col("g.h").alias("h"), *(F.col(f"g.w{j}").alias(f"w{j}") for j in range(K)))
    votes = grams.join(known, "h", "left").filter("pos = -1 OR template IS NOT NULL")
    same = F.col("w0") == F.col("t0")
    for j in range(1, K):
        same = same & (F.col(f"w{j}") == F.col(f"t{j}"))
    diagonals = votes.groupBy("row", "doc_id", "n_words", "template", "label", "is_base", "size", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count_if(same).alias("votes"), F.min(F.when(same, F.col("pos"))).alias("first"), F.max(F.when(same, F.col("pos") + K - 1)).alias("last")
    )
    # Merge neighbouring diagonals of one template in one text; the group's size is bounded by the text's hits.
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > gap) | F.col("is_base"), F.lit(True))
    band = F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = diagonals.withColumn("band", band).groupBy("row", "doc_id", "n_words", "template", "label", "is_base", "size", "band").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    share = F.least(F.coalesce(F.col("votes") / F.col("size"), F.lit(0.0)), F.lit(1.0))
    dense = F.col("last") - F.col("first") + 1 <= 2 * (F.col("size") + K - 1)
    hit = F.when(F.col("is_base"), F.col("votes") >= F.col("size")).otherwise((share >= cover) & dense)
    found = spans.withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn("share", share)
    place = F.when(F.col("hit") & F.col("is_base"), F.col("first").cast("long"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        found.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(place).alias("n_base"),
            F.min(place).alias("first_word"),
            F.max(place).alias("last_word"),
            joined(F.when(F.col("hit") & F.col("is_base"), F.col("label"))).alias("base_labels"),
            joined(F.when(F.col("hit"), F.col("label"))).alias("labels"),
            F.max(F.when(F.col("hit"), F.col("share")).otherwise(F.least("share", F.lit(0.99)) * 0.5)).alias("score"),
            F.to_json(F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct("first", "last", "label"))))).alias("spans"),
        )
        .drop("row")
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
