"""License scans: phrase places, and an exact set-similarity join of text blocks with license templates.

A block is any run of consecutive words, over line ends too, a quarter longer than the template. The join finds every
block b and template t with |b and t| >= needed, both as word sets; ``needed`` is 0.8 of the template's words, or all
of them where it has fewer than ten. Words are put in one global order, rarest in the whole corpus first. A document
can only hold such a block if it holds one of the first |t| - needed + 1 words of the template (prefix filter), enough
template words at all (length filter), and enough of them from the shared word on in both orders (position filter).
In what is left, every block that starts at a template word is counted exactly; no other can hold more. Only template
words have a place in the order: no other word can be shared.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public license texts and notices, as words.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions"""),
    ("mit", """the software is provided as is without warranty of any kind express or implied including but not limited to
        the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the
        authors or copyright holders be liable for any claim damages or other liability whether in an action of contract
        tort or otherwise arising from out of or in connection with the software or the use or other dealings in the
        software"""),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", """licensed under the apache license version 2 0 the license you may not use this file except in
        compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
        unless required by applicable law or agreed to in writing software distributed under the license is distributed
        on an as is basis without warranties or conditions of any kind either express or implied see the license for the
        specific language governing permissions and limitations under the license"""),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general
        public license as published by the free software foundation either version of the license or at your option any
        later version this program is distributed in the hope that it will be useful but without any warranty without
        even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public
        license for more details"""),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc", """this work is licensed under a creative commons attribution international license to view a copy of this
        license visit http creativecommons org licenses"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met redistributions of source code must retain the above copyright notice this list
        of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright
        notice this list of conditions and the following disclaimer in the documentation and or other materials provided
        with the distribution"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies"""),
    ("mpl-2.0", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl
        was not distributed with this file you can obtain one at http mozilla org mpl 2 0"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify
        publish use compile sell or distribute this software either in source code form or as a compiled binary for any
        purpose commercial or non commercial and by any means"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be
        held liable for any damages arising from the use of this software permission is granted to anyone to use this
        software for any purpose including commercial applications and to alter it and redistribute it freely subject to
        the following restrictions"""),
]
#: Share of a template's different words that a block must hold; templates of fewer than SHORT different words: all.
THRESHOLD, SHORT = 0.8, 10
#: Length of a block, in lengths of the template.
STRETCH = 1.25


def words_of(text: Column) -> Column:
    """Lower-case words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Letters beyond A-Z are lowered too, which
    can make no base phrase and split or join no word."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def _literal(words: list[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def word_order(docs: DataFrame, templates: list[tuple[str, str]]) -> list[str]:
    """The templates' words, rarest first by the number of documents that hold them; ties by code point."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    met = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), _literal(vocabulary))).alias("word"))
    counts = {r["word"]: r["count"] for r in met.groupBy("word").count().collect()}  # as many rows as template words
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def needed(words: set[str], threshold: float) -> int:
    return len(words) if len(words) < SHORT else ceil(threshold * len(words) - 1e-9)


def template_table(spark: SparkSession, order: list[str], templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """One row per template and prefix word: label, its words in order, how many are needed, length of a block, word, place."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for n, (label, text) in enumerate(templates):
        words, long = sorted(set(text.split()), key=rank.__getitem__), ceil(STRETCH * len(text.split()))
        need = needed(set(words), threshold)
        if words:
            values = (n, label, _literal(words), need, long, _literal(words[: len(words) - need + 1]))
            rows.append(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(c) for c, v in zip(("n", "label", "words", "need", "long", "prefix"), values, strict=True)]))
    kind = "array<struct<n:int,label:string,words:array<string>,need:int,long:int,prefix:array<string>>>"
    each = spark.range(1).select(F.explode(F.array(*rows).cast(kind)).alias("t")).select("t.*")
    return each.select("n", "label", "words", "need", "long", F.posexplode("prefix").alias("place", "word"))


def block_matches(rows: DataFrame, prefixes: DataFrame, order: list[str]) -> DataFrame:
    """``rows(rid, w)``, w a document's words -> ``(rid, label, contained)`` for every template that a block meets;
    contained: the largest share of its words in one block."""
    at = F.array_sort(F.transform(F.array_intersect("w", _literal(order)), lambda w: F.array_position(_literal(order), w)))
    held = F.transform(at, lambda r: F.element_at(_literal(order), r.cast("int")))
    shared = rows.select("rid", held.alias("held")).select("rid", "held", F.posexplode("held").alias("j", "word")).join(F.broadcast(prefixes), "word")
    may = shared.where("size(held) >= need").where("1 + least(size(words) - place - 1, size(held) - j - 1) >= need").where(F.size(F.array_intersect("held", "words")) >= F.col("need"))
    pairs = may.select("rid", "n", "label", "words", "need", "long").dropDuplicates(["rid", "n"])
    # the places of a template's words in each document that may hold it
    places = F.expr("filter(transform(w, (x, i) -> struct(i as at, x as word)), s -> array_contains(words, s.word))")
    found = pairs.join(rows, "rid").withColumn("places", places)
    blocks = F.expr("transform(places, (p, i) -> size(array_distinct(transform(filter(slice(places, i + 1, long), s -> s.at < p.at + long), s -> s.word))))")
    best = found.select("rid", "label", "need", F.size("words").alias("size"), F.array_max(blocks).alias("best")).where("best >= need")
    return best.select("rid", "label", (F.col("best") / F.col("size")).alias("contained"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score)``, one row per input row.

    ``score`` is 1 with a base phrase, else the largest containment of a template that a block meets, else 0.
    A null or empty text has no words: zeros, null places, empty labels. Long texts are read whole. Documents that hold a
    template several times count once. Templates without words match nothing, nor does an empty list of them. Repeated rows and null ids stay. Empty table: no rows. Extra columns are left out.
    """
    templates = TEMPLATES if templates is None else templates
    order = word_order(docs, templates)
    prefixes = template_table(docs.sparkSession, order, templates, threshold)
    rare = sorted({r["word"] for r in prefixes.select("word").distinct().collect()})  # template words
    starts = "|".join(PHRASES)
    w, line = F.col("w"), F.col("line")
    may = F.exists(_literal(sorted({p.split()[-1] for p in PHRASES})), lambda x: F.array_contains(w, x))
    based = (
        docs.select(F.col("doc_id").cast("bigint"), words_of(F.col("text")).alias("w"))
        .withColumn("line", F.when(may, F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))).otherwise(F.lit(" ")))
        .withColumn("pieces", F.split(line, f"(?<= )(?=(?:{starts}) )"))
        .select(
            "doc_id",
            F.size(w).cast("bigint").alias("n_words"),
            (F.size("pieces") - 1).cast("bigint").alias("n_base"),
            F.when(F.size("pieces") > 1, F.size(F.split(F.element_at("pieces", 1), " ")) - 2).cast("bigint").alias("first_word"),
            F.when(F.size("pieces") > 1, F.size(w) - F.size(F.split(F.element_at("pieces", -1), " ")) + 1).cast("bigint").alias("last_word"),
            F.array_compact(F.array(*[F.when(line.contains(f" {p} "), F.lit(v)) for p, v in PHRASES.items()])).alias("base"),
            F.when(F.arrays_overlap(w, _literal(rare)), w).alias("w"),
        )
        .withColumn("rid", F.monotonically_increasing_id())
    )
    rows = saved(based, "licenses")
    met = block_matches(rows.where("w is not null").select("rid", "w"), prefixes, order)
    per = met.groupBy("rid").agg(F.collect_set("label").alias("found"), F.max("contained").alias("contained"))
    joined = rows.drop("w").join(per, "rid", "left")
    names = lambda c: F.array_join(F.array_sort(c), ",")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        names(F.col("base")).alias("base_labels"),
        names(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_T = ", ".join(f"({n}, '{label}', '{' '.join(text.split())}')" for n, (label, text) in enumerate(TEMPLATES))
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT *, list_filter(range(len(w)), lambda i: (w[i+1] = 'cc' AND w[i+2] = 'by')
    OR (w[i+1] = 'general' AND w[i+2] = 'public' AND w[i+3] = 'license')
    OR (w[i+1] = 'all' AND w[i+2] = 'rights' AND w[i+3] = 'reserved')) AS s FROM d),
b AS (SELECT *, list_sort(list_distinct(list_transform(s, lambda i: CASE w[i+1] WHEN 'cc' THEN 'cc-by' WHEN 'general' THEN 'gpl' ELSE 'reserved' END))) AS base FROM p),
t AS (SELECT n, label, list_distinct(string_split(text, ' ')) AS words, ceil({STRETCH} * len(string_split(text, ' ')))::BIGINT AS long
    FROM (VALUES {_T}) v(n, label, text)),
k AS (SELECT *, CASE WHEN len(words) < {SHORT} THEN len(words) ELSE ceil({THRESHOLD} * len(words) - 1e-9) END AS need FROM t),
m AS (SELECT rid, label, len(words) AS size, need,
    list_max(list_transform(range(len(w)), lambda i: len(list_intersect(list_distinct(w[i+1:i+long]), words)))) AS best
    FROM d, k WHERE len(list_intersect(list_distinct(w), words)) >= need),
g AS (SELECT rid, list(DISTINCT label) AS found, max(best / size) AS c FROM m WHERE best >= need GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, len(s)::BIGINT AS n_base, list_min(s)::BIGINT AS first_word, list_max(s)::BIGINT AS last_word,
    array_to_string(base, ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
    CASE WHEN len(s) > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM b LEFT JOIN g USING (rid)
"""
