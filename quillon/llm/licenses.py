"""License scans: exact phrases, and templates found by diagonal voting.

All rolling K-word hashes of all texts are joined to the positions where the
license templates have the same K words.  A match votes for the diagonal
(document position minus template position); votes of a document, template and
diagonal are added up, diagonals within SLACK words are merged (a few words put
in or left out), and a merged span is verified by the share of template words it
covers.  The template table is fixed and small, so it is broadcast; nothing is
shuffled but the votes and one short row a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.textops import Chunk, by_chunk, byte_class, grams, lists
from quillon.llm.workdir import mapped

K = 4
SLACK = 3
#: A span is taken if it covers this share of its template, or this many words of it, and this share of what it spans.
MIN_COVER, MIN_WORDS, MIN_DENSITY = 0.75, 24, 0.6

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Public license notices by label (words only; case and marks don't matter).
TEMPLATES = (
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("all-rights-reserved", "copyright all rights reserved no part of this publication may be reproduced distributed or transmitted in any form"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def _words(texts: pa.Array) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk, a hash of each word, its document, its index within it, and the number of words of each document."""
    chunk = Chunk(texts)
    chunk.buf = _FOLD[chunk.buf]
    starts, ends = chunk.segments(_WORD)
    doc = chunk.doc_of(starts)
    n = np.bincount(doc, minlength=chunk.n)
    first = np.cumsum(n) - n
    return chunk, chunk.hash(starts, ends), doc, np.arange(len(starts)) - first[doc], n


def _rolling(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs within one document, and the index of their first word."""
    g = grams(h, k)
    whole = np.flatnonzero(doc[: len(g)] == doc[k - 1 :]) if len(g) else np.zeros(0, np.int64)
    return g[whole], whole


def _phrase_hashes() -> list[tuple[str, int, np.uint64]]:
    out = []
    for phrase, label in PHRASES.items():
        _, h, doc, _, n = _words(pa.array([phrase]))
        out.append((label, int(n[0]), _rolling(h, doc, int(n[0]))[0][0]))
    return out


def _base(rows: DataFrame) -> DataFrame:
    """Per row: n_words and where the phrases stand."""
    keep = [f for f in rows.schema if f.name != "text"]
    schema = T.StructType([*keep, *T.StructType().add("n_words", "long").add("n_base", "long").add("first_word", "long").add("last_word", "long").add("base", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _phrase_hashes()

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            _, h, doc, index, n = _words(b.column(b.schema.get_field_index("text")))
            count = np.zeros(len(n), np.int64)
            first, last = np.full(len(n), np.iinfo(np.int64).max), np.full(len(n), -1)
            labels: list[set[str]] = [set() for _ in n]
            for label, k, want in phrases:
                g, at = _rolling(h, doc, k)
                at = at[g == want]
                np.add.at(count, doc[at], 1)
                np.minimum.at(first, doc[at], index[at])
                np.maximum.at(last, doc[at], index[at])
                for d in set(doc[at].tolist()):
                    labels[d].add(label)
            none = count == 0
            cols = [b.column(b.schema.get_field_index(f.name)) for f in keep]
            return pa.RecordBatch.from_arrays([*cols, pa.array(n.astype(np.int64)), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([sorted(x) for x in labels], pa.list_(pa.string()))], schema.names)

        return by_chunk(one)(batches)

    return mapped(rows, run, schema)


def template_positions(spark) -> DataFrame:
    """One row per position of each template: template, label, length, tpos, gram."""
    rows = []
    for t, (label, text) in enumerate(TEMPLATES):
        _, h, doc, _, n = _words(pa.array([text]))
        g, at = _rolling(h, doc, K)
        rows += [(t, label, int(n[0]), int(i), int(x)) for x, i in zip(g.astype(np.int64), at)]
    return spark.createDataFrame(rows, "template int, label string, length int, tpos int, gram long")


def _grams(rows: DataFrame) -> DataFrame:
    """Per row its key and all its rolling K-word hashes, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            _, h, doc, _, n = _words(b.column(b.schema.get_field_index("text")))
            g, _ = _rolling(h, doc, K)
            return pa.RecordBatch.from_arrays([b.column(0), lists(g.astype(np.int64), np.maximum(n - K + 1, 0), pa.int64())], ["key", "grams"])

        return by_chunk(one)(batches)

    return mapped(rows, run, T.StructType([rows.schema["key"], T.StructField("grams", T.ArrayType(T.LongType()))]))


def spans(rows: DataFrame) -> DataFrame:
    """Verified license spans of rows (key, text): key, label, first, last (words), cover (share of the template)."""
    votes = _grams(rows.select("key", "text")).select("key", F.posexplode("grams").alias("pos", "gram")).join(F.broadcast(template_positions(rows.sparkSession)), "gram")
    # rows that are equal have one key: their votes are the same places
    by_diagonal = votes.groupBy("key", "template", "label", "length", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("at"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK) | F.lag("diagonal").over(order).isNull()
    merged = by_diagonal.withColumn("band", F.sum(fresh.cast("int")).over(order)).groupBy("key", "template", "label", "length", "band").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"), F.min("first").alias("first"), (F.max("last") + (K - 1)).alias("last"))
    covered = F.aggregate("at", F.struct(F.lit(-K).alias("p"), F.lit(0).alias("n")), lambda a, x: F.struct(x.alias("p"), (a["n"] + F.least(F.lit(K), x - a["p"])).alias("n")))["n"]
    merged = merged.withColumn("covered", covered).withColumn("cover", F.col("covered") / F.col("length"))
    stretch = F.element_at("at", -1) + K - F.element_at("at", 1)
    return merged.where(((F.col("cover") >= MIN_COVER) | (F.col("covered") >= MIN_WORDS)) & (F.col("covered") >= MIN_DENSITY * stretch)).select("key", "label", "first", "last", "cover")


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text is empty: no words, no labels (empty strings), score 0.  Equal
    rows get equal results.  score: the largest share of a template that a
    verified span covers; a phrase alone counts 0.5.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select(F.struct(F.xxhash64("doc_id", "text").alias("a"), F.hash("text", "doc_id").alias("b")).alias("key"), "doc_id", "text")
    found = spans(rows).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    out = _base(rows).join(found, "key", "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.least(score, F.lit(1.0)).alias("score"))
