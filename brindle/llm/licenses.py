"""Licence scans by diagonal voting, with DataFrame functions only.

The hashes of all rolling three-word sequences of the texts are joined to the
positions of the same sequences in licence templates (a fixed list, so it is
broadcast). Matches vote for a diagonal: text position less template position.
Neighbouring diagonals, as inserted or missing words make them, are merged: each
diagonal with those up to ``gap`` words after it, so a span is at most that much
longer than the template. A span is verified by walking through the template: only
positions that stand further on in the text than all before them count, and these
must cover enough of the template. Of overlapping spans the best one stays.

Exact phrases are templates that must be covered whole on one diagonal; a place
is such a diagonal. Word equality is tested beside the hash.

Defined cases: a null or empty text has no words, no places, empty labels and
score 0; a null id stays null; repeated rows are scanned each; an empty table
gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import WORD_PATTERN
from brindle.llm.words import word_rows


class Template(NamedTuple):
    label: str
    text: str
    exact: bool


#: Phrases that name a licence, and the wording of well-known public licence notices.
TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", False),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", False),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", False),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", False),
    Template("gpl-3", "licensed under the GNU General Public License, version 3", False),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", False),
    Template("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", False),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", False),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License", False),
    Template("unlicense", "This is free and unencumbered software released into the public domain", False),
    Template("mit", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", False),
    Template("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License", False),
    Template("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", False),
    Template("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details", False),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", False),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", False),
    Template("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", False),
    Template("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", False),
)

GRAM = 3
_SENTINEL_KEY = 0


def template_words(text: str) -> list[str]:
    return re.findall(WORD_PATTERN, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def template_grams(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """Rows (tid, label, exact, n_grams, tpos, ta, tb, tc), and one row with tid -1 that the sentinel meets."""
    rows: list[tuple] = [(-1, None, None, None, None, None, None, None)]
    for tid, t in enumerate(templates):
        w = template_words(t.text)
        if len(w) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {t.text!r}")
        rows += [(tid, t.label, t.exact, len(w) - GRAM + 1, k, *w[k : k + GRAM]) for k in range(len(w) - GRAM + 1)]
    return spark.createDataFrame(
        rows, "tid int, label string, exact boolean, n_grams int, tpos int, ta string, tb string, tc string"
    ).withColumn("h", F.when(F.col("tid") < 0, F.lit(_SENTINEL_KEY)).otherwise(F.xxhash64("ta", "tb", "tc")))


def matches(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row per document (tid -1) and per sequence of three words that a template has too."""
    grams = word_rows(docs, "text", "doc_id").withColumn(
        "h", F.when(F.col("pos") == 0, F.lit(_SENTINEL_KEY)).otherwise(F.xxhash64("a", "b", "c"))
    )
    table = F.broadcast(template_grams(docs.sparkSession, templates))
    same = (F.col("pos") == 0) & (F.col("tid") < 0) | (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")) & (F.col("c") == F.col("tc"))
    return grams.join(table, "h").where(same).select(
        "row", "doc_id", "n_words", "tid", "label", "exact", "n_grams", "tpos", (F.col("pos") - 1 - F.col("tpos")).alias("diagonal")
    )


def find_spans(matched: DataFrame, gap: int = 3, coverage: float = 0.75) -> DataFrame:
    """Verified spans of templates, and the row of each document itself (tid -1).

    (row, doc_id, n_words, tid, label, exact, start, covered): ``covered`` is the share of the template's positions
    that occur in the span in rising order.
    """
    by_row = matched.repartition("row")  # one exchange serves all steps below
    kind = ["row", "doc_id", "n_words", "tid", "label", "exact", "n_grams"]
    diagonals = by_row.groupBy(*kind, "diagonal").agg(F.collect_set("tpos").alias("held"))
    order = Window.partitionBy("row", "tid").orderBy("diagonal")
    near = F.collect_list(F.struct("diagonal", "held")).over(order.rangeBetween(0, gap))
    places = F.flatten(F.transform("near", lambda x: F.transform(x["held"], lambda t: F.struct(t.cast("long").alias("tpos"), (t + x["diagonal"]).alias("pos")))))
    nothing = F.struct(F.lit(-1).cast("long").alias("tpos"), F.lit(-1).cast("long").alias("top"), F.lit(0).cast("long").alias("n"))

    def walk(a: Column, x: Column) -> Column:
        """Of a template position's places the first counts, if it is beyond all before."""
        on = F.struct(x["tpos"].alias("tpos"), F.greatest(a["top"], x["pos"]).alias("top"), (a["n"] + (x["pos"] > a["top"]).cast("long")).alias("n"))
        return F.when(x["tpos"] == a["tpos"], a).otherwise(on)

    rising = F.aggregate(F.array_sort(places), nothing, walk)["n"]
    counted = diagonals.withColumn("near", F.when(~F.col("exact"), near)).withColumn("n", F.when(F.col("exact"), F.size("held")).otherwise(rising))
    counted = counted.withColumn("covered", F.col("n") / F.col("n_grams"))
    enough = F.when(F.col("exact"), F.col("n") == F.col("n_grams")).otherwise(F.col("covered") >= coverage)
    spans = counted.where((F.col("tid") < 0) | enough).select(*kind, "diagonal", "covered")
    apart = F.coalesce(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(order) > gap), F.lit(True))
    numbered = spans.withColumn("new", apart.cast("int")).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.min_by("diagonal", F.struct(-F.col("covered"), "diagonal"))
    return numbered.groupBy(*kind, "span").agg(best.alias("start"), F.max("covered").alias("covered")).select(*kind[:-1], "start", "covered")


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each document."""
    spans = find_spans(matches(docs, templates))
    found, base = F.col("tid") >= 0, F.col("exact") & (F.col("tid") >= 0)
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return (
        spans.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            names(base).alias("base_labels"),
            names(found).alias("labels"),
            F.coalesce(F.max(F.when(found, F.col("covered"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
