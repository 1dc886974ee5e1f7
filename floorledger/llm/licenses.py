"""License notices by an exact set-similarity join of text blocks with notice templates.

A block meets a template when it holds at least a threshold's share of the template's distinct words.  Words are ranked
by how often they occur in the whole corpus, rarest first.  A template of n words that must share r with a block then
has one of its first n - r + 1 words in it (prefix filter); the block must hold at least r template words (length
filter); and from a shared word on, neither side may have too few words left (positional filter).  What passes is
counted in full.

Words alone do not make a notice: a block that meets a template must also hold a share of its runs of three words.  Where
templates have most of their runs in common (versions of one license), the one that is held best counts.  Phrases are
templates that must be held whole; their words' order is checked afterwards.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorledger.llm.words import words

# Shares of a template's distinct words and of its distinct runs that a block must hold.
THRESHOLD, RUN_THRESHOLD = 0.8, 0.7
RUN_WORDS = 3
# Two templates are rivals when they share at least this part of the runs of the one that has fewer.
RIVAL_SHARE = 0.5

# Phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Public license notices as they stand at the head of files, and short forms of them, by label.
NOTICES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. Neither the name of the copyright holder nor the names of "
        "its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission.",
    ),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License",),
    "cc-by-nc-4.0": (
        "licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "cc-by-sa-4.0": (
        "licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    ),
    "gpl-3.0": (
        "this work is licensed under the GNU General Public License version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "mit": (
        "released under the MIT license",
        "licensed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}


def runs_of(own: tuple[str, ...], width: int) -> set[str]:
    """Runs of so many words, as a text each."""
    return {" ".join(own[at : at + width]) for at in range(len(own) - width + 1)}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    base: bool
    threshold: float

    @cached_property
    def tokens(self) -> set[str]:
        return set(self.words)

    @property
    def needed(self) -> int:
        return max(1, math.ceil(self.threshold * len(self.tokens) - 1e-9))

    @property
    def run_words(self) -> int:
        return min(RUN_WORDS, len(self.words))

    @cached_property
    def runs(self) -> set[str]:
        return runs_of(self.words, self.run_words)

    @property
    def needed_runs(self) -> int:
        return max(1, math.ceil((1.0 if self.base else RUN_THRESHOLD) * len(self.runs) - 1e-9))


def templates(phrases: dict[str, str], notices: dict[str, tuple[str, ...]], threshold: float) -> list[Template]:
    base = [Template(label, tuple(phrase.split()), True, 1.0) for phrase, label in phrases.items()]
    lowered = lambda text: tuple(re.findall("[a-z0-9]+", text.lower()))
    return base + [Template(label, lowered(text), False, threshold) for label, texts in notices.items() for text in texts]


TEMPLATES = tuple(templates(PHRASES, NOTICES, THRESHOLD))


def rivals(chosen: tuple[Template, ...]) -> list[list[int]]:
    """For each template the numbers of those of another label that have most runs in common with it."""

    def alike(one: Template, other: Template) -> bool:
        shared = len(one.runs & other.runs)
        return shared >= RIVAL_SHARE * min(len(one.runs), len(other.runs))

    return [
        [n for n, other in enumerate(chosen) if not (one.base or other.base or one.label == other.label) and alike(one, other)]
        for one in chosen
    ]


def wider(chosen: tuple[Template, ...]) -> list[list[int]]:
    """For each template the rivals that have all of its runs and more."""
    return [[n for n in near if chosen[at].runs < chosen[n].runs] for at, near in enumerate(rivals(chosen))]


def rarest_first(documents: DataFrame, chosen: tuple[Template, ...]) -> list[str]:
    """All template words, by their number of occurrences in the corpus; one row per template word comes back."""
    known = sorted(set().union(*(template.tokens for template in chosen)))
    vocabulary = documents.sparkSession.createDataFrame([(word,) for word in known], "word string")
    occurring = documents.select(F.explode(words(F.col("text"))).alias("word"))
    # Broadcast: the vocabulary is that of the templates, whatever the corpus.
    found = occurring.join(F.broadcast(vocabulary), "word").groupBy("word").count()
    counts = {row["word"]: row["count"] for row in found.collect()}
    return sorted(known, key=lambda word: (counts.get(word, 0), word))


def prefix_index(spark: SparkSession, chosen: tuple[Template, ...], order: list[str]) -> DataFrame:
    """A row per template and word of its prefix: ``rank, place, template, size, needed, ranks, words, base, label, runs,
    run_words, needed_runs, rivals, wider``."""
    rank = {word: at for at, word in enumerate(order, 1)}
    near, beyond, rows = rivals(chosen), wider(chosen), []
    for number, template in enumerate(chosen):
        ranks = sorted(rank[word] for word in template.tokens)
        for place in range(len(ranks) - template.needed + 1):
            fixed = (number, len(ranks), template.needed, ranks, list(template.words), template.base, template.label)
            order_ = (sorted(template.runs), template.run_words, template.needed_runs, near[number], beyond[number])
            rows.append((ranks[place], place, *fixed, *order_))
    return spark.createDataFrame(
        rows,
        "rank int, place int, template int, size int, needed int, ranks array<int>, words array<string>, "
        "base boolean, label string, runs array<string>, run_words int, needed_runs int, rivals array<int>, wider array<int>",
    )


def _literal(values: list[str]) -> Column:
    return F.array(*[F.lit(value) for value in values])


def license_blocks(documents: DataFrame, chosen: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id, key, n_words, block, template, label, base, containment, run_share, rivals, wider, places``: every block
    that meets a template, and one row with block -1 per text.

    Blocks overlap by half and are twice as long as the longest template, so a notice lies in one whatever its place.
    ``places`` are the word numbers where a phrase starts, each reported by one block only.
    """
    spark = documents.sparkSession
    order = rarest_first(documents, chosen)
    index = prefix_index(spark, chosen, order)
    first = [sorted(template.tokens, key=order.index)[: len(template.tokens) - template.needed + 1] for template in chosen]
    prefixes = sorted(set().union(*first))
    stride = max(len(template.words) for template in chosen)

    text = F.col("text").cast("string")
    key = F.xxhash64(F.coalesce(text, F.lit(""))).alias("key")
    texts = documents.select(F.col("doc_id").cast("long"), key, words(text).alias("words"))
    starts = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / stride).cast("int"))
    blocks = F.transform(
        starts, lambda at: F.struct(at.alias("block"), F.slice("words", at * stride + 1, 2 * stride).alias("words"))
    )
    likely = F.filter(blocks, lambda block: F.arrays_overlap(block["words"], _literal(prefixes)))
    mark = F.array(F.struct(F.lit(-1).alias("block"), F.slice("words", 1, 0).alias("words")))
    held = F.when(F.arrays_overlap("words", _literal(prefixes)), F.concat(mark, likely)).otherwise(mark)
    cut = texts.select("doc_id", "key", F.size("words").alias("n_words"), F.explode(held).alias("held"))

    common = F.array_intersect("held.words", _literal(order))
    shared = F.array_sort(F.transform(common, lambda word: F.array_position(_literal(order), word).cast("int")))
    probing = cut.select(
        "doc_id", "key", "n_words",
        F.col("held.block").alias("block"), F.col("held.words").alias("block_words"), shared.alias("shared"),
    ).select("*", F.posexplode_outer("shared").alias("at", "rank"))
    left = F.least(F.col("size") - F.col("place"), F.size("shared") - F.col("at"))
    overlap = F.size(F.array_intersect("shared", "ranks"))
    enough = F.least(F.size("shared"), left, overlap) >= F.col("needed")
    likely = probing.join(F.broadcast(index), "rank", "left").where(F.coalesce(enough, F.lit(False)) | (F.col("block") == -1))
    # Few blocks come this far; their runs are counted against the template's.
    at_each = F.sequence(F.lit(0), F.greatest(F.size("block_words") - F.col("run_words"), F.lit(0)))
    own_runs = F.transform(at_each, lambda at: F.array_join(F.slice("block_words", at + 1, F.col("run_words")), " "))
    held_runs = F.when(F.col("block") >= 0, F.size(F.array_intersect(own_runs, F.col("runs"))))
    met = likely.withColumn("held_runs", held_runs)
    met = met.withColumn("met", F.coalesce(F.col("held_runs") >= F.col("needed_runs"), F.lit(False)))
    length = F.size("words")
    offsets = F.filter(
        F.sequence(F.lit(0), F.least(F.lit(stride), F.size("block_words")) - 1),
        lambda at: F.slice("block_words", at + 1, length) == F.col("words"),
    )
    starts = F.transform(offsets, lambda at: (F.col("block") * stride + at).cast("long"))
    return met.where(F.col("met") | (F.col("block") == -1)).select(
        "doc_id", "key", "n_words", "block", "template", "label", "base",
        (overlap / F.col("size")).alias("containment"),
        (F.col("held_runs") / F.size("runs")).alias("run_share"),
        "rivals", "wider",
        F.when(F.col("met") & F.col("base"), starts).alias("places"),
    )


def licenses(documents: DataFrame, chosen: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.

    Null text has no words; without a notice labels are empty and the score is 0.  The score is the largest share of a
    template's words that one block holds, 1 for a phrase.  A template does not count where a rival is met in the same
    block or one beside it that is held better, or holds all of its runs and more.  Repeated rows each get the same result.
    """
    blocks = license_blocks(documents, chosen)
    counts = (F.col("block") >= 0) & (~F.col("base") | (F.size("places") > 0))
    hit = F.struct(
        "block", "template", "label", "base", "containment", "run_share", "rivals", "wider", "places"
    )

    def beats(other: Column, one: Column) -> Column:
        near = F.array_contains(one["rivals"], other["template"]) & (F.abs(other["block"] - one["block"]) <= 1)
        better = (other["run_share"] > one["run_share"]) & ~F.array_contains(other["wider"], one["template"])
        return near & (better | F.array_contains(one["wider"], other["template"]))

    hit = F.when(counts, hit)
    rows = blocks.groupBy("doc_id", "key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(hit).alias("hits"),
        F.count(F.when(F.col("block") == -1, 1)).alias("copies"),
    )
    best = F.filter("hits", lambda one: ~F.exists("hits", lambda other: beats(other, one)))
    rows = rows.withColumn("hits", best)
    phrases = F.filter("hits", lambda hit: hit["base"])
    places = F.flatten(F.transform(phrases, lambda hit: hit["places"]))
    rows = rows.select(
        "doc_id", "n_words", "copies",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(phrases, lambda hit: hit["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.col("hits.label"))), ",").alias("labels"),
        F.coalesce(F.array_max(F.col("hits.containment")), F.lit(0.0)).alias("score"),
    )
    repeated = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return rows.withColumn("copy", repeated).drop("copies", "copy")
