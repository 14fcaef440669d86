"""Licence scan: a trained paragraph classifier, confirmed by templates (DataFrame functions and pyspark.ml only).

Lines that hold a word of the templates other than the commonest are classified
by multinomial logistic regression over hashed word unigrams and bigrams: each
as it is (a long one in overlapping windows of ``WINDOW`` words) and together
with the lines after it, up to a blank line and ``WINDOW`` words, so that a
notice wrapped over several lines is seen whole.  Training rows are crops of the licence templates below
and, for the class unknown, phrases that only talk of licences plus at most
``NEGATIVES`` paragraphs of the scanned texts without a licence word (of each hash
class the one with the smallest hash).  The probabilities are calibrated by a temperature, and a
paragraph below the confidence that keeps every held-out unknown out is unknown.
A predicted family counts only when the paragraph holds enough of the word
trigrams of one of its templates.

Defined cases: columns other than the two named ones are not read; a null, empty or blank text has no paragraphs and no licence;
repeated rows are scanned one by one; a paragraph with several families reports
the one that is likeliest, a document the set of its paragraphs' families; an
empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import written

FEATURES = 1 << 14
WINDOW, STRIDE = 64, 48
#: Bound of the sample of paragraphs that train the unknown class.
NEGATIVES = 3000
#: Share of a template's trigrams that confirms a prediction.
CONFIRM = 0.6
TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0)
#: Words that keep a paragraph out of the unknown sample.
CUES = "licen[sc]|copyright|warrant|copyleft|public domain|all rights|spdx|creative commons|redistribut|permission|gnu|apache|mozilla"

#: Well-known wordings of licence notices, by family.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
            "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
            "to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Released under the Apache 2.0 license.",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later",
                "Licensed under the GNU General Public License version 3.", "Released under the GPL v3 license.",
                "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
                "Foundation, either version 3 of the License, or any later version"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only",
                "Released under the GPL v2 license.",
                "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later",
             "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
                 "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": ["Released under the BSD License.", "Licensed under the 3-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
            "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
                "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
             "SPDX-License-Identifier: Zlib"],
    "CC0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or "
            "neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
}
UNKNOWN = "unknown"
#: Phrases of the unknown class that use the same words.
TALK = ["You need a valid driving license to rent a car.", "The license plate of the car was missing.", "The permission of the owner is required.",
        "The general public was invited.", "The terms of the contract are listed below.", "A copy of this letter was sent to the person.",
        "The apache helicopter took off.", "He released a new version of the song.", "The foundation published its report, version 2.",
        "All visitors are free of charge to obtain a copy.", "The source and binary files are large.", "Creative work in common rooms.",
        "The software was distributed to the schools.", "Ask which license applies before you use the material.", "MIT is a university.",
        "Copyright law is complicated.", "The warranty covers two years."]
FAMILIES = sorted(TEMPLATES)
CLASSES = [*FAMILIES, UNKNOWN]


#: Template words too common in any text to call for a closer look.
COMMON = frozenset("a all and any are as at be by do either for free from have i in including is it its later may not of on or other s shall so "
                   "subject that the these this those to under use v was which with without work you your charge person deal".split())


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def cue_words() -> list[str]:
    """The words of the templates but for the common ones.

    They touch more than 1 - ``CONFIRM`` of every template's trigrams (a test
    holds them to that), so a paragraph without any of them cannot be
    confirmed and need not be classified.
    """
    every = {w for f in FAMILIES for t in TEMPLATES[f] for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w}
    return sorted(every - COMMON)


def _grams(col: str) -> Column:
    """Word unigrams and bigrams."""
    return F.expr(f"concat({col}, if(size({col}) > 1, transform(sequence(1, size({col}) - 1), i -> concat(element_at({col}, i), ' ', "
                  f"element_at({col}, i + 1))), cast(array() as array<string>)))")


def _trigrams(col: str) -> str:
    return (f"if(size({col}) >= 3, transform(sequence(1, size({col}) - 2), i -> array_join(slice({col}, i, 3), ' ')), array(array_join({col}, ' ')))")


#: Lines that a notice is looked for in from its first one on.
LINES = 12


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mark, place, w): word arrays of the lines of every text that hold a cue word, and of these with the lines after them.

    Words are split and looked through inside the row, so the bulk of the
    lines never becomes rows.  Lines that no cue word follows within the window
    stay as they are.
    """
    cues = F.array(*[F.lit(c) for c in cue_words()])
    base = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"))
    rows = F.transform("lines", lambda line, i: F.struct(i.alias("place"), words(line).alias("w")))
    rows = F.filter(rows, lambda r: F.arrays_overlap(r["w"], cues))
    found = base.select("key", "mark", "lines", F.explode(rows).alias("r")).where("r is not null")
    # the lines from here to the next blank one
    block = F.slice("lines", F.col("r.place") + 1, F.lit(LINES))
    end = F.array_position(F.transform(block, lambda x: x.rlike(r"^\s*$")), True).cast("int")
    block = F.when(end > 0, F.slice(block, F.lit(1), end - 1)).otherwise(block)
    found = found.select("key", "mark", "r.place", "r.w", F.when(F.size("r.w") < WINDOW, F.array_join(block, " ")).alias("more")) \
                 .withColumn("joined", F.slice(words(F.col("more")), 1, WINDOW))
    cut = F.expr(f"if(size(w) <= {WINDOW}, array(w), transform(sequence(1, size(w) - {WINDOW - STRIDE}, {STRIDE}), i -> slice(w, i, {WINDOW})))")
    whole = F.when((F.size("joined") > F.size("w")) & F.arrays_overlap(F.slice("joined", F.size("w") + 1, F.lit(WINDOW)), cues), F.array("joined")) \
             .otherwise(F.array().cast("array<array<string>>"))
    return found.select("key", "mark", "place", F.explode(F.concat(cut, whole)).alias("w"))


def template_rows(spark: SparkSession) -> DataFrame:
    """(family, template, w) of the fixed templates."""
    rows = [(f, t) for f in FAMILIES for t in TEMPLATES[f]]
    values = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("template")) for f, t in rows])
    return spark.range(1).select(F.explode(values).alias("x")).select("x.family", "x.template", words(F.col("x.template")).alias("w"))


def training_rows(spark: SparkSession, sample: DataFrame) -> DataFrame:
    """(w, label, held): crops of the templates, phrases of the unknown class and sampled paragraphs."""
    crops = template_rows(spark).selectExpr("family", "w", "explode(array(4, 6, 9, 14, 22, 1000)) as n") \
        .selectExpr("family", "explode(transform(sequence(1, greatest(size(w) - n + 1, 1)), i -> slice(w, i, n))) as w").distinct()
    # a crop that several families share tells nothing about the family
    own = crops.groupBy("w").agg(F.count("*").alias("n"), F.first("family").alias("family"))
    own = own.select("w", F.when(F.col("n") == 1, F.col("family")).otherwise(UNKNOWN).alias("family"))
    talk = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in TALK])).alias("t")).select(words(F.col("t")).alias("w"), F.lit(UNKNOWN).alias("family"))
    rows = own.union(talk).union(sample.select("w", F.lit(UNKNOWN).alias("family")))
    index = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("family")) - 1
    return rows.select("w", index.cast("double").alias("label"), (F.pmod(F.xxhash64("w"), F.lit(5)) == 0).alias("held"))


def _features(rows: DataFrame) -> DataFrame:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(rows.withColumn("grams", _grams("w"))).drop("grams")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[LogisticRegressionModel, float, float]:
    """(model, temperature, least confidence of a family)."""
    spark = docs.sparkSession
    lines = docs.select(F.explode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line"))
    plain = lines.where(~F.col("line").rlike(f"(?i){CUES}") & F.col("line").rlike(r"[\p{L}\p{N}]"))
    sample = plain.groupBy(F.pmod(F.xxhash64("line"), F.lit(NEGATIVES)).alias("b")).agg(F.expr("min_by(line, struct(xxhash64(line), line))").alias("line")) \
                  .select(words(F.col("line")).alias("w"))
    sample = written(sample, "licence-sample")          # else the one task of the training rows would gather every partial
    rows = written(_features(training_rows(spark, sample)).coalesce(1), "licence-training")
    train = rows.where("not held")
    model = LogisticRegression(maxIter=40, regParam=2e-4, family="multinomial").fit(train.select("label", "features"))
    z = _margins(model.transform(rows.where("held"))).withColumn("own", F.expr("element_at(z, cast(label as int) + 1)"))
    sums = z.agg(*[F.sum(F.expr(f"ln(aggregate(z, 0D, (a, x) -> a + exp((x - own) / {t}D)))")).alias(f"t{k}")
                   for k, t in enumerate(TEMPERATURES)]).first()
    best = min(range(len(TEMPERATURES)), key=lambda k: sums[k] if sums[k] is not None else 0.0)
    heat = TEMPERATURES[best]
    unknown = len(FAMILIES)
    worst = _probabilities(z, heat).where(F.col("label") == unknown).agg(F.max(F.expr(f"array_max(slice(p, 1, {unknown}))"))).first()[0]
    return model, heat, min(max(worst or 0.0, 0.5), 0.9)


def _margins(rows: DataFrame) -> DataFrame:
    """Class margins; classes the model was not shown count as impossible."""
    return rows.withColumn("z", vector_to_array("rawPrediction")) \
               .withColumn("z", F.expr(f"transform(sequence(1, {len(CLASSES)}), i -> coalesce(try_element_at(z, i), -1e9D))"))


def _probabilities(rows: DataFrame, heat: float) -> DataFrame:
    top = rows.withColumn("m", F.array_max("z")).withColumn("e", F.expr(f"transform(z, x -> exp((x - m) / {heat}D))"))
    top = top.withColumn("s", F.expr("aggregate(e, 0D, (a, y) -> a + y)"))
    return top.withColumn("p", F.expr("transform(e, x -> x / s)")).drop("m", "e", "s")


def scan_paragraphs(docs: DataFrame, model, heat: float, least: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mark, place, family, probability, confirmed) of the paragraphs that a family is predicted for."""
    unknown = len(FAMILIES)
    # written first: the model's steps would else be repeated for the filter on the prediction
    found = written(paragraphs(docs, key, text), "licence-candidates")
    scored = model.transform(_features(found))
    scored = scored.where(F.col("prediction") != unknown).select("key", "mark", "place", "w", "rawPrediction")
    # cut here too: the expressions below name their inputs many times
    scored = written(_margins(scored).select("key", "mark", "place", "w", "z"), "licence-margins")
    scored = _probabilities(scored, heat).withColumn("probability", F.expr(f"array_max(slice(p, 1, {unknown}))"))
    names = F.array(*[F.lit(c) for c in FAMILIES])
    scored = scored.where(F.col("probability") >= least) \
        .withColumn("family", F.element_at(names, F.expr(f"cast(array_position(slice(p, 1, {unknown}), probability) as int)")))
    # the templates are a fixed list of a few dozen rows
    shapes = template_rows(docs.sparkSession).selectExpr("family", f"array_distinct({_trigrams('w')}) as shape") \
        .groupBy("family").agg(F.collect_list("shape").alias("shapes"))
    both = scored.join(F.broadcast(shapes), "family").withColumn("own", F.expr(f"array_distinct({_trigrams('w')})"))
    share = F.expr("array_max(transform(shapes, s -> size(array_intersect(s, own)) / size(s)))")
    return both.select("key", "mark", "place", "family", "probability", (share >= CONFIRM).alias("confirmed"))


def licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_paragraphs, n_predicted, n_confirmed, families, probability) of every document.

    ``families`` lists the confirmed families in order, joined by commas, empty
    without one; ``probability`` is the highest of a confirmed paragraph, 0 without one.
    """
    model, heat, least = fit(docs, key, text)
    found = written(scan_paragraphs(docs, model, heat, least, key, text).distinct(), "licence-paragraphs")
    per = found.groupBy("key", "mark").agg(
        F.countDistinct("place").alias("n_predicted"), F.countDistinct(F.when(F.col("confirmed"), F.col("place"))).alias("n_confirmed"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.max(F.when(F.col("confirmed"), F.col("probability"))).alias("probability"))
    n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))).cast("long")
    each = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), n.alias("n_paragraphs")).alias("d")
    return each.join(per.alias("f"), F.expr("d.key <=> f.key and d.mark = f.mark"), "left").select(
        F.col("d.key").alias(key), "n_paragraphs", F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"),
        F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"))
