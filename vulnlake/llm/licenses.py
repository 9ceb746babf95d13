"""Licence scan of paragraphs: an n-gram classifier, a calibrated unknown class, templates.

A paragraph is a line of a text. Its features are the words and word pairs that the
templates use and ordinary text rarely does. A multinomial logistic regression over these
sparse features tells licence families from unknown text; it is trained on notices made
from the templates and on a bounded sample of the corpus. A second regression on notices
kept out of the first turns the odds against the unknown class into a calibrated chance:
below one half the family is `unknown`. A family is confirmed if the paragraph contains
most of the word pairs of one of its templates.

Only DataFrame operations and Spark's own estimators are used. Paragraphs without a
feature are all alike to the model, and unknown, so they are dropped in the scan itself;
the rest is written once, with its features, and scored from there.

Defined cases: null and empty texts have no paragraphs; case, punctuation and accents do
not count; repeated rows give repeated results; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import table
from vulnlake.session import write_out

UNKNOWN = "unknown"
#: Paragraphs of the corpus in the training set, and the share of them that may hold a feature.
NEGATIVES, COMMON = 5000, 0.002
CHANCE, SIMILAR = 0.5, 0.6
#: Short notices by family, in the words in which they are commonly given.
TEMPLATES = {
    "MIT": ["released under the MIT License", "SPDX-License-Identifier: MIT", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "Apache-2.0": ["licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "you may not use this file except in compliance with the Apache License"],
    "GPL-3.0": ["licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0"],
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0"],
    "BSD": ["released under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "redistribution and use in source and binary forms, with or without modification, are permitted"],
    "MPL-2.0": ["subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["released under the ISC License", "SPDX-License-Identifier: ISC"],
    "CC-BY-4.0": ["licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["released under CC0 1.0 Universal", "dedicated to the public domain under the Creative Commons Zero waiver"],
    "proprietary": ["all rights reserved", "no part of this work may be reproduced without written permission of the owner"],
}
OPENINGS = ("", "This work is", "This project is", "The code in this file is", "Unless noted otherwise, the software is", "Copyright 2020 the authors;", "The text is")
ENDINGS = ("", "see the LICENSE file for details", "all contributions are welcome", "with all files of this repository")
#: Sentences that use words of licences without being one.
OTHERS = (
    "the driver had to renew the licence of the car",
    "version 2.0 was released in the spring",
    "the public was general in its praise",
    "a license plate was found under the bridge",
    "the free software course starts at nine",
    "rights and duties of the citizens",
    "a copy of the file is on the desk",
    "the foundation was published as a book",
    "creative people share what is common to all",
    "mit freundlichen worten und der bitte um eine antwort",
)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def grams(tokens: Column) -> Column:
    """Words and pairs of neighbouring words."""
    pairs = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tokens, F.filter(pairs, lambda p: p.isNotNull()))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, paragraph number, text) of every line that is not empty."""
    lines = F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("paragraph", "text")
    return docs.select(F.col(id_col).alias("id"), lines).where(F.trim("text") != "")


def notices(spark: SparkSession) -> DataFrame:
    """Training notices (family, text, fold): every template with openings and endings."""
    rows = [
        (family, f"{opening} {template} {ending}", k % 4)
        for family, templates in TEMPLATES.items()
        for template in templates
        for k, (opening, ending) in enumerate((o, e) for o in OPENINGS for e in ENDINGS)
    ]
    rows += [(UNKNOWN, text, k % 4) for k, text in enumerate(OTHERS)]
    return spark.createDataFrame(rows, "family string, text string, fold int")


def training(spark: SparkSession, lines: DataFrame, negatives: int) -> DataFrame:
    """Notices and at most `negatives` corpus paragraphs that do not speak of licences."""
    plain = lines.where(~F.lower("text").rlike("licen|copyright|rights reserved|spdx|public domain"))
    order = F.xxhash64("id", "paragraph")
    chosen = plain.orderBy(order, "id", "paragraph").limit(negatives)
    sample = chosen.select(F.lit(UNKNOWN).alias("family"), "text", F.pmod(order, F.lit(4)).cast("int").alias("fold"))
    rows = notices(spark).unionByName(sample).withColumn("grams", F.array_distinct(grams(words(F.col("text")))))
    return write_out(rows.select("family", "fold", "grams"), "notices")


def vocabulary(rows: DataFrame, common: float) -> list[str]:
    """Grams of the notices that few of the unknown paragraphs hold.

    Their number is bounded by the templates.
    """
    n = max(rows.where(F.col("family") == UNKNOWN).count(), 1)
    is_unknown = (F.col("family") == UNKNOWN).cast("long")
    counts = rows.select(is_unknown.alias("u"), F.explode("grams").alias("gram")).groupBy("gram")
    counts = counts.agg(F.sum("u").alias("u"), F.sum(1 - F.col("u")).alias("known"))
    kept = counts.where((F.col("known") > 0) & (F.col("u") <= common * n))
    return sorted(r["gram"] for r in kept.select("gram").collect())


class LicenseModel:
    """The vocabulary, the classifier over it and the calibration of its odds."""

    def __init__(self, rows: DataFrame, common: float = COMMON):
        self.families = [UNKNOWN, *TEMPLATES]
        self.vocabulary = vocabulary(rows, common)
        self.counter = CountVectorizerModel.from_vocabulary(self.vocabulary, "grams", "features")
        self.counter.setBinary(True)
        label = F.array_position(F.array(*map(F.lit, self.families)), F.col("family")) - 1
        rows = self.counter.transform(rows.withColumn("label", label.cast("double"))).cache()
        learner = LogisticRegression(family="multinomial", regParam=2e-3, maxIter=60)
        self.classifier: LogisticRegressionModel = learner.fit(rows.where("fold <> 3"))
        held = self._odds(self.classifier.transform(rows.where("fold = 3")))
        held = held.withColumn("label", (F.col("label") > 0).cast("double"))
        self.assembler = VectorAssembler(inputCols=["odds"], outputCol="margin")
        platt = LogisticRegression(featuresCol="margin", regParam=1e-2, probabilityCol="calibrated", rawPredictionCol="calibrated_raw", predictionCol="licensed")
        self.calibration = platt.fit(self.assembler.transform(held).select("margin", "label"))
        rows.unpersist()

    def _odds(self, scored: DataFrame) -> DataFrame:
        p = vector_to_array("probability")
        odds = F.log(F.greatest(1 - p[0], F.lit(1e-12))) - F.log(F.greatest(p[0], F.lit(1e-12)))
        known = F.slice(p, 2, len(self.families) - 1)
        best = F.array_position(known, F.array_max(known)).cast("int")
        likeliest = F.element_at(F.array(*map(F.lit, self.families[1:])), best)
        return scored.withColumn("odds", odds).withColumn("likeliest", likeliest)

    def features(self, tokens: Column) -> Column:
        """The vocabulary's grams in a paragraph."""
        return F.filter(grams(tokens), lambda g: g.isin(self.vocabulary))

    def score(self, rows: DataFrame) -> DataFrame:
        """The rows (with `grams`) with `family` and `probability`."""
        scored = self._odds(self.classifier.transform(self.counter.transform(rows)))
        scored = self.calibration.transform(self.assembler.transform(scored.drop("features", "rawPrediction", "probability", "prediction")))
        probability = vector_to_array("calibrated")[1]
        family = F.when(probability >= CHANCE, F.col("likeliest")).otherwise(UNKNOWN)
        return scored.withColumn("probability", probability).withColumn("family", family)


def similarity(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows with the share of a template's grams that they hold, at most over the family."""
    notes = [(f, t) for f, templates in TEMPLATES.items() for t in templates]
    templates = spark.createDataFrame(notes, "family string, template string")
    listed = templates.select("family", F.array_distinct(grams(words(F.col("template")))).alias("own"))
    listed = listed.groupBy("family").agg(F.collect_list("own").alias("templates"))
    # One row per family, a constant number.
    joined = rows.join(F.broadcast(listed), "family", "left")
    share = F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("all_grams"))) / F.size(t))
    return joined.withColumn("similarity", F.coalesce(F.array_max(share), F.lit(0.0)))


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", negatives: int = NEGATIVES, common: float = COMMON
) -> DataFrame:
    """Every paragraph with a licence feature.

    Columns id, paragraph (number of the line), text, family, probability, similarity and
    confirmed.
    """
    spark = docs.sparkSession
    lines = paragraphs(docs, id_col, text_col)
    model = LicenseModel(training(spark, lines, negatives), common)
    marked = lines.withColumn("grams", model.features(words(F.col("text")))).where(F.size("grams") > 0)
    marked = write_out(marked, "paragraphs")
    scored = model.score(marked).withColumn("all_grams", grams(words(F.col("text"))))
    scored = similarity(spark, scored)
    confirmed = (F.col("family") != UNKNOWN) & (F.col("similarity") >= SIMILAR)
    return scored.select("id", "paragraph", "text", "family", "probability", "similarity", confirmed.alias("confirmed"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
