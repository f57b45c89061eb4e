"""Licence scan: a trained paragraph classifier with template confirmation.

A paragraph is a line with a word, or all lines of a block (lines between lines
without a letter or digit) joined, less those that are a notice by themselves,
so that wrapped and commented notices are found.  It is described by its word
n-grams (one to three words) that the licence templates know and that hold a
distinctive word, one that is rare among the ordinary lines of all documents.  A
sparse multinomial logistic regression over them tells the licence families and
``unknown`` apart; it is trained on the templates, cut and joined in several
ways, and on a bounded sample of the corpus' own lines.  A paragraph is only
believed above a probability that is calibrated on all ordinary lines kept out
of training; lines that pass the template comparison are not ordinary.  The
regression names the family of a believed paragraph.  It is confirmed when the
paragraph holds most 3-word windows and all marks (name and version) of a
template, and the best such template is one of that family; where the best one
is another family's, the paragraph is ``disputed`` and not confirmed.

DataFrame functions and Spark ML only.  A paragraph without a distinctive word
has no feature and so the model's answer for the empty vector, ``unknown``;
a look-up of the words' probes finds the others, so only they are taken apart.
Texts are read three times: for the notices, for the lines per template word,
and for the lines with a probe, which are written and scored once for both the
calibration and the scan.

Defined results: a null text has no paragraphs; rows that repeat a doc_id are
scanned one by one; extra columns are carried untouched by ``scan``; an empty
table gives an empty result (the model is then trained on templates alone).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

UNKNOWN = "unknown"
#: documents whose paragraphs describe ordinary text, about
SAMPLE_DOCS = 400
#: the draw of the sample is one of so many
DRAWS = 1 << 40
#: a distinctive word is in fewer than one of so many sample paragraphs
RARE = 50
#: share of kept-out ordinary paragraphs that may be believed
MAX_FALSE = 0.001
CONFIRM_PCT = 80
#: bins of the score histogram
BINS = 10000
#: fixed texts: the usual short notices of each licence family
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0"],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later "
        "version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or any later "
        "version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only"],
    "lgpl-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-2.1-only"],
    "lgpl-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or any "
        "later version.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only"],
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or any "
        "later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "SPDX-License-Identifier: AGPL-3.0-only"],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC"],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense"],
    "cc0-1.0": [
        "Licensed under CC0 1.0.",
        "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain "
        "Dedication.",
        "SPDX-License-Identifier: CC0-1.0"],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}
#: what tells a family from its kin, the name first; a template's own marks must
#: all be there
MARKS = {
    "apache-2.0": ["apache license version 2.0", "apache-2.0"],
    "mit": ["mit license", "hereby granted free of charge", "spdx-license-identifier mit"],
    "bsd": ["redistribution and use in source and binary forms", "bsd license", "bsd-3-clause"],
    "gpl-3.0": ["gnu general public license", "version 3", "gpl-3.0-or-later", "gpl-3.0-only"],
    "gpl-2.0": ["gnu general public license", "version 2", "gpl-2.0-or-later", "gpl-2.0-only"],
    "lgpl-2.1": ["gnu lesser general public license", "version 2.1", "lgpl-2.1-or-later", "lgpl-2.1-only"],
    "lgpl-3.0": ["gnu lesser general public license", "version 3", "lgpl-3.0-or-later", "lgpl-3.0-only"],
    "agpl-3.0": ["gnu affero general public license", "version 3", "agpl-3.0-or-later", "agpl-3.0-only"],
    "isc": ["hereby granted provided that", "isc license", "spdx-license-identifier isc"],
    "unlicense": ["unencumbered software", "spdx-license-identifier unlicense"],
    "cc0-1.0": ["cc0 1.0", "cc0-1.0"],
    "mpl-2.0": ["mozilla public license v 2.0", "mpl-2.0"],
    "cc-by": ["cc by 4.0", "commons attribution 4.0"],
    "cc-by-sa": ["cc by-sa 4.0", "commons attribution-sharealike 4.0"],
    "cc-by-nc": ["cc by-nc 4.0", "commons attribution-noncommercial 4.0"],
}
_SPLIT = r"[^a-z0-9.\-]+"
#: what is left of a piece between two splits without dots and hyphens around it
_WORD = r"[a-z0-9](?:[a-z0-9.\-]*[a-z0-9])?"
#: a line of which any word can be a template's
_SPOKEN = r"[\p{L}\p{N}]"


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(".-") for x in re.split(_SPLIT, text.lower())) if w]


def grams_of(words: list[str], sizes=(1, 2, 3)) -> list[str]:
    return [" ".join(words[i:i + n]) for n in sizes for i in range(len(words) - n + 1)]


def words(text: Column) -> Column:
    """As ``words_of``."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def grams(w: Column, n: int) -> Column:
    at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(w, i + 1, n), " "))


def paragraphs(docs: DataFrame) -> DataFrame:
    """One row per line that holds a letter or digit: ``paragraph`` beside the
    columns.  (The outer explode keeps the optimizer from splitting each text a
    second time, to look for empty arrays.)"""
    return (docs.withColumn("paragraph", F.explode_outer(F.split(F.coalesce("text", F.lit("")), "\n")))
            .where(F.col("paragraph").rlike(_SPOKEN)).drop("text"))


def blocks(docs: DataFrame) -> DataFrame:
    """One row per run of lines between lines without a letter or digit, such
    as bare comment signs: ``_lines`` beside the columns; the lines are those of
    ``paragraphs``."""
    parts = F.split(F.coalesce("text", F.lit("")), r"\n[^\p{L}\p{N}]*\n")
    lines = F.filter(F.split("_b", "\n"), lambda x: x.rlike(_SPOKEN))
    return (docs.withColumn("_b", F.explode_outer(parts)).drop("text")
            .withColumn("_lines", F.explode_outer(F.array(lines))).drop("_b").where(F.size("_lines") > 0))


def _templates() -> list[dict]:
    out = []
    for family, texts in TEMPLATES.items():
        for t in texts:
            w = words_of(t)
            flat = f" {' '.join(w)} "
            marks = [f" {m} " for m in MARKS[family] if f" {m} " in flat]
            out.append({"family": family, "windows": sorted(set(grams_of(w, (3,)) or [" ".join(w)])), "marks": marks})
    return out


def _anchors() -> list[str]:
    """A text that holds all marks of a template holds one of these runs of
    letters and digits."""
    return sorted({max(re.findall("[a-z0-9]+", t["marks"][0]), key=len) for t in _templates()})


def _has_anchor(text: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(text), "[^a-z0-9]+"), F.array(*map(F.lit, _anchors())))


def _matches(w: Column) -> Column:
    """Templates of which the words ``w`` hold the name (the first mark) and
    CONFIRM_PCT of the windows: share, family, and whether all marks are there.
    The windows are only compared where a name is met."""
    text = lambda t: F.array(*map(F.lit, t))
    known = F.array(*[F.struct(F.lit(t["family"]).alias("family"), F.lit(t["marks"][0]).alias("name"),
                               text(t["marks"]).alias("marks"), text(t["windows"]).alias("windows"))
                      for t in _templates()])
    share = lambda s, m: F.filter(F.transform(s["t"], lambda t: F.struct(
        (F.size(F.array_intersect(m, t["windows"])) * 100 / F.size(t["windows"])).alias("share"),
        t["family"].alias("family"), F.forall(t["marks"], lambda x: F.contains(s["s"], x)).alias("marked"))),
        lambda t: t["share"] >= CONFIRM_PCT)
    none = F.slice(share(F.struct(F.slice(known, 1, 1).alias("t"), F.lit("").alias("s")), text([""])), 1, 0)
    met = lambda s: _let(F.struct(s.alias("s"), F.filter(known, lambda t: F.contains(s, t["name"])).alias("t")),
                         lambda x: F.when(F.size(x["t"]) > 0, _let(F.concat(grams(w, 2), grams(w, 3)),
                                                                   lambda m: share(x, m))).otherwise(none))
    return _let(F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")), met)


def _notice(text: Column) -> Column:
    """Whether the text passes the comparison with any template."""
    return _let(text, lambda t: F.when(_has_anchor(t), _let(words(t), lambda w: F.size(_matches(w)) > 0))
                .otherwise(F.lit(False)))


def _rest(lines: Column, notice: Callable[[Column], Column]) -> Column:
    """The lines that aren't a ``notice`` by themselves."""
    return _let(lines, lambda a: F.when(_has_anchor(F.array_join(a, " ")), F.filter(a, lambda x: ~notice(x))).otherwise(a))


def _plain(lines: Column) -> Column:
    """The ordinary ones: neither a notice alone nor, all joined, one."""
    return _let(_rest(lines, _notice), lambda a: F.when(_notice(F.array_join(a, " ")), F.slice(a, 1, 0)).otherwise(a))


def ordinary(docs: DataFrame) -> DataFrame:
    """``paragraphs`` without the lines that are a notice, alone or joined with
    the lines of their block."""
    return (blocks(docs).withColumn("paragraph", F.explode_outer(_plain(F.col("_lines")))).drop("_lines")
            .where("paragraph IS NOT NULL"))


def _line_counts(lines: DataFrame, among: list[str]) -> dict[str, int]:
    """Lines (paragraph) that hold each of the words; "" counts them all."""
    held = F.concat(F.array_distinct(words(F.col("paragraph"))), F.array(F.lit("")))
    got = lines.select(F.explode_outer(held).alias("w")).where(F.col("w").isin([*among, ""])).groupBy("w").count()
    return {r["w"]: r["count"] for r in got.collect()}


def ordinary_counts(docs: DataFrame, among: list[str]) -> dict[str, int]:
    """``_line_counts`` of the ordinary lines of ``docs`` (text): all lines less
    the notices, which only blocks with an anchor can hold."""
    anchored = stored(blocks(docs.select("text").where(_has_anchor(F.col("text"))))
                      .where(_has_anchor(F.array_join("_lines", " "))), "licence-anchored", "zstd")
    every = _line_counts(paragraphs(docs.select("text")), among)
    noticed = stored(anchored.select("_lines", F.explode_outer(F.array(_plain(F.col("_lines")))).alias("_plain"))
                     .where(F.size("_plain") < F.size("_lines")), "licence-notices", "zstd")
    lines = lambda c: noticed.select(F.explode(c).alias("paragraph"))
    inside, plain = _line_counts(lines("_lines"), among), _line_counts(lines("_plain"), among)
    return {w: n - inside.get(w, 0) + plain.get(w, 0) for w, n in every.items()}


def _variants(text: str) -> list[str]:
    """The template and what is met of it: halves, lower case, in a sentence."""
    w = text.split()
    half = len(w) // 2
    return [text, text.lower(), text.rstrip("."), f"{text} All rights reserved.", f"Notice: {text}",
            *([" ".join(w[:-2]), " ".join(w[2:]), " ".join(w[:half]), " ".join(w[half:])] if len(w) >= 8 else [])]


class LicenceModel:
    """Vocabulary, regression, threshold and the probes: a text with a feature
    holds one of them as a run of letters and digits."""

    def __init__(self, vocabulary: list[str], families: list[str], model: LogisticRegressionModel,
                 threshold: float, probes: list[str]):
        self.vocabulary, self.families, self.model = vocabulary, families, model
        self.threshold, self.probes = threshold, probes

    def may_match(self, text: Column) -> Column:
        return F.arrays_overlap(F.split(F.lower(text), "[^a-z0-9]+"), F.array(*map(F.lit, self.probes)))

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (paragraph) with probabilities ``_p``.

        The words and then the probabilities are written before they are used
        again: a filter on a computed column would else be carried down to the
        words and take every paragraph apart once per word.  Of the words only
        those of the vocabulary are written, the others as null."""
        known = _known_words(words(F.col("paragraph")), _spelled(self.vocabulary))
        split = stored(rows.withColumn("_w", known), "licence-candidates", "zstd")
        return stored(_probabilities(split, self.vocabulary, self.model).drop("_g", "_x", "_w"), "licence-scores", "zstd")

    def known(self) -> Column:
        return 1 - F.get("_p", len(self.families) - 1)

    def classify(self, scored: DataFrame) -> DataFrame:
        """Believed rows of ``score`` with family, probability, confirmed and
        disputed (the best template is another family's)."""
        each = F.slice("_p", 1, len(self.families) - 1)
        likely = F.get(F.array(*[F.lit(f) for f in self.families]),
                       F.array_position(each, F.array_max(each)).cast("int") - 1)
        believed = scored.where(self.known() >= self.threshold).withColumn(
            "_named", _let(words(F.col("paragraph")), _named))
        return (believed.withColumn("probability", self.known()).withColumn("family", likely)
                .withColumn("confirmed", F.array_contains("_named", F.col("family")))
                .withColumn("disputed", (F.size("_named") > 0) & ~F.col("confirmed")).drop("_p", "_named"))


def _probabilities(rows: DataFrame, vocabulary: list[str], model: LogisticRegressionModel) -> DataFrame:
    """``rows`` (``_w``) with ``_p``, the probability of each family."""
    got = _vectors(rows, vocabulary)
    got = model.setFeaturesCol("_x").setProbabilityCol("_q").setRawPredictionCol("").setPredictionCol("").transform(got)
    return got.withColumn("_p", vector_to_array("_q")).drop("_q")


def _spelled(vocabulary: list[str]) -> list[str]:
    return sorted({w for g in vocabulary for w in g.split()})


def _known_words(w: Column, among: list[str]) -> Column:
    return F.transform(w, lambda x: F.when(x.isin(among), x))


def _known_grams(w: Column, among: list[str]) -> Column:
    """The one to three word grams that hold no other words than these."""
    def of(t: Column) -> Column:
        at = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
        run = lambda n: F.transform(at, lambda i: F.concat(
            *[x for k in range(n) for x in (F.lit(" "), F.get(t, i + k))][1:]))
        return F.array_compact(F.concat(t, run(2), run(3)))
    return _let(_known_words(w, among), of)


def _vectors(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``rows`` (``_w``) with the feature vector ``_x``."""
    g = rows.withColumn("_g", _known_grams(F.col("_w"), _spelled(vocabulary)))
    return CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_g", outputCol="_x").setBinary(True).transform(g)


def _named(w: Column) -> Column:
    """Families of the best among the templates that the words hold with all
    their marks."""
    marked = F.filter(_matches(w), lambda t: t["marked"])
    best = lambda m: F.array_max(F.transform(m, lambda t: t["share"]))
    return _let(marked, lambda m: F.array_distinct(F.transform(
        F.filter(m, lambda t: t["share"] >= best(m)), lambda t: t["family"])))


def units(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """What of ``docs`` (text and more) can have a feature: ``doc`` (all other
    columns), ``_block``, ``paragraph``, ``_joined`` (else a line), ``_plain`` (an
    ordinary line).  Blocks are written with their lines that hold a probe, whole
    only where they hold an anchor."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("doc"), "text").where(model.may_match(F.col("text")))
    hit = F.filter("_lines", lambda x: model.may_match(x))
    kept = stored(blocks(rows).withColumn("_hit", F.explode_outer(F.array(hit))).where(F.size("_hit") > 0).select(
        "doc", F.monotonically_increasing_id().alias("_block"), "_hit",
        F.when(_has_anchor(F.array_join("_lines", " ")), F.col("_lines")).alias("_whole")), "licence-blocks", "zstd")
    unit = lambda text, joined, plain: F.struct(
        text.alias("paragraph"), F.lit(joined).alias("_joined"), plain.alias("_plain"))
    plainly = _let(F.struct(_plain(F.col("_whole")).alias("p")), lambda o: F.transform(
        "_hit", lambda x: unit(x, False, F.array_contains(o["p"], x))))
    lines = F.when(F.col("_whole").isNull(), F.transform("_hit", lambda x: unit(x, False, F.lit(True)))).otherwise(plainly)
    # a line that lacks a mark, as the version on the next line, stays with its block
    rest = F.array_join(_rest(F.col("_whole"), lambda x: F.when(_has_anchor(x), _let(words(x), lambda w: F.size(_named(w)) > 0))
                              .otherwise(F.lit(False))), " ")
    whole = F.when(F.size("_whole") > 1, F.array(unit(rest, True, F.lit(False))))
    return (kept.select("doc", "_block", F.explode_outer(F.concat(lines, F.coalesce(whole, F.slice(lines, 1, 0)))).alias("_u"))
            .select("doc", "_block", "_u.*"))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[LicenceModel, DataFrame]:
    """The model, fitted on the templates and on paragraphs of about
    ``sample_docs`` documents of ``docs`` (doc_id, text and more), and the scored
    ``units`` of all documents, which ``judge`` reads."""
    spark = docs.sparkSession
    n = docs.count()
    draw = lambda key: F.pmod(F.xxhash64(key, F.lit(5)), F.lit(DRAWS)) < F.lit(
        math.ceil(sample_docs / max(n, sample_docs) * DRAWS))
    kept_out = lambda key: F.pmod(F.xxhash64(key, F.lit(6)), F.lit(2)) == 0
    sample = stored(ordinary(docs.where(draw("doc_id")).select("doc_id", "text")), "paragraphs")
    # distinctive words: rare among all ordinary lines; bounded by the templates' words
    template_words = sorted({w for ts in TEMPLATES.values() for t in ts for w in words_of(t)})
    seen = ordinary_counts(docs, template_words)
    total = seen.pop("", 0)
    common = {w for w, k in seen.items() if k and k * RARE >= total}
    rare = [w for w in template_words if w not in common and (len(w) > 1)]
    vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams_of(words_of(t))
                         if set(g.split()) & set(rare)})
    families = [*sorted(TEMPLATES), UNKNOWN]
    examples = [(x, float(families.index(f))) for f, ts in sorted(TEMPLATES.items()) for t in ts for x in _variants(t)]
    # generic legal words alone say nothing
    examples += [(w, float(len(families) - 1)) for w in rare for _ in range(3)]
    values = ", ".join("(" + "'{}', {}D".format(x.replace("\\", "\\\\").replace("'", "\\'"), y) + ")" for x, y in examples)
    positive = spark.sql(f"SELECT * FROM VALUES {values} AS t(paragraph, label)")
    background = sample.where(~kept_out("doc_id")).withColumn("label", F.lit(float(len(families) - 1)))
    rows = positive.union(background.select("paragraph", "label"))
    rows = stored(rows.withColumn("_w", words(F.col("paragraph"))), "licence-examples")
    fitted = LogisticRegression(featuresCol="_x", labelCol="label", family="multinomial", regParam=1e-3,
                                elasticNetParam=0.5, maxIter=60).fit(
        stored(_vectors(rows, vocabulary).select("_x", "label"), "licence-training"))
    probes = sorted({max(re.findall("[a-z0-9]+", w), key=len) for w in rare})
    model = LicenceModel(vocabulary, families, fitted, 0.5, probes)
    scored = model.score(units(docs, model))
    # a probability that at most MAX_FALSE of all ordinary lines out of training pass; those without a probe score least
    trained = F.coalesce(draw("doc.doc_id") & ~kept_out("doc.doc_id"), F.lit(False))
    n_held = total - background.count()
    scores = scored.where(F.col("_plain") & ~trained).select(F.floor(model.known() * BINS).cast("int").alias("b"))
    above = 0
    for r in sorted(scores.groupBy("b").count().collect(), reverse=True):
        above += r["count"]
        if above > MAX_FALSE * n_held:
            model.threshold = max(0.5, min(0.99, (r["b"] + 1) / BINS))
            break
    return model, scored


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LicenceModel:
    return learn(docs, sample_docs)[0]


def judge(scored: DataFrame, model: LicenceModel) -> DataFrame:
    """Believed paragraphs of scored ``units``: doc, paragraph, family,
    probability, confirmed, disputed."""
    found = model.classify(scored)
    # joined lines count where they are confirmed and none of the lines is by itself
    mine = Window.partitionBy("_block", "family")
    sure = lambda joined: F.max(F.col("confirmed") & (F.col("_joined") == joined)).over(mine)
    return (found.withColumn("_by_line", sure(False)).withColumn("_by_block", sure(True))
            .where(F.when(F.col("_joined"), F.col("confirmed") & ~F.col("_by_line"))
                   .otherwise(F.col("confirmed") | ~F.col("_by_block")))
            .drop("_block", "_joined", "_plain", "_by_line", "_by_block"))


def scan(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """Believed paragraphs of ``docs`` (text and more): ``doc`` (all other
    columns), paragraph, family, probability, confirmed, disputed."""
    return judge(model.score(units(docs, model)), model)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    numbered = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    model, scored = learn(numbered)
    found = stored(judge(scored, model).select("doc.doc_id", "doc.row", "family", "confirmed", "disputed"), "licences")
    per_doc = found.groupBy("doc_id", "row").agg(
        F.count(F.lit(1)).alias("n_predicted"), F.sum(F.col("confirmed").cast("long")).alias("n_confirmed"),
        F.sum(F.col("disputed").cast("long")).alias("n_disputed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"))
    k = per_doc.withColumnsRenamed({"doc_id": "_d", "row": "_r"})
    return (numbered.select("doc_id", "row")
            .join(k, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r")), "left")
            .select("doc_id", F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"),
                    F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"),
                    F.coalesce("n_disputed", F.lit(0)).alias("n_disputed"), F.coalesce("families", F.lit("")).alias("families")))
