"""Licence notices in text, by a trained paragraph classifier.

A paragraph is a line. Its word unigrams and bigrams feed a multinomial logistic regression over
licence families and an unknown class. It is trained on variants of the templates below (cut, with
words lost and foreign words around) and, for the unknown class, on paragraphs of ``SAMPLE`` documents of
the corpus, the first by hash of the id, and on shuffled template words. A temperature fitted on
held-out variants calibrates the probabilities. A predicted family counts if its probability reaches
``CERTAIN`` and the comparison with a template of that family confirms it: ``COVERED`` of the
template's bigrams are in the paragraph, or of the paragraph's in the template.

A paragraph without any template bigram can't be confirmed and is unknown. Null and empty texts have no
paragraphs. Rows that repeat give a row each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountlens.llm.common import map_arrow
from accountlens.llm.linear import fit_softmax, softmax

SAMPLE = 300
VARIANTS = 60
CERTAIN = 0.5
COVERED = 0.6
UNKNOWN = "unknown"

# Notices of public licences.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD License.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
}
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words_of_line(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


@dataclass
class LicenceModel:
    families: list[str]  # the last is the unknown class
    features: dict
    weights: np.ndarray
    temperature: float
    templates: list[tuple[str, set]]

    def __post_init__(self) -> None:
        self.pairs = set().union(*(t for _, t in self.templates))

    def vector(self, words: list[str]) -> np.ndarray:
        x = np.zeros(len(self.features) + 1)
        grams = [*words, *zip(words, words[1:])]
        other = 0
        for g in grams:
            k = self.features.get(g)
            if k is None:
                other += 1
            else:
                x[k] = 1.0
        x /= max(1.0, np.sqrt(x.sum()))
        x[-1] = other / max(1, len(grams))
        return x

    def classify(self, line: str) -> tuple[str, float]:
        """Family and its probability; ``UNKNOWN`` unless a template confirms it."""
        words = words_of_line(line)
        if self.pairs.isdisjoint(zip(words, words[1:])):
            return UNKNOWN, 1.0
        z = np.append(self.vector(words), 1.0) @ self.weights / self.temperature
        p = softmax(z)
        best = int(p.argmax())
        family = self.families[best]
        if family == UNKNOWN or p[best] < CERTAIN:
            return UNKNOWN, float(p[-1])
        own = bigrams(words)
        for name, template in self.templates:
            shared = len(own & template)
            if name == family and shared >= COVERED * min(len(template), max(3, len(own))):
                return family, float(p[best])
        return UNKNOWN, float(p[-1])


def _variants(words: list[str], foreign: list[str], random: np.random.Generator, n: int) -> list[list[str]]:
    out = [words]
    for _ in range(n - 1):
        w = list(words)
        if len(w) > 12 and random.random() < 0.5:
            size = int(random.integers(max(8, len(w) // 2), len(w) + 1))
            at = int(random.integers(0, len(w) - size + 1))
            w = w[at : at + size]
        lost = 0.1 if len(w) > 8 else 0.0
        w = [x for x in w if random.random() >= lost]
        around = [foreign[int(k)] for k in random.integers(0, len(foreign), int(random.integers(0, 6)))]
        cut = int(random.integers(0, len(around) + 1))
        out.append(around[:cut] + w + around[cut:])
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> LicenceModel:
    """The classifier; ``sample`` documents stand for text that is no licence."""
    texts = (
        docs.where(F.col(text_col).isNotNull())
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(sample)
        .select(F.slice(F.split(F.col(text_col), "\n"), 1, 20).alias("lines"))
        .collect()
    )
    random = np.random.default_rng(9)
    templates = [(f, bigrams(words_of_line(t))) for f, ts in TEMPLATES.items() for t in ts]
    corpus = [w for row in texts for line in row["lines"] if (w := words_of_line(line)[:200])]
    # the sample may hold notices itself: lines that cover a template aren't taken as unknown
    corpus = [w for w in corpus if all(len(bigrams(w) & t) < 0.5 * len(t) for _, t in templates)]
    foreign = [x for w in corpus for x in w][:20_000] or ["lorem"]
    families = [*TEMPLATES, UNKNOWN]
    rows: list[tuple[list[str], int]] = [(w, len(families) - 1) for w in corpus[:2000]]
    vocabulary: dict = {}
    every: list[str] = []
    for k, (_, listed) in enumerate(TEMPLATES.items()):
        for t in listed:
            words = words_of_line(t)
            every += words
            for g in [*words, *zip(words, words[1:])]:
                vocabulary.setdefault(g, len(vocabulary))
            rows += [(v, k) for v in _variants(words, foreign, random, VARIANTS)]
    for _ in range(800):
        n = int(random.integers(3, 30))
        mix = [every[int(k)] if random.random() < 0.5 else foreign[int(random.integers(0, len(foreign)))] for k in random.integers(0, len(every), n)]
        rows.append((mix, len(families) - 1))
    model = LicenceModel(families, vocabulary, np.zeros(0), 1.0, templates)
    x = np.array([model.vector(w) for w, _ in rows])
    y = np.array([k for _, k in rows])
    held = random.random(len(rows)) < 0.2
    model.weights = fit_softmax(x[~held], y[~held], len(families))
    z = np.c_[x[held], np.ones(held.sum())] @ model.weights
    loss = [(-np.log(softmax(z / t)[np.arange(len(z)), y[held]] + 1e-12).mean(), t) for t in np.geomspace(0.1, 3, 30)]
    model.temperature = float(min(loss)[1])
    return model


def scan(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_paragraphs, found) of each row; found: array of (paragraph, family, probability)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    one = pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64())])

    def make():
        classify, seen = held.value.classify, {}

        def of(line: str) -> tuple[str, float]:
            """As ``classify``, with the notices of late remembered."""
            if len(line) > 400:
                return classify(line)
            if line not in seen:
                if len(seen) >= 50_000:
                    seen.clear()
                seen[line] = classify(line)
            return seen[line]

        def work(batch: pa.RecordBatch) -> list:
            counts, found = [], []
            for value in batch.column(1):
                lines = (value.as_py() or "").split("\n")
                counts.append(sum(1 for x in lines if x.strip()))
                found.append(
                    [
                        {"paragraph": k, "family": family, "probability": p}
                        for k, line in enumerate(lines)
                        for family, p in (of(line),)
                        if family != UNKNOWN
                    ]
                )
            return [batch.column(0), counts, pa.array(found, pa.list_(one))]

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
        make,
        f"id {kind}, n_paragraphs long, found array<struct<paragraph: int, family: string, probability: double>>",
    ).withColumnRenamed("id", id_col)
