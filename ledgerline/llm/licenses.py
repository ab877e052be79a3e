"""License scan: fixed phrases, and licence templates found through a positional index.

The index holds, for each template, the positions of its PROBES words of highest IDF in
the corpus. Every word of a file that the index holds gives the place at which that
template would have to start; places that enough probes agree on (the intersection of
the postings by relative position) are verified word by word: the share of the
template's IDF weight found in place must reach MATCH and the template's mandatory key
phrases must stand inside the place. Document frequencies cover all files; only the
templates' words are counted, so the statistics have a fixed size.

Cases: a null text is empty: no words, no labels, score 0; all places count, those of
overlapping phrases too; equal rows get equal results; without rows every IDF is 0 and
every word weighs the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.rows import TEXT, annotate, gathered, table
from ledgerline.llm.textwords import LETTERS, STEP_BYTES, Words, steps, words_of

PROBES = 6
AGREE = 0.5  # share of a template's probes that must agree on its place
MATCH = 0.8
SLACK = 3  # words around the place in which a key phrase may also start

# The base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Label, template, mandatory key phrases.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0", ("apache license version 2.0",)),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("in compliance with the license",),
    ),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    (
        "gpl",
        "you can redistribute it and/or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version",
        ("gnu general public license", "free software foundation"),
    ),
    (
        "lgpl",
        "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published "
        "by the free software foundation",
        ("gnu lesser general public license",),
    ),
    ("mit", "released under the mit license", ("the mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "isc",
        "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted",
        ("for any purpose with or without fee",),
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        ("mozilla public license v 2.0",),
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("cc-by-4.0", "licensed under cc by 4.0", ("cc by 4.0",)),
    ("cc-by-sa-4.0", "licensed under cc by-sa 4.0", ("cc by-sa 4.0",)),
    ("cc-by-nc-4.0", "licensed under cc by-nc 4.0", ("cc by-nc 4.0",)),
    ("cc-by-4.0", "creative commons attribution 4.0 international", ("creative commons attribution 4.0",)),
)

OUTPUTS = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
)


def split_words(text: str) -> list[bytes]:
    w = words_of(pa.array([text]), LETTERS, lower=True)
    return [w.text(i) for i in range(len(w.start))]


class Templates:
    """Templates and phrases as numbers of a common small vocabulary."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES) -> None:
        self.labels = [t[0] for t in templates]
        self.phrase_labels = [p[1] for p in phrases]
        lists = {
            "base": [split_words(p[0]) for p in phrases],
            "templates": [split_words(t[1]) for t in templates],
        }
        keyed = [[split_words(k) for k in t[2]] for t in templates]
        every = [w for group in [*lists.values(), *keyed] for words in group for w in words]
        self.vocabulary = sorted(set(every))
        number = {w: i for i, w in enumerate(self.vocabulary)}

        def numbers(words: list[bytes]) -> np.ndarray:
            return np.array([number[w] for w in words], np.int64)

        self.base = [numbers(w) for w in lists["base"]]
        self.templates = [numbers(w) for w in lists["templates"]]
        self.keys = [[numbers(w) for w in group] for group in keyed]
        w = words_of(pa.array([w.decode() for w in self.vocabulary]), LETTERS)
        hashed = w.keys()
        self.order = np.argsort(hashed)
        self.hashed = hashed[self.order]

    def read(self, words: Words) -> np.ndarray:
        """Vocabulary number of each word, -1 for words outside."""
        keys = words.keys()
        at = np.minimum(np.searchsorted(self.hashed, keys), len(self.hashed) - 1)
        return np.where(self.hashed[at] == keys, self.order[at], -1)

    def weighted(self, idf: np.ndarray) -> Templates:
        """Sets each template's word weights and probes: the positions of highest IDF, earlier ones first."""
        if not idf.any():
            idf = np.ones_like(idf)
        self.weights = [idf[t] for t in self.templates]
        self.probes = [np.sort(np.argsort(-w, kind="stable")[:PROBES]) for w in self.weights]
        return self


def phrase_starts(ids: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Words at which the phrase's words stand consecutively in one text."""
    at = np.flatnonzero(ids == phrase[0])
    at = at[at + len(phrase) <= len(ids)]
    for j in range(1, len(phrase)):
        at = at[ids[at + j] == phrase[j]]
    return at[row[at] == row[at + len(phrase) - 1]]


def places(ids: np.ndarray, words: Words, row: np.ndarray, t: int, known: Templates) -> tuple[np.ndarray, np.ndarray]:
    """(texts, scores) of the verified places of template t."""
    template, weights, probes = known.templates[t], known.weights[t], known.probes[t]
    votes = [np.flatnonzero(ids == template[p]) for p in probes]
    rows = np.concatenate([row[v] for v in votes])
    start = np.concatenate([v - p for v, p in zip(votes, probes, strict=True)])
    # a place is a text and where the template would start; it may lie before the text's first word
    place, count = np.unique(np.stack([rows, start]), axis=1, return_counts=True)
    rows, start = place[:, count >= max(1, np.ceil(AGREE * len(probes)))]
    if not len(rows):
        return rows, np.zeros(0)
    cells = start[:, None] + np.arange(len(template))
    inside = (cells >= words.first[rows][:, None]) & (cells < words.first[rows + 1][:, None])
    equal = inside & (ids[np.clip(cells, 0, len(ids) - 1)] == template)
    score = (equal * weights).sum(axis=1) / weights.sum()
    good = score >= MATCH
    for key in known.keys[t]:
        at = phrase_starts(ids, row, key)
        low = np.searchsorted(at, np.maximum(start - SLACK, words.first[rows]))
        high = np.searchsorted(at, np.minimum(start + len(template) + SLACK, words.first[rows + 1]))
        good &= high > low
    return rows[good], np.minimum(score[good], 1.0)


def label_lists(texts: pa.Array, known: Templates) -> list:
    words = words_of(texts, LETTERS, lower=True)
    ids, row, n = known.read(words), words.row(), len(texts)
    n_base = np.zeros(n, np.int64)
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    base: dict[int, set[str]] = {}
    for phrase, label in zip(known.base, known.phrase_labels, strict=True):
        at = phrase_starts(ids, row, phrase)
        texts_at, own = row[at], at - words.first[row[at]]
        n_base += np.bincount(texts_at, minlength=n)
        np.minimum.at(first, texts_at, own)
        np.maximum.at(last, texts_at, own)
        for r in np.unique(texts_at):
            base.setdefault(int(r), set()).add(label)
    labels = {r: set(found) for r, found in base.items()}
    score = np.zeros(n)
    for t, label in enumerate(known.labels):
        rows, scores = places(ids, words, row, t, known)
        np.maximum.at(score, rows, scores)
        for r in np.unique(rows):
            labels.setdefault(int(r), set()).add(label)
    none = pa.array(n_base == 0)

    def some(values: np.ndarray) -> pa.Array:
        return pa.array(values, pa.int64(), mask=none.to_numpy(zero_copy_only=False))

    def joined(found: dict[int, set[str]]) -> list[str]:
        return [",".join(sorted(found.get(r, ()))) for r in range(n)]

    return [words.counts, n_base, some(first), some(last), joined(base), joined(labels), score]


def document_frequencies(docs: DataFrame, known: Templates) -> tuple[int, np.ndarray]:
    """(number of texts, in how many of them each vocabulary word stands), over all texts."""
    size = len(known.vocabulary)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        count, seen = 0, np.zeros(size, np.int64)
        for step in steps(batches, TEXT, STEP_BYTES):
            words = words_of(step.column(0), LETTERS, lower=True)
            ids = known.read(words)
            at = np.flatnonzero(ids >= 0)
            seen += np.bincount(np.unique(words.row()[at] * size + ids[at]) % size, minlength=size)
            count += step.num_rows
        yield {"word": np.arange(-1, size, dtype=np.int32), "texts": np.concatenate([[count], seen])}

    rows = gathered(docs.select(F.col("text").cast("string").alias(TEXT)), "word int, texts bigint", collect)
    found = {r["word"]: r["texts"] for r in rows.groupBy("word").agg(F.sum("texts").alias("texts")).collect()}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(size)], np.int64)


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Every row with its phrase places, labels and the score of its best template."""
    known = Templates(templates, phrases)
    count, seen = document_frequencies(docs, known)
    shared = docs.sparkSession.sparkContext.broadcast(known.weighted(np.log((count + 1) / (seen + 1))))
    return annotate(docs, OUTPUTS, lambda step: label_lists(step.column(TEXT), shared.value), keep)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
