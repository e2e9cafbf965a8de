"""Licence scans by a positional rare-token index.

Templates are licence notices as word sequences.  A file holds a notice at
some position if at least ``COVERAGE`` of its words stand where the template
has them and all words of its mandatory key phrases do.  A template of n words
may miss m = n - ceil(COVERAGE * n) of them, so at least one of its m + 1 words
of highest inverse document frequency must be in place: only those are posted,
as (template, position).  Each file's words are looked up in these postings,
hits of equal relative position are intersected to candidates, and these are
verified word by word.  Document frequencies cover all files.

Results: one row (doc_id, licence, word_pos, coverage) for each notice found;
a file with none, null or empty has no row.  Repeated rows have rows of their
own.  Overlapping finds are all listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import only
from .textops import Words, slices

COVERAGE = 0.8


@dataclass(frozen=True)
class Template:
    licence: str
    text: str
    keys: tuple[str, ...]


TEMPLATES = (
    Template("MIT", "Released under the MIT License.", ("the MIT License",)),
    Template("MIT", "This project is licensed under the terms of the MIT license.", ("the MIT license",)),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted, free of charge",)),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("the Apache License, Version 2.0",)),
    Template("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache.org/licenses/LICENSE-2.0",)),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("GNU General Public License, version 3",)),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("GNU General Public License, version 2",)),
    Template("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("GNU General Public License",)),
    Template("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("GNU Lesser General Public License",)),
    Template("AGPL", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("GNU Affero General Public License",)),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("Mozilla Public License, v. 2.0",)),
    Template("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("CC BY-NC 4.0",)),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("CC BY-SA 4.0",)),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", ("CC BY 4.0",)),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("Creative Commons Attribution 4.0",)),
    Template("Unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software", "the public domain")),
)


class Compiled:
    """Templates as word hashes, with the places of their key phrases."""

    def __init__(self, templates: tuple[Template, ...], coverage: float):
        words = Words(pa.array([t.text for t in templates]))
        self.words = [words.hash[words.off[i] : words.off[i + 1]] for i in range(len(templates))]
        self.need = [math.ceil(coverage * len(w) - 1e-9) for w in self.words]
        self.key = []
        for t, own in zip(templates, self.words):
            must = np.zeros(len(own), bool)
            for phrase in t.keys:
                p = Words(pa.array([phrase])).hash
                at = next(i for i in range(len(own) - len(p) + 1) if (own[i : i + len(p)] == p).all())
                must[at : at + len(p)] = True
            self.key.append(must)
        self.vocabulary = np.unique(words.hash)
        self.names = [t.licence for t in templates]

    def post(self, df: np.ndarray) -> None:
        """Post each template's rarest words: as many as may be missing, and one more."""
        posts = []
        for t, own in enumerate(self.words):
            freq = df[np.searchsorted(self.vocabulary, own)]
            rare = np.lexsort((np.arange(len(own)), freq))[: len(own) - self.need[t] + 1]
            posts += [(own[p], t, p) for p in rare.tolist()]
        posts.sort()
        self.post_word = np.array([p[0] for p in posts], np.uint64)
        self.post_template = np.array([p[1] for p in posts], np.int64)
        self.post_pos = np.array([p[2] for p in posts], np.int64)

    def find(self, words: Words) -> list[tuple[int, int, int, float]]:
        """(text, template, position, coverage) of each notice."""
        low = np.searchsorted(self.post_word, words.hash, "left")
        times = np.searchsorted(self.post_word, words.hash, "right") - low
        hit = np.flatnonzero(times)
        if not len(hit):
            return []
        at = np.repeat(hit, times[hit])
        nth = np.arange(len(at)) - np.repeat(np.cumsum(times[hit]) - times[hit], times[hit])
        post = np.repeat(low[hit], times[hit]) + nth
        doc = words.doc()[at]
        rel = at - words.off[doc] - self.post_pos[post]
        triples = np.unique(np.stack([doc, self.post_template[post], rel], axis=1), axis=0)
        out = []
        for d, t, r in triples.tolist():
            own, first, last = self.words[t], words.off[d], words.off[d + 1]
            place = np.arange(len(own)) + first + r
            inside = (place >= first) & (place < last)
            same = inside & (words.hash[np.clip(place, 0, len(words.hash) - 1)] == own)
            n = int(same.sum())
            if n >= self.need[t] and same[self.key[t]].all():
                out.append((d, t, r, round(n / len(own), 6)))
        return out


def licence_finds(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, licence, template, word_pos, coverage) of each notice; word_pos may be negative where its start is missing."""
    rows = only(df, doc_id=id_col, text=text_col).filter("text is not null")
    index = Compiled(templates, coverage)
    vocabulary = index.vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for i, j in slices(batch.column(0)):
                words = Words(batch.column(0).slice(i, j - i))
                at = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
                hit = vocabulary[at] == words.hash
                total += np.bincount(np.unique(words.doc()[hit] * len(vocabulary) + at[hit]) % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    counted = rows.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n")).collect()  # one row a licence word
    freq = np.zeros(len(vocabulary), np.int64)
    for w, n in counted:
        freq[w] = n
    index.post(freq)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("text")):
                found = index.find(Words(batch.column("text").slice(i, j - i)))
                if found:
                    d, t, r, c = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(i, j - i).take(pa.array(d)), pa.array([index.names[x] for x in t]), pa.array(t, pa.int32()), pa.array(r, pa.int32()), pa.array(c, pa.float64())],
                        names=["doc_id", "licence", "template", "word_pos", "coverage"],
                    )

    return rows.mapInArrow(find, f"doc_id {id_type}, licence string, template int, word_pos int, coverage double")
