"""Licence scan: fixed phrases, and an exact set-similarity join of text blocks with licence templates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import documents, texts

#: Phrases whose every place is reported, with their labels: fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: (label, wording) of well-known public licence notices: fixed values.
TEMPLATES = (
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
CONTAINMENT = 0.8
_NC = frozenset({"nc", "noncommercial", "commercial"})
_SA = frozenset({"sa", "sharealike", "alike"})
_ND = frozenset({"nd", "noderivatives", "noderivs", "derivatives", "derivs"})
_CC = (frozenset({"cc", "creative", "commons"}), frozenset({"attribution", "by"}))
#: Label: (word groups, words of other licences). A block tells its label if it holds a word of each group
#: that its template has a word of, and no word of another licence.
TOLD_BY: dict[str, tuple] = {
    "agpl": (({"affero"},), ()),
    "apache": (({"apache"},), ()),
    "cc-by": (_CC, _NC | _SA | _ND),
    "cc-by-nc": ((*_CC, _NC), _SA | _ND),
    "cc-by-nc-sa": ((*_CC, _NC, _SA), _ND),
    "cc-by-nd": ((*_CC, _ND), _NC | _SA),
    "cc-by-sa": ((*_CC, _SA), _NC | _ND),
    "epl": (({"eclipse"},), ()),
    "gpl": (({"gnu", "general"},), {"affero", "lesser"}),
    "lgpl": (({"lesser"},), ()),
    "mit": (({"mit"},), ()),
    "mpl": (({"mozilla"},), ()),
    "unlicense": (({"unencumbered"},), ()),
}

FIELDS = "n_words long, places array<struct<label:string,first:long>>, matches array<struct<label:string,template:int,first:long,n_words:long,containment:double,told:boolean>>"
_NOT_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of lower-cased ASCII letters, digits and all characters beyond ASCII, as UTF-8."""
    return (text or "").encode().lower().translate(_NOT_WORD).split()


def places(words: list[bytes]) -> list[tuple[str, int]]:
    """(label, index of the first word) of every place of a phrase."""
    found = []
    for phrase, label in PHRASES.items():
        parts = phrase.encode().split()
        at = -1
        for _ in range(words.count(parts[0])):
            at = words.index(parts[0], at + 1)
            if words[at : at + len(parts)] == parts:
                found.append((label, at))
    return found


class TemplateIndex:
    """Templates as word sets in one global order, with a prefix index.

    The order: words of no template first, then the templates' words by ascending document frequency.
    A block that contains ``need`` of a template's n words must have one of its n - need + 1 first
    (prefix filter) and ``need`` words at all (length filter). If a word is the first that the two share, all
    others come after it in both orders: n less its place in the template's order, and the number of the block's words
    from its place in the global order on, must both be ``need`` or more (positional filter).
    """

    def __init__(self, frequency: dict[bytes, int], templates=TEMPLATES, containment: float = CONTAINMENT):
        self.templates, self.prefix = [], {}
        words = {w for _, wording in templates for w in wording.encode().split()}
        self.place = {w: k for k, w in enumerate(sorted(words, key=lambda w: (frequency.get(w, 0), w)))}
        for k, (label, wording) in enumerate(templates):
            wording = wording.encode().split()
            order = sorted(set(wording), key=lambda w: (frequency.get(w, 0), w))
            need = -(-int(round(containment * len(order) * 1000)) // 1000)
            groups, others = TOLD_BY.get(label, ((), ()))
            groups = [g for g in (frozenset(w.encode() for w in g) for g in groups) if not g.isdisjoint(order)]
            self.templates.append((label, {w: i for i, w in enumerate(order)}, len(wording), need, (groups, frozenset(w.encode() for w in others))))
            for w in order[: len(order) - need + 1]:
                self.prefix.setdefault(w, []).append(k)
        self.rare = frozenset(self.prefix)

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int, int, float, bool]]:
        """(label, template, first word, number of words, containment, told) of each matching stretch.

        A block is any run of as many words as the template has, or the whole text if that is
        shorter; overlapping blocks that match are one stretch with the best containment. It
        is told if one of its blocks meets TOLD_BY.
        """
        if self.rare.isdisjoint(words):
            return []
        seeds: dict[int, dict[bytes, list[int]]] = {}
        for i, w in enumerate(words):
            if w in self.prefix:
                for k in self.prefix[w]:
                    seeds.setdefault(k, {}).setdefault(w, []).append(i)
        order = np.array([self.place.get(w, -1) for w in words])
        held = {w: np.r_[0, np.cumsum(order >= self.place[w])] for w in {w for of in seeds.values() for w in of}}
        found = []
        for k, at in sorted(seeds.items()):
            label, rank, length, need, telling = self.templates[k]
            if len(words) >= need:
                near = self.near([(held[w], np.array(i)) for w, i in at.items()], length, need)
                found += [(label, k, first, end - first, best / len(rank), told) for first, end, best, told in self._stretches(words, near, rank, length, need, telling)]
        return found

    @staticmethod
    def near(seeds: list[tuple[np.ndarray, np.ndarray]], length: int, need: int) -> list[tuple[int, int]]:
        """Ranges (first, last) of the starts of blocks that hold a seed and pass the positional filter for it.

        A seed word comes with the number of words from its place in the order on, before each word of the text, and its own places.
        """
        n = len(seeds[0][0]) - 1
        last = max(0, n - length)
        passes = np.zeros(last + 1, bool)
        for held, at in seeds:
            change = np.zeros(last + 2, np.int64)
            np.add.at(change, np.clip(at - length + 1, 0, last), 1)
            np.add.at(change, np.minimum(at, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
            passes[starts[held[np.minimum(starts + length, n)] - held[starts] >= need]] = True
        starts = np.flatnonzero(passes)
        runs = np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1)
        return [(int(r[0]), int(r[-1])) for r in runs if len(r)]

    @staticmethod
    def _stretches(words, near, rank, length, need, telling):
        """Slide a block over each range of starts, counting the distinct template words inside."""
        groups, others = telling
        out: list[list] = []
        for low, high in near:
            inside: Counter = Counter(w for w in words[low : low + length] if w in rank)
            for start in range(low, high + 1):
                if start > low:
                    gone, new = words[start - 1], words[start + length - 1]
                    if gone in rank:
                        inside[gone] -= 1
                        if not inside[gone]:
                            del inside[gone]
                    if new in rank:
                        inside[new] += 1
                if len(inside) < need:
                    continue
                end = min(start + length, len(words))
                block = words[start:end]
                told = others.isdisjoint(block) and not any(g.isdisjoint(block) for g in groups)
                if out and start < out[-1][1]:
                    out[-1][1:] = [end, max(out[-1][2], len(inside)), told or out[-1][3]]
                else:
                    out.append([start, end, len(inside), told])
        return out


VOCABULARY = frozenset(w.encode() for _, wording in TEMPLATES for w in wording.split())


def _frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(VOCABULARY.intersection(words_of(text)))
    yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def word_frequency(docs: DataFrame) -> dict[bytes, int]:
    """Documents that hold each word of the templates, over all of ``docs``: at most len(VOCABULARY) rows."""
    parts = texts(docs).select("text").mapInArrow(_frequency_batches, "word string, n long")
    return {r.word.encode(): r.n for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, places of the phrases, and stretches that match a template.

    The first pass counts the templates' words over all documents, the second joins each document's
    blocks with the templates, which are a fixed list and go to every task. No document is shuffled.
    A null text is empty and matches nothing; repeated and null doc_ids pass; extra columns are ignored.
    Ties can't arise: every place and stretch is listed, and overlapping stretches of one template are one.
    An empty table gives an empty table. A very long text is scanned whole, its words held once.
    """
    index = TemplateIndex(word_frequency(docs))
    kind = dict(docs.dtypes)["doc_id"]
    place = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))
    match = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64()), ("told", pa.bool_())]))

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, matched = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                sizes.append(len(words))
                found.append([{"label": a, "first": b} for a, b in places(words)])
                matched.append([dict(zip(("label", "template", "first", "n_words", "containment", "told"), m, strict=True)) for m in index.matches(words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, place), pa.array(matched, match)], ["doc_id", "n_words", "places", "matches"])

    return texts(docs).mapInArrow(scan_batches, f"doc_id {kind}, {FIELDS}")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    base, more = F.col("places.label"), F.filter("matches", lambda m: m["told"])["label"]
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first").alias("first_word"),
        F.array_max("places.first").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.containment"), F.lit(0.0))).alias("score"),
        F.size("matches").cast("long").alias("n_matches"),
    )
