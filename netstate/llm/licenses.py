"""License scans with a positional index of rare words.

Every template (a notice, or a short phrase) is indexed by its rarest words: word -> (template, position). A text looks up
the rarest licence words that it holds, and the postings of a template are intersected by relative position: places where
at least two positions agree on the start, give or take the edits that the template allows. There its key phrases must
stand in full, and the words around them may differ by so many edits. Which words are rare follows from document
frequencies over all texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.llm import text as T

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Share of a notice's words that must agree at a place; the rest may be replaced or left out, or as many put in.
AGREEMENT = 0.8


@dataclass(frozen=True)
class Template:
    """Words to find; the phrases that must be there word by word; whether every word must agree."""

    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]
    exact: bool = False


def template(label: str, text: str, *keys: str, exact: bool = False) -> Template:
    words = tuple(w.decode() for w in WORDS.findall(text.encode().lower()))
    found = []
    for key in keys:
        own = tuple(w.decode() for w in WORDS.findall(key.encode().lower()))
        at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
        found.append((at, at + len(own)))
    return Template(label, words, tuple(found), exact)


#: Phrases whose places are counted.
BASE = (
    template("mit", "mit license", exact=True),
    template("apache", "apache license", exact=True),
    template("gpl", "general public license", exact=True),
)
#: Sentences by which texts name their licence.
NOTICES = (
    template("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    template("apache-2.0", "you may not use this file except in compliance with the License", "in compliance with the license"),
    template("mit", "Released under the MIT License", "mit license"),
    template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files", "permission is hereby granted free of charge"),
    template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu general public license", "version 3"),
    template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", "gnu general public license", "version 2"),
    template("lgpl", "licensed under the GNU Lesser General Public License", "lesser general public license"),
    template("agpl-3.0", "licensed under the GNU Affero General Public License, version 3", "affero general public license"),
    template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa 4 0"),
    template("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4 0"),
    template("cc-by-nc-4.0", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
             "creative commons attribution noncommercial 4 0"),
    template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License",
             "creative commons attribution 4 0"),
    template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted",
             "redistribution and use in source and binary forms"),
    template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v 2 0"),
    template("isc", "Permission to use, copy, modify, and distribute this software for any purpose", "permission to use copy modify"),
)


class Words:
    """Words of whole texts as numbers in the templates' vocabulary; -1 for any other word."""

    def __init__(self, templates):
        self.vocabulary = {w.encode(): i for i, w in enumerate(sorted({w for t in templates for w in t.words}))}

    def of(self, data: np.ndarray, borders: np.ndarray):
        """Numbers, and the word borders of the texts."""
        content, get = data.tobytes().lower(), self.vocabulary.get
        numbers, counts = [], [0]
        for a, b in zip(borders[:-1], borders[1:]):
            numbers.extend([get(w, -1) for w in WORDS.findall(content, a, b)])
            counts.append(len(numbers))
        return np.array(numbers, np.int32), np.array(counts)


def document_frequencies(docs: DataFrame, templates=BASE + NOTICES, text: str = "text") -> dict[str, int]:
    """In how many texts each template word occurs. The result has a row for each word of the templates at most."""
    sent = Words(templates)

    def count(batches):
        total = np.zeros(len(sent.vocabulary), np.int64)
        for batch in batches:
            for _, data, borders in T.runs(batch.column(0)):
                numbers, ends = sent.of(data, borders)
                owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                seen = np.unique(owner[numbers >= 0] * len(total) + numbers[numbers >= 0])
                total += np.bincount(seen % len(total), minlength=len(total))
        names = [w.decode() for w in sent.vocabulary]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], ["word", "texts"])

    counted = docs.select(text).mapInArrow(count, "word string, texts long").groupBy("word").agg(F.sum("texts"))
    return {w: 0 for t in templates for w in t.words} | {w: n for w, n in counted.collect()}


class Index:
    """Postings of each template's rarest words, by document frequencies over all texts.

    A notice of m words of which a share a must agree allows k = m - ceil(a m) edits: words put in, left out or replaced.
    Of its k + 2 rarest positions at least two then stand in the text, each within k words of its place, so no notice is
    missed. An exact phrase allows no edit, and all its positions are looked up.
    """

    def __init__(self, templates, frequencies, vocabulary, agreement: float):
        self.templates = templates
        self.words = [np.array([vocabulary[w.encode()] for w in t.words], np.int32) for t in templates]
        self.keys = [((0, len(t.words)),) if t.exact or not t.keys else tuple(sorted(t.keys)) for t in templates]
        self.edits = [0 if t.exact else len(t.words) - int(np.ceil(agreement * len(t.words))) for t in templates]
        self.postings: list[dict[int, int]] = []
        for t, words, edits in zip(templates, self.words, self.edits):
            by_rarity = sorted(range(len(words)), key=lambda p, t=t: (frequencies[t.words[p]], p))
            self.postings.append({p: int(words[p]) for p in (by_rarity if t.exact else by_rarity[: edits + 2])})
        self.rare = np.unique([w for of in self.postings for w in of.values()])
        self.distance = lru_cache(1 << 16)(self._distance)

    def starts(self, i: int, places: dict[int, np.ndarray], n: int) -> np.ndarray:
        """Places where the template would start, on which postings of enough of its positions agree within its edits."""
        of, edits = self.postings[i], self.edits[i]
        wanted = len(of) if self.templates[i].exact else min(2, len(of))
        found = [(places[w] - p) for p, w in of.items() if len(places[w])]
        if len(found) < wanted:
            return np.zeros(0, np.int64)
        shifts = np.arange(-edits, edits + 1)
        agreed, votes = np.unique(np.concatenate([np.unique(at[:, None] + shifts) for at in found]), return_counts=True)
        return agreed[votes >= wanted]

    def places(self, numbers: np.ndarray, ends: np.ndarray, owner: np.ndarray):
        """(template, text, first word, end, agreeing share) of every place in the texts whose words are `numbers`."""
        at = np.flatnonzero(np.isin(numbers, self.rare))
        order = np.argsort(numbers[at], kind="stable")
        held = np.searchsorted(numbers[at][order], [self.rare, self.rare + 1])
        places = {int(w): at[order[a:b]] for w, a, b in zip(self.rare, *held)}
        for i, words in enumerate(self.words):
            begin, end = self.keys[i][0]
            first = self.starts(i, places, len(numbers)) + begin
            first = first[(first >= 0) & (first + end - begin <= len(numbers))]
            if not len(first):
                continue
            key = first[:, None] + np.arange(end - begin)
            first = first[(numbers[key] == words[begin:end]).all(1) & (owner[first] == owner[key[:, -1]])]
            for place in first.tolist():
                text = int(owner[place])
                low, high = int(ends[text]), int(ends[text + 1])
                low, high = max(low, place - begin - self.edits[i]), min(high, place - begin + len(words) + 2 * self.edits[i])
                edits, before, after = self.distance(i, numbers[low:place].tobytes(), numbers[place:high].tobytes())
                if edits <= self.edits[i]:
                    yield i, text, place - before, place + after, 1 - edits / len(words)

    def _distance(self, i: int, before: bytes, after: bytes) -> tuple[int, int, int]:
        """Least edits of the template around its first key phrase, and the words that it takes before and from there on.

        Every key phrase stands word by word. `before` ends where the first one starts, `after` starts with it.
        """
        words, (first, *others) = self.words[i].tolist(), self.keys[i]
        left, right = np.frombuffer(before, np.int32).tolist(), np.frombuffer(after, np.int32).tolist()
        row = edit_row(words[: first[0]][::-1], left[::-1])
        head = min(range(len(row)), key=lambda length: (row[length], length))
        reached, done = {first[1] - first[0]: row[head]}, first[1]
        for begin, end in [*others, (len(words), len(words))]:
            onward: dict[int, int] = {}
            for place, cost in reached.items():
                for length, more in enumerate(edit_row(words[done:begin], right[place:])):
                    upto = place + length + end - begin
                    if right[place + length : upto] == words[begin:end]:
                        onward[upto] = min(onward.get(upto, cost + more), cost + more)
            reached, done = onward, end
        if not reached:
            return len(words), 0, 0
        edits, tail = min((cost, upto) for upto, cost in reached.items())
        return edits, head, tail


def edit_row(words: list[int], text: list[int]) -> list[int]:
    """Edit distances of `words` to the beginnings of `text`, by their length."""
    row = list(range(len(text) + 1))
    for count, word in enumerate(words, 1):
        above, row = row, [count]
        for j, other in enumerate(text):
            row.append(min(above[j] + (word != other), above[j + 1] + 1, row[j] + 1))
    return row


def scan_licenses(
    docs: DataFrame, frequencies: dict[str, int], key: str = "doc_id", text: str = "text",
    base=BASE, notices=NOTICES, agreement: float = AGREEMENT, spans: bool = True,
) -> DataFrame:
    """One row per row of docs: key, n_words, n_base, first_word, last_word, base_labels, labels, score and, if wanted, spans.

    Words are runs of digits, a-z (after lower-casing A-Z) and non-ASCII characters. n_base counts all places of base
    phrases; first_word and last_word are their smallest and largest start, null without one. labels adds those of notices.
    score is the largest share 1 - edits / words of any template found, else 0. spans lists (label, start, end) of all places.
    A null text is an empty one: no words, empty labels. Repeated rows give repeated results.
    """
    templates = tuple(base) + tuple(notices)
    kind = docs.schema[key].dataType.simpleString()
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    names = [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", *["spans"] * spans]

    def scan(batches):
        words = Words(templates)
        index = Index(templates, frequencies, words.vocabulary, agreement)
        for batch in batches:
            n = batch.num_rows
            sizes, hits = np.zeros(n, np.int64), [[] for _ in range(n)]
            for first, data, borders in T.runs(batch.column("t")):
                numbers, ends = words.of(data, borders)
                sizes[first : first + len(ends) - 1] = np.diff(ends)
                owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                for i, home, start, end, share in index.places(numbers, ends, owner):
                    hits[first + home].append((start - int(ends[home]), i, share, end - int(ends[home])))
            for h in hits:
                h.sort()
            plain = [[(h[0], h[1]) for h in own if h[1] < len(base)] for own in hits]
            name = lambda found: ",".join(sorted({templates[i].label for i in found}))
            columns = [
                batch.column(key), pa.array(sizes), pa.array([len(p) for p in plain], pa.int64()),
                pa.array([p[0][0] if p else None for p in plain], pa.int64()),
                pa.array([p[-1][0] if p else None for p in plain], pa.int64()),
                pa.array([name(i for _, i in p) for p in plain]), pa.array([name(h[1] for h in own) for own in hits]),
                pa.array([max((h[2] for h in own), default=0.0) for own in hits], pa.float64()),
            ]
            if spans:
                listed = [[{"label": templates[h[1]].label, "start": h[0], "end": h[3]} for h in own] for own in hits]
                columns.append(pa.array(listed, pa.list_(span)))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = (
        f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
        + (", spans array<struct<label string, start bigint, end bigint>>" if spans else "")
    )
    return docs.select(F.col(key), F.col(text).alias("t")).mapInArrow(scan, schema)
