"""Licence scan by a positional index of rare words.

Templates are indexed by word and position. A file is looked up by the licence words that are rarest in the
corpus (document frequencies are counted over all files), template postings are intersected with the file's
postings by relative position, and a template counts only where its mandatory key phrases stand.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are all reported, and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices of common licences, each with phrases that must stand in a copy.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["hereby granted free of charge", "deal in the software without restriction"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["licensed under the apache license version 2"]),
    ("apache-2", "licensed under the apache license version 2", ["licensed under the apache license version 2"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["redistribute it and or modify it under the terms of the gnu general public license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["terms of the mozilla public license v 2"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "permitted provided that the following conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("cc0", "licensed under cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license", ["creative commons attribution sharealike"]),
    ("cc-by-sa", "licensed under cc by sa", ["licensed under cc by sa"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license", ["creative commons attribution noncommercial"]),
    ("mit", "spdx license identifier mit", ["spdx license identifier mit"]),
    ("apache-2", "spdx license identifier apache 2 0", ["spdx license identifier apache 2"]),
    ("gpl-3", "spdx license identifier gpl 3 0", ["spdx license identifier gpl 3"]),
    ("gpl-2", "spdx license identifier gpl 2 0", ["spdx license identifier gpl 2"]),
]
#: Bytes of words: digits, a to z (A to Z are lower-cased) and all that isn't ASCII; others become spaces.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[int, tuple[bytes, ...]], ...]  # position in the template, words
    base: bool = False


def _templates(base: dict[str, str], notices: list) -> list[Template]:
    out = []
    for label, text, keys in [(label, phrase, [phrase]) for phrase, label in base.items()] + notices:
        words = tuple(text.encode().split())
        at = []
        for k in keys:
            key = tuple(k.encode().split())
            at.append((next(i for i in range(len(words)) if words[i : i + len(key)] == key), key))
        out.append(Template(label, words, tuple(at), text in base and keys == [text]))
    return out


TEMPLATES = _templates(BASE_PHRASES, NOTICES)


class Index:
    """Templates by their rarest key word, and the scan of one file's words."""

    def __init__(self, templates: list[Template], idf: dict[bytes, float], slack: int = 8, least: float = 0.6):
        self.slack, self.least = slack, least
        self.vocabulary = frozenset(w for t in templates for w in t.words)
        self.by_anchor: dict[bytes, list[tuple[Template, int]]] = defaultdict(list)  # word -> template, position
        for t in templates:
            anchor = max(sorted({w for _, key in t.keys for w in key}), key=lambda w: idf.get(w, math.inf))
            # One position is enough: every copy of the template has this key phrase.
            place = next(at + key.index(anchor) for at, key in t.keys if anchor in key)
            self.by_anchor[anchor].append((t, place))
        self.idf = idf

    def postings(self, words: list[bytes]) -> dict[bytes, list[int]]:
        found: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.vocabulary:
                found.setdefault(w, []).append(i)
        return found

    def _stands(self, sets: dict[bytes, set[int]], key: tuple[bytes, ...], start: int, slack: int) -> bool:
        for s in sorted(range(-slack, slack + 1), key=abs):
            if all(start + s + i in sets.get(w, ()) for i, w in enumerate(key)):
                return True
        return False

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Places of base phrases (start, label), and the best coverage of each label."""
        postings = self.postings(words)
        places, best = [], {}
        rare = sorted((w for w in postings if w in self.by_anchor), key=lambda w: -self.idf.get(w, math.inf))
        if not rare:
            return places, best
        sets = {w: set(p) for w, p in postings.items()}
        for w in rare:
            for t, place in self.by_anchor[w]:
                for p in postings[w]:
                    start = p - place
                    if t.base:
                        if all(start + i in sets.get(x, ()) for i, x in enumerate(t.words)):
                            places.append((start, t.label))
                            best[t.label] = 1.0
                        continue
                    (at, key), *_ = [k for k in t.keys if w in k[1]]
                    if not self._stands(sets, key, start + at, 0) or not all(self._stands(sets, k, start + q, self.slack) for q, k in t.keys if k != key):
                        continue
                    near = sum(any(start + i + s in sets.get(x, ()) for s in range(-self.slack, self.slack + 1)) for i, x in enumerate(t.words))
                    if near >= self.least * len(t.words):
                        best[t.label] = max(best.get(t.label, 0.0), near / len(t.words))
        return places, best


def document_frequencies(docs: DataFrame, text_col: str = "text", templates: list[Template] = TEMPLATES) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those with each licence word: at most one row per template word reaches the driver."""
    vocabulary = frozenset(w for t in templates for w in t.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, int] = defaultdict(int)
        for b in batches:
            for text in b.column(0).to_pylist():
                n[b""] += 1
                for w in vocabulary.intersection(words_of(text)):
                    n[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r["word"].encode(): r["n"] for r in rows}
    return df.pop(b"", 0), df


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] = TEMPLATES, slack: int = 8, least: float = 0.6) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A label is given where all key phrases of one of its templates stand, within ``slack`` words of their
    place, and at least the share ``least`` of the template's words does; score is the largest such share,
    1 for a base phrase, 0 for none. Null texts are empty: no words, no labels, null places. Ids pass
    through, null or repeated; other columns aren't read; an empty table gives an empty result.
    """
    n, df = document_frequencies(docs, text_col, templates)
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) for t in templates for w in t.words}
    index = Index(templates, idf, slack, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                places, best = index.scan(words)
                starts = [s for s, _ in places]
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(best)), max(best.values(), default=0.0)))
            cols = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
