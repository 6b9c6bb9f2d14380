"""License scans: an exact set-similarity join of license templates with text blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

# Phrases whose words stand consecutively, and openings of license notices.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# The bodies of short licenses and the notices of long ones, as they are published.
FULL_TEXTS = (
    (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
        "mit",
    ),
    (
        """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution.""",
        "bsd",
    ),
    (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies.""",
        "isc",
    ),
    (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http www apache org licenses LICENSE 2 0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "apache-2",
    ),
    (
        """This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of
        the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
        "gpl-3",
    ),
    (
        """This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is
        granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
        "zlib",
    ),
)
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("all rights reserved", "all-rights-reserved"),
    *(
        (" ".join(words.lower().replace(",", " ").replace(".", " ").replace(";", " ").replace(":", " ").replace("(", " ").replace(")", " ").replace('"', " ").split()), label)
        for words, label in FULL_TEXTS
    ),
)
# Words that tell a license from others; a block must hold those of them that the template has.
MARKS = {
    "mit": "mit permission hereby granted files", "apache-2": "apache 2", "gpl-3": "gnu general 3", "bsd": "redistribution redistributions binary", "isc": "permission fee", "zlib": "authors damages alter freely", "mpl-2": "mozilla 2",
    "cc-by-nc": "cc by nc", "cc-by": "creative commons attribution", "all-rights-reserved": "all rights reserved",
}


@dataclass(frozen=True)
class LicenseConfig:
    """A block contains a template when it holds ``threshold_percent`` of its distinct tokens.

    Blocks are all windows of so many consecutive words as the template has, over that share; lines don't matter.
    A block must also hold those of its label's ``marks`` that are in the template; without any, a template of fewer
    than ``whole_below`` distinct tokens must be held whole.
    """

    phrases: tuple[tuple[str, str], ...] = tuple(PHRASES.items())
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    threshold_percent: int = 80
    marks: tuple[tuple[str, str], ...] = tuple(MARKS.items())
    whole_below: int = 12


def _vocabulary(cfg: LicenseConfig) -> np.ndarray:
    """Sorted hashes of the tokens of all templates and phrases; their number is that of the templates' tokens."""
    texts = [t for t, _ in (*cfg.phrases, *cfg.templates)]
    return np.unique(np.concatenate(K.hash_words(texts, K.ALNUM)))


def _known(words: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words that are in the vocabulary, and their numbers there."""
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    here = np.flatnonzero(vocabulary[at] == words)
    return here, at[here]


def _count(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for b in K.slices(batch, "text"):
                words, _ = K.word_hashes(*K.flat(b.column("text")), K.ALNUM)
                total += np.bincount(_known(words, vocabulary)[1], minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["token", "n"])

    return run


@dataclass
class _Join:
    """Templates as sets of token ranks, rarest first, and the width of their blocks."""

    cfg: LicenseConfig
    vocabulary: np.ndarray
    rank: np.ndarray

    def __post_init__(self) -> None:
        number = lambda text: np.searchsorted(self.vocabulary, K.hash_words([text], K.ALNUM)[0])
        self.sets = [np.unique(self.rank[number(t)]) for t, _ in self.cfg.templates]
        self.marks = [np.flatnonzero(np.isin(s, self.rank[_known(K.hash_words([dict(self.cfg.marks).get(label, "")], K.ALNUM)[0], self.vocabulary)[1]])).tolist() for s, (_, label) in zip(self.sets, self.cfg.templates, strict=True)]
        share = [self.cfg.threshold_percent if m or len(s) >= self.cfg.whole_below else 100 for s, m in zip(self.sets, self.marks, strict=True)]
        self.need = [-(-len(s) * x // 100) for s, x in zip(self.sets, share, strict=True)]
        self.width = [-(-len(number(t)) * 100 // self.cfg.threshold_percent) for t, _ in self.cfg.templates]
        # A phrase is a template to be contained whole: its prefix is its rarest token.
        self.sought = [(number(p), label) for p, label in self.cfg.phrases]
        self.rarest = [int(np.argmin(self.rank[p])) for p, _ in self.sought]

    def blocks(self, t: int, here: np.ndarray, ranks: np.ndarray, row: np.ndarray, at: np.ndarray) -> list[tuple[int, float]]:
        """First word and containment of the blocks that contain a template, the best of those that overlap.

        ``here`` are the numbers of known words, with their ``ranks``; ``at`` are the first words of the rows.
        """
        members, need, width = self.sets[t], self.need[t], self.width[t]
        if not len(members):
            return []
        place = np.minimum(np.searchsorted(members, ranks), len(members) - 1)
        mine = members[place] == ranks
        word, place = here[mine], place[mine]
        if len(word) < need:
            return []
        low, high = [], []
        # A block's rarest common token is in the template's prefix, the tokens of which leave enough others after them.
        for i in range(len(members) - need + 1):
            c = word[place == i]
            if not len(c):
                continue
            lo, hi = np.maximum(c - width + 1, at[row[c]]), np.minimum(c + width, at[row[c] + 1])
            near = word[place >= i]  # positional filter: the others are not rarer
            # Length filter: fewer known words around than a block needs.
            ok = np.searchsorted(near, hi) - np.searchsorted(near, lo) >= need
            low.append(lo[ok])
            high.append(hi[ok])
        if not sum(map(len, low)):
            return []
        lo, hi = np.concatenate(low), np.concatenate(high)
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], np.maximum.accumulate(hi[order])
        head = np.flatnonzero(np.concatenate([[True], lo[1:] >= hi[:-1]]))
        begin, end = np.searchsorted(word, lo[head]), np.searchsorted(word, hi[np.concatenate([head[1:] - 1, [len(hi) - 1]])])
        return [x for a, b in zip(begin, end, strict=True) for x in self._within(t, word[a:b].tolist(), place[a:b].tolist())]

    def _within(self, t: int, word: list[int], place: list[int]) -> list[tuple[int, float]]:
        """The blocks in a stretch of one row, given by the template's tokens there."""
        need, width, size, marks = self.need[t], self.width[t], len(self.sets[t]), self.marks[t]
        out: list[list] = []
        count: dict[int, int] = {}
        r = 0
        for j, w in enumerate(word):
            while r < len(word) and word[r] < w + width:
                count[place[r]] = count.get(place[r], 0) + 1
                r += 1
            common = len(count)
            if common >= need and all(m in count for m in marks):
                seen: set[int] = set()
                k = j
                while len(seen) < common:
                    seen.add(place[k])
                    k += 1
                last = word[k - 1]
                if not out or w > out[-1][1]:
                    out.append([w, last, common])
                elif (common, w - last) > (out[-1][2], out[-1][0] - out[-1][1]):
                    out[-1] = [w, last, common]
            count[place[j]] -= 1
            if not count[place[j]]:
                del count[place[j]]
        return [(w, common / size) for w, _, common in out]

    def places(self, words: np.ndarray, row: np.ndarray, here: np.ndarray, known: np.ndarray) -> list[tuple[np.ndarray, str]]:
        """First positions of each phrase: candidates by its rarest token, then all its words in their order."""
        number = np.full(len(words), -1)
        number[here] = known
        out = []
        for (phrase, label), rare in zip(self.sought, self.rarest, strict=True):
            first = here[known == phrase[rare]] - rare
            first = first[(first >= 0) & (first + len(phrase) <= len(words))]
            if len(first):
                first = first[row[first] == row[first + len(phrase) - 1]]
            for i, w in enumerate(phrase):
                first = first[number[first + i] == w]
            out.append((first, label))
        return out


def _scan(join: _Join):
    cfg = join.cfg

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.slices(batch, "text"):
                data, offs = K.flat(b.column("text"))
                n = len(offs) - 1
                look = K.ALNUM.copy()
                look[0x41:0x5B] = True
                s, e, row = K.spans(data, offs, look)
                words = K.hash_spans(data, s, e, True, 1)
                at = np.searchsorted(s, offs)
                here, known = _known(words, join.vocabulary)
                places, low, high = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
                base: list[set[str]] = [set() for _ in range(n)]
                for first, label in join.places(words, row, here, known):
                    for p in first:
                        r = row[p]
                        i = int(p - at[r])
                        places[r] += 1
                        low[r] = i if low[r] < 0 else min(low[r], i)
                        high[r] = max(high[r], i)
                        base[r].add(label)
                ls, _, lrow = K.line_spans(data, offs)
                labels = [set(x) for x in base]
                score = np.array([1.0 if x else 0.0 for x in base])
                matches: list[list[dict]] = [[] for _ in range(n)]
                ranks = join.rank[known]
                for t, (_, label) in enumerate(cfg.templates):
                    for w, share in join.blocks(t, here, ranks, row, at):
                        r = int(row[w])
                        labels[r].add(label)
                        score[r] = max(score[r], share)
                        matches[r].append({"line": int(np.searchsorted(ls, s[w], side="right") - 1 - np.searchsorted(lrow, r)), "template": t, "containment": share})
                text = lambda sets: pa.array([",".join(sorted(x)) for x in sets], pa.string())
                absent = pa.array(low < 0)
                position = lambda x: pa.array(x.astype(np.int64), pa.int64(), mask=absent.to_numpy(zero_copy_only=False))
                yield pa.record_batch(
                    [b.column("id"), pa.array(np.diff(at), pa.int64()), pa.array(places, pa.int64()), position(low), position(high), text(base), text(labels), pa.array(score, pa.float64()), pa.array(matches, pa.list_(pa.struct([("line", pa.int32()), ("template", pa.int32()), ("containment", pa.float64())])))],
                    names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
                )

    return run


def scan_licenses(docs: DataFrame, config: LicenseConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, phrase places, labels, score and the ``matches`` of blocks with templates.

    Tokens are ordered by how often they stand in all documents, rarest first; a first pass counts the
    templates' tokens.  A block, of consecutive words across line ends, can only contain enough of a template if it
    holds a token of the template's prefix, and around it enough known tokens that are not rarer; blocks that
    pass these prefix, length and positional filters are verified on the full sets.  So every block with at least
    the threshold's share of a template's distinct tokens, and all that tell its license from others, is found; of blocks that overlap, the best is a match,
    at the line where it begins.  A phrase is joined by its rarest token over the whole
    text, lines disregarded too, and its words are then compared one after another.  ``score`` is the largest
    containment found, 1 with a phrase and 0 without anything.

    A null or empty text has no words, labels or places.  Null and repeated ids are rows like others.
    An empty table gives an empty result; other columns are ignored.
    """
    cfg = config or LicenseConfig()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    vocabulary = _vocabulary(cfg)
    counted = rows.select("text").mapInArrow(_count(vocabulary), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(len(vocabulary), np.int64)
    for token, n in counted:
        frequency[token] = n
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, frequency))] = np.arange(len(vocabulary))
    schema = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<line:int,template:int,containment:double>>"
    return rows.mapInArrow(_scan(_Join(cfg, vocabulary, rank)), schema).withColumnRenamed("id", id_col)
