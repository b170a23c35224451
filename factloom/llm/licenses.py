"""Licence scans with a positional index over rare words.

Licence templates are word sequences, from single phrases to whole licence texts; each word's inverse document frequency is measured over all documents.
The index has positional postings (word, template, place) of each template's rarest words: from the highest IDF on, as many as an alignment with `MIN_SHARE` of the
template's weight can't miss altogether. A file's words are looked up from the highest IDF on; each of their places gives, with each posting, an alignment
(place in the file minus place in the template), and the weights of the postings that agree on one are added up. Alignments that have enough of the indexed weight are
intersected with the file's places of all of the template's words; a template counts from `MIN_SHARE` on if, last, its mandatory key
phrase stands there word for word. The index is small and fixed in size: it holds the templates, not the corpus.

Defined results: a null or empty text has no words and no labels; a template's best alignment counts; of words with the same IDF the
first in the template is indexed; repeated rows give the same result; an empty table gives
an empty result; extra columns are kept by `scan`, except those named as its outputs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Base phrases and their labels. Fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Templates beyond these: label, words, mandatory key phrase. The wording of public licences.
TEMPLATES = [
    ("gpl-3.0", "gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "permission to use copy modify and or distribute"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "to deal in the software without restriction"),
    ("bsd-2-clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "to endorse or promote products derived from this software"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "you may not use this file except in compliance with the license"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "free software you can redistribute it and or modify it under the terms of the gnu"),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software", "for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "to alter it and redistribute it freely"),
    ("boost-1.0", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost software license"),
    ("mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file"),
    ("unlicense-notice", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("mit-full", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "shall be included in all copies or substantial portions of the software"),
    ("isc-full", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "the author disclaims all warranties with regard to this software"),
    ("bsd-3-full", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "endorse or promote products derived from this software"),
]
#: A template counts if this share of its words, by IDF, stands at the proposed relative position.
MIN_SHARE = 0.6
#: Rounding of sums of weights that are compared in different orders.
SLACK = 1e-9

#: A-Z becomes a-z, other ASCII that isn't a digit or letter becomes a blank, bytes above stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


@dataclass
class Entry:
    label: str
    words: list[bytes]
    key: int  # where the mandatory phrase begins in words
    key_len: int
    base: bool
    weights: list[float] = field(default_factory=list)
    total: float = 0.0
    rare: list[int] = field(default_factory=list)  # places whose words are indexed
    least: float = 0.0  # weight of indexed places that an alignment with enough words has


def entries() -> list[Entry]:
    found = [Entry(label, p.encode().split(), 0, len(p.split()), True) for p, label in PHRASES.items()]
    for label, text, phrase in TEMPLATES:
        words, need = text.encode().split(), phrase.encode().split()
        found.append(Entry(label, words, next(i for i in range(len(words)) if words[i : i + len(need)] == need), len(need), False))
    return found


@dataclass
class Index:
    entries: list[Entry]
    idf: dict[bytes, float]
    postings: dict[bytes, list[tuple[int, int]]]  # word: templates and the places in them


def vocabulary() -> set[bytes]:
    return {w for e in entries() for w in e.words}


def document_frequency(df: DataFrame, text: str = "text") -> tuple[int, dict[bytes, int]]:
    """The number of documents, and of those with each licence word; one row a task for each word."""

    def run(batches):
        vocab, n, total = vocabulary(), 0, {}
        for part in shared.chunks(batches, "text"):
            for t in part.column("text").to_pylist():
                n += 1
                for w in vocab.intersection(words_of(t)):
                    total[w] = total.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(["", *(w.decode() for w in total)], pa.string()), pa.array([n, *total.values()], pa.int64())], names=["word", "n"])

    rows = df.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}  # no more rows than licence words
    return found.pop(b"", 0), found


def index(n: int, frequency: dict[bytes, int]) -> Index:
    """Postings of each template's words from the highest IDF on, until no alignment that misses all of them can have MIN_SHARE of the
    weight; of a base phrase, which is wanted whole, the one rarest word."""
    idf = {w: math.log((n + 1) / (frequency.get(w, 0) + 1)) + 1 for w in vocabulary()}
    found, postings = entries(), {}
    for i, e in enumerate(found):
        e.weights = [idf[w] for w in e.words]
        e.total = sum(e.weights)
        spare, got = (0.0 if e.base else (1 - MIN_SHARE) * e.total), 0.0
        for k in sorted(range(len(e.words)), key=lambda k: (-e.weights[k], k)):
            e.rare.append(k)
            got += e.weights[k]
            postings.setdefault(e.words[k], []).append((i, k))
            if got > spare + SLACK:
                break
        e.least = got if e.base else got - spare
    return Index(found, idf, postings)


def scan_words(words: list[bytes], found: Index) -> tuple[list[tuple[int, str]], dict[str, float]]:
    """Places of base phrases (start, label), and the share of each further label's best template."""
    base, more = [], {}
    rare = found.postings.keys() & set(words)
    if not rare:
        return base, more
    places: dict[bytes, list[int]] = {}  # the file's postings: where each licence word stands
    for i, w in enumerate(words):
        if w in found.idf:
            places.setdefault(w, []).append(i)
    met: dict[tuple[int, int], float] = {}  # weight of the indexed words by template and alignment
    for w in sorted(rare, key=lambda w: (-found.idf[w], w)):
        for i, k in found.postings[w]:
            for at in places[w]:
                met[i, at - k] = met.get((i, at - k), 0.0) + found.idf[w]
    sets = {w: set(p) for w, p in places.items()}
    for (i, s), weight in met.items():
        e = found.entries[i]
        if weight < e.least - SLACK:
            continue
        if not e.base:
            share = sum(w for k, w in enumerate(e.weights) if s + k in sets.get(e.words[k], ())) / e.total
            if share < MIN_SHARE:
                continue
        if any(s + k not in sets.get(e.words[k], ()) for k in range(e.key, e.key + e.key_len)):
            continue  # the mandatory phrase isn't there word for word
        if e.base:
            base.append((s, e.label))
        else:
            more[e.label] = max(share, more.get(e.label, 0.0))
    return sorted(base), more


def scan(df: DataFrame, found: Index, text: str = "text") -> DataFrame:
    """df without `text`, with the words counted, the places of base phrases, labels and a score."""
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    keep = [c for c in df.columns if c not in (text, *made)]
    body = shared.fresh(df, "__text")

    def run(batches):
        for part in shared.chunks(batches, body):
            rows = []
            for t in part.column(body).to_pylist():
                words = words_of(t)
                base, more = scan_words(words, found)
                labels = {x for _, x in base}
                score = max([1.0] * bool(base) + list(more.values()), default=0.0)
                rows.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | more.keys())), round(min(score, 1.0), 6)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types))], names=[*keep, *made])

    return shared.in_arrow(df.select(*shared.columns(keep), *(c.alias(body) for c in shared.columns([text]))), run, f"{shared.ddl(df, keep)}n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select("doc_id", "text")
    return scan(docs, index(*document_frequency(docs)))


def oracle() -> str:
    """The same in DuckDB: every place of a licence word joined with every template that has it, by relative position."""
    rows = ", ".join(f"({i}, '{e.label}', {e.base}, {e.key}, {e.key_len}, '{b' '.join(e.words).decode()}')" for i, e in enumerate(entries()))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), entry(e, label, base, key, key_len, words) AS (VALUES {rows}
), part AS (
  SELECT e, unnest(string_split(words, ' ')) AS word, generate_subscripts(string_split(words, ' '), 1) - 1 AS k FROM entry
), token AS (
  SELECT r, i, word FROM (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d) WHERE word IN (SELECT word FROM part)
), idf AS (
  SELECT p.word, ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT t.r) + 1)) + 1 AS w FROM (SELECT DISTINCT word FROM part) p LEFT JOIN token t USING (word) GROUP BY p.word
), weight AS (
  SELECT e, k, word, w FROM part JOIN idf USING (word)
), total AS (
  SELECT e, sum(w) AS w FROM weight GROUP BY e
), aligned AS (
  SELECT t.r, y.e, t.i - y.k AS s, sum(y.w) AS w, count(*) FILTER (y.k >= x.key AND y.k < x.key + x.key_len) AS hit
  FROM token t JOIN weight y USING (word) JOIN entry x USING (e) GROUP BY t.r, y.e, t.i - y.k
), found AS (
  SELECT a.r, x.label, x.base, a.s, a.w / t.w AS share FROM aligned a JOIN entry x USING (e) JOIN total t USING (e) WHERE a.hit = x.key_len AND (x.base OR a.w / t.w >= {MIN_SHARE})
), by_row AS (
  SELECT r, count(*) FILTER (base) AS n, min(s) FILTER (base) AS lo, max(s) FILTER (base) AS hi, max(CASE WHEN base THEN 1 ELSE share END) AS score,
         coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM found GROUP BY r
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, round(least(coalesce(score, 0), 1), 6)::DOUBLE AS score
FROM d LEFT JOIN by_row USING (r)
"""
