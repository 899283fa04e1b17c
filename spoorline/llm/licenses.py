"""License scans by a positional rare-token index, in DataFrame functions only (operator 8)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch

#: Fixed value: words before lower-casing; A-Z belong to them as a-z do.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    """A sentence of a licence, the licence's label, and the key phrase that has to stand in a file."""

    label: str
    text: str
    phrase: str
    base: bool = False

    @cached_property
    def words(self) -> list[str]:
        return re.findall("[a-z0-9]+", self.text.lower())

    @cached_property
    def key(self) -> list[str]:
        return re.findall("[a-z0-9]+", self.phrase.lower())

    @cached_property
    def offset(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key)


# The base phrases and labels.
BASE = (
    Template("mit", "released under the mit license", "under the mit license", base=True),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2", base=True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", base=True),
)
# Fixed values: (label, key phrase, sentence) of public licence texts.
_SENTENCES = (
    ("mit", "permission is hereby granted free of charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "permission notice shall be included in all copies or substantial portions of the software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "you may not use this file except in compliance with the license", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2", "distributed under the license is distributed on an as is basis", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "redistribution and use in source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "used to endorse or promote products derived from this software", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl-2", "gnu general public license version 2", "licensed under the GNU General Public License version 2"),
    ("gpl-2", "either version 2 of the license or at your option any later version", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3", "gnu general public license version 3", "licensed under the GNU General Public License version 3"),
    ("gpl-3", "either version 3 of the license or at your option any later version", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "you should have received a copy of the gnu general public license", "You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl", "gnu lesser general public license", "licensed under the GNU Lesser General Public License"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    ("agpl", "gnu affero general public license", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2", "mozilla public license version 2", "subject to the terms of the Mozilla Public License version 2.0"),
    ("mpl-2", "mozilla public license v 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2", "if a copy of the mpl was not distributed with this file", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "free and unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "in no event will the authors be held liable for any damages", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "altered source versions must be plainly marked as such", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("boost-1", "boost software license version 1 0", "Distributed under the Boost Software License, Version 1.0."),
    ("epl-2", "eclipse public license 2 0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("epl-1", "eclipse public license v1 0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("cc-by", "cc by 4 0", "licensed under CC BY 4.0"),
    ("cc-by", "creative commons attribution 4 0 international license", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "cc by sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd", "cc by nd", "licensed under CC BY-ND 4.0"),
    ("cc0-1", "cc0 1 0 universal", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal"),
    ("artistic-2", "the artistic license 2 0", "you can redistribute it and/or modify it under the terms of the Artistic License 2.0"),
    ("wtfpl", "do what the fuck you want to public license", "licensed under the Do What The Fuck You Want To Public License"),
    ("psf-2", "psf license agreement for python", "PSF LICENSE AGREEMENT FOR PYTHON"),
    ("cddl-1", "common development and distribution license", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("ofl-1", "sil open font license version 1 1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
)
TEMPLATES = BASE + tuple(Template(label, text, phrase) for label, phrase, text in _SENTENCES)


def _lowered(text: Column) -> Column:
    """A-Z in lower case. lower() does the same for words of ASCII letters, but for two characters that it maps into them."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    odd = text.contains("\u0130") | text.contains("\u212a")
    return F.when(odd, F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def licence_words(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[DataFrame, list[str]]:
    """(doc_id, codes) of every row, and the words of the templates; a code is a word's place in these from 1, else 0."""
    known = sorted({w for t in templates for w in t.words})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all(_lowered(text), F.lit(WORD), F.lit(0))
    listed = F.array(*map(F.lit, known))
    codes = F.transform(words, lambda w: F.when(w.isin(*known), F.array_position(listed, w).cast("short")).otherwise(F.lit(0).cast("short")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), codes.alias("codes")), known


def word_rarity(coded: DataFrame, known: list[str]) -> dict[str, float]:
    """IDF of every template word over all documents: log((n + 1) / (df + 1)). One row per template word reaches the driver."""
    listed = coded.select(F.explode(F.array_distinct(F.filter("codes", lambda c: c > 0))).alias("c"))
    df = {known[r.c - 1]: r.n for r in listed.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = coded.count()
    return {w: math.log((total + 1) / (df.get(w, 0) + 1)) for w in known}


def license_hits(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, hits) of every row of ``docs`` (doc_id, text); a hit: start, label, base, share.

    Texts are split once; each word that stands in a template is written as its number, every other as 0. IDF counts
    all documents. A template's key phrase is posted under its word of the highest IDF, with the relative positions of its
    words, rarest first. A file looks up its own licence words, those of the highest IDF first: their postings, not the
    number of templates, are what it costs. Where the file also holds the next rarer word, the places of the rarest give
    starts, which are intersected with the places of each next rarer word at its relative position, until the whole phrase
    is verified. ``share`` is the part of the
    sentence's words that stand at their relative positions. Every place of a phrase holds all its words, so none is
    missed, and sentences of a licence may stand in any order.

    Null counts as empty: no words, no hits. Repeated rows give repeated results; other columns are ignored; an
    empty table gives an empty result. Time grows with a text's words, and with its hits by a sentence's length.
    """
    coded, known = licence_words(docs, templates)
    coded = Scratch(docs.sparkSession).write(coded)
    idf = word_rarity(coded, known)
    code = {w: i + 1 for i, w in enumerate(known)}
    rare_first = sorted(known, key=lambda w: (-idf[w], w))
    rank = {w: i for i, w in enumerate(rare_first)}

    def short(values: list[int]) -> str:
        return "array(" + ", ".join(f"{v}S" for v in values) + ")"

    def posting(t: Template) -> str:
        posts = sorted(enumerate(t.key), key=lambda p: (rank[p[1]], p[0]))
        listed = "array(" + ", ".join(f"named_struct('c', {code[w]}S, 'k', {k})" for k, w in posts) + ")"
        return f"named_struct('p', {listed}, 'label', '{t.label}', 'base', {str(t.base).lower()}, 'text', {short([code[w] for w in t.words])}, 'off', {t.offset})"

    by_lead: dict[int, list[str]] = {}
    for t in templates:
        by_lead.setdefault(code[min(t.key, key=rank.__getitem__)], []).append(posting(t))
    kind = "array<struct<p: array<struct<c: smallint, k: int>>, label: string, base: boolean, text: array<smallint>, off: int>>"
    postings = "array(" + ", ".join(f"cast(array({', '.join(by_lead.get(c, []))}) as {kind})" for c in range(len(known) + 1)) + ")"
    leads = short(sorted(by_lead))
    found = f"""
        flatten(transform(
            array(struct(
                array_intersect({short([code[w] for w in rare_first])}, codes) as own,
                filter(transform(codes, (c, i) -> struct(c, i)), s -> s.c > 0S) as at)),
            f -> flatten(transform(
                filter(flatten(transform(f.own, c -> get({postings}, cast(c as int)))), t -> array_contains(f.own, t.p[least(1, size(t.p) - 1)].c)),
                t -> transform(
                    aggregate(
                        slice(t.p, 2, size(t.p)),
                        transform(filter(f.at, s -> s.c = t.p[0].c), s -> s.i - t.p[0].k),
                        (starts, p) -> filter(starts, s -> get(codes, s + p.k) = p.c)),
                    s -> struct(
                        s as start, t.label as label, t.base as base,
                        size(filter(transform(t.text, (c, k) -> get(codes, s - t.off + k) = c), x -> x)) / cast(size(t.text) as double) as share))))))"""
    none = "cast(array() as array<struct<start: int, label: string, base: boolean, share: double>>)"
    return coded.select("doc_id", F.size("codes").cast("long").alias("n_words"), F.expr(f"case when arrays_overlap(codes, {leads}) then {found} else {none} end").alias("hits"))
