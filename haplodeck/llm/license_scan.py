"""License scan: every shingle looked up among the templates', verified by containment.

Words are compared in lower case without ASCII punctuation; shingles are runs of five. All shingles of a
text are looked up among those of the templates, so every text that holds CONTAINED of a template's
shingles is found, however they are spread. Hits on near diagonals (place in the text less place in the
template) are one stretch; a stretch that holds CONTAINED of the template is a place where it stands. The
other stretches of a text and template are joined in text order until they hold as much together, so a
notice interrupted by other words is one place.

Of overlapping places of different licences the one of highest containment stays (of equals, that of the
longer template): a notice of version 2 is not one of version 3 as well. SPDX-License-Identifier lines
count by the ids they name, and do not compete.

Templates go to every task in blocks of at most BLOCK_WORDS words; more templates take more passes over
the texts. No texts are shuffled, only the places found.

Null text is empty: nothing is found. A template must have five words. Templates of one licence that
share text are each found. Repeated rows each get their rows; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplodeck.llm.arrow_text import PUNCTUATION, chunks, grams, words
from haplodeck.llm.tables import written

SHINGLE = 5
BANDS, ROWS = 6, 2
CONTAINED = 0.8
BLOCK_WORDS = 200_000
MARGIN = 8
_BITS = 22

# Wording of public licence notices.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT License text follows",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}

_GNU = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} General Public "
    "License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any "
    "later version.",
    "Licensed under the GNU {1} General Public License, version {2}.")
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution.")


def _gnu(work: str, kind: str, version: str) -> list[str]:
    return [t.format(work, kind, version) for t in _GNU]


# Looked for besides TEMPLATES: other licences, and versions whose wording is close to one of those.
MORE_TEMPLATES = {
    "GPL-1.0": _gnu("program", "", "1"),
    "GPL-2.0": _gnu("program", "", "2"),
    "GPL-3.0": _gnu("program", "", "3")[1:],
    "LGPL-2.1": _gnu("library", "Lesser", "2.1"),
    "LGPL-3.0": _gnu("library", "Lesser", "3"),
    "AGPL-3.0": _gnu("program", "Affero", "3"),
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-2-Clause": [_BSD_2],
    "BSD-3-Clause": [
        _BSD_2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."],
    "BSD": [
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied "
        "warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular "
        "purpose are disclaimed."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."],
}
TAG = "SPDX-License-Identifier"
_TAG_LINE = re.compile(TAG.lower().encode() + rb":[ \t]*([^\r\n]*)")
_TAG_ID = re.compile(r"[A-Za-z0-9.+-]+")
#: Ids as the templates write them; the lines may use any case.
_KNOWN = {name.lower(): name for name in (*TEMPLATES, *MORE_TEMPLATES)}


def collision_probability(similarity: float) -> float:
    return 1 - (1 - similarity ** ROWS) ** BANDS


def _shingles(text: str) -> np.ndarray:
    for _, _, data, offsets in chunks(pa.array([text]), max(len(text.encode()), 1)):
        return grams(words(data, offsets, apart=PUNCTUATION), SHINGLE)[0]
    return np.zeros(0, np.uint64)


def _template_index(templates: list[np.ndarray]):
    """Sorted shingles of all templates, with the template and place they stand for."""
    key = np.concatenate(templates)
    item = np.repeat(np.arange(len(templates)), [len(t) for t in templates])
    place = np.concatenate([np.arange(len(t)) for t in templates])
    order = np.argsort(key, kind="stable")
    return key[order], item[order], place[order]


def _meetings(hashes: np.ndarray, index, bits: np.ndarray):
    """(shingle of the text, template, place in it) of all shingles that a template has."""
    known, item, place = index
    near = np.flatnonzero(bits[hashes >> np.uint64(64 - _BITS)])
    a = np.searchsorted(known, hashes[near], "left")
    many = np.searchsorted(known, hashes[near], "right") - a
    flat = np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(near, many), item[flat], place[flat]


def _places(hashes: np.ndarray, wanted: np.ndarray, n: int, at: np.ndarray, begin: np.ndarray, bounds: tuple[int, int]):
    """(share, first, last shingle) of every place of one template in one text. `at` are the hits, `begin`
    the template's start on their diagonals, in order of `begin`."""
    fresh = np.ones(len(at), bool)
    # an edit puts the rest of a copy a little off: near diagonals are one stretch
    fresh[1:] = begin[1:] > begin[:-1] + n // 4 + 2
    first = np.flatnonzero(fresh)
    whole, rest = [], []
    for i, j in zip(first, [*first[1:], len(at)], strict=True):
        low, high = max(int(begin[i]) - MARGIN, bounds[0]), min(int(begin[j - 1]) + n + MARGIN, bounds[1])
        a, b = int(at[i:j].min()), int(at[i:j].max())
        share = float(np.isin(wanted, hashes[low:high]).mean())
        if share >= CONTAINED:
            whole.append((-share, i - j, a, b))
        else:
            rest.append((a, b, np.unique(hashes[at[i:j]])))
    out, starts, ends = [], [], []

    def taken(a: int, b: int) -> int | None:
        """Where a span goes among the places, none if it overlaps one."""
        k = bisect.bisect_right(starts, b)
        return None if k and ends[k - 1] >= a else k

    # a shingle that the template repeats also lies on other diagonals: the fullest stretch goes first
    for share, _, a, b in sorted(whole):
        k = taken(a, b)
        if k is not None:
            starts.insert(k, a)
            ends.insert(k, b)
            out.append((-share, a, b))
    held, span = np.zeros(0, np.uint64), None
    for a, b, own in sorted(rest, key=lambda x: x[:2]):
        if taken(a, b) is None:
            continue
        more = np.union1d(held, own)
        if span and len(more) == len(held) and len(held) >= CONTAINED * len(wanted):
            out.append((len(held) / len(wanted), *span))
            more, span = own, None
        held, span = more, (a, b) if span is None else (span[0], max(b, span[1]))
    if span and len(held) >= CONTAINED * len(wanted):
        out.append((len(held) / len(wanted), *span))
    return out


def _tags(data: np.ndarray, offsets: np.ndarray, w) -> Iterator[tuple[int, str, int]]:
    """(text, id, word) of every licence that an SPDX line names."""
    for m in _TAG_LINE.finditer(w.data.tobytes()):
        doc = int(np.searchsorted(offsets, m.start(), "right")) - 1
        line = data[m.start(1):min(m.end(1), int(offsets[doc + 1]))].tobytes().decode("utf-8", "replace")
        word = int(np.searchsorted(w.starts, m.start()) - w.first[doc])
        before = ""
        for name in _TAG_ID.findall(line.split("*/")[0].split("-->")[0]):
            if before == "WITH" or name in ("AND", "OR", "WITH"):
                before = name
            elif before in ("", "AND", "OR"):  # words behind an expression are none of it
                before = name
                yield doc, _KNOWN.get(name.lower(), name), word
            else:
                break


def _scan(docs: DataFrame, key: str, text: str, block: list[tuple[str, str]], tags: bool) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(block)
    names = [key, "_text", "license_id", "template", "containment", "first_word", "_last", "_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        templates = [_shingles(t) for _, t in own]
        sets = [np.unique(t) for t in templates]
        index = _template_index(templates)
        bits = np.zeros(1 << _BITS, bool)
        bits[index[0] >> np.uint64(64 - _BITS)] = True
        for batch in batches:
            rows = []
            for base, _, data, offsets in chunks(batch.column(1)):
                w = words(data, offsets, apart=PUNCTUATION)
                if tags:
                    rows += [(base + d, name, TAG, 1.0, at, at, 0) for d, name, at in _tags(data, offsets, w)]
                hashes, place = grams(w, SHINGLE)
                bounds = np.searchsorted(place, w.first)
                at, item, inside = _meetings(hashes, index, bits)
                if not len(at):
                    continue
                doc = np.searchsorted(bounds, at, "right") - 1
                begin = at - inside
                order = np.lexsort((at, begin, item, doc))
                at, doc, item, begin = at[order], doc[order], item[order], begin[order]
                first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
                for i, j in zip(first, [*first[1:], len(doc)], strict=True):
                    d, t = int(doc[i]), int(item[i])
                    if j - i < CONTAINED * len(sets[t]) or len(
                            np.unique(hashes[at[i:j]])) < CONTAINED * len(sets[t]):
                        continue
                    ends = int(bounds[d]), int(bounds[d + 1])
                    for share, a, b in _places(hashes, sets[t], len(templates[t]), at[i:j], begin[i:j], ends):
                        rows.append((base + d, *own[t], share, a - ends[0], b - ends[0] + SHINGLE - 1, len(templates[t])))
            if rows:
                doc, *columns = zip(*rows, strict=True)
                doc = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(doc), batch.column(2).take(doc),
                     *[pa.array(c, k) for c, k in zip(columns, (
                         pa.string(), pa.string(), pa.float64(), *[pa.int64()] * 3), strict=True)]], names)

    return docs.select(F.col(key), F.col(text), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text")).mapInArrow(
        run, f"{key} {kind}, _text long, license_id string, template string, containment double, "
             "first_word long, _last long, _n long")


def _one_licence(found: DataFrame, key: str) -> DataFrame:
    """Without places that overlap a better one of another licence: the best of all stays, then the best
    of those that do not overlap it, and so on, within each run of overlapping places."""
    per_text = Window.partitionBy(key, "_text").orderBy("first_word", "_last", "license_id", "template")
    reach = F.max("_last").over(per_text.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("_new", F.coalesce((F.col("first_word") > reach).cast("int"), F.lit(1))).withColumn(
        "_run", F.sum("_new").over(per_text.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("containment", "_n", "first_word", "_last", "license_id", "template")

    def better(kept: Column, x: Column) -> Column:
        beaten = F.exists(kept, lambda k: (k["license_id"] != x["license_id"]) & (
            k["first_word"] <= x["_last"]) & (x["first_word"] <= k["_last"]))
        return F.when(beaten, kept).otherwise(F.concat(kept, F.array(x)))

    grouped = runs.groupBy(key, "_text", "_run").agg(F.sort_array(F.collect_list(place), asc=False).alias("_all"))
    return grouped.select(key, F.explode(F.aggregate(
        "_all", F.slice("_all", F.lit(1), F.lit(0)), better)).alias("_p")).select(
            key, *[f"_p.{c}" for c in ("license_id", "template", "containment", "first_word")])


def notices(docs: DataFrame, templates: dict[str, list[str]] | None = None, key: str = "doc_id",
            text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """key, license_id, template, containment, first_word: one row per place where a template stands.
    Without `templates` those of this module and the SPDX lines are looked for."""
    blocks, size, tags = [[]], 0, not templates
    for own in ([templates] if templates else [TEMPLATES, MORE_TEMPLATES]):
        for name, t in ((name, t) for name, texts in own.items() for t in texts):
            n = len(_shingles(t))
            if not n:
                raise ValueError(f"a template of {name} has less than {SHINGLE} words")
            if size + n > block_words and blocks[-1]:
                blocks.append([])
                size = 0
            blocks[-1].append((name, t))
            size += n
    out = None
    for i, block in enumerate(blocks):
        found = _scan(docs, key, text, block, tags and i == 0)
        out = found if out is None else out.unionByName(found)
    out = written(out, "notices")
    tagged = F.col("template") == TAG
    places = _one_licence(out.where(~tagged), key)
    return places.unionByName(out.where(tagged).select(places.columns))


def licenses(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """key, license_id, n_found, containment (best), first_word (of the first place)."""
    return notices(docs, key=key, **options).groupBy(key, "license_id").agg(
        F.count("*").alias("n_found"), F.max("containment").alias("containment"),
        F.min("first_word").alias("first_word"))
