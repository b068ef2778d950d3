"""Licence notices by conditional compression.

Candidate blocks are runs of words around licensing words, over line breaks and
paragraphs: a block ends where more words follow without a licensing word than
in any template.  Each is compressed alone and with every template as a raw
zstandard dictionary; the templates are ranked by how much smaller that makes
the block.  In this order they are confirmed by aligning words: a template wins
when its marking words (name and version) are all there, the phrases that tell
licences apart (``TELLING``) are there just if it has them, no negation stands before
or within, and the words missing and added within its span are at most
``TOLERANCE`` of it.  What the winner covers is cut out, and the rest of the block is
ranked again, so a block can hold several notices.  ``reduction`` is the winner's,
on what it covers.

A licence's title, its text and its SPDX line are notices of their own.  In an
SPDX expression each licence that has a template is one.

Letter case, punctuation around words and white space don't count.  Blocks
longer than ``WINDOW`` words are searched in windows that overlap by half, which
is more than the longest template.

Defined results: null and empty texts have no notice; each row of the input has
its own; an empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices as their licences word them, and each licence's marking words.
TEMPLATES = (
    ("MIT", ("mit",), "Released under the MIT License."),
    ("MIT", ("mit",), "Licensed under the MIT License."),
    ("MIT", ("permission", "charge", "sublicense"),
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
     "and associated documentation files (the \"Software\"), to deal in the Software without "
     "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
     "Software is furnished to do so, subject to the following conditions: The above copyright notice "
     "and this permission notice shall be included in all copies or substantial portions of the "
     "Software."),
    ("Apache-2.0", ("apache", "2.0"), "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", ("apache", "2.0"),
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", ("general", "public", "3"),
     "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", ("general", "public", "3"),
     "This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation, either version 3 of "
     "the License, or (at your option) any later version."),
    ("GPL-2.0", ("general", "public", "2"),
     "This program is free software; you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation; either version 2 of "
     "the License, or (at your option) any later version."),
    ("LGPL-2.1", ("lesser", "2.1"),
     "This library is free software; you can redistribute it and/or modify it under the terms of the "
     "GNU Lesser General Public License as published by the Free Software Foundation; either version "
     "2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", ("mozilla", "2.0"),
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", ("redistribution", "binary"),
     "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met: Redistributions of source code must retain the "
     "above copyright notice, this list of conditions and the following disclaimer."),
    ("ISC", ("permission", "fee"),
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
     "fee is hereby granted, provided that the above copyright notice and this permission notice "
     "appear in all copies."),
    ("CC-BY-4.0", ("by", "4.0"), "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", ("by-sa", "4.0"), "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", ("by-nc", "4.0"), "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", ("attribution-noncommercial", "4.0"),
     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", ("attribution", "4.0"),
     "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", ("cc0", "1.0"), "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", ("unencumbered", "domain"),
     "This is free and unencumbered software released into the public domain."),
    ("MIT", ("mit",), "Distributed under the MIT License."),
    ("MIT", ("mit",), "The MIT License"),
    ("BSD-2-Clause", ("redistribution", "binary", "reproduce"),
     "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met: Redistributions of source code must retain the "
     "above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
     "binary form must reproduce the above copyright notice, this list of conditions and the following "
     "disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", ("redistribution", "binary", "neither", "endorse"),
     "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met: Redistributions of source code must retain the "
     "above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
     "binary form must reproduce the above copyright notice, this list of conditions and the following "
     "disclaimer in the documentation and/or other materials provided with the distribution. Neither "
     "the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission."),
    ("BSD-4-Clause", ("redistribution", "binary", "advertising", "acknowledgement"),
     "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met: Redistributions of source code must retain the "
     "above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
     "binary form must reproduce the above copyright notice, this list of conditions and the following "
     "disclaimer in the documentation and/or other materials provided with the distribution. All "
     "advertising materials mentioning features or use of this software must display the following "
     "acknowledgement: This product includes software developed by the copyright holder. Neither the "
     "name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission."),
    ("GPL-3.0", ("general", "public", "3"),
     "This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation, version 3 of the License."),
    ("GPL-2.0", ("general", "public", "2"),
     "This program is free software; you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    ("AGPL-3.0", ("affero", "3"),
     "This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
     "of the License, or (at your option) any later version."),
    ("AGPL-3.0", ("affero", "3"),
     "This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU Affero General Public License as published by the Free Software Foundation, version 3."),
    ("LGPL-3.0", ("lesser", "3"),
     "This library is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 "
     "of the License, or (at your option) any later version."),
    ("LGPL-2.0", ("library", "2"),
     "This library is free software; you can redistribute it and/or modify it under the terms of the "
     "GNU Library General Public License as published by the Free Software Foundation; either version 2 "
     "of the License, or (at your option) any later version."),
    ("MPL-1.1", ("mozilla", "1.1"),
     "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); "
     "you may not use this file except in compliance with the License. You may obtain a copy of the "
     "License at"),
    ("EPL-1.0", ("eclipse", "v1.0"),
     "This program and the accompanying materials are made available under the terms of the Eclipse "
     "Public License v1.0 which accompanies this distribution."),
    ("EPL-2.0", ("eclipse", "2.0"),
     "This program and the accompanying materials are made available under the terms of the Eclipse "
     "Public License 2.0 which is available at"),
    ("EPL-2.0", ("eclipse", "v2.0"),
     "This program and the accompanying materials are made available under the terms of the Eclipse "
     "Public License v2.0 which accompanies this distribution."),
)
# Phrases that tell licences of one wording apart, words that negate.
TELLING = (
    "affero general", "lesser general", "library general", "general public", "mozilla public",
    "eclipse public", "advertising materials",
)
NEGATIONS = {"not", "never", "no", "isn't", "aren't", "wasn't", "cannot", "unlike", "nor"}
# Words after a span in which a telling phrase counts as its own, and before it
# in which a negation does.
AFTERWARDS, BEFOREHAND = 12, 4
# Each licence's SPDX identifiers.
SPDX = {
    "MIT": ("MIT",), "Apache-2.0": ("Apache-2.0",),
    "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
    "LGPL-2.1": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"),
    "MPL-2.0": ("MPL-2.0",), "BSD-2-Clause": ("BSD-2-Clause",), "BSD-3-Clause": ("BSD-3-Clause",),
    "ISC": ("ISC",), "CC-BY-4.0": ("CC-BY-4.0",), "CC-BY-SA-4.0": ("CC-BY-SA-4.0",),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0",), "CC0-1.0": ("CC0-1.0",), "Unlicense": ("Unlicense",),
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "LGPL-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "LGPL-2.0": ("LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later"),
    "BSD-4-Clause": ("BSD-4-Clause",), "MPL-1.1": ("MPL-1.1",), "EPL-1.0": ("EPL-1.0",),
}
TAG = "spdx-license-identifier"
TEMPLATES += tuple(
    (name, (TAG, i.lower()), f"SPDX-License-Identifier: {i}") for name, ids in SPDX.items() for i in ids
)

CUE = re.compile(
    r"licen[cs]|copyright|spdx|permission|redistribut|public[\W_]{1,40}domain|warrant"
    r"|advertising[\W_]{1,40}materials|endorse[\W_]{1,40}or",
    re.I,
)
# Bytes that a template must save for it to be aligned.
LEAST_SAVED = 6
TOLERANCE = 0.15
WINDOW = 400
LEVEL = 12

# A hyphen at a line's end holds a word together, over the next line's comment signs.
_WORD = re.compile(r"[^\W_](?:[^\W_]|[.'\-](?=[^\W_])|-[ \t]*\r?\n[\W_]{0,40}(?=[^\W_]))*")
_BREAK = re.compile(r"-[ \t]*\r?\n[\W_]*")


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Lower-case words, in one spelling of licence, with their places."""
    return [
        (_BREAK.sub("-", m[0]).lower().replace("licence", "license"), m.start(), m.end())
        for m in _WORD.finditer(text)
    ]


def compressors():
    """One without a dictionary, and each template's with its licence, marks and words."""
    import zstandard

    out = []
    for name, marks, text in TEMPLATES:
        words = tuple(w for w, _, _ in words_of(text))
        raw = zstandard.ZstdCompressionDict(
            " ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        packed = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=raw, write_checksum=False, write_content_size=False
        )
        out.append((name, marks, words, packed))
    plain = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
    return plain, out


def _reach() -> tuple[int, int, int]:
    """Most words that a notice has before its first cue, after its last, and between two;
    a block's are no fewer between two than before and after, so that blocks don't meet."""
    before = after = between = 0
    for _, _, text in TEMPLATES:
        extra = 2 + int(TOLERANCE * len(_WORD.findall(text)))
        cues = list(CUE.finditer(text))
        before = max(before, extra + len(_WORD.findall(text, 0, cues[0].start())))
        after = max(after, extra + len(_WORD.findall(text, cues[-1].end())))
        for a, b in zip(cues, cues[1:], strict=False):
            between = max(between, extra + len(_WORD.findall(text, a.end(), b.start())))
    return before, after, max(between, before + after)


BEFORE, AFTER, BETWEEN = _reach()


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans around cues that have at most ``BETWEEN`` words between them."""
    start = end = None

    def ended() -> tuple[int, int]:
        after = list(islice(_WORD.finditer(text, end), AFTER))
        return start, after[-1].end() if after else end

    for cue in CUE.finditer(text):
        if start is not None:
            if len(list(islice(_WORD.finditer(text, end, cue.start()), BETWEEN + 1))) <= BETWEEN:
                end = cue.end()
                continue
            yield ended()
        before = deque(_WORD.finditer(text, end or 0, cue.start()), BEFORE)
        start, end = (before[0].start() if before else cue.start()), cue.end()
    if start is not None:
        yield ended()


def expressions(words: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """``words`` with a tag, of no length, before every licence of an SPDX expression."""
    out = list(words)
    for i in range(2, len(out) - 1):
        if out[i][0] in ("or", "and", "with") and out[i - 2][0] == TAG:
            out[i] = (TAG, out[i + 1][1], out[i + 1][1])
    return out


def differences(words: list[str], template: tuple[str, ...]) -> tuple[int, int, list[str], int]:
    """First and last + 1 word of the template's span, the words missing, the number added."""
    found = [b for b in SequenceMatcher(None, words, template, autojunk=False).get_matching_blocks() if b.size]
    # Stray words far from the rest aren't part of the span.
    while len(found) > 1 and found[1].a - (found[0].a + found[0].size) > len(template) / 4 >= found[0].size:
        found = found[1:]
    while len(found) > 1 and found[-1].a - (found[-2].a + found[-2].size) > len(template) / 4 >= found[-1].size:
        found = found[:-1]
    if not found:
        return 0, 0, list(template), 0
    first, last = found[0].a, found[-1].a + found[-1].size
    same = {i for b in found for i in range(b.b, b.b + b.size)}
    missing = [w for i, w in enumerate(template) if i not in same]
    return first, last, missing, last - first - len(same)


def _phrases(words) -> set[str]:
    joined = f" {' '.join(words)} "
    return {p for p in TELLING if f" {p} " in joined}


def _other(text: str, words: list[tuple[str, int, int]], first: int, last: int, template) -> bool:
    """Whether words ``first`` to ``last`` say another licence than the template, or none."""
    bare = [w for w, _, _ in words[first : last + AFTERWARDS]]
    own = _phrases(template)
    if _phrases(bare[: last - first]) - own or own - _phrases(bare):
        return True
    if "advertising materials" in _phrases(bare) - own:
        return True
    for w, _, end in words[max(0, first - BEFOREHAND) : first]:
        if w in NEGATIONS and not re.search(r"[.!?;:]\s", text[end : words[first][1]]):
            return True
    return sum(w in NEGATIONS for w in bare[: last - first]) > sum(w in NEGATIONS for w in template)


def notices(text: str, made=None) -> list[dict]:
    """Confirmed notices of a text, in order of place; ``made``: what ``compressors`` gives."""
    plain, templates = made or compressors()
    out = []

    def search(words: list[tuple[str, int, int]]) -> None:
        if not words:
            return
        bare = [w for w, _, _ in words]
        raw = " ".join(bare).encode()
        alone = len(plain.compress(raw))
        ranked = sorted(
            ((1 - len(t[3].compress(raw)) / alone, -i) for i, t in enumerate(templates)), reverse=True
        )
        for reduction, i in ranked:
            name, marks, template, _ = templates[-i]
            # Templates of a few words save little; one whose words are all there is aligned.
            if reduction * alone < LEAST_SAVED and not set(template) <= set(bare):
                continue
            first, last, missing, added = differences(bare, template)
            if set(marks) & set(missing) or len(missing) + added > TOLERANCE * len(template):
                continue
            if _other(text, words, first, last, template):
                continue
            covered = " ".join(bare[first:last]).encode()
            reduction = 1 - len(templates[-i][3].compress(covered)) / len(plain.compress(covered))
            out.append({
                "license": name, "reduction": reduction, "start": words[first][1],
                "end": words[last - 1][2], "words_missing": len(missing), "words_added": added,
            })
            search(words[:first])
            search(words[last:])
            return

    for start, end in blocks(text):
        words = expressions([(w, a + start, b + start) for w, a, b in words_of(text[start:end])])
        for at in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2):
            search(words[at : at + WINDOW])
    # A notice that two windows hold is one, as is one that a window cut off.
    kept: dict[tuple, dict] = {}
    most = -1
    for n in sorted(out, key=lambda n: (n["start"], -n["end"])):
        if n["end"] > most:
            kept.setdefault((n["start"], n["license"]), n)
            most = n["end"]
    return list(kept.values())


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a notice: ``doc_id, license, reduction, start, end, words_missing,
    words_added, notice`` (the text from ``start`` to ``end``, in code points)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["license", "reduction", "start", "end", "words_missing", "words_added", "notice"]
    kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compressors()
        for batch in batches:
            rows, found = [], []
            for i, value in enumerate(batch.column(1)):
                whole = value.as_py() or ""
                for n in notices(whole, made):
                    rows.append(i)
                    found.append(n | {"notice": whole[n["start"] : n["end"]]})
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        *[pa.array([n[c] for n in found], k) for c, k in zip(names, kinds, strict=True)],
                    ],
                    names=["doc_id", *names],
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run,
        f"doc_id {kind}, license string, reduction double, start bigint, end bigint, "
        "words_missing int, words_added int, notice string",
    )
