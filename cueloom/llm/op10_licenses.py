"""License notices in documents, by conditional compression.

Words that announce a license pick candidate blocks: for each template the words around
such a place that a notice with that wording would take up, and a few to spare. A block is
compressed alone and with its template as a zstandard raw dictionary; the templates are
ranked by how much smaller their blocks get. The best are confirmed, in that order, by exact wording:
the template's words are aligned with the block's, the differences are listed, and the
notice stands if few words differ and none of them names a license, a version or a number.
Confirmed winners own their words; a longer reduction wins an overlap.

Documents without such words leave the plan before Python, by plain substring tests.

Defined results: null and empty texts hold no notice. Rows that repeat are reported each.
A document may hold many notices, also of one license. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = 9
LEAST_REDUCTION = 0.3
MOST_DIFFERENT = 0.15
CONFIRMED = 3

# The customary wording of license notices and grants.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        " software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR"
        " CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files (the \"Software\"), to deal in the Software without restriction, including"
        " without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
        " copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the"
        " following conditions:",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation; either version 2 of the License, or (at your"
        " option) any later version.",
    ],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL"
        " was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met:",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Substrings that announce a notice; every template holds one.
SIGNS = ("licen", "permission", "redistribut", "public domain", "cc0")
#: Words that must not differ.
NAMES = frozenset(
    "apache mit gnu gpl lgpl agpl lesser affero general mozilla mpl bsd isc cc cc0 by nc sa nd creative commons"
    " attribution unlicense v version".split()
)
_WORD = re.compile(r"\w+(?:\.\d+)*")
_SIGN = re.compile("|".join(SIGNS))


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(_WORD.finditer(text.lower()))
    return [m.group() for m in found], [m.span() for m in found]


@dataclass
class Template:
    license: str
    words: list[str]
    sign: int  # the word that announces it
    packer: zstandard.ZstdCompressor

    @classmethod
    def of(cls, license: str, text: str) -> Template:
        words, spans = words_of(text)
        at = _SIGN.search(text.lower()).start()
        sign = next(i for i, (a, b) in enumerate(spans) if b > at)
        held = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return cls(license, words, sign, _packer(held))


def _packer(held=None) -> zstandard.ZstdCompressor:
    plain = {} if held is None else {"dict_data": held}
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False, **plain)


def templates() -> list[Template]:
    return [Template.of(name, text) for name, texts in TEMPLATES.items() for text in texts]


def wording(template: list[str], block: list[str]) -> tuple[int, int, list[str], list[str]]:
    """Where the template lies in the block, and its missing and extra words there."""
    match = SequenceMatcher(None, template, block, autojunk=False)
    parts = [m for m in match.get_matching_blocks() if m.size]
    if not parts:
        return 0, 0, list(template), []
    begin, end = parts[0].b, parts[-1].b + parts[-1].size
    missing, extra = [], []
    for op, a1, a2, b1, b2 in match.get_opcodes():
        if op in ("replace", "delete"):
            missing += template[a1:a2]
        if op in ("replace", "insert"):
            extra += block[max(b1, begin) : min(b2, end)]
    return begin, end, missing, extra


def confirmed(template: list[str], missing: list[str], extra: list[str]) -> bool:
    fixed = any(w in NAMES or any(c.isdigit() for c in w) for w in missing + extra)
    return not fixed and len(missing) + len(extra) <= MOST_DIFFERENT * len(template)


def notices(text: str, known: list[Template], alone: zstandard.ZstdCompressor) -> list[dict]:
    """Confirmed notices of a text, in order, none overlapping another."""
    words, spans = words_of(text)
    low = text.lower()
    signs = [i for i, (a, b) in enumerate(spans) if _SIGN.search(low, a, b) or low.startswith("public domain", a)]
    found = []
    for i in signs:
        ranked = []
        for t in known:
            spare = 1 + int(MOST_DIFFERENT * len(t.words))
            begin = max(0, i - t.sign - spare)
            block = words[begin : i - t.sign + len(t.words) + spare]
            data = " ".join(block).encode()
            size = len(alone.compress(data))
            # A notice shorter than its surroundings cannot save more than its own share.
            share = min(1.0, len(t.words) / max(len(block), 1))
            saved = (size - len(t.packer.compress(data))) / max(size, 1)
            if saved >= LEAST_REDUCTION * share:
                ranked.append((saved / share, len(t.words), t, begin, block))
        ranked.sort(key=lambda r: (-r[0], -r[1], r[2].license))
        for reduction, _, t, begin, block in ranked[:CONFIRMED]:
            a, b, missing, extra = wording(t.words, block)
            if confirmed(t.words, missing, extra):
                found.append({
                    "license": t.license, "start": spans[begin + a][0], "end": spans[begin + b - 1][1],
                    "reduction": round(reduction, 6), "missing": missing, "extra": extra})
                break
    found.sort(key=lambda f: (-(f["end"] - f["start"]), f["start"], f["license"]))
    kept: list[dict] = []
    for f in found:
        if all(f["end"] <= k["start"] or f["start"] >= k["end"] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f["start"])


def license_notices(docs: DataFrame) -> DataFrame:
    """doc_id, license, start, end, reduction, missing and extra of every notice.

    ``start`` and ``end`` count characters of the text.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, alone = templates(), _packer()
        schema = pa.schema([
            ("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
            ("reduction", pa.float64()), ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string()))])
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                rows = [{"doc_id": doc_id.as_py(), **n} for n in notices(text.as_py(), known, alone)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    low = F.lower("text")
    told = F.lit(False)
    for sign in SIGNS:
        told = told | F.contains(low, F.lit(sign))
    return docs.select("doc_id", "text").where(told).mapInArrow(
        scan, "doc_id long, license string, start long, end long, reduction double,"
        " missing array<string>, extra array<string>"
    )
