"""License scan by conditional compression.

Blocks (runs of neighbouring lines with wording that licences use) are compressed once plainly and
once with each template as a raw zstandard dictionary. The template that saves the largest share wins and
is confirmed only if the exact word differences between block and template are few.
"""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEVEL = 19
MIN_SAVING = 0.25
MAX_DIFFERENT = 0.25  # of the block's words
CACHE_BLOCKS = 100_000
MAX_WORDS = 2_000  # longer lines are scanned in pieces of so many words

# Notices and opening wording of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Released under the MIT License. Licensed under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. Licensed under CC BY-SA 4.0. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. Licensed under CC BY-NC 4.0. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Proprietary": "Copyright. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
}
MARKERS = r"(?i)licen[sc]|copyright|permission|redistribut|warrant|public domain|all rights reserved|free software"

_marked = re.compile(MARKERS)
_word = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")


def blocks(text: str) -> list[tuple[int, str]]:
    """Offset and text of each run of neighbouring lines that hold licence wording; long ones in pieces of words."""
    out, at, run, begin = [], 0, [], 0
    for line in [*text.split("\n"), None]:
        if line is not None and _marked.search(line):
            begin = begin if run else at
            run.append(line)
        elif run:
            whole = "\n".join(run)
            words = [m.start() for m in re.finditer(r"\S+", whole)]
            cuts = [0, *words[MAX_WORDS::MAX_WORDS], len(whole)]
            out += [(begin + a, whole[a:b]) for a, b in zip(cuts, cuts[1:]) if whole[a:b].strip()]
            run = []
        at += len(line or "") + 1
    return out


class Scanner:
    """Compressors with one template each; verdicts of recurring blocks are remembered."""

    def __init__(self, templates: dict[str, str]):
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.templates = [(name, _word.findall(text.lower()), zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))) for name, text in sorted(templates.items())]
        self.known: dict[str, tuple] = {}

    def verdict(self, block: str) -> tuple:
        """license, saving, runner_up, its saving, n_words, n_different, differences, confirmed."""
        if block not in self.known:
            if len(self.known) > CACHE_BLOCKS:
                self.known.clear()
            self.known[block] = self._verdict(block)
        return self.known[block]

    def _verdict(self, block: str) -> tuple:
        data = block.encode()
        size = len(self.plain.compress(data))
        ranked = sorted(((size - len(packer.compress(data))) / size, name, words) for name, words, packer in self.templates)
        ranked = sorted(ranked, key=lambda r: (-r[0], r[1]))
        saving, name, template = ranked[0]
        words = _word.findall(block.lower())
        same = difflib.SequenceMatcher(None, words, template, autojunk=False)
        kept = [m for m in same.get_matching_blocks() if m.size >= 2]
        covered = {k for m in kept for k in range(m.a, m.a + m.size)}
        other = [w for k, w in enumerate(words) if k not in covered]
        confirmed = bool(words) and saving >= MIN_SAVING and len(other) <= MAX_DIFFERENT * len(words)
        return name, saving, ranked[1][1] if len(ranked) > 1 else None, ranked[1][0] if len(ranked) > 1 else None, len(words), len(other), " ".join(other), confirmed


_SCHEMA = "doc_id long, block_start long, block string, license string, saving double, runner_up string, runner_up_saving double, n_words long, n_different long, differences string, confirmed boolean"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per block with licence wording: the winning template, its lead and the wording differences.

    Texts without such wording, null or empty texts give no rows. Null or repeated ``doc_id`` are scanned row
    by row. An empty table gives no rows. Other columns are ignored.
    """

    def work(batches):
        scanner = Scanner(templates)
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        for batch in batches:
            rows = [(key, at, block, *scanner.verdict(block)) for key, text in zip(batch.column(0).to_pylist(), batch.column(1)) for at, block in blocks(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], names)

    hits = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(F.col("text").rlike(MARKERS))
    return hits.mapInArrow(work, _SCHEMA)
