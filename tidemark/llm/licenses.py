"""Licence scan by sentence rules.

Every known sentence, normalised to lower-case words, has an identifier. A text becomes the sequence of
identifiers of the known sentences in it, in order; sentences may run over line ends. Licence rules are
ordered sequences of identifiers, tried longest first, and name the licence.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced

# Braces stand for one to ``GAP`` words of a name; at the end of a sentence for whatever follows.
GAP = 16
# Sentences of public licence texts and of usual notices.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-title": "The MIT License",
    "mit-title-2": "MIT License",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
    ),
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-grant": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "gpl-details": "See the GNU General Public License for more details.",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-notice": "Released under CC0 1.0.",
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "bsd-names": (
        "Neither the name of {} nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    "bsd-names-2": (
        "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-further": "Neither the name {}",
    "gpl2-grant": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."
    ),
    "lgpl21-grant": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."
    ),
    "lgpl3-grant": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "lgpl3-grant-2": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "agpl3-grant": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "unlicense-grant": "This is free and unencumbered software released into the public domain.",
    "apache-title": "Apache License Version 2.0, January 2004",
}

# Licence names and the sequences that stand for them.
RULES = [
    ("MIT", ["mit-grant", "mit-condition"]),
    ("MIT", ["mit-title", "mit-grant", "mit-condition"]),
    ("MIT", ["mit-title-2", "mit-grant", "mit-condition"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-notice-2"]),
    ("Apache-2.0", ["apache-grant", "apache-copy"]),
    ("Apache-2.0", ["apache-grant"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-3.0-or-later", ["gpl-grant", "gpl-warranty", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-grant"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("CC-BY-4.0", ["cc-by-4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names-2"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-2.0-or-later", ["gpl2-grant"]),
    ("LGPL-2.1-or-later", ["lgpl21-grant"]),
    ("LGPL-3.0-or-later", ["lgpl3-grant"]),
    ("LGPL-3.0-or-later", ["lgpl3-grant-2"]),
    ("AGPL-3.0-or-later", ["agpl3-grant"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense-grant"]),
    ("Apache-2.0", ["apache-title"]),
]

# A licence is not named where one of these sentences follows: it has a clause more.
NOT_BEFORE = {"BSD-2-Clause": {"bsd-names", "bsd-names-2", "bsd-advertising", "bsd-further"}}

_WORD = re.compile(r"[a-z0-9]+")
_GAP = "0gap0"
_BREAK = re.compile(r"\n|[.!?;:](?:\s|$)")


def normalised(sentence: str) -> list[str]:
    return _WORD.findall(sentence.lower())


class Scanner:
    """Known sentences by their first word, and rules by their first sentence."""

    def __init__(self, sentences: dict[str, str], rules: list[tuple[str, list[str]]]):
        self.by_word: dict[str, list[tuple[str, list[str]]]] = defaultdict(list)
        needed = set()
        for name, sentence in sentences.items():
            words = normalised(sentence.replace("{}", f" {_GAP} "))
            self.by_word[words[0]].append((name, words))
            needed.add(max((w for w in words if w != _GAP), key=lambda w: (len(w), w)))
        for known in self.by_word.values():
            known.sort(key=lambda k: (-len(k[1]), k[0]))
        # A text without any of these words holds no known sentence.
        self.needed = sorted(needed)
        self.rules = sorted(rules, key=lambda r: (-len(r[1]), r[0]))

    @staticmethod
    def _end(words: list[tuple[str, int, int]], at: int, known: list[str], closes: list[bool]) -> int | None:
        """Where a sentence that starts at a word ends, if it fits; gaps as short as they can be."""
        for k, w in enumerate(known):
            if w == _GAP:
                if k == len(known) - 1:
                    return at
                ends = (Scanner._end(words, at + n, known[k + 1 :], closes) for n in range(1, GAP + 1))
                return next((end for end in ends if end is not None), None)
            if at >= len(words) or words[at][0] != w:
                return None
            at += 1
        return at if closes[at - 1] else None

    def sentences(self, text: str) -> list[tuple[str, int, int]]:
        """Name, start and end of the known sentences, leftmost and longest first, without overlap.

        A sentence starts behind a line end or a closing mark and ends before one, or where the text does;
        inside, marks and line ends don't matter.
        """
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text) if not text.isascii() else text.lower()
        if not any(w in lowered for w in self.needed):
            return []
        words = [(m[0], m.start(), m.end()) for m in _WORD.finditer(lowered)]
        opens, closes = [True] * len(words), [True] * len(words)
        for i in range(1, len(words)):
            opens[i] = closes[i - 1] = _BREAK.search(lowered, words[i - 1][2], words[i][1]) is not None
        found, i = [], 0
        while i < len(words):
            step = 1
            if opens[i]:
                for name, known in self.by_word.get(words[i][0], ()):
                    end = self._end(words, i, known, closes)
                    if end is not None:
                        found.append((name, words[i][1], words[end - 1][2]))
                        step = end - i
                        break
            i += step
        return found

    def licences(self, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Name, start and end of the licences that the sequence of sentences stands for."""
        names, out, i = [n for n, _, _ in found], [], 0
        while i < len(names):
            for licence, sequence in self.rules:
                after = names[i + len(sequence) : i + len(sequence) + 1]
                if names[i : i + len(sequence)] == sequence and not NOT_BEFORE.get(licence, set()).intersection(after):
                    out.append((licence, found[i][1], found[i + len(sequence) - 1][2]))
                    i += len(sequence)
                    break
            else:
                i += 1
        return out


def scan(documents: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """``doc_id, n_sentences, sentence_ids, n_licenses, licenses, spans`` of every row of ``documents``.

    ``sentence_ids`` are those found, in order; ``licenses`` the distinct names, sorted; ``spans`` are
    ``name:start:end`` in code points, in order; all comma-joined. Null and empty texts, and texts without known
    sentences, have empty strings. Repeated rows and null ids are scanned like any row.
    """

    def run(batches):
        scanner = Scanner(sentences, rules)
        for batch in sliced(batches):
            known = [scanner.sentences(t or "") for t in batch.column(1).to_pylist()]
            found = [scanner.licences(k) for k in known]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(k) for k in known], pa.int64()),
                    pa.array([",".join(n for n, _, _ in k) for k in known], pa.string()),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([",".join(sorted({n for n, _, _ in f})) for f in found], pa.string()),
                    pa.array([",".join(f"{n}:{s}:{e}" for n, s, e in f) for f in found], pa.string()),
                ],
                names=["doc_id", "n_sentences", "sentence_ids", "n_licenses", "licenses", "spans"],
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_sentences long, sentence_ids string, n_licenses long, licenses string, spans string"
    )
