"""License scans (operator 2); DataFrame functions only.

A paragraph is a line, with the next ones as long as none is blank and the one before ends without . ! or ?, so that
wrapped notices are whole. Each is classified. Those without any of the words in ANCHORS are counted by themselves, as the
query's SQL counts only the others. A multinomial logistic regression over the word one- and two-grams that occur
is trained on the driver from TEMPLATES, from NAMES in all FORMS, and from COUNTER and COUNTER_FORMS (sentences about licences, courts, drivers... that
grant nothing), all of fixed size; its weights, in whole numbers, are a small table that every task gets.
Paragraphs' n-grams are joined to it and the weights summed. UNKNOWN is a class of its own, trained on
notices of other licences; held-out folds calibrate the temperature and the least probability of a family,
under which a paragraph that reads like a licence is unknown. A family is confirmed where at least half of
the paragraph's three-grams, or of a template's, are shared with one template of the family, or where one is shared that
holds a word of KEYS in a form of the family's names; else the paragraph counts as unknown. Of paragraphs and templates under three
words the whole is compared.

Defined results: null and empty texts have no licences; repeated rows are scanned each; a null doc_id is
passed on; an empty table gives an empty table; extra columns are not read. A paragraph's n-grams are one array of its
row, so memory follows the longest text.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TEMPLATES = {
    "mit": [
        "Released under the MIT License.", "This project is licensed under the MIT License.", "Licensed under the MIT license, see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "SPDX-License-Identifier: MIT", "MIT License", "The MIT License (MIT)",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http www apache org licenses LICENSE 2.0", "This product is released under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
        "SPDX-License-Identifier: Apache-2.0", "Apache License", "Apache License Version 2.0, January 2004", "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL version 2 or any later version.", "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: LGPL-2.1", "GNU GPL", "GNU General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "Released under the GNU GPL v3.", "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "bsd": [
        "Licensed under the BSD 3 Clause License.", "Released under the BSD License.", "Use of this source code is governed by a BSD style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "BSD License", "BSD 3-Clause License",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "Released under the MPL 2.0.",
        "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License", "If a copy of the MPL was not distributed with this file, You can obtain one at http mozilla org MPL 2.0.",
    ],
    "cc_by_nc": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Content is available under CC BY-NC-SA 3.0.",
        "Licensed under the Creative Commons Attribution NonCommercial ShareAlike License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0", "CC BY-NC 4.0",
    ],
    "cc_by": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Content is available under CC BY-SA 3.0 unless otherwise noted.",
        "SPDX-License-Identifier: CC-BY-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0", "CC BY 4.0", "Text is available under the Creative Commons Attribution ShareAlike License.", "Dedicated to the public domain under CC0 1.0.",
    ],
    "unknown": [
        "Licensed under the Eclipse Public License, version 2.0.", "This work is licensed under the Artistic License.", "Released under the zlib License.", "Licensed under the Boost Software License, version 1.0.",
        "Distributed under the terms of the Acme Community License.", "This software is provided under a proprietary license agreement.", "Released under the Unlicense.", "Licensed under the ISC License.",
        "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "You may use this software only under the terms of the license that comes with it.", "Published under the Open Data Commons Attribution License.",
    ],
}
COUNTER = [
    "He lost his driving license after the accident.", "The restaurant applied for a license to sell wine.", "The court ruled on the license of the broadcaster.", "She was granted permission to enter the building.",
    "The Apache helicopters landed near the base.", "Researchers at MIT published a new study.", "The general public was invited to the hearing.", "All rights of the tenants are protected by the law.",
    "The software crashed again, and nobody could say why.", "A copy of the report was sent to the office.", "The warranty covers parts and labour for two years.", "The creative commons of the village was a meadow.",
    "The version of the story that he told was different.", "In this file you find the names of the guests.", "The terms of the agreement were kept secret.", "Any person may attend free of charge.",
    "The foundation gave money to the school.", "The source of the river is in the mountains.", "The following conditions were reported by the weather service.", "This work is about the history of the town.",
    "The project was released to the press on Monday.", "The public library is open until nine.", "The mozilla browser was opened and the page was read.", "The source code was written in the summer.",
    "Content of the letter is not known.", "Modification of the house is not allowed by the city.", "He is a licensed physician and works under pressure.", "The text is available in the library.",
    "The driver must renew the license before the contract ends.", "Her license to practise law was revoked under the new act.", "The pilot's license expired last year.", "A fishing license is required in the park.", "The bank was granted a license by the regulator.",
    "The company sells a license for each seat of its software.", "The city issued a building permit under the old code.", "The student was released under the condition that he pay.", "The band released the album under its own name.", "The dog license costs ten dollars a year.",
    "They applied for permission to use the hall.", "Permission was granted by the council after a long debate.", "The public license office opens at eight.", "You must show your license and registration to the officer.", "The station lost its broadcast license in March.",
    "Version 2 of the plan was distributed to all members.", "The warranty is void without a receipt.", "The software is sold with a warranty of two years.", "Copyright law was the subject of the lecture.", "The notice was posted above the door.",
    "The terms of the license between the two firms are secret.", "A copy of the license hung on the wall of the bar.", "The marriage license was signed by the clerk.", "He drives without a license.", "All conditions of the contract are met by the seller.",
    "The general license fee rose by three percent.", "The foundation published a report on free software.", "The license plate was found near the river.", "The taxi license is worth more than the car.", "Without a licence the shop may not sell tobacco.",
    "A chemist at MIT won a medal.", "The MIT crew lost the boat race.", "The novel was released under a false name.", "The theatre's license was renewed by the city.", "The board of the school renewed the license for a year.", "The Apache fled to the mountains.",
]
#: How a licence's name stands in a sentence; with NAMES these are trained on and confirm like templates.
NAMES = {
    "mit": ["MIT License", "MIT", "Expat License"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0", "Apache License", "Apache Software License", "Apache 2"],
    "gpl": ["GNU General Public License", "GPL", "GNU GPL", "GPLv3", "GPLv2", "GPL-3.0", "GPL v2", "LGPL", "AGPL", "GNU Lesser General Public License", "GNU Affero General Public License"],
    "bsd": ["BSD License", "BSD", "3-Clause BSD License", "2-Clause BSD License", "New BSD License", "BSD 3-Clause License", "BSD-3-Clause"],
    "mpl": ["Mozilla Public License", "Mozilla Public License, version 2.0", "MPL", "MPL 2.0", "MPL-2.0"],
    "cc_by_nc": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 3.0", "CC BY-NC", "Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 License"],
    "cc_by": ["CC BY 4.0", "CC BY-SA 4.0", "CC BY", "CC BY-SA", "Creative Commons Attribution License", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution-ShareAlike License"],
    "unknown": ["Eclipse Public License", "Artistic License", "zlib License", "Boost Software License", "ISC License", "Acme Community License", "license agreement", "Open Data Commons License", "Foo License"],
}
FORMS = [
    "License: {}", "Licensed under the {}.", "Licensed under {}.", "This project is released under the {}.", "The code is {} licensed.", "It is distributed under the terms of the {}.", "The library is available under the {}.",
    "The text is under {}, see LICENSE.", "All files are covered by the {}.", "You may use this program under the {}.", "This work is published under a {}.", "It is free software under the terms of {}.", "Use of this source is governed by the {}.",
]
#: Uses of words of licences that grant nothing.
COUNTER_FORMS = {
    "He studied at {}.|Teachers of {} went on strike.|The head of {} resigned.|The {} group came home late.|{} announced its results.|A report by {} shows the costs.|Her work at {} took a year.|{} was founded long ago.": [
        "MIT", "Apache", "Mozilla", "the Apache Corporation", "the Commons", "the Foundation",
    ],
    "Only licensed {} may work here.|Licensed {} earn more.|The number of licensed {} fell.|The law protects licensed {}.": ["doctors", "drivers", "plumbers", "dealers"],
    "The {} is built under license in Spain.|Its {} is sold under a license from the owner.|They make the {} under licence.": ["car", "radio", "drug", "game"],
    "The {} got its license back.|Without a license the {} was closed.|The {} pays for its licence each year.|The {} needs a license from the city.": ["shop", "hotel", "boat", "school"],
    "The {} gave permission to begin.|Permission for the {} was given in June.|The {} has a warranty.|The copyright of the {} was sold.|The copyright in the {} ended.": ["house", "film", "song", "machine"],
}
#: The words of a family's names that tell it from other words.
KEYS = {
    "mit": "mit expat", "apache": "apache", "gpl": "gpl gplv2 gplv3 lgpl agpl gnu", "bsd": "bsd", "mpl": "mpl mozilla", "cc_by_nc": "nc noncommercial", "cc_by": "cc cc0 creative attribution sharealike",
    "unknown": "eclipse epl artistic zlib boost isc unlicense",
}
#: Words of which every template has one at least; the SQL counts no paragraph without one.
ANCHORS = sorted({
    *" ".join(KEYS.values()).split(" "), *"license licence licenses licences licensed licenced licensing copyright permission permissions redistribute redistribution redistributions".split(" "),
    *"warranty warranties disclaimer spdx compliance sublicense noncommercial".split(" "),
})
NONE = "none"
CLASSES = [*TEMPLATES, NONE]
SCALE = 1000
SHARED = 0.5


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def _grams(words: list[str], n: int) -> list[str]:
    return [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 400, l2: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], len(CLASSES))), np.zeros(len(CLASSES))
    want = np.eye(len(CLASSES))[y]
    # Licences weigh the same, and NONE as much as all of them.
    weight = np.array([1.0 / (len(CLASSES) - 1) if c != NONE else 1.0 for c in CLASSES]) / 2
    share = want / want.sum(axis=0).clip(1) * weight
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - want) * share.sum(axis=1, keepdims=True)
        vw, vb = 0.9 * vw - 1.5 * (x.T @ g + l2 * w), 0.9 * vb - 1.5 * g.sum(axis=0)
        w, b = w + vw, b + vb
    return w, b


@lru_cache(1)
def trained() -> tuple[dict[str, list[int]], list[int], float]:
    """(whole weights of each n-gram, those of the bias, least probability of a family), calibrated."""
    texts = [(t, CLASSES.index(c)) for c, many in [*TEMPLATES.items(), (NONE, COUNTER)] for t in many]
    formed = [(form.format(name), CLASSES.index(c), k % 4) for c, names in NAMES.items() for name in names for k, form in enumerate(FORMS)]
    formed += [(form.format(name), CLASSES.index(NONE), k % 4) for forms, names in COUNTER_FORMS.items() for name in names for k, form in enumerate(forms.split("|"))]
    # Long texts with many common words grant nothing either.
    texts += [(" ".join(COUNTER[k::step]), CLASSES.index(NONE)) for step in (1, 2, 3, 4) for k in range(step)]
    rows, labels, fold = [], [], []
    for k, (text, label) in enumerate(texts):
        words = _words(text)
        parts = [words, ["notes", *words], [*words, "more"]] + ([words[: len(words) // 2 + 2], words[len(words) // 3 :]] if len(words) > 12 else [])
        for part in parts:
            rows.append(_grams(part, 1) + _grams(part, 2))
            labels.append(label)
            fold.append(k % 4)
    for text, label, own in formed:  # held out by forms, not by names
        rows.append(_grams(_words(text), 1) + _grams(_words(text), 2))
        labels.append(label)
        fold.append(own)
    names = sorted({g for r in rows for g in r})
    index = {g: k for k, g in enumerate(names)}
    x, y, fold = np.zeros((len(rows), len(names))), np.array(labels), np.array(fold)
    for k, r in enumerate(rows):
        x[k, [index[g] for g in r]] = 1
    held = np.zeros((len(rows), len(CLASSES)))
    for f in range(4):
        w, b = _fit(x[fold != f], y[fold != f])
        held[fold == f] = x[fold == f] @ w + b

    def probabilities(t: float) -> np.ndarray:
        z = held / t
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    temperature = min(np.linspace(0.5, 4, 36), key=lambda t: -np.log(probabilities(t)[np.arange(len(y)), y].clip(1e-9)).mean())
    p = probabilities(temperature)
    families = [k for k, c in enumerate(CLASSES) if c not in ("unknown", NONE)]
    best = np.array(families)[p[:, families].argmax(axis=1)]
    # The least probability at which held-out families are right nine times in ten.
    levels = np.linspace(0.2, 0.9, 71)
    good = [t for t in levels if (p[np.arange(len(y)), best] >= t).any() and (best == y)[p[np.arange(len(y)), best] >= t].mean() >= 0.9]
    least = float(good[0]) if good else 0.9
    w, b = _fit(x, y)
    whole = lambda v: [int(round(SCALE * c / temperature)) for c in v]
    return {g: v for g, v in zip(names, map(whole, w), strict=True) if max(map(abs, v)) >= SCALE // 20}, whole(b), least


_LOW = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A line's end that the next line continues: the last sign is no white space and ends no sentence.
_WRAP = r"([^.!?\x09-\x0D ])[ \t\r]*\n"
#: White space of any script around a paragraph, as SQL's trim() takes it off.
_AROUND = r"^\p{Zs}+|(?<!\p{Zs})\p{Zs}+\z"
_WHOLE = "\x02"  # before the words of a paragraph or template that is too short for three-grams
_DOC = "\x01"  # no word has this; it stands for a document's own row


def _words_of(line):
    plain = F.regexp_replace(F.regexp_replace(F.translate(line, *_LOW), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), _AROUND, "")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _n_grams(words, n: int):
    """Arrays of the n-grams of an array of words."""
    some = F.sequence(F.lit(0), F.size(words) - F.lit(n))
    grams = F.transform(some, lambda k: F.concat_ws(" ", *[F.get(words, k + F.lit(i)) for i in range(n)]))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def _far() -> int:
    """How far under NONE all other classes must lie for none of them to hold half."""
    return math.ceil(SCALE * math.log(len(CLASSES) - 1)) + 1


def _templates() -> list[tuple[str, int, list[str]]]:
    """(family, size, three-grams) of each template, of which half the size must be shared; the whole of one under three words.

    The forms of a family's names are put together, with a size of one; 255 three-grams fit into the eight bits of a template.
    """
    threes = lambda words: _grams(words, 3) if len(words) > 2 else [_WHOLE + " ".join(words)]
    grams = [(c, sorted(set(threes(_words(t))))) for c in TEMPLATES if c != "unknown" for t in TEMPLATES[c]]
    out = [(c, len(g), g) for c, g in grams if g]
    for c, names in NAMES.items():
        if c != "unknown":
            keys = set(KEYS[c].split(" "))
            named = sorted({g for name in names for form in FORMS for g in threes(_words(form.format(name))) if keys & set(_words(g))})
            out += [(c, 1, named[k : k + 255]) for k in range(0, len(named), 255)]
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_licensed (paragraphs), families, n_unknown, n_confirmed, all four of paragraphs with an
    anchor word; n_unanchored and unanchored_families of those without one that read like a licence."""
    spark = docs.sparkSession
    weights, bias, least = trained()
    columns = [f"w{k}" for k in range(len(CLASSES))]
    kinds = _templates()
    of: dict[str, list[int]] = {}
    for k, (_, _, grams) in enumerate(kinds):
        for g in grams:
            of.setdefault(g, []).append(k)
    zero = [0] * len(CLASSES)
    # Eight templates share a whole number, with eight bits for the three-grams met of each: none has over 255.
    meets = [f"m{k}" for k in range(-(-len(kinds) // 8))]
    packed = lambda g: [sum(1 << (8 * (t % 8)) for t in of.get(g, ()) if t // 8 == k) for k in range(len(meets))]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    listed = sorted({*weights, *of, *ANCHORS, _DOC})
    known = [(g, int(g in ANCHORS), *weights.get(g, zero), *map(signed, packed(g))) for g in listed]
    table = spark.createDataFrame(known, "gram string, " + ", ".join(f"{c} long" for c in ["anchor", *columns, *meets]))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    parts = F.split(F.regexp_replace("text", _WRAP, "$1 "), "\n")
    lines = rows.select("row", "doc_id", F.posexplode(F.concat(parts, F.array(F.lit(_DOC)))).alias("line", "body"))
    # explode() of one array makes a column that is made once, not an expression repeated for each n-gram.
    own = F.when(F.col("body") == _DOC, F.array(F.lit(_DOC))).otherwise(_words_of(F.col("body")))
    words = lines.select("row", "doc_id", "line", F.explode(F.array(own)).alias("words")).filter(F.size("words") > 0)
    # Words that are in no n-gram of the table become null, and so do the n-grams that hold one of them.
    single = sorted({w for g in listed for w in g.strip(_WHOLE).split(" ")})
    words = words.select("row", "doc_id", "line", "words", F.explode(F.array(F.transform("words", lambda w: F.when(w.isin(single), w)))).alias("own"))
    after = lambda w, k, n: F.when(w.isNotNull(), F.concat(w, *[x for i in range(1, n) for x in (F.lit(" "), F.get("own", k + F.lit(i)))]))
    some = F.concat("own", F.transform("own", lambda w, k: after(w, k, 2)), F.transform("own", lambda w, k: after(w, k, 3)))
    some = F.when(F.size("words") > 2, some).otherwise(F.array_append(some, F.concat(F.lit(_WHOLE), F.array_join("words", " "))))
    held = words.select("row", "doc_id", "line", "words", F.explode(F.array(F.array_distinct(F.filter(some, lambda g: g.isin(listed))))).alias("held"))
    # How many three-grams a paragraph has matters only if a template has one of them.
    threes = F.when((F.size("words") > 2) & F.exists("held", lambda g: g.isin(sorted(of))), F.size(F.array_distinct(_n_grams(F.col("words"), 3)))).otherwise(1)
    grams = held.select("row", "doc_id", "line", threes.alias("n_threes"), (F.get("words", F.lit(0)) == _DOC).alias("is_doc"), F.explode("held").alias("gram"))
    # The table has a fixed number of rows; few n-grams of a text are in it, and only these are summed.
    sums = grams.join(F.broadcast(table), "gram").groupBy("row", "doc_id", "line", "n_threes", "is_doc").agg(F.max("anchor").alias("anchor"), *[F.sum(c).alias(c) for c in [*columns, *meets]])
    # No class other than NONE can hold half where all lie this far below it; most paragraphs end here.
    others = F.greatest(*[F.col(c) + F.lit(b) for c, b in zip(columns[:-1], bias[:-1], strict=True)])
    sums = sums.filter(F.col("is_doc") | (others > F.col(columns[-1]) + F.lit(bias[-1] - _far())))
    families = [c for c in CLASSES if c not in ("unknown", NONE)]
    at = {c: k for k, c in enumerate(CLASSES)}
    first, last = at[families[0]], at[families[-1]]
    # Step by step, so that no expression is repeated inside others.
    steps = sums.select("row", "doc_id", "n_threes", "is_doc", (F.col("anchor") > 0).alias("anchored"), F.array(*meets).alias("met"), F.array(*[(F.col(c) + F.lit(b)) / F.lit(float(SCALE)) for c, b in zip(columns, bias, strict=True)]).alias("z"))
    steps = steps.withColumn("top", F.array_max("z")).withColumn("e", F.transform("z", lambda z: F.exp(z - F.col("top"))))
    steps = steps.withColumn("total", F.aggregate("e", F.lit(0.0), lambda x, y: x + y)).withColumn("p", F.transform("e", lambda e: e / F.col("total")))
    steps = steps.withColumn("own", F.slice("p", first + 1, last - first + 1)).withColumn("best", F.array_max("own"))
    none, unknown = F.get("p", F.lit(at[NONE])), F.get("p", F.lit(at["unknown"]))
    named = F.get(F.array(*map(F.lit, families)), (F.array_position("own", F.col("best")) - 1).cast("int"))
    family = F.when(F.col("is_doc") | (none >= 0.5), F.lit(None).cast("string")).when((F.col("best") >= least) & (F.col("best") >= unknown), named).otherwise(F.lit("unknown"))
    judged = steps.select("row", "doc_id", "n_threes", "is_doc", "anchored", "met", family.alias("family"))
    kept = [(k, c, n) for k, (c, n, _) in enumerate(kinds)]
    count = lambda k: F.shiftrightunsigned(F.get("met", F.lit(k // 8)), 8 * (k % 8)).bitwiseAND(F.lit(255))
    shares = F.array(*[(F.col("family") == c) & (count(k) >= SHARED * F.least(F.lit(n), F.col("n_threes"))) for k, c, n in kept])
    counted, other = F.col("family").isNotNull() & F.col("anchored"), F.col("family").isNotNull() & ~F.col("anchored")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c & F.col("ok"), F.col("family")))), ",")
    found = judged.withColumn("ok", F.col("family").isNotNull() & (F.col("n_threes") > 0) & F.coalesce(F.exists(shares, lambda x: x), F.lit(False))).groupBy("row", "doc_id").agg(
        F.count_if(counted).alias("n_licensed"), joined(counted).alias("families"), F.count_if(counted & ~F.col("ok")).alias("n_unknown"), F.count_if(counted & F.col("ok")).alias("n_confirmed"),
        F.count_if(other).alias("n_unanchored"), joined(other).alias("unanchored_families"),
    )
    return found.drop("row")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(common.read(spark, sf_dir, "documents")).select("doc_id", "n_licensed", "families", "n_unknown", "n_confirmed")


def oracle_sql() -> str:
    weights, bias, least = trained()
    names = [f"w{k}" for k in range(len(CLASSES))]
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    families = [c for c in CLASSES if c not in ("unknown", NONE)]
    share = {c: f"exp(z{k} - top) / total" for k, c in enumerate(CLASSES)}
    kinds = _templates()
    plain = f"trim(regexp_replace(translate(body, '{_LOW[0]}', '{_LOW[1]}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"
    return f"""
WITH weights(gram, {", ".join(names)}) AS (VALUES {", ".join(f"({quote(g)}, {', '.join(map(str, v))})" for g, v in weights.items())}),
templates(family, template, size, gram) AS (VALUES {", ".join(f"('{c}', {k}, {n}, {quote(x)})" for k, (c, n, g) in enumerate(kinds) for x in g)}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
whole AS (SELECT r, regexp_replace(t, '([^.!?\\x09-\\x0D ])[ \\t\\r]*\\n', '\\1 ', 'g') AS t FROM docs),
split AS (SELECT r, unnest(string_split(t, chr(10))) AS body, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM whole),
lines AS (SELECT r, line, list_filter(string_split({plain}, ' '), lambda x: x <> '') AS w FROM split),
grams AS (SELECT r, line, w, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])))) AS gram FROM lines WHERE list_has_any(w, [{', '.join(map(quote, ANCHORS))}])),
sums AS (SELECT r, line, any_value(w) AS w, {", ".join(f"(sum({n}) + {b}) / {float(SCALE)} AS z{k}" for k, (n, b) in enumerate(zip(names, bias, strict=True)))} FROM grams JOIN weights USING (gram) GROUP BY r, line),
tops AS (SELECT *, greatest({", ".join(f"z{k}" for k in range(len(CLASSES)))}) AS top FROM sums),
totals AS (SELECT *, {" + ".join(f"exp(z{k} - top)" for k in range(len(CLASSES)))} AS total FROM tops),
bests AS (SELECT *, greatest({", ".join(share[c] for c in families)}) AS best FROM totals),
judged AS (SELECT r, line, w, CASE WHEN best >= {least} AND best >= {share["unknown"]} THEN CASE {" ".join(f"WHEN {share[c]} = best THEN '{c}'" for c in families)} END ELSE 'unknown' END AS family
  FROM bests WHERE NOT ({share[NONE]} >= 0.5)),
mine AS (SELECT r, line, family, list_distinct(CASE WHEN len(w) < 3 THEN [chr(2) || array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END) AS g FROM judged),
spread AS (SELECT r, line, family, len(g) AS own, unnest(g) AS gram FROM mine),
confirmed AS (SELECT DISTINCT r, line, 1 AS ok FROM (SELECT r, line FROM spread JOIN templates USING (family, gram) GROUP BY r, line, template HAVING count(*) >= {SHARED} * least(any_value(own), any_value(size)))),
found AS (SELECT r, count(*) AS n_licensed, string_agg(DISTINCT CASE WHEN ok = 1 THEN family END, ',' ORDER BY CASE WHEN ok = 1 THEN family END) AS families,
  count(CASE WHEN ok IS NULL THEN 1 END) AS n_unknown, count(ok) AS n_confirmed FROM judged LEFT JOIN confirmed c USING (r, line) GROUP BY r)
SELECT doc_id, coalesce(n_licensed, 0) AS n_licensed, coalesce(families, '') AS families, coalesce(n_unknown, 0) AS n_unknown, coalesce(n_confirmed, 0) AS n_confirmed FROM docs LEFT JOIN found USING (r)
"""
