"""License scans on sentences that are no templates: HELD and OTHER, whose misses were seen while the templates were extended,
and BLIND and BLIND_OTHER, which were written before and looked at after."""

import math

import duckdb
import pytest

from lattica.llm import licenses

HELD = {
    "mit": [
        "The code is MIT licensed.", "This package is distributed under the MIT license.", "MIT © 2021 Jane Doe", "Available as open source under the terms of the MIT License.", "All code in this repository is covered by the MIT License.",
        "License: MIT", "The above copyright notice shall be included in all copies of the Software.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this library.",
        "This plugin is free software, released under the MIT license.", "You may use it under the terms of the MIT license.", "// SPDX-License-Identifier: MIT",
    ],
    "apache": [
        "The library is available under the Apache 2 license.", "This project uses the Apache License, Version 2.0.", "License: Apache-2.0", "All files are Apache 2.0 licensed unless stated otherwise.",
        "Copyright 2019 The Authors. Licensed under the Apache License, Version 2.0.", "Code is made available under the terms of the Apache License 2.0.", "Distributed under the Apache Software License.",
        "Unless required by applicable law, software distributed under the License is distributed on an AS IS BASIS.", "You may not use this file except in compliance with the License.", "Apache 2.0, see LICENSE.",
    ],
    "gpl": [
        "This program is distributed under the GPL-3.0.", "The driver is released under the terms of the GNU GPL version 2.", "License: GPLv3", "This file is part of Foo, which is free software under the GNU General Public License.",
        "The plugin is GPL licensed.", "It is free software; you can redistribute it under the terms of the GNU Lesser General Public License.", "This code is covered by the GNU Affero General Public License, version 3.",
        "This program comes with ABSOLUTELY NO WARRANTY; see the GNU General Public License for details.", "Dual licensed under the GPL and a commercial license.", "Published under GPL v2 or later.",
    ],
    "bsd": [
        "The software is distributed under the 3-clause BSD license.", "License: BSD", "This package is BSD licensed.", "Redistribution and use in source and binary forms are permitted.", "Available under a 2-clause BSD license.",
        "Use of this code is governed by the BSD license that can be found in the LICENSE file.", "Redistributions in binary form must reproduce the above copyright notice in the documentation.", "It is provided under the New BSD License.",
    ],
    "mpl": [
        "This file is subject to the Mozilla Public License, version 2.0.", "The code is available under the MPL 2.0.", "License: MPL-2.0", "Distributed under the terms of the Mozilla Public License.", "MPL 2.0 licensed.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1.",
    ],
    "cc_by_nc": [
        "All images are licensed under CC BY-NC 4.0.", "This dataset is released under a Creative Commons Attribution-NonCommercial license.", "License: CC BY-NC-SA 4.0", "The text is available under CC BY-NC-ND 3.0.",
        "Photos are shared under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 licence.", "Creative Commons Attribution-NonCommercial 4.0 International",
    ],
    "cc_by": [
        "This article is distributed under the terms of the Creative Commons Attribution License.", "Photo by Anna, licensed under CC BY 2.0.", "License: CC BY-SA 4.0", "The documentation is available under the Creative Commons Attribution-ShareAlike 4.0 license.",
        "This is an open access article under the CC BY license.", "Map data is licensed under a Creative Commons Attribution 4.0 International License.", "Except where otherwise noted, content is licensed under CC BY 4.0.",
    ],
    "unknown": [
        "Licensed under the Academic Free License.", "The font is released under the SIL Open Font License.", "This software is distributed under the Python Software Foundation License.", "License: EPL-1.0",
        "This file is licensed under the Microsoft Public License.", "Released under the WTFPL.", "Use is subject to the terms of the license agreement.",
    ],
}
OTHER = [
    "The pub's license was renewed for MIT students by the public board.", "His medical license was suspended by the state board.", "The minister revoked the mining license of the company.", "A hunting license costs forty dollars.", "Poetic license allows a writer to bend the truth.",
    "She teaches physics at MIT.", "The MIT team won the robot race.", "A study from MIT found that sleep helps memory.", "The Apache are a people of the southwest.", "An Apache helicopter flew over the valley.", "He drove an Apache pickup for many years.",
    "The copyright of the song belongs to the widow.", "The film company sued for breach of copyright.", "All copies of the book were sold.", "Two copies of the contract were signed.", "The above notice was sent to all tenants.", "The permission of the owner is required.",
    "They were granted permission to land.", "No person may enter without permission.", "The general public was not allowed inside.", "The public was warned of the storm.", "The committee issued a public notice.", "The wildebeest, or gnu, lives in Africa.", "A herd of gnu crossed the river.",
    "The driver must carry a valid license at all times.", "The car comes with a warranty of five years.", "The dealer refused to honour the warranty.", "The software was late and full of errors.", "New software was installed on all machines.", "The software company hired ten people.",
    "The prisoners were released under a new law.", "The record was released under the name of the drummer.", "The report was distributed to all members.", "Food was distributed under the eyes of the police.", "The papers were made available to the press.", "Tickets are available at the office.",
    "The house of commons voted on the bill.", "The commons were used by all farmers.", "The creative director left the agency.", "Attribution of the painting to Rembrandt is doubtful.", "The crime was blamed on the gang without attribution.", "Version 2 of the phone is faster.", "The first version of the play was longer.",
    "The second clause of the contract was struck out.", "The clause on rent was disputed in court.", "The terms of the loan were hard.", "The terms of the treaty were agreed in Paris.", "He agreed to the terms and conditions of the sale.", "The source of the leak is unknown.", "The source asked not to be named.",
    "The project was funded by the state.", "The file was lost by the police.", "See the file for details of the case.", "The details of the plan are secret.", "The project is subject to approval by the council.", "The plan is subject to the following conditions.", "The law applies to all files.", "The law was written in haste.",
    "The bar lost its liquor license after the fire.", "The city will license food trucks next year.", "Licensed nurses are in short supply.", "A licensed electrician must do the work.", "The licensing board met on Monday.", "The toy is sold under license in Japan.", "The firm makes the engine under license.",
    "The station's licence fee pays for the programme.", "Mozilla laid off many workers in the autumn.", "He worked at Mozilla for ten years.", "The Berkeley campus was closed by the strike.", "The open source movement began in the nineties.", "Open source software is used by many banks.", "Free software is a matter of liberty, not price.",
]

BLIND = {
    "mit": ["Released under an MIT license, so do as you like.", "This tool is MIT-licensed; contributions are welcome.", "Copyright (c) 2018 Jo Roe. Licensed under the MIT license.", "We publish our scripts under the MIT License.", "MIT License, see LICENSE.txt for the text."],
    "apache": ["The SDK is open source software released under the Apache 2.0 license.", "Licensed to the Foundation under one or more contributor license agreements, under the Apache License, Version 2.0.", "Our client code is licensed under Apache 2.0.", "This module is under the Apache License v2.", "See the License for the specific language governing permissions."],
    "gpl": ["Moodle plugins must be licensed under the GNU GPL v3.", "The kernel module is distributed under the GNU General Public License v2.", "You can copy and modify it under the terms of the GPL.", "This library is free software under the LGPL.", "Released under the AGPL, version 3."],
    "bsd": ["This driver is licensed under the terms of the BSD license.", "Our code is open source under the BSD 2-Clause License.", "Released under a BSD-style license.", "Redistributions of source code must retain the above copyright notice.", "Licensed under the modified BSD license, see COPYING."],
    "mpl": ["Our add-on is licensed under the Mozilla Public License 2.0.", "Source files are under MPL 2.0.", "This Source Code Form is subject to the terms of the MPL."],
    "cc_by_nc": ["You may share these slides under CC BY-NC-SA 4.0.", "Recordings are licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives license.", "This book is published under the CC BY-NC license."],
    "cc_by": ["Wikipedia text is under the Creative Commons Attribution-ShareAlike License.", "Figures are reused under CC BY 4.0.", "This work is available under a Creative Commons Attribution 3.0 license.", "Unless noted, photos are licensed CC BY-SA 2.0."],
    "unknown": ["Distributed under the Ruby license.", "The fonts are licensed under the Bitstream Vera License.", "This program is licensed under the Common Public License."],
}
BLIND_OTHER = [
    "The doctor's licence was taken away after two trials.", "Every pilot renews the license once a year.", "The club was refused a license to serve beer.", "MIT students built a small satellite.", "An MIT professor won the prize.", "Apache pilots were trained in the desert.",
    "The museum holds the copyright of the letters.", "The play is out of copyright since last year.", "Copyright lawyers met in Geneva.", "Planning permission was refused by the council.", "The teacher gave her permission to leave.", "The washing machine is still under warranty.",
    "The seller gives no warranty for old cars.", "Wealth should be redistributed, the party says.", "The redistribution of seats favours the north.", "A creative use of space won the award.", "Creative people like to work at night.", "The total eclipse was seen in the south.", "The loan gave a boost to the firm.",
    "Mozilla opened an office in Berlin.", "The speaker of the Commons called for order.", "The magazine was published under a new title.", "The film was released under a different title.", "He works under the name of Fox.", "The land is free for the use of the public.", "The general told the public that the war was over.",
    "The foundation is licensed by the state to run two schools.", "The bank may lose its licence over the scandal.", "The new fishing licence covers the whole lake.", "He was licensed to preach in 1832.", "The disclaimer on the box was hard to read.", "The gnu is hunted by lions.", "The software of the bank was changed in May.",
    "Under the terms of the deal, workers keep their jobs.", "All rights and duties pass to the heirs.", "Source books for teachers are free of charge.", "The pharmacy's license hangs above the counter.", "They license the brand to a firm in Italy.",
]


def _judged(spark, texts):
    rows = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r for r in sorted(rows, key=lambda r: r.doc_id)]


def _figures(spark, licensed, other):
    """(recall and precision of licence or none, share of licences with the right family)."""
    pairs = [(c, t) for c, many in licensed.items() for t in many] + [("none", t) for t in other]
    judged = [(c, t, r) for (c, t), r in zip(pairs, _judged(spark, [t for _, t in pairs]), strict=True)]
    own = [(c, t, r) for c, t, r in judged if c != "none"]
    found, wrong = sum(r.n_licensed > 0 for _, _, r in own), [t for c, t, r in judged if c == "none" and r.n_licensed]
    misnamed = [(c, t, r.families) for c, t, r in own if r.n_licensed and r.families != ("" if c == "unknown" else c)]
    print("missed", [t for _, t, r in own if not r.n_licensed], "wrong", wrong, "misnamed", misnamed)
    named = found - len(misnamed)
    print(f"recall {found}/{len(own)}, precision {found}/{found + len(wrong)}, named {named}/{len(own)}")
    return found / len(own), found / (found + len(wrong)), named / len(own)


def test_sentences_are_no_templates():
    known = {t for many in licenses.TEMPLATES.values() for t in many} | set(licenses.COUNTER)
    assert not known & ({t for part in (HELD, BLIND) for many in part.values() for t in many} | set(OTHER) | set(BLIND_OTHER))


@pytest.mark.parametrize("licensed, other", [(HELD, OTHER), (BLIND, BLIND_OTHER)], ids=["seen", "blind"])
def test_recall_and_precision(spark, licensed, other):
    recall, precision, named = _figures(spark, licensed, other)
    assert recall >= 0.9 and precision >= 0.97 and named >= 0.75


def _family(text):
    """The class of a paragraph by plain sums over its n-grams; None if none."""
    weights, bias, least = licenses.trained()
    words = licenses._words(text)
    z = [sum(v) / licenses.SCALE for v in zip(bias, *(weights[g] for g in {*licenses._grams(words, 1), *licenses._grams(words, 2)} if g in weights), strict=True)]
    p = [math.exp(x - max(z)) for x in z]
    p = dict(zip(licenses.CLASSES, (x / sum(p) for x in p), strict=True))
    best = max((c for c in p if c not in ("unknown", licenses.NONE)), key=p.get)
    return None if p[licenses.NONE] >= 0.5 else best if p[best] >= max(least, p["unknown"]) else "unknown"


def test_paragraphs_without_an_anchor_are_judged(spark):
    bare = [
        "This library is free software under the LGPLv3.", "You may use this program under the AGPLv3.", "It is distributed under the terms of the LGPLv2.1.", "This code is relicensed under the terms of the project.",
        "You may use, copy and modify this software for any purpose.", "Released under the MPLv2.", "All rights reserved.", "Dedicated to the public domain.", "The weather was fine.", "This is it.", "",
    ]
    whole = "This program is free software: you can use and modify it\nunder the terms of GPL3."
    bare += [t for t in OTHER + BLIND_OTHER if not set(licenses.ANCHORS) & set(licenses._words(t))]
    assert not set(licenses.ANCHORS) & {w for t in [*bare, whole] for w in licenses._words(t)}
    rows = _judged(spark, [*bare, whole, "\n\n".join([bare[0], "Released under the MIT License.", bare[1], bare[8]])])
    assert [r.n_unanchored for r in rows[: len(bare)]] == [int(_family(t) is not None) for t in bare] and [r.n_unanchored for r in rows[:5]] == [1] * 5
    assert all((r.n_licensed, r.families) == (0, "") for r in rows[:-1])
    assert (rows[-2].n_unanchored, rows[-2].unanchored_families) == (1, "gpl")
    assert (rows[-1].n_licensed, rows[-1].families, rows[-1].n_unanchored) == (1, "mit", 2)


def test_rows_are_those_of_the_sql(spark, tmp_path):
    ends = ["", " ", "\n", "\u00a0", "\u00a0\n", "\u3000 \u2003", "\u2028", "\u200b", ".\u00a0", "\r\n\u00a0\n"]
    texts = [a + t + b for t in ("MIT License", "License: GPLv3", "licences", "This library is free software under the LGPLv3.") for a in ends for b in ends] + ["\u00a0" * 5, None, "", "MIT\u00a0License", "\x01", "\x02mit license"]
    spark.createDataFrame([(k if k % 5 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(con.execute(licenses.oracle_sql()).fetchall(), key=key)
    assert sorted(map(tuple, licenses.op2_license_scan(spark, str(tmp_path)).collect()), key=key) == want
    assert sum(r[1] for r in want) > 100
