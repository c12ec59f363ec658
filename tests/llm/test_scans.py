import datetime

from compare import compare, connect
from tables import SMALL, documents  # noqa: F401

from lanternfish.llm import license_scan, queries, url_filter


def test_licences(documents):  # noqa: F811
    mit = license_scan.SENTENCES[2] + ":\n" + license_scan.SENTENCES[3] + "."
    rows = [
        (1, None), (2, ""), (3, "Some text. Released under the  MIT license!\nmore"), (4, mit + " " + mit), (5, "permission to play"),
        (6, "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nx"),
        (7, "Licensed under the Apache License, Version 2.0;\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\nhttp://x"),
        (8, "All rights reserved. " * 5000), (9, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ]
    got = {r["doc_id"]: (r["n_sentences"], r["licences"]) for r in license_scan.scan(documents(rows)).collect()}
    assert got[1] == got[2] == got[5] == (0, "")
    assert got[3] == (1, "MIT") and got[4] == (4, "MIT") and got[6] == (3, "Apache-2.0") and got[7] == (3, "Apache-2.0")
    assert got[8] == (5000, "LicenseRef-all-rights-reserved") and got[9] == (2, "GPL-2.0-or-later")


def test_every_sentence_has_a_hint_and_is_normalised_alike():
    import re

    for sentence in license_scan.SENTENCES:
        assert re.search(license_scan.HINT, sentence) or "free software" in sentence.lower(), sentence
        assert license_scan.normalised(sentence) == license_scan.normalised("  " + sentence.upper() + "...")
    assert all(1 <= i <= len(license_scan.SENTENCES) for _, seq in license_scan.RULES for i in seq)


def test_every_rule_finds_its_wrapped_sentences(documents):  # noqa: F811
    import textwrap

    rows, wanted = [], {}
    for k, (name, seq) in enumerate(license_scan.RULES):
        text = "Copyright 2020 Some One. " + " ".join(license_scan.SENTENCES[i - 1] + "." for i in seq) + " And more follows."
        for w, (width, mark) in enumerate(((40, ""), (72, " * "), (76, "# "), (10**6, ""))):
            rows.append((10 * k + w, "\n".join(mark + x for x in textwrap.wrap(text, width))))
            wanted[10 * k + w] = (len(seq), name)
    got = {r["doc_id"]: (r["n_sentences"], r["licences"]) for r in license_scan.scan(documents(rows)).collect()}
    assert got == wanted


def test_published_headers(documents, spark, tmp_path):  # noqa: F811
    """Notices as they are published, in comments and wrapped; the SQL twin finds the same."""
    notices = {
        "Apache-2.0": """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */""",
        "LGPL-2.1-or-later": """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,""",
        "AGPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.""",
        "ISC": """Copyright (c) 2020, Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
        "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.""",
        "EPL-2.0": """ * This program and the accompanying materials are made available under the
 * terms of the Eclipse Public License 2.0 which is available at
 * https://www.eclipse.org/legal/epl-2.0/
 *
 * SPDX-License-Identifier: EPL-2.0""",
        "Zlib": """Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented;""",
        "BSL-1.0": """// Distributed under the Boost Software License, Version 1.0.
//    (See accompanying file LICENSE_1_0.txt or copy at
//          https://www.boost.org/LICENSE_1_0.txt)""",
        "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain
worldwide. This software is distributed without any warranty.""",
        "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or""",
        "MIT": "# SPDX-License-Identifier: MIT\nimport os\n",
        "": "This is free and encumbered software. The library is free; you can use it under any license named MIT.",
    }
    docs = documents(list(enumerate(notices.values())))
    got = {r["doc_id"]: r["licences"] for r in license_scan.scan(docs).collect()}
    assert got == dict(enumerate(notices))
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    verdict = compare(spark, connect(str(tmp_path)), "op7_license_scan", queries.QUERIES["op7_license_scan"], queries.SQL_TWINS["op7_license_scan"], str(tmp_path))
    assert verdict.startswith("ok"), verdict


def test_url_lists(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    entries = spark.createDataFrame(
        [
            ("host:bad.com", "add", day(10), 1), ("host:bad.com", "remove", day(40), 2), ("host:bad.com", "add", day(40), 3), ("host:bad.com", "remove", day(50), 4),
            ("path:ok.com/ads", "add", day(0), 5), ("host:late.com", "add", day(99), 6), (None, "add", day(1), 7), ("host:x.com", "add", None, 8), ("host:c.com", "add", day(2), 9), ("host:c.com", "remove", day(2), 10),
        ],
        "pattern string, action string, dated_on date, seq long",
    )
    asked = [
        ("http://bad.com/", 9, False), ("https://User@WWW.Bad.com.:80/x?y", 10, True), ("http://a.b.bad.com", 45, True), ("http://bad.com", 50, False),
        ("http://notbad.com", 20, False), ("http://ok.com/ads/1#f", 70, True), ("http://ok.com/adsense", 70, False), ("http://late.com", 98, False),
        (None, 20, False), ("bad.com", 20, False), ("http://bad.com/" + "a/" * 3000, 20, True), ("http://c.com", 3, False), ("http://bad.com", None, False), ("http://bad.com", None, False),
    ]
    captures = spark.createDataFrame([(k, u, None if d is None else day(d), "z") for k, (u, d, _) in enumerate(asked)], "page_id long, url string, fetched_on date, u string")
    out = url_filter.block(captures, entries)
    assert out.columns == ["page_id", "url", "fetched_on", "u", "blocked", "pattern"]
    got = {r["page_id"]: r["blocked"] for r in out.collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(asked)}
    assert url_filter.block(captures.where("false"), entries).count() == 0
    assert url_filter.block(captures.where("fetched_on is null"), entries).where("blocked").count() == 0
    far = captures.union(spark.createDataFrame([(99, "http://late.com", datetime.date(9000, 1, 1), "z")], captures.schema))
    got = {r["page_id"]: r["blocked"] for r in url_filter.block(far, entries).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(asked)} | {99: True}
    assert url_filter.block(captures, entries.where("false")).where("blocked").count() == 0


def test_same_as_sql(spark):
    for name in ("op1_url_filter", "op7_license_scan"):
        verdict = compare(spark, connect(SMALL), name, queries.QUERIES[name], queries.SQL_TWINS[name], SMALL)
        assert verdict.startswith("ok"), (name, verdict)
