"""Licences by their sentences.

A text is normalised (lower case, runs of other characters than letters and digits become one space) between ends of
lines and sentences. Known licence sentences are found from one such end to another, also over ends within them: lines
may be wrapped anywhere, with comment marks, and a sentence may hold an abbreviation. The identifiers found, in the order of the text, are matched
against ordered rules, each a sequence of identifiers; a rule takes its sentences, so a later, shorter rule doesn't
report the same licence text again.

Defined cases: null and empty texts have no licence; sentences between those of a sequence do not break it unless they
are known themselves; a licence found several times is reported once; repeated rows are scanned one by one; an empty
table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices.
SENTENCES = (
    "Released under the MIT License",
    "Licensed under the MIT License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
    " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
    " permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "Licensed under the Apache License, Version 2.0",
    "you may not use this file except in compliance with the License",
    "You may obtain a copy of the License at",
    "This work is licensed under the GNU General Public License, version 3",
    "This program is free software",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free"
    " Software Foundation, either version 3 of the License, or (at your option) any later version",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free"
    " Software Foundation, either version 2 of the License, or (at your option) any later version",
    "Licensed under CC BY-NC 4.0",
    "Licensed under CC BY 4.0",
    "Licensed under CC BY-SA 4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission",
    "All rights reserved",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "This library is free software",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the"
    " Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the"
    " Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the"
    " Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by"
    " the Free Software Foundation",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
    " granted, provided that the above copyright notice and this permission notice appear in all copies",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted,"
    " provided that the above copyright notice and this permission notice appear in all copies",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"
    " which is available at https://www.eclipse.org/legal/epl-2.0/",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"
    " which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter"
    " it and redistribute it freely, subject to the following restrictions",
    "Distributed under the Boost Software License, Version 1.0",
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to"
    " this software to the public domain worldwide",
    "This is free and unencumbered software released into the public domain",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
)

#: Rules in order: licence and the numbers of its sentences, from 1.
RULES = (
    ("Apache-2.0", (21, 6, 7)),
    ("Apache-2.0", (5, 6, 7)),
    ("MIT", (3, 4)),
    ("GPL-3.0-or-later", (9, 10)),
    ("GPL-2.0-or-later", (9, 11)),
    ("BSD-3-Clause", (16, 17, 18)),
    ("BSD-2-Clause", (16, 17)),
    ("Apache-2.0", (5,)),
    ("MIT", (1,)),
    ("MIT", (2,)),
    ("MIT", (3,)),
    ("GPL-3.0-only", (8,)),
    ("GPL-3.0-or-later", (10,)),
    ("GPL-2.0-or-later", (11,)),
    ("CC-BY-NC-4.0", (12,)),
    ("CC-BY-4.0", (13,)),
    ("CC-BY-SA-4.0", (14,)),
    ("CC-BY-4.0", (15,)),
    ("MPL-2.0", (20,)),
    ("Apache-2.0", (21,)),
    ("LGPL-2.1-or-later", (22, 23)),
    ("LGPL-3.0-or-later", (22, 24)),
    ("LGPL-2.1-or-later", (9, 23)),
    ("LGPL-3.0-or-later", (9, 24)),
    ("LGPL-2.1-or-later", (23,)),
    ("LGPL-3.0-or-later", (24,)),
    ("AGPL-3.0-or-later", (9, 25)),
    ("AGPL-3.0-or-later", (25,)),
    ("GPL-2.0-only", (9, 26)),
    ("GPL-2.0-only", (26,)),
    ("ISC", (27,)),
    ("ISC", (28,)),
    ("0BSD", (29,)),
    ("EPL-1.0", (30,)),
    ("EPL-2.0", (31,)),
    ("EPL-2.0", (32,)),
    ("Zlib", (33,)),
    ("BSL-1.0", (34,)),
    ("CC0-1.0", (35,)),
    ("Unlicense", (36,)),
    ("CC-BY-SA-4.0", (37,)),
    ("CC-BY-NC-4.0", (38,)),
    ("CC-BY-ND-4.0", (39,)),
    ("CC-BY-NC-SA-4.0", (40,)),
    ("CC-BY-NC-ND-4.0", (41,)),
    ("LicenseRef-all-rights-reserved", (19,)),
)

# A file may also name any of these licences by its identifier.
_NAMED = tuple(dict.fromkeys(name for name, _ in RULES if not name.startswith("LicenseRef")))
RULES += tuple((name, (len(SENTENCES) + k,)) for k, name in enumerate(_NAMED, 1))
SENTENCES += tuple(f"SPDX-License-Identifier: {name}" for name in _NAMED)

#: Every known sentence has one of these; other texts need not be split.
HINT = r"(?i)licen[cs]e|permi|redistribut|free\W+software|copyright|all\W+rights|compliance|unencumbered"
#: Ends of sentences; the mark of an end is no part of a normalised sentence anyway.
END = r"[.!?:;][\x20\x09-\x0D]+|[.!?:;]$|\n+"


def normalised(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def sentence_ids(text: Column) -> Column:
    """Numbers of the known sentences in a text, in its order."""
    names = [normalised(s) for s in SENTENCES]
    parts = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(text, END, "\n")), "[^a-z0-9\n]+", " "), " ?\n[ \n]*", "\n")
    # words of a sentence are apart by a blank or by an end
    anywhere = "|".join(s.replace(" ", "[ \n]") for s in sorted(names, key=len, reverse=True))
    whole = F.concat(F.lit("\n"), F.btrim(parts), F.lit("\n"))
    found = F.regexp_extract_all(whole, F.lit(f"(?<=\n)(?:{anywhere})(?=\n)"), F.lit(0))
    known = F.array(*[F.lit(s) for s in names])
    numbers = F.transform(found, lambda s: F.array_position(known, F.translate(s, "\n", " ")))
    return F.when(text.rlike(HINT), numbers).otherwise(F.array().cast("array<bigint>"))


def licences(ids: Column) -> Column:
    """Licences whose sequences occur among the identifiers, by rule order, each once."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",,".join(map(str, seq)) + ",").alias("seq")) for name, seq in RULES])
    zero = F.struct(F.array_join(F.transform(ids, lambda i: F.concat(F.lit(","), i.cast("string"), F.lit(","))), "").alias("rest"), F.array().cast("array<string>").alias("names"))
    step = lambda a, r: F.struct(
        F.replace(a["rest"], r["seq"], F.lit("|")).alias("rest"),
        F.when(F.contains(a["rest"], r["seq"]), F.array_append(a["names"], r["name"])).otherwise(a["names"]).alias("names"),
    )
    return F.array_distinct(F.aggregate(rules, zero, step, lambda a: a["names"]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, licences): number of known sentences and the licences, comma-joined in rule order."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("ids", sentence_ids(F.col("text")))
    return df.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join(F.when(F.size("ids") > 0, licences(F.col("ids"))).otherwise(F.array().cast("array<string>")), ",").alias("licences"))
