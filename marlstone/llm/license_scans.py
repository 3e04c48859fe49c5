"""License scans: known sentences of licences are recognised one by one, then their sequence is read by ordered rules; DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

# Sentences of public licences and of common notices, as they end at . ! ? ; : or a line's end. Each one's identifier is its place, from 1.
SENTENCES = (
    "Licensed under the Apache License, Version 2.0",
    'Licensed under the Apache License, Version 2.0 (the "License")',
    "you may not use this file except in compliance with the License",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "See the License for the specific language governing permissions and limitations under the License",
    "Released under the MIT License",
    "Licensed under the MIT License",
    "MIT License",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "This work is licensed under the GNU General Public License, version 3",
    "This program is free software",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "Licensed under CC BY-NC 4.0",
    "Licensed under CC BY 4.0",
    "Licensed under CC BY-SA 4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "All rights reserved",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
    "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide",
    "This is free and unencumbered software released into the public domain",
    "This library is free software",
)


@dataclass(frozen=True)
class LicenseRule:
    """A licence and the identifiers of sentences that state it, in order."""

    license: str
    kind: str
    sentences: tuple[int, ...]


# The first rule that fits takes its sentences, so longer ones stand before those they hold.
RULES = (
    LicenseRule("Apache-2.0", "permissive", (2, 3, 4, 5, 6)),
    LicenseRule("Apache-2.0", "permissive", (2, 3)),
    LicenseRule("Apache-2.0", "permissive", (1,)),
    LicenseRule("MIT", "permissive", (10, 11, 12)),
    LicenseRule("MIT", "permissive", (7,)),
    LicenseRule("MIT", "permissive", (8,)),
    LicenseRule("MIT", "permissive", (9,)),
    LicenseRule("BSD-3-Clause", "permissive", (13, 14, 15, 16)),
    LicenseRule("BSD-2-Clause", "permissive", (13, 14, 15)),
    LicenseRule("ISC", "permissive", (17,)),
    LicenseRule("GPL-3.0", "copyleft", (18,)),
    LicenseRule("GPL-3.0", "copyleft", (19, 20, 22)),
    LicenseRule("GPL-3.0", "copyleft", (19, 20)),
    LicenseRule("GPL-2.0", "copyleft", (19, 21, 22)),
    LicenseRule("GPL-2.0", "copyleft", (19, 21)),
    LicenseRule("CC-BY-NC-4.0", "restricted", (23,)),
    LicenseRule("CC-BY-4.0", "permissive", (24,)),
    LicenseRule("CC-BY-SA-4.0", "copyleft", (25,)),
    LicenseRule("CC-BY-4.0", "permissive", (26,)),
    LicenseRule("CC-BY-NC-4.0", "restricted", (27,)),
    LicenseRule("MPL-2.0", "copyleft", (28,)),
    LicenseRule("MPL-2.0", "copyleft", (29,)),
    LicenseRule("LGPL-3.0", "copyleft", (37, 31)),
    LicenseRule("LGPL-3.0", "copyleft", (19, 31)),
    LicenseRule("LGPL-2.1", "copyleft", (37, 32)),
    LicenseRule("LGPL-2.1", "copyleft", (19, 32)),
    LicenseRule("AGPL-3.0", "copyleft", (19, 33)),
    LicenseRule("EPL-2.0", "copyleft", (34,)),
    LicenseRule("CC0-1.0", "permissive", (35,)),
    LicenseRule("Unlicense", "permissive", (36,)),
    LicenseRule("reserved", "restricted", (30,)),
)
#: A notice that stands in most licences' headers: it counts only where no licence is found.
NOTICE = "reserved"
#: So many unknown sentences may stand between two of a rule, such as a number or a name; more end it.
GAP = 3

#: A sentence ends at a mark before white space or at a line's end; in a wrapped text at a mark or an empty line.
BY_LINES, WRAPPED = r"[.!?;:]+[ \t\r\n]+|[\r\n]+", r"[.!?;:]+[ \t\r\n]+|\n[ \t\r]*\n"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: str) -> str:
    """A-Z lower-cased; what is neither a letter of a-z nor a digit is one space."""
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(_UPPER, _LOWER))).strip(" ")


def _sentences(text: Column, ends: str) -> Column:
    clean = F.split(F.translate(text, _UPPER, _LOWER), ends)
    return F.filter(F.transform(clean, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))), lambda s: s != "")


def _known(sentences: Column) -> Column:
    """The sentences' identifiers, without unknown ones, as text: ,1,2, or a comma if none; a bar stands where more than GAP unknown ones do."""
    identifiers = F.create_map(*(F.lit(x) for i, s in enumerate(SENTENCES, 1) for x in (normalised(s), str(i))))
    found = F.transform(sentences, lambda s: F.coalesce(F.try_element_at(identifiers, s), F.lit("-")))
    marked = F.concat(F.lit(","), F.array_join(found, ","), F.lit(","))
    short = F.regexp_replace(F.regexp_replace(marked, rf"(?:(?<=,)-,){{{GAP + 1},}}", "|,"), r"(?<=,)-,", "")
    return F.when(F.regexp_like(marked, F.lit("[0-9]")), short).otherwise(",")


def _pattern(rule: LicenseRule) -> str:
    return f",{','.join(map(str, rule.sentences))},"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences, sentence_ids, wrapped_ids, licenses, kind) of each document; the identifiers are those of known sentences, read by lines and as wrapped text.

    licenses are those whose rule fits either sequence, with at most GAP unknown sentences between two of a rule, in the order of the rules, joined by commas; kind is the strictest: restricted, copyleft, permissive, or none.
    That all rights are reserved is a notice: it is reported, as restricted, only where no licence is found. Null and empty texts have no sentences and no licence; very long ones are read whole. Repeated rows and null ids are kept; other columns are dropped. Nothing is shuffled and no Python runs on executors.
    """
    found = docs.select(F.col(id_col), _sentences(text_of(text_col), BY_LINES).alias("lines"), _known(_sentences(text_of(text_col), WRAPPED)).alias("rest_1"))
    found = found.select(id_col, F.size("lines").cast("long").alias("n_sentences"), _known(F.col("lines")).alias("ids"), "rest_1").withColumn("rest_0", F.col("ids"))
    # each rule reads what the rules before it have left
    struct = F.struct("rest_0", "rest_1", F.array().cast("array<string>").alias("names"), F.array().cast("array<string>").alias("kinds"))
    rules = F.array(*(F.struct(F.lit(_pattern(r)).alias("pattern"), F.lit(r.license).alias("license"), F.lit(r.kind).alias("kind")) for r in RULES))

    def applied(state: Column, rule: Column) -> Column:
        fits = F.contains(state["rest_0"], rule["pattern"]) | F.contains(state["rest_1"], rule["pattern"])
        return F.struct(
            F.replace(state["rest_0"], rule["pattern"], F.lit(",")).alias("rest_0"),
            F.replace(state["rest_1"], rule["pattern"], F.lit(",")).alias("rest_1"),
            F.when(fits, F.array_append(state["names"], rule["license"])).otherwise(state["names"]).alias("names"),
            F.when(fits, F.array_append(state["kinds"], rule["kind"])).otherwise(state["kinds"]).alias("kinds"),
        )

    none = (F.col("rest_0") == ",") & (F.col("rest_1") == ",")
    state = F.when(~none, F.aggregate(rules, struct, applied))
    out = found.withColumn("ids_1", F.col("rest_1")).withColumn("state", state)
    # only the notice's rule is the last, so its kind stands at the end
    alone = F.size(F.array_distinct("state.names")) == 1
    names = F.when(alone, F.array_distinct("state.names")).otherwise(F.filter(F.array_distinct("state.names"), lambda n: n != NOTICE))
    kinds = F.when(alone | ~F.array_contains("state.names", NOTICE), F.col("state.kinds")).otherwise(F.slice("state.kinds", F.lit(1), F.size("state.kinds") - 1))
    kind = F.coalesce(*(F.when(F.array_contains(kinds, k), F.lit(k)) for k in ("restricted", "copyleft", "permissive")), F.lit("none"))
    plain = lambda ids: F.trim(F.replace(F.col(ids), F.lit("|,"), F.lit("")), F.lit(","))
    return out.select(id_col, "n_sentences", plain("ids").alias("sentence_ids"), plain("ids_1").alias("wrapped_ids"), F.coalesce(F.array_join(names, ","), F.lit("")).alias("licenses"), kind.alias("kind"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    known = ", ".join(f"('{normalised(s)}', '{i}')" for i, s in enumerate(SENTENCES, 1))
    steps, last = [], "s0"
    for i, r in enumerate(RULES, 1):
        p = _pattern(r)
        steps.append(f"s{i} AS (SELECT doc_id, n_sentences, ids, ids_1, replace(a, '{p}', ',') AS a, replace(b, '{p}', ',') AS b, CASE WHEN contains(a, '{p}') OR contains(b, '{p}') THEN list_append(hits, {i}) ELSE hits END AS hits FROM {last})")
        last = f"s{i}"
    names = "[" + ", ".join(f"'{r.license}'" for r in RULES) + "]"
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"

    def split(ends: str) -> str:
        return f"list_filter(list_transform(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{ends}'), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '')"

    def marked(column: str) -> str:
        return f"(SELECT ',' || string_agg(coalesce(i, '-'), ',' ORDER BY p) || ',' FROM (SELECT unnest({column}) AS s, generate_subscripts({column}, 1) AS p) x LEFT JOIN known USING (s))"

    def ids(column: str) -> str:
        # each unknown one is ';' first, so that its comma can't be part of an identifier's
        return f"coalesce(CASE WHEN regexp_matches({column}, '[0-9]') THEN replace(regexp_replace(replace({column}, '-,', ';'), ';{{{GAP + 1},}}', '|,', 'g'), ';', '') END, ',')"

    return f"""
WITH known(s, i) AS (VALUES {known}),
t AS (SELECT doc_id, {split(BY_LINES)} AS lines, {split(WRAPPED)} AS wrapped FROM documents),
q AS (SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_sentences, {marked("lines")} AS by_lines, {marked("wrapped")} AS as_wrapped FROM t),
s0 AS (SELECT doc_id, n_sentences, {ids("by_lines")} AS ids, {ids("as_wrapped")} AS ids_1, {ids("by_lines")} AS a, {ids("as_wrapped")} AS b, CAST([] AS INTEGER[]) AS hits FROM q),
{", ".join(steps)},
m AS (SELECT *, list_transform(hits, lambda h: {names}[h]) AS found FROM {last}),
n AS (SELECT doc_id, n_sentences, trim(replace(ids, '|,', ''), ',') AS sentence_ids, trim(replace(ids_1, '|,', ''), ',') AS wrapped_ids,
             list_filter(hits, lambda h: {names}[h] <> '{NOTICE}' OR len(list_distinct(found)) = 1) AS used FROM m),
o AS (SELECT *, list_transform(used, lambda h: {names}[h]) AS l, list_transform(used, lambda h: {kinds}[h]) AS k FROM n)
SELECT doc_id, n_sentences, sentence_ids, wrapped_ids, array_to_string(list_filter(l, lambda x, i: NOT list_contains(l[1 : i - 1], x)), ',') AS licenses,
       CASE WHEN list_contains(k, 'restricted') THEN 'restricted' WHEN list_contains(k, 'copyleft') THEN 'copyleft' WHEN list_contains(k, 'permissive') THEN 'permissive' ELSE 'none' END AS kind
FROM o
"""


OP6_SQL = _oracle()
