"""Licence scans by sentence rules, in DataFrame functions alone.

A text's sentences, whole on a line or wrapped over several, are normalised and looked up among known licence sentences; the sequence of identifiers found is then held
against rules, each an ordered list of identifiers that must follow one another, with others between them allowed.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sentences of public licences and notices, normalised (lower case, letters and digits, single spaces).
SENTENCES = {
    1: "this work is licensed under the gnu general public license version 3",
    2: "licensed under cc by nc 4 0",
    3: "released under the mit license",
    4: "licensed under the apache license version 2 0",
    5: "licensed under the apache license version 2 0 the license",
    6: "you may not use this file except in compliance with the license",
    7: "you may obtain a copy of the license at",
    8: "http www apache org licenses license 2 0",
    9: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    10: "see the license for the specific language governing permissions and limitations under the license",
    11: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    12: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    13: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    14: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    15: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    16: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    17: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    18: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    19: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    20: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    21: "see the gnu general public license for more details",
    22: "licensed under the mit license",
    23: "this work is licensed under a creative commons attribution 4 0 international license",
    24: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    25: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    26: "licensed under cc by 4 0",
    27: "licensed under cc by sa 4 0",
    28: "this is free and unencumbered software released into the public domain",
    29: "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    30: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    31: "this source code form is subject to the terms of the mozilla public license v 2 0",
    32: "spdx license identifier mit",
    33: "spdx license identifier apache 2 0",
    34: "spdx license identifier gpl 3 0 or later",
    35: "spdx license identifier gpl 3 0 only",
    36: "spdx license identifier bsd 3 clause",
    40: "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    41: "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    42: "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    43: "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    44: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    45: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2",
    46: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    47: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    48: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    49: "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    50: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    51: "see the gnu lesser general public license for more details",
    52: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    53: "see the gnu affero general public license for more details",
    54: "you should have received a copy of the gnu general public license along with this program",
    55: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    56: "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    57: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    59: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    60: "this software is provided as is without any express or implied warranty",
    61: "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    62: "distributed under the boost software license version 1 0",
    63: "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    64: "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    65: "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    66: "you just do what the fuck you want to",
    67: "this software is released under the mit license",
    68: "this project is licensed under the mit license",
    69: "this project is licensed under the apache license 2 0",
    70: "licensed under the apache license 2 0",
    71: "this project is licensed under the terms of the mit license",
    72: "this work is licensed under the creative commons attribution 4 0 international license",
    73: "this work is licensed under the creative commons attribution sharealike 4 0 international license",
    74: "this work is licensed under the creative commons attribution noncommercial 4 0 international license",
    75: "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    76: "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    77: "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    78: "licensed under cc by nc sa 4 0",
    79: "licensed under cc by nd 4 0",
    80: "licensed under cc by nc nd 4 0",
    81: "use of this source code is governed by a bsd style license that can be found in the license file",
    82: "use of this source code is governed by an mit style license that can be found in the license file",
    83: "released under the gnu general public license version 2",
    84: "released under the bsd license",
    85: "this source code form is subject to the terms of the mozilla public license v",
}
# Names that follow the tag of a file's licence; their sentences are numbered from 100 on.
TAGGED = (
    "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT-0", "MPL-2.0", "PostgreSQL", "Python-2.0", "Unlicense", "WTFPL", "Zlib", "0BSD", "Artistic-2.0", "EUPL-1.2", "CDDL-1.0",
)
TAGS = {100 + i: name for i, name in enumerate(TAGGED)}
SENTENCES |= {i: "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower()) for i, name in TAGS.items()}
# Rules by licence name; each is an ordered list of sentence identifiers. A rule that is part of a longer one that holds does not count.
RULES = (
    ("Apache-2.0", (4,)), ("Apache-2.0", (5, 6, 9, 10)), ("Apache-2.0", (33,)), ("BSD-2-Clause", (14, 15, 16)), ("BSD-3-Clause", (14, 15, 16, 17)),
    ("BSD-3-Clause", (36,)), ("CC-BY-4.0", (23,)), ("CC-BY-4.0", (26,)), ("CC-BY-NC-4.0", (2,)), ("CC-BY-NC-4.0", (25,)), ("CC-BY-SA-4.0", (24,)),
    ("CC-BY-SA-4.0", (27,)), ("GPL-2.0-or-later", (19, 20)), ("GPL-3.0", (1,)), ("GPL-3.0-only", (35,)), ("GPL-3.0-or-later", (18, 20)),
    ("GPL-3.0-or-later", (34,)), ("ISC", (30,)), ("MIT", (3,)), ("MIT", (11, 12, 13)), ("MIT", (22,)), ("MIT", (32,)), ("MPL-2.0", (31,)), ("Unlicense", (28, 29)),
    ("Apache-2.0", (69,)), ("Apache-2.0", (70,)), ("BSD-3-Clause", (14, 15, 16, 41)), ("BSD-3-Clause", (14, 15, 16, 42)), ("BSD-4-Clause", (14, 15, 16, 43, 17)),
    ("BSD-4-Clause", (14, 15, 16, 43, 42)), ("GPL-2.0-only", (45, 20)), ("GPL-2.0-only", (46, 20)), ("GPL-2.0-only", (83,)), ("LGPL-2.1-or-later", (47, 50)), ("LGPL-3.0-or-later", (48, 50)), ("LGPL-3.0-or-later", (49, 20)),
    ("AGPL-3.0-or-later", (52, 20)), ("MPL-2.0", (85,)), ("MPL-2.0", (85, 55)), ("MPL-2.0", (85, 56)), ("EPL-2.0", (57,)), ("Zlib", (60, 59)), ("BSL-1.0", (61,)), ("BSL-1.0", (62,)), ("CC0-1.0", (63,)), ("CC0-1.0", (64,)), ("WTFPL", (65, 66)),
    ("MIT", (67,)), ("MIT", (68,)), ("MIT", (71,)), ("CC-BY-4.0", (72,)), ("CC-BY-SA-4.0", (73,)), ("CC-BY-NC-4.0", (74,)), ("CC-BY-NC-SA-4.0", (75,)), ("CC-BY-ND-4.0", (76,)), ("CC-BY-NC-ND-4.0", (77,)),
    ("CC-BY-NC-SA-4.0", (78,)), ("CC-BY-ND-4.0", (79,)), ("CC-BY-NC-ND-4.0", (80,)), ("BSD-3-Clause", (81,)), ("MIT", (82,)), ("BSD-3-Clause", (84,)), *((name, (i,)) for i, name in TAGS.items()),
)
#: Every known sentence holds one of these, so that only texts with one are taken apart.
HINT = "(?i)licen[cs]|mpl|materials|law the author|fuck|permi|redistribut|warrant|public domain|anyone is free|copyright|software"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _part_of(ids: tuple[int, ...], more: tuple[int, ...]) -> bool:
    """Whether ids stand in more in the same order, and more is longer."""
    rest = iter(more)
    return len(ids) < len(more) and all(i in rest for i in ids)


def longer_rules(ids: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The rules that ids is part of."""
    return [more for _, more in RULES if _part_of(ids, more)]


def rule_pattern(ids: tuple[int, ...]) -> str:
    """Matches ',id,id,...,' where ids stand in this order."""
    return "," + ",([0-9]+,)*".join(map(str, ids)) + ","


#: A known sentence as it stands in normalised lines: whole, from line to line, no blank line inside. A short one goes before a
#: longer one that begins with it, so that a line which is a known sentence by itself stays one.
FOUND = "(?<![^\n])(?:" + "|".join(x.replace(" ", "[ \n]") for x in sorted(SENTENCES.values(), key=len)) + ")(?![^\n])"


def normalised(text: str) -> Column:
    """Lines of lower-case letters and digits with single spaces. Signs that begin a line (comments) go; a blank line follows . ! ?
    and white space (so version numbers stay whole), a new line ; : and white space, which may stand inside a sentence."""
    t = F.regexp_replace(F.translate(text, UPPER, LOWER), "(^|\n)[^a-z0-9\n]+", "$1")
    t = F.regexp_replace(t, "[.!?](?:[ \t\r\f\x0B]*\n|[ \t\r\f\x0B]+)", "\n\n")
    t = F.regexp_replace(t, "[;:][ \t\r\f\x0B]+(?=[^ \t\r\f\x0B\n])", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9\n]+", " "), " *\n *", "\n"))


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_known, sentence_ids, licences for each row of docs (doc_id, text).

    Of the rules that hold, those that are part of a longer one that holds do not count (two clauses of three).
    sentence_ids lists the known sentences in the order of the text, licences the names whose rule matches, sorted; both are
    comma-joined and empty where there is none, as for a null or empty text. Null ids and repeated rows are kept; other columns
    are ignored; an empty table gives an empty one. No shuffle and no Python: each text is looked through where it is read.
    """
    known = F.create_map(*(F.lit(x) for i, s in SENTENCES.items() for x in (s, i)))
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    rows = docs.select("doc_id", F.when(hinted, F.regexp_extract_all(normalised("text"), F.lit(FOUND), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("sentences"))
    rows = rows.select("doc_id", F.transform("sentences", lambda s: F.try_element_at(known, F.translate(s, "\n", " "))).alias("ids"))
    rows = rows.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("sentence_ids"))
    padded = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    longest = lambda ids: reduce(lambda a, more: a & ~padded.rlike(rule_pattern(more)), longer_rules(ids), padded.rlike(rule_pattern(ids)))
    names = F.array(*(F.when(longest(ids), F.lit(name)) for name, ids in RULES))
    found = F.when(F.col("n_known") > 0, F.array_join(F.array_sort(F.array_distinct(F.array_compact(names))), ",")).otherwise(F.lit(""))
    return rows.select("doc_id", "n_known", "sentence_ids", found.alias("licences"))


def _sql() -> str:
    known = ", ".join(f"('{s}', {i})" for i, s in SENTENCES.items())
    # '^$' matches no identifiers: a rule without a longer one
    rules = ", ".join(f"('{name}', '{rule_pattern(ids)}', '{'|'.join(map(rule_pattern, longer_rules(ids))) or '^$'}')" for name, ids in RULES)
    return f"""
with known(sentence, id) as (values {known}), rules(name, pattern, longer) as (values {rules}),
cut as (select doc_id, row_number() over () as r, string_split(regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
  '([.!?;:])[ \\t\\r\\f\\x0B]+', '\\1' || chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)) as s from documents),
parts as (select r, unnest(s) as sentence, unnest(range(len(s))) as nth from cut),
hits as (select r, count(*) as n, string_agg(cast(k.id as varchar), ',' order by nth) as ids from parts p join known k on trim(p.sentence, ' ') = k.sentence group by r),
named as (select r, string_agg(distinct name, ',' order by name) as licences from hits h join rules x on regexp_matches(',' || h.ids || ',', x.pattern) and not regexp_matches(',' || h.ids || ',', x.longer) group by r)
select c.doc_id, coalesce(h.n, 0) as n_known, coalesce(h.ids, '') as sentence_ids, coalesce(n.licences, '') as licences
from cut c left join hits h using (r) left join named n using (r)"""


SQL = _sql()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
