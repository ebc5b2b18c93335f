"""License scans by sentence rules, with DataFrame functions only.

A text is normalised (letters and digits, lower case, single spaces), with marks at sentence ends and line breaks.
Known licence sentences are found from mark to mark, whatever marks are inside, so also where lines are wrapped or are
comments; their identifiers, in text order, are matched against ordered rules, whose sentences must all occur in that
order, with anything between them but the rule's first sentence again.  A rule that matches takes its sentences away, so
that a shorter rule does not see them: the text of one licence is one licence.  Nothing is shuffled.

Defined results: null and empty texts have no sentences and no licences; repeated rows give repeated rows; sentences
match wholly, so a known phrase inside a longer sentence is not recognised, unless it is a notice ("... under ...") that
follows its subject and is or are; extra columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised, by identifier.
SENTENCES = {
    "apache2_notice": "licensed under the apache license version 2 0",
    "apache2_grant": "licensed under the apache license version 2 0 the license",
    "apache2_comply": "you may not use this file except in compliance with the license",
    "apache2_copy": "you may obtain a copy of the license at",
    "apache2_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2_limits": "see the license for the specific language governing permissions and limitations under the license",
    "mit_notice": "released under the mit license",
    "mit_title": "the mit license",
    "mit_title_short": "mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3_notice": "this work is licensed under the gnu general public license version 3",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_details": "see the gnu general public license for more details",
    "cc_by_nc_notice": "licensed under cc by nc 4 0",
    "cc_by_notice": "licensed under cc by 4 0",
    "cc_by_sa_notice": "licensed under cc by sa 4 0",
    "cc0_notice": "released under cc0 1 0",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_as_is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "mpl2_notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mit_title_the": "the mit license mit",
    "mit_liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl_received": "you should have received a copy of the gnu general public license along with this program",
    "lgpl21_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21_free_program": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3_free_program": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl_hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl_details": "see the gnu lesser general public license for more details",
    "agpl3_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl_details": "see the gnu affero general public license for more details",
    "gpl2_notice": "licensed under the gnu general public license version 2",
    "lgpl21_notice": "licensed under the gnu lesser general public license version 2 1",
    "lgpl3_notice": "licensed under the gnu lesser general public license version 3",
    "agpl3_notice": "licensed under the gnu affero general public license version 3",
    "isc_title": "isc license",
    "isc_notice": "licensed under the isc license",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zero_bsd_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc_as_is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc_liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib_origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "zlib_altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "zlib_kept": "this notice may not be removed or altered from any source distribution",
    "zlib_notice": "licensed under the zlib license",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "unlicense_grant": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "epl1_notice": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at",
    "epl2_notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "epl2_short": "licensed under the eclipse public license 2 0",
    "boost_notice": "distributed under the boost software license version 1 0",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd_liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "mpl2_copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "cc_by_nd_notice": "licensed under cc by nd 4 0",
    "cc_by_nc_sa_notice": "licensed under cc by nc sa 4 0",
    "cc_by_nc_nd_notice": "licensed under cc by nc nd 4 0",
    "all_rights": "all rights reserved",
}
# Ordered rules; a licence may have several.  Longer forms stand first.  Sentences without a rule (all rights
# reserved, conditions and disclaimers by themselves) are named but make no licence.
RULES = (
    ("Apache-2.0", ("apache2_grant", "apache2_comply", "apache2_copy", "apache2_as_is", "apache2_limits")),
    ("Apache-2.0", ("apache2_grant", "apache2_comply", "apache2_as_is")),
    ("Apache-2.0", ("apache2_grant",)),
    ("Apache-2.0", ("apache2_notice",)),
    ("MIT", ("mit_title", "mit_grant", "mit_condition", "mit_as_is")),
    ("MIT", ("mit_title_the", "mit_grant", "mit_condition", "mit_as_is")),
    ("MIT", ("mit_title_short", "mit_grant", "mit_condition", "mit_as_is")),
    ("MIT", ("mit_grant", "mit_condition", "mit_as_is")),
    ("MIT", ("mit_notice",)),
    ("MIT", ("mit_title",)),
    ("MIT", ("mit_title_the",)),
    ("MIT", ("mit_title_short",)),
    ("AGPL-3.0-or-later", ("agpl3_free", "gpl_hope", "agpl_details")),
    ("LGPL-2.1-or-later", ("lgpl21_free", "lgpl_hope", "lgpl_details")),
    ("LGPL-3.0-or-later", ("lgpl3_free", "lgpl_hope", "lgpl_details")),
    ("LGPL-2.1-or-later", ("lgpl21_free_program", "gpl_hope", "lgpl_details")),
    ("LGPL-3.0-or-later", ("lgpl3_free_program", "gpl_hope", "lgpl_details")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope", "gpl_details")),
    ("GPL-2.0-or-later", ("gpl2_free", "gpl_hope", "gpl_details")),
    ("GPL-3.0-only", ("gpl3_notice",)),
    ("GPL-2.0-only", ("gpl2_notice",)),
    ("LGPL-2.1-only", ("lgpl21_notice",)),
    ("LGPL-3.0-only", ("lgpl3_notice",)),
    ("AGPL-3.0-only", ("agpl3_notice",)),
    ("CC-BY-NC-SA-4.0", ("cc_by_nc_sa_notice",)),
    ("CC-BY-NC-ND-4.0", ("cc_by_nc_nd_notice",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_notice",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_notice",)),
    ("CC-BY-ND-4.0", ("cc_by_nd_notice",)),
    ("CC-BY-4.0", ("cc_by_notice",)),
    ("CC0-1.0", ("cc0_notice",)),
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advertising", "bsd_endorse", "bsd_as_is")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_endorse", "bsd_as_is")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_as_is")),
    ("ISC", ("isc_grant", "isc_as_is")),
    ("ISC", ("isc_notice",)),
    ("ISC", ("isc_title",)),
    ("0BSD", ("zero_bsd_grant", "isc_as_is")),
    ("Zlib", ("zlib_as_is", "zlib_grant", "zlib_origin", "zlib_altered", "zlib_kept")),
    ("Zlib", ("zlib_notice",)),
    ("Unlicense", ("unlicense_free",)),
    ("EPL-1.0", ("epl1_notice",)),
    ("EPL-2.0", ("epl2_notice",)),
    ("EPL-2.0", ("epl2_short",)),
    ("BSL-1.0", ("boost_notice",)),
    ("BSL-1.0", ("boost_grant",)),
    ("MPL-2.0", ("mpl2_notice",)),
)
# Ends of sentences and lines, with words that begin a comment line.
MARKED = r"[\n\r]+(?:[ \t]*(?:REM|dnl)\b)?|[.!?;:]+[ \t]+"
START, SUBJECT = r"(?<=\| )", r"(?<= (?:is|are)(?: also| hereby)? )"
NOTICE = re.compile(r"(?:this work is )?(?:licensed|released) under ")


def _letters(known: dict[str, str]) -> dict[str, str]:
    """A letter for each identifier: a text's sentences are a word, and rules are patterns of words."""
    return {k: chr(0x4E00 + i) for i, k in enumerate(known)}


def _pattern(sentences: tuple[str, ...], letter: dict[str, str]) -> tuple[str, int]:
    """The pattern of a rule, with groups for what stands between its sentences, and the number of groups."""
    return f"([^{letter[sentences[0]]}]*?)".join(letter[k] for k in sentences), len(sentences) - 1


def _forms(known: dict[str, str]) -> tuple[dict[str, str], str]:
    """Identifiers by sentence, with the forms of notices after a subject, and the pattern that finds all of them.

    Longer sentences stand first, so that one is not taken for its own beginning.
    """
    ids = {v: k for k, v in known.items()}
    found = {v: START for v in ids}
    for sentence, k in list(ids.items()):
        if m := NOTICE.match(sentence):
            for verb in ("licensed", "released", "distributed"):
                form = f"{verb} under {sentence[m.end() :]}"
                found[form] = f"(?:{START}|{SUBJECT})" if form in found else SUBJECT
                ids.setdefault(form, k)
    longest = sorted(found, key=lambda x: (-len(x), x))
    either = lambda start: "|".join(v.replace(" ", r" (?:\| )?") for v in longest if start in found[v])
    return ids, f"(?:{START}(?:{either(START)})|(?=[lrd]){SUBJECT}(?:{either(SUBJECT)}))(?= \\|)"


def sentence_ids(text: Column, known: dict[str, str]) -> Column:
    """The identifiers of the known sentences of a text, in text order."""
    ids, pattern = _forms(known)
    table = F.create_map(*(F.lit(x) for v, k in ids.items() for x in (v, k)))
    marked = F.concat(F.lit("|"), F.regexp_replace(F.translate(text, "|", ","), MARKED, "|"), F.lit("|"))
    plain = F.lower(F.regexp_replace(F.regexp_replace(marked, "[^A-Za-z0-9|]+", " "), r" ?\|[ |]*", " | "))
    return F.transform(F.regexp_extract_all(plain, F.lit(pattern), F.lit(0)), lambda s: F.element_at(table, F.replace(s, F.lit("| "), F.lit(""))))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", known: dict[str, str] | None = None, rules: tuple = RULES) -> DataFrame:
    """keep columns, sentence_ids array<string> in text order, licences array<string> in rule order."""
    known = known or SENTENCES
    ids = docs.select(*(F.col(f"`{c}`") for c in keep), sentence_ids(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), known).alias("sentence_ids"))
    letter = _letters(known)
    table = F.create_map(*(F.lit(x) for k, c in letter.items() for x in (k, c)))
    word = F.array_join(F.transform("sentence_ids", lambda k: F.element_at(table, k)), "")
    patterns = [(name, *_pattern(sentences, letter)) for name, sentences in rules]
    ordered = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(p).alias("pattern"), F.lit("".join(f"${g + 1}" for g in range(n))).alias("rest")) for name, p, n in patterns))
    start = F.struct(word.alias("word"), F.array().cast("array<string>").alias("found"))
    met = lambda a, r: F.struct(F.regexp_replace(a["word"], r["pattern"], r["rest"]).alias("word"), F.when(F.rlike(a["word"], r["pattern"]), F.array_append(a["found"], r["name"])).otherwise(a["found"]).alias("found"))
    found = F.aggregate(ordered, start, met, lambda a: F.array_distinct(a["found"]))
    return ids.withColumn("licences", F.when(F.size("sentence_ids") == 0, F.array().cast("array<string>")).otherwise(found))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licences (comma-joined), licensed."""
    got = scan(docs)
    return got.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"), (F.size("licences") > 0).alias("licensed"))


def _sql() -> str:
    """The same normalisation and rules.  Every mark is doubled, for without looking around a match takes the marks at its ends."""
    forms, _ = _forms(SENTENCES)
    letter = _letters(SENTENCES)
    longest = sorted(forms, key=lambda x: (-len(x), x))
    subject = [v for v in longest if v.split(" ", 1)[0] in ("licensed", "released", "distributed") and NOTICE.match(SENTENCES[forms[v]])]
    whole = [v for v in longest if v in SENTENCES.values()]
    either = lambda texts: "|".join(v.replace(" ", r" (?:\| \| )?") for v in texts)
    pattern = rf"\| (?:{either(whole)}) \|| (?:is|are)(?: also| hereby)? (?:{either(subject)}) \|"
    ids = "map {" + ", ".join(f"'{v}': '{k}'" for v, k in forms.items()) + "}"
    letters = "map {" + ", ".join(f"'{k}': '{c}'" for k, c in letter.items()) + "}"
    steps = []
    for i, (name, sentences) in enumerate(RULES):
        p, n = _pattern(sentences, letter)
        steps.append(f"w{i + 1} AS (SELECT * EXCLUDE (word, raw), CASE WHEN regexp_matches(word, '{p}') THEN list_append(raw, '{name}') ELSE raw END AS raw, regexp_replace(word, '{p}', '{''.join(f'{chr(92)}{g + 1}' for g in range(n))}', 'g') AS word FROM w{i})")
    return f"""
WITH o AS (SELECT doc_id, '|' || regexp_replace(replace(coalesce(text, ''), '|', ','), '{MARKED}', '|', 'g') || '|' AS marked FROM documents),
p AS (SELECT doc_id, replace(lower(regexp_replace(regexp_replace(marked, '[^A-Za-z0-9|]+', ' ', 'g'), ' ?\\|[ |]*', ' | ', 'g')), ' | ', ' | | ') AS plain FROM o),
i AS (SELECT doc_id, list_transform(regexp_extract_all(plain, '{pattern}'), lambda m: ({ids})[replace(regexp_replace(m, '^(\\| | (is|are)( also| hereby)? )| \\|$', '', 'g'), ' | | ', ' ')]) AS ids FROM p),
w0 AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda k: ({letters})[k]), '') AS word, CAST([] AS VARCHAR[]) AS raw FROM i),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_filter(raw, lambda x, k: list_position(raw, x) = k), ',') AS licences, len(raw) > 0 AS licensed FROM w{len(RULES)}
"""


SQL = _sql()
