"""Licence scans by sentence rules.

Sentences are normalised and looked up among known licence sentences; a text thus
becomes a sequence of sentence identifiers. Ordered rules are then matched against
the sequence: an earlier rule takes its identifiers away from later ones.

A line end inside a paragraph is white space and comment marks are no words, so notices
wrapped in source files read as published. A known sentence also counts as part of a
longer one, on whole words; after the word "not" it does not count.

All of it is built-in functions on one row. The tables are small fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterledger.llm.texts import spare

# Known sentences after normalisation, by identifier: the published wording up to where names or addresses
# follow. Fixed values.
SENTENCES = {
    "apache2Under": "licensed under the apache license version 2 0",
    "apache2Choice": "you may not use this file except in compliance with the license",
    "apache2Copy": "you may obtain a copy of the license at",
    "apache2Warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2Limits": "see the license for the specific language governing permissions and limitations under the license",
    "mitUnder": "released under the mit license",
    "mitLicensed": "licensed under the mit license",
    "mitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mitNotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mitWarranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mitLiability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "iscGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl3Work": "this work is licensed under the gnu general public license version 3",
    "gpl2Work": "this work is licensed under the gnu general public license version 2",
    "freeSoftware": "is free software",
    "gplTerms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgplTerms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "agplTerms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "version2OrLater": "either version 2 of the license or at your option any later version",
    "version21OrLater": "either version 2 1 of the license or at your option any later version",
    "version3OrLater": "either version 3 of the license or at your option any later version",
    "gnuHope": "is distributed in the hope that it will be useful but without any warranty",
    "gnuImplied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gplDetails": "see the gnu general public license for more details",
    "lgplDetails": "see the gnu lesser general public license for more details",
    "agplDetails": "see the gnu affero general public license for more details",
    "gplCopy": "you should have received a copy of the gnu general public license along with",
    "lgplCopy": "you should have received a copy of the gnu lesser general public license along with",
    "agplCopy": "you should have received a copy of the gnu affero general public license along with",
    "bsdUse": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsdSource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsdBinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsdNames": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsdWarranty": "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "mpl2Form": "this source code form is subject to the terms of the mozilla public license",
    "mpl2Obtain": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "ccBy4": "licensed under cc by 4 0",
    "ccBySa4": "licensed under cc by sa 4 0",
    "ccByNc4": "licensed under cc by nc 4 0",
    "ccByNcSa4": "licensed under cc by nc sa 4 0",
    "ccByNd4": "licensed under cc by nd 4 0",
    "ccBy4Long": "licensed under a creative commons attribution 4 0 international license",
    "ccBySa4Long": "licensed under a creative commons attribution sharealike 4 0 international license",
    "ccByNc4Long": "licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0Waive": "has waived all copyright and related or neighboring rights to",
    "spdxApache2": "spdx license identifier apache 2 0",
    "spdxMit": "spdx license identifier mit",
    "spdxBsd2": "spdx license identifier bsd 2 clause",
    "spdxBsd3": "spdx license identifier bsd 3 clause",
    "spdxGpl2": "spdx license identifier gpl 2 0 only",
    "spdxGpl2Later": "spdx license identifier gpl 2 0 or later",
    "spdxGpl3": "spdx license identifier gpl 3 0 only",
    "spdxGpl3Later": "spdx license identifier gpl 3 0 or later",
    "spdxMpl2": "spdx license identifier mpl 2 0",
    "allRights": "all rights reserved",
}

_HOPE = ("gnuHope", "gnuImplied")

# Rules in order: a licence and the sentence identifiers that must follow one another. Fixed values.
RULES = (
    ("Apache-2.0", ("apache2Under", "apache2Choice", "apache2Copy", "apache2Warranty", "apache2Limits")),
    ("Apache-2.0", ("apache2Under", "apache2Choice", "apache2Copy")),
    ("Apache-2.0", ("apache2Under", "apache2Choice")),
    ("Apache-2.0", ("apache2Under",)),
    ("Apache-2.0", ("spdxApache2",)),
    ("MIT", ("mitGrant", "mitNotice", "mitWarranty", "mitLiability")),
    ("MIT", ("mitGrant", "mitNotice")),
    ("MIT", ("mitUnder",)),
    ("MIT", ("mitLicensed",)),
    ("MIT", ("mitGrant",)),
    ("MIT", ("spdxMit",)),
    ("ISC", ("iscGrant",)),
    ("GPL-3.0-or-later", ("freeSoftware", "gplTerms", "version3OrLater", *_HOPE, "gplDetails", "gplCopy")),
    ("GPL-3.0-or-later", ("freeSoftware", "gplTerms", "version3OrLater")),
    ("GPL-3.0-or-later", ("spdxGpl3Later",)),
    ("GPL-2.0-or-later", ("freeSoftware", "gplTerms", "version2OrLater", *_HOPE, "gplDetails", "gplCopy")),
    ("GPL-2.0-or-later", ("freeSoftware", "gplTerms", "version2OrLater")),
    ("GPL-2.0-or-later", ("spdxGpl2Later",)),
    ("GPL-3.0", ("gpl3Work",)),
    ("GPL-3.0", ("spdxGpl3",)),
    ("GPL-2.0", ("gpl2Work",)),
    ("GPL-2.0", ("spdxGpl2",)),
    ("LGPL-3.0-or-later", ("freeSoftware", "lgplTerms", "version3OrLater", *_HOPE, "lgplDetails", "lgplCopy")),
    ("LGPL-3.0-or-later", ("freeSoftware", "lgplTerms", "version3OrLater")),
    ("LGPL-2.1-or-later", ("freeSoftware", "lgplTerms", "version21OrLater", *_HOPE, "lgplDetails", "lgplCopy")),
    ("LGPL-2.1-or-later", ("freeSoftware", "lgplTerms", "version21OrLater")),
    ("AGPL-3.0-or-later", ("freeSoftware", "agplTerms", "version3OrLater", *_HOPE, "agplDetails", "agplCopy")),
    ("AGPL-3.0-or-later", ("freeSoftware", "agplTerms", "version3OrLater")),
    ("BSD-3-Clause", ("bsdUse", "bsdSource", "bsdBinary", "bsdNames", "bsdWarranty")),
    ("BSD-3-Clause", ("bsdUse", "bsdSource", "bsdBinary", "bsdNames")),
    ("BSD-3-Clause", ("spdxBsd3",)),
    ("BSD-2-Clause", ("bsdUse", "bsdSource", "bsdBinary", "bsdWarranty")),
    ("BSD-2-Clause", ("bsdUse", "bsdSource", "bsdBinary")),
    ("BSD-2-Clause", ("spdxBsd2",)),
    ("MPL-2.0", ("mpl2Form", "mpl2Obtain")),
    ("MPL-2.0", ("spdxMpl2",)),
    ("CC-BY-NC-SA-4.0", ("ccByNcSa4",)),
    ("CC-BY-NC-4.0", ("ccByNc4",)),
    ("CC-BY-NC-4.0", ("ccByNc4Long",)),
    ("CC-BY-SA-4.0", ("ccBySa4",)),
    ("CC-BY-SA-4.0", ("ccBySa4Long",)),
    ("CC-BY-ND-4.0", ("ccByNd4",)),
    ("CC-BY-4.0", ("ccBy4",)),
    ("CC-BY-4.0", ("ccBy4Long",)),
    ("CC0-1.0", ("cc0Waive",)),
)

#: Comment marks at the start of a line, taken out first.
MARKS = r"\n[ \t]*[#*/;%!-]+"
#: A sentence ends at a blank line, or after a sign and white space.
BREAK = r"\n[ \t\r]*\n|[.!?;][ \t\r\n]+"
#: Every known sentence has one of these words, so other sentences need no lookup.
HINTS = ("licen", "rights", "redistribut", "software", "copy", "warrant")
#: Known sentences as whole words, of two that begin alike the longer one first; "not" before one is taken along.
KNOWN = r"\b((?:not )?(?:" + "|".join(sorted(SENTENCES.values(), reverse=True)) + r"))\b"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(sentence: Column) -> Column:
    """A-Z in lower case; runs of other signs than letters and digits become one blank."""
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, UPPER.lower()), r"[^a-z0-9]+", " "))


def identifier_sequence(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order, each between blanks."""
    known = F.create_map(*[F.lit(v) for name, sentence in SENTENCES.items() for v in (sentence, name)])
    hint = "(?i)" + "|".join(HINTS)
    unmarked = F.regexp_replace(F.concat(F.lit("\n"), text), MARKS, "\n")
    hinted = F.filter(F.split(unmarked, BREAK), lambda s: s.rlike(hint))
    found = F.flatten(F.transform(hinted, lambda s: F.regexp_extract_all(normalised(s), F.lit(KNOWN), 1)))
    names = F.filter(F.transform(found, lambda s: F.element_at(known, s)), lambda n: n.isNotNull())
    # Two blanks between identifiers, so that neighbours can both be replaced.
    return F.when(text.rlike(hint), F.concat(F.lit(" "), F.array_join(names, "  "), F.lit(" "))).otherwise("  ")


def scanned(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` with (sentence_ids, licenses, unmatched_ids).

    ``licenses`` has one entry for each rule that matched, in the order of the text;
    ``unmatched_ids`` are known sentences that no rule took. A text without known
    sentences, an empty and a null one get empty results. Repeated rows are scanned each;
    columns of these three names are overwritten, all others stay. No shuffle.
    """
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    ids, rest = spare("_ids", docs.columns), spare("_left", docs.columns)
    rows = docs.withColumn(ids, identifier_sequence(text))
    left = F.col(ids)
    for license_name, names in RULES:
        left = F.replace(left, F.lit(" " + "  ".join(names) + " "), F.lit(f" ={license_name} "))
    rows = rows.withColumn(rest, left)
    return rows.withColumns(
        {
            "sentence_ids": F.trim(F.replace(ids, F.lit("  "), F.lit(" "))),
            "licenses": F.array_join(F.regexp_extract_all(rest, F.lit(r"=(\S+)"), 1), ", "),
            "unmatched_ids": F.array_join(F.regexp_extract_all(rest, F.lit(r" ([^ =]+)"), 1), " "),
        }
    ).drop(ids, rest)


def scan_sql() -> str:
    """The same for DuckDB, over the table ``documents``."""
    known = ", ".join(f"'{sentence}': '{name}'" for name, sentence in SENTENCES.items())
    left = "ids"
    for license_name, names in RULES:
        left = f"replace({left}, ' {'  '.join(names)} ', ' ={license_name} ')"
    return rf"""
    with known as (select map {{{known}}} as names),
    sentences as (
      select doc_id, list_transform(
        regexp_split_to_array(regexp_replace(chr(10) || coalesce(text, ''), '{MARKS}', chr(10), 'g'), '{BREAK}'),
        lambda s: trim(regexp_replace(translate(s, '{UPPER}', '{UPPER.lower()}'), '[^a-z0-9]+', ' ', 'g'))) as cut
      from documents),
    listed as (
      select doc_id, list_filter(list_transform(
        flatten(list_transform(cut, lambda s: regexp_extract_all(s, '{KNOWN}', 1))),
        lambda s: names[s]), lambda n: n is not null) as found
      from sentences, known),
    joined as (select doc_id, ' ' || coalesce(array_to_string(found, '  '), '') || ' ' as ids from listed),
    matched as (select doc_id, ids, {left} as rest from joined)
    select doc_id, trim(replace(ids, '  ', ' ')) as sentence_ids,
      coalesce(array_to_string(regexp_extract_all(rest, '=(\S+)', 1), ', '), '') as licenses,
      coalesce(array_to_string(regexp_extract_all(rest, ' ([^ =]+)', 1), ' '), '') as unmatched_ids
    from matched"""
