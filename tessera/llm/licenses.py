"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, which are normalised: lower case, one spelling of "license", signs
other than letters, digits, dots, plus and slash become a blank. Comment marks at the start and end of lines are
taken out before, so a commented header reads as the plain one. Sentences with a licence word or a fixed part of a
known licence sentence are mapped to the identifiers of known licence sentences. The identifiers of a text, in order, are then matched
against rules, sequences of identifiers, the longest statements first; what a rule has matched is
taken out, so a licence's full text does not count again as a mere mention.

All of it is a function of one row: no shuffle, no state. A line break is a blank unless the line
after it is empty, so wrapped sentences stay whole. A null or empty text has no licences; repeated
mentions count once in ``licenses``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from re import _constants as parts, _parser as patterns

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of which a licence sentence holds at least one.
WORDS = ("license", "licence", "licensed", "copyright", "spdx", "rights reserved", "public domain", "permission",
         "redistribution", "warranty", "creative commons", "cc by", "cc0", "without restriction", "endorse")

# Public licence sentences as patterns over normalised sentences, with our identifiers.
SENTENCES = (
    ("SpdxMIT", r"spdx license identifier mit( |$)"),
    ("SpdxApache2", r"spdx license identifier apache 2\.0"),
    ("SpdxBSD3", r"spdx license identifier bsd 3 clause"),
    ("SpdxBSD2", r"spdx license identifier bsd 2 clause"),
    ("SpdxGPL2plus", r"spdx license identifier gpl 2\.0(\+| or later)"),
    ("SpdxGPL2", r"spdx license identifier gpl 2\.0( only)?$"),
    ("SpdxGPL3plus", r"spdx license identifier gpl 3\.0(\+| or later)"),
    ("SpdxGPL3", r"spdx license identifier gpl 3\.0( only)?$"),
    ("SpdxMPL2", r"spdx license identifier mpl 2\.0"),
    ("GrantMIT", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("KeepNotice", r"the above copyright notice and this permission notice shall be included"),
    ("AsIs", r"the software is provided as is without warranty of any kind"),
    ("NoLiability", r"in no event shall the (authors|copyright)"),
    ("GrantISC", r"permission to use copy modify and/or distribute this software for any purpose with or without fee"),
    ("AsIsISC", r"the software is provided as is and the author disclaims all warranties"),
    ("RedistBoth", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("NoEndorse", r"neither the name of .* may be used to endorse or promote products"),
    ("AsIsBSD", r"this software is provided by the (copyright holders|authors?|regents).* as is"),
    ("NoticeApache", r"you may not use this file except in compliance with the license"),
    ("RefApache2", r"apache license,? (version |v)?2\.0"),
    ("WarrantyApache", r"distributed under the license is distributed on an as is basis"),
    ("LaterAGPL3", r"affero general public license .*version 3.*any later version"),
    ("LaterLGPL", r"lesser general public license .*any later version"),
    ("LaterGPL2", r"gnu general public license .*version 2 .*any later version"),
    ("LaterGPL3", r"gnu general public license .*version 3 .*any later version"),
    ("RefAGPL3", r"affero general public license( version 3| v3|$)"),
    ("RefLGPL3", r"lesser general public license( version 3| v3)"),
    ("RefLGPL21", r"lesser general public license( version 2\.1| v2\.1)"),
    ("RefGPL2", r"gnu general public license( version 2| v2)( |$)"),
    ("RefGPL3", r"gnu general public license( version 3| v3)( |$)"),
    ("RefMPL2", r"mozilla public license( version | v\.? ?| )2\.0"),
    ("RefMIT", r"(under|by|to) (the )?(terms of the )?mit license"),
    ("RefBSD3", r"(3|three) clause bsd license|bsd 3 clause"),
    ("RefBSD2", r"(2|two) clause bsd license|bsd 2 clause"),
    ("RefISC", r"under (the )?(terms of the )?isc license"),
    ("RefBoost", r"boost software license version 1\.0"),
    ("RefEPL2", r"eclipse public license (version |v )?2\.0"),
    ("RefCC0", r"cc0 1\.0|creative commons zero"),
    ("RefCCBYNCND4", r"cc by nc nd 4\.0|attribution noncommercial noderivatives 4\.0"),
    ("RefCCBYNCSA4", r"cc by nc sa 4\.0|attribution noncommercial sharealike 4\.0"),
    ("RefCCBYNC4", r"cc by nc 4\.0|attribution noncommercial 4\.0"),
    ("RefCCBYSA4", r"cc by sa 4\.0|attribution sharealike 4\.0"),
    ("RefCCBYND4", r"cc by nd 4\.0|attribution noderivatives 4\.0"),
    ("RefCCBY4", r"cc by 4\.0|attribution 4\.0"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain"),
    ("PublicDomain", r"(in|into|to) the public domain"),
    ("AllRights", r"all rights reserved"),
)

# Sequences of sentence identifiers and the licence that each states, in order of precedence.
RULES = (
    ("MIT", ("GrantMIT", "KeepNotice", "AsIs", "NoLiability")),
    ("MIT", ("GrantMIT", "KeepNotice", "AsIs")),
    ("MIT", ("GrantMIT", "KeepNotice")),
    ("ISC", ("GrantISC", "AsIsISC")),
    ("BSD-3-Clause", ("RedistBoth", "NoEndorse", "AsIsBSD")),
    ("BSD-3-Clause", ("RedistBoth", "NoEndorse")),
    ("BSD-2-Clause", ("RedistBoth", "AsIsBSD")),
    ("Apache-2.0", ("RefApache2", "NoticeApache", "WarrantyApache")),
    ("Apache-2.0", ("RefApache2", "NoticeApache")),
    ("Apache-2.0", ("RefApache2", "WarrantyApache")),
    ("Unlicense", ("Unlicense", "PublicDomain")),
    ("AGPL-3.0-or-later", ("LaterAGPL3", "RefAGPL3")),
    ("GPL-2.0-or-later", ("LaterGPL2", "RefGPL2")),
    ("GPL-3.0-or-later", ("LaterGPL3", "RefGPL3")),
    ("ISC", ("GrantISC",)),
    ("BSD-2-Clause", ("RedistBoth",)),
    ("MIT", ("SpdxMIT",)), ("MIT", ("RefMIT",)),
    ("Apache-2.0", ("SpdxApache2",)), ("Apache-2.0", ("RefApache2",)),
    ("BSD-3-Clause", ("SpdxBSD3",)), ("BSD-3-Clause", ("RefBSD3",)),
    ("BSD-2-Clause", ("SpdxBSD2",)), ("BSD-2-Clause", ("RefBSD2",)),
    ("AGPL-3.0-or-later", ("LaterAGPL3",)), ("AGPL-3.0", ("RefAGPL3",)),
    ("LGPL", ("LaterLGPL",)), ("LGPL-3.0", ("RefLGPL3",)), ("LGPL-2.1", ("RefLGPL21",)),
    ("GPL-2.0-or-later", ("SpdxGPL2plus",)), ("GPL-2.0-or-later", ("LaterGPL2",)),
    ("GPL-2.0", ("SpdxGPL2",)), ("GPL-2.0", ("RefGPL2",)),
    ("GPL-3.0-or-later", ("SpdxGPL3plus",)), ("GPL-3.0-or-later", ("LaterGPL3",)),
    ("GPL-3.0", ("SpdxGPL3",)), ("GPL-3.0", ("RefGPL3",)),
    ("MPL-2.0", ("SpdxMPL2",)), ("MPL-2.0", ("RefMPL2",)),
    ("ISC", ("RefISC",)), ("BSL-1.0", ("RefBoost",)), ("EPL-2.0", ("RefEPL2",)), ("CC0-1.0", ("RefCC0",)),
    ("CC-BY-NC-ND-4.0", ("RefCCBYNCND4",)), ("CC-BY-NC-SA-4.0", ("RefCCBYNCSA4",)), ("CC-BY-NC-4.0", ("RefCCBYNC4",)),
    ("CC-BY-SA-4.0", ("RefCCBYSA4",)), ("CC-BY-ND-4.0", ("RefCCBYND4",)), ("CC-BY-4.0", ("RefCCBY4",)),
    ("Unlicense", ("Unlicense",)), ("public-domain", ("PublicDomain",)), ("all-rights-reserved", ("AllRights",)),
)

# Marks that open a line of a comment, and marks that close one; "rem", "dnl" and ".\\"" are those of scripts and manuals.
OPENS = r'(?m)^[ \t]*(?:/\*+!?|\*+/?|//+!?|#+!?|--+|;+|%+|<!--+|\.?\\"|@?rem(?=[ \t\r]|$)|dnl(?=[ \t\r]|$))[ \t]*'
CLOSES = r"(?m)[ \t]*(?:\*+/|--+>)[ \t\r]*$"


def _fixed(pattern) -> list[str]:
    """Texts of which whatever the pattern matches holds at least one, as long as the pattern allows."""
    choices, run = [[""]], ""
    for kind, value in [*pattern, (None, None)]:
        if kind is parts.LITERAL:
            run += chr(value)
            continue
        choices.append([run])
        run = ""
        if kind is parts.SUBPATTERN:
            choices.append(_fixed(value[-1]))
        elif kind is parts.BRANCH:
            choices.append([x for one in value[1] for x in _fixed(one)])
    return max(choices, key=lambda c: min(map(len, c)))


FIXED = tuple(sorted({x for _, p in SENTENCES for x in _fixed(patterns.parse(p))}))
# The longest word of each, for whole texts, where a line break or sign may stand between words.
LONGEST = tuple(sorted({max(re.findall(r"[a-z0-9]+", x), key=len) for x in FIXED}))


def _has_word(text: Column, more: tuple[str, ...] = ()) -> Column:
    found = F.lit(False)
    for word in (*WORDS, *more):
        found = found | F.contains(text, F.lit(word))
    return found


def sentences(text: Column) -> Column:
    """Normalised sentences of a text in lower case."""
    one = F.regexp_replace(F.regexp_replace(text, CLOSES, ""), OPENS, "")
    one = F.regexp_replace(one, r"\n[ \t\r]*\n", "\u0001")
    one = F.regexp_replace(one, r"[ \t\r\n]+", " ")
    one = F.regexp_replace(one, r"([.!?]) ", "$1\u0001")
    one = F.replace(one, F.lit("licence"), F.lit("license"))
    one = F.regexp_replace(one, "[^a-z0-9.+/\u0001]+", " ")
    return F.transform(F.split(one, "\u0001"), lambda s: F.regexp_replace(s, r"^[. ]+|[. ]+$", ""))


def identifiers(sentence: Column) -> Column:
    """Identifiers of the known sentences that a normalised sentence holds."""
    known = F.array(*[F.when(sentence.rlike(pattern), F.lit(name)) for name, pattern in SENTENCES])
    return F.filter(known, lambda x: x.isNotNull())


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_licenses`` and ``_sentences`` (arrays) and ``_unknown``, licence sentences not known."""
    rows = docs.withColumn("_lower", F.lower(F.coalesce(F.col(text), F.lit(""))))
    spoken = F.filter(sentences(F.col("_lower")), lambda s: _has_word(s, FIXED))
    each = F.transform(spoken, lambda s: F.struct(identifiers(s).alias("ids"), _has_word(s).alias("word")))
    rows = rows.withColumn("_each", F.when(_has_word(F.replace(F.col("_lower"), F.lit("licence"), F.lit("license")), LONGEST),
                                           each).otherwise(F.array().cast("array<struct<ids: array<string>, word: boolean>>")))
    rows = rows.drop("_lower").withColumn("_sentences", F.flatten("_each.ids")).withColumn(
        "_unknown", F.size(F.filter("_each", lambda x: x["word"] & (F.size(x["ids"]) == 0)))).drop("_each")
    rules = F.array(*[F.struct(F.lit("".join(f"<{s}>" for s in sequence)).alias("sequence"), F.lit(name).alias("license"))
                      for name, sequence in RULES])
    start = F.struct(F.concat(F.lit(""), F.array_join(F.transform("_sentences", lambda s: F.concat(
        F.lit("<"), s, F.lit(">"))), "")).alias("left"), F.array().cast("array<string>").alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["sequence"])
        return F.struct(F.replace(state["left"], rule["sequence"], F.lit("|")).alias("left"),
                        F.when(hit, F.array_append(state["found"], rule["license"])).otherwise(state["found"]).alias("found"))

    found = F.when(F.size("_sentences") > 0, F.aggregate(rules, start, apply)["found"]).otherwise(
        F.array().cast("array<string>"))
    return rows.withColumn("_licenses", F.array_distinct(found))


def sql() -> str:
    """The same scan of ``documents`` for DuckDB."""
    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def has_word(column: str, more: tuple[str, ...] = ()) -> str:
        return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in (*WORDS, *more)) + ")"

    # DuckDB's patterns know neither a look ahead nor the line ends other than "\n": both are taken in and put back.
    ends = r"[\r\x{85}\x{2028}\x{2029}]"
    opens = OPENS.replace("(?m)^", f"(?m)(^|{ends})").replace("(?=", "(?:")
    closes = CLOSES.removesuffix(r"[ \t\r]*$") + rf"(?:[ \t\r]*$|[ \t]*({ends}))"
    bare = f"regexp_replace(regexp_replace(t, {quoted(closes)}, '\\1', 'g'), {quoted(opens)}, '\\1', 'g')"
    known = ", ".join(f"CASE WHEN regexp_matches(s, {quoted(p)}) THEN {quoted(n)} END" for n, p in SENTENCES)
    steps, last = [], "seen"
    for i, (name, sequence) in enumerate(RULES):
        wanted = quoted("".join(f"<{s}>" for s in sequence))
        steps.append(f"rule{i} AS (SELECT doc_id, ids, unknown, replace(rest, {wanted}, '|') AS rest, CASE WHEN contains(rest, "
                     f"{wanted}) AND NOT list_contains(found, {quoted(name)}) THEN list_append(found, {quoted(name)}) "
                     f"ELSE found END AS found FROM {last})")
        last = f"rule{i}"
    return f"""
WITH lowered AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
cut AS (SELECT doc_id, CASE WHEN {has_word("replace(t, 'licence', 'license')", LONGEST)} THEN
  string_split(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace({bare}, '\\n[ \\t\\r]*\\n', chr(1), 'g'), '[ \\t\\r\\n]+', ' ', 'g'), '([.!?]) ', '\\1' || chr(1), 'g'),
  'licence', 'license'), '[^a-z0-9.+/' || chr(1) || ']+', ' ', 'g'), chr(1)) ELSE [] END AS parts FROM lowered),
spoken AS (SELECT doc_id, [s for s in [regexp_replace(p, '^[. ]+|[. ]+$', '', 'g') for p in parts] if {has_word('s', FIXED)}]
  AS parts FROM cut),
named AS (SELECT doc_id, [[x for x in [{known}] if x IS NOT NULL] for s in parts] AS each,
  [{has_word('s')} for s in parts] AS word FROM spoken),
seen AS (SELECT doc_id, flatten(each) AS ids,
  len([i for i in range(1, len(each) + 1) if word[i] AND len(each[i]) = 0]) AS unknown,
  array_to_string(['<' || x || '>' for x in flatten(each)], '') AS rest, CAST([] AS VARCHAR[]) AS found FROM named),
{", ".join(steps)}
SELECT doc_id, array_to_string(found, ',') AS licenses, array_to_string(ids, ',') AS sentence_ids,
  CAST(unknown AS INTEGER) AS unknown FROM {last}"""
