"""Licence recognition by sentence rules, in DataFrame functions only.

Text is cut into sentences, each is normalised, and known licence sentences become identifiers. A licence is found
where its rule, an ordered list of identifiers, matches sentences of the document. Two cuts are read: by lines, for
one-line notices, and by paragraphs with wrapped lines joined, for complete licence texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame

from sigwarn.llm.store import id_of_any_name
from pyspark.sql import functions as F

# Normalised licence sentences (lower case, words and digits joined by single spaces) by identifier.
SENTENCES = {
    "apache2-notice": "licensed under the apache license version 2 0",
    "apache2-long": "licensed under the apache license version 2 0 the license",
    "apache2-use": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "ccbync4-notice": "licensed under cc by nc 4 0",
    "ccby4-notice": "licensed under cc by 4 0",
    "ccbysa4-notice": "licensed under cc by sa 4 0",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-asis": "this software is provided by the copyright holders and contributors as is",
    "all-rights": "all rights reserved",
}
# What licences are called, as patterns on normalised sentences, and their tags in machine-read lines.
NAMES = {
    "Apache-2.0": (r"apache (software )?license( ?v| version)? ?2( 0)?", "apache 2 0"),
    "MIT": (r"(mit|expat) license", "mit"),
    "ISC": (r"isc license", "isc"),
    "BSD-2-Clause": (r"((simplified|2 clause|two clause) bsd|bsd (2|two) clause)( license)?", "bsd 2 clause"),
    "BSD-3-Clause": (r"((new|revised|modified|3 clause|three clause) bsd|bsd (3|three) clause)( license)?", "bsd 3 clause"),
    "MPL-2.0": (r"(mozilla public license|mpl)( ?v| version)? ?2 0", "mpl 2 0"),
    "GPL-2.0": (r"(gnu general public license|gnu gpl|gpl)( ?v| version)? ?2( 0)?", r"gpl 2 0( only| or later)?"),
    "GPL-3.0": (r"(gnu general public license|gnu gpl|gpl)( ?v| version)? ?3( 0)?", r"gpl 3 0( only| or later)?"),
    "LGPL-2.1": (r"(gnu lesser general public license|gnu lgpl|lgpl)( ?v| version)? ?2 1", r"lgpl 2 1( only| or later)?"),
    "LGPL-3.0": (r"(gnu lesser general public license|gnu lgpl|lgpl)( ?v| version)? ?3( 0)?", r"lgpl 3 0( only| or later)?"),
    "AGPL-3.0": (r"(gnu affero general public license|gnu agpl|agpl)( ?v| version)? ?3( 0)?", r"agpl 3 0( only| or later)?"),
    "CC0-1.0": (r"(cc0|creative commons zero)( 1 0)?( universal)?", "cc0 1 0"),
} | {
    f"CC-{tag.upper().replace(' ', '-')}-{v}.0": (rf"(creative commons {words}|cc {tag}) {v} 0", f"cc {tag} {v} 0")
    for tag, words in (("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nc", "attribution non ?commercial"), ("by nd", "attribution no ?deriv[a-z]*"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv[a-z]*"))
    for v in (3, 4)
}
#: A sentence names a licence where these words stand before its name, or after its tag's; what may stand between is bounded.
GRANTED = r"(^| )((re)?licensed|released|(re)?distributed|available|provided|published|covered|governed|subject)( under| by| to)( either( of)?)?( the)?( (terms|conditions)( and conditions)? of)?( the| a| an)? "
TAGGED = r"(^| )spdx license identifier ([a-z0-9]+ ){0,24}"


def named_patterns() -> dict[str, str]:
    """A pattern on normalised sentences for the identifier name:<licence> and one for tag:<licence>."""
    out = {f"name:{k}": f"{GRANTED}({name})( |$)" for k, (name, _) in NAMES.items()}
    return out | {f"tag:{k}": f"{TAGGED}({tag})( |$)" for k, (_, tag) in NAMES.items()}


# Licence rules, the identifiers that follow one another.
RULES = {
    "Apache-2.0": [["apache2-notice"], ["apache2-long", "apache2-use", "apache2-copy"]],
    "MIT": [["mit-notice"], ["mit-licensed"], ["mit-grant", "mit-keep"]],
    "GPL-3.0": [["gpl3-notice"], ["gpl-free", "gpl-warranty"]],
    "CC-BY-NC-4.0": [["ccbync4-notice"]],
    "CC-BY-4.0": [["ccby4-notice"]],
    "CC-BY-SA-4.0": [["ccbysa4-notice"]],
    "BSD": [["bsd-redistribution", "bsd-asis"]],
    "Proprietary": [["all-rights"]],
}
#: Said of a whole document only where no other licence is found.
ALONE = "Proprietary"
#: A sentence ends at a line end, and at a stop that blanks and then no digit follow; the stop stays with it.
STOP, LINES = r"([.!?;])[ \t]+([^0-9 \t])", r"[\r\n]+"
#: Sentences without one of these are not looked up; each known sentence has one.
MARKS = r"(?i)licen[sc]e|permission|permitted|warrant|redistribut|copyright|reserved|\b(released|distributed|available|published|covered|subject)\b"

# Complete sentences of licence texts, their variants under one identifier, after REWRITES.
_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_REDISTRIBUTE = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_AS_IS = "this software is provided by the holder as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_FREE = "this program is free software you can redistribute it and or modify it under the terms of the gnu {}general public license"
_LATER = ("either version {} of the license or at your option any later version", "either version {} or at your option any later version", "version {} of the license", "version {}")
_GNU = {"gpl2": ("", "2"), "gpl3": ("", "3"), "lgpl21": ("lesser ", "2 1"), "lgpl3": ("lesser ", "3"), "agpl3": ("affero ", "3")}
_ISC = "permission to use copy modify {} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
_NEITHER = "neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_USEFUL = "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
_APACHE = "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
_OBTAIN = "you may obtain a copy of the license at"
_CC = {"ccby4": "attribution", "ccbync4": "attribution noncommercial", "ccbysa4": "attribution sharealike"}
TEXT_SENTENCES = {
    "mit-grant": [_GRANT],
    "mit-keep": [f"the above copyright notice and this permission notice {x}shall be included in all copies or substantial portions of the software" for x in ("", "including the next paragraph ")],
    "isc-grant": [_ISC.format(x) for x in ("and or", "and")],
    "bsd-neither": [_NEITHER],
    "gpl-warranty": [_USEFUL],
    "gpl3-title": ["gnu general public license version 3 29 june 2007"],
    "gpl-verbatim": ["everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"],
    "bsd-redistribution": [_REDISTRIBUTE],
    "bsd-asis": [_AS_IS],
    "apache2-use": [_APACHE],
    "apache2-copy": [_OBTAIN, *[f"{_OBTAIN} {x} www apache org licenses license 2 0" for x in ("http", "https")]],
    "apache2-title": [f"apache license version 2 0 january 2004{x}" for x in ("", " http www apache org licenses", " https www apache org licenses")],
    "apache2-terms": ["terms and conditions for use reproduction and distribution"],
} | {
    f"{k}-free": [f"{_FREE.format(kind)} {by}{x.format(v)}" for by in ("as published by the free software foundation ", "") for x in _LATER] for k, (kind, v) in _GNU.items()
} | {f"{k}-licensed": [f"this work is licensed under the creative commons {v} 4 0 international {x}license" for x in ("", "public ")] for k, v in _CC.items()} | {
    f"{k}-accept": [f"by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons {v} 4 0 international public license public license"] for k, v in _CC.items()
}
#: Variants of licence texts: the licence's holder or program, and a line before the first sentence.
REWRITES = [
    (r"^this software is provided by (?:[a-z0-9]+ ){1,20}?as is ", "this software is provided by the holder as is "),
    (r"^(?:(?:the )?names? |3 )?neither the names? of (?:[a-z0-9]+ ){1,16}?(?:n?or the names of )", "neither the name of the holder nor the names of "),
    (r" (?:its|their|any) contributors may be used ", " its contributors may be used "),
    (r"^(?:[a-z0-9]+ ){1,8}?(is free software you can redistribute it |is distributed in the hope that it will be useful )", "this program $1"),
    (r"^copyright (?:[a-z0-9]+ ){1,12}?everyone is permitted ", "everyone is permitted "),
    (r"^this work is licensed under a ", "this work is licensed under the "),
]
# Licence rules of complete texts, the identifiers in order; any sentences may lie between two.
TEXT_RULES = {
    "Apache-2.0": [["apache2-use", "apache2-copy"], ["apache2-title", "apache2-terms"]],
    "MIT": [["mit-grant", "mit-keep"]],
    "GPL-3.0": [["gpl3-free", "gpl-warranty"], ["gpl3-title", "gpl-verbatim"]],
    "CC-BY-NC-4.0": [["ccbync4-licensed"], ["ccbync4-accept"]],
    "CC-BY-4.0": [["ccby4-licensed"], ["ccby4-accept"]],
    "CC-BY-SA-4.0": [["ccbysa4-licensed"], ["ccbysa4-accept"]],
    # numbered conditions and their numbers lie between; the third condition makes it the three-clause text
    "BSD": [["bsd-redistribution", "bsd-asis"]],
    "BSD-3-Clause": [["bsd-redistribution", "bsd-neither", "bsd-asis"]],
    "ISC": [["isc-grant"]],
    "GPL-2.0": [["gpl2-free"]],
    "LGPL-2.1": [["lgpl21-free"]],
    "LGPL-3.0": [["lgpl3-free"]],
    "AGPL-3.0": [["agpl3-free"]],
}
#: A wrapped sentence ends at a stop before a blank or line end, at a line without letters and digits, and at a colon
#: that ends a line before a number or capital. Stops of company names don't count.
TEXT_STOP = r"(?<!\b(?i:inc|ltd|corp|co))[.!?][\"')\]]*(?=\s)|\r?\n[^\p{L}\p{N}\r\n]*(?=\r?\n)|:[ \t]*\r?\n(?=[^\p{L}\p{N}\r\n]*[A-Z0-9])"
#: Texts without one of these hold no sentence of TEXT_SENTENCES.
TEXT_MARKS = r"(?i)license|permission|redistribution|\bas is\b|warranty|conditions for use"


def normalise(sentence: Column) -> Column:
    """Lower case of A-Z; every run of anything but a-z and digits is one blank; none at the ends."""
    low = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.btrim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def _named(s: Column) -> Column:
    """name: and tag: identifiers of the licences that a normalised sentence names."""
    hits = F.array_compact(F.array(*[F.when(s.rlike(pattern), F.lit(name)) for name, pattern in named_patterns().items()]))
    return F.when(s.rlike(GRANTED) | s.rlike(TAGGED), hits).otherwise(F.array().cast("array<string>"))


def _ids(known: Column, named: Column) -> Column:
    return F.when(known != "", F.array(known)).when(F.size(named) > 0, named).otherwise(F.array(F.lit("")))


def sentence_ids(text: Column) -> Column:
    """The identifiers of each of a text's sentences in order, [''] for unknown ones; empty sentences are left out.

    Only sentences with one of MARKS are normalised and looked up; one that isn't known may name licences.
    """
    known = F.create_map(*[F.lit(x) for name, s in SENTENCES.items() for x in (s, name)])
    look = lambda s: F.when(s.rlike(MARKS), _once(normalise(s), lambda n: _ids(F.coalesce(F.try_element_at(known, n), F.lit("")), _named(n)))).otherwise(F.array(F.lit("")))
    return F.transform(F.filter(F.split(F.regexp_replace(text, STOP, "$1\n$2"), LINES), lambda s: s != ""), look)


def _once(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def text_sentence_ids(text: Column) -> Column:
    """The same of the complete sentences of a text whose wrapped lines are joined, by TEXT_SENTENCES."""
    known = F.create_map(*[F.lit(x) for name, variants in TEXT_SENTENCES.items() for s in variants for x in (s, name)])

    def look(s: Column) -> Column:
        for pattern, to in REWRITES:
            s = F.regexp_replace(s, pattern, to)
        return F.coalesce(F.try_element_at(known, s), F.lit(""))

    cut = F.filter(F.transform(F.split(text, TEXT_STOP), normalise), lambda s: s != "")
    return F.when(text.rlike(TEXT_MARKS), F.transform(cut, lambda s: _ids(look(s), _named(s)))).otherwise(F.array().cast("array<array<string>>"))


@id_of_any_name("n_sentences", "n_known", "sentence_ids", "licenses", "n_licenses")
def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, list[list[str]]] | None = None, text_rules: dict[str, list[list[str]]] | None = None
) -> DataFrame:
    """doc_id, n_sentences, n_known, sentence_ids (comma-joined known ones), licenses (comma-joined, in order of rules), n_licenses.

    A rule matches where its identifiers follow one another with no other sentence between them; a text rule (of
    TEXT_RULES unless rules are given) where they come in this order in the joined text. A sentence that isn't known but
    grants something under a licence's name, or holds its tag, has the identifier name: or tag: of that licence. A
    reservation of all rights counts where no licence is found.

    n_sentences counts the cut by lines; known sentences of the joined text come after those of the lines, without ones
    that these have. Null texts count as empty: no sentences, '' and 0. Repeated rows are scanned each; null ids stay
    null. An empty table gives an empty result; other columns are not looked at.
    """
    named = {k: [[f"name:{k}"], [f"tag:{k}"]] for k in NAMES} if rules is None else {}
    text_rules = (TEXT_RULES if rules is None else {}) if text_rules is None else text_rules
    rules = RULES if rules is None else rules
    names = list(dict.fromkeys([*rules, *text_rules, *named]))
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col), sentence_ids(text).alias("_lines"), text_sentence_ids(text).alias("_texts"))
    out = out.select(id_col, F.size("_lines").cast("long").alias("n_sentences"), F.flatten("_lines").alias("_ids"), F.flatten("_texts").alias("_joined"))
    there = lambda c: F.filter(c, lambda s: s != "")
    # names in wrapped sentences are for texts whose lines say nothing
    own = F.filter("_joined", lambda s: ~s.rlike("^(name|tag):"))
    out = out.withColumn("_joined", F.when(F.size(there("_ids")) > 0, own).otherwise(F.col("_joined")))
    known = F.concat(there("_ids"), F.array_except(there("_joined"), there("_ids")))
    line, joined = [F.concat(F.lit(","), F.array_join(c, ","), F.lit(",")) for c in ("_ids", "_joined")]
    ordered = lambda ids: "," + ",(?:[^,]*,)*".join(map(re.escape, ids)) + ","
    alone = lambda v: [c.contains(f",{v[0]},") for c in (line, joined)]

    def match(name: str) -> Column:
        hits = [line.contains("," + ",".join(v) + ",") for v in rules.get(name, [])] + [joined.rlike(ordered(v)) for v in text_rules.get(name, [])]
        return F.when(_any(hits + [c for v in named.get(name, []) for c in alone(v)]), F.lit(name))

    found = F.array_compact(F.array(*[match(name) for name in names]))
    out = out.select(id_col, "n_sentences", known.alias("_known"), F.when(F.size(known) > 0, found).otherwise(F.array().cast("array<string>")).alias("_found"))
    kept = F.when(F.size("_found") > 1, F.array_remove("_found", ALONE)).otherwise(F.col("_found"))
    out = out.withColumn("_found", kept)
    return out.select(
        id_col, "n_sentences", F.size("_known").cast("long").alias("n_known"), F.array_join("_known", ",").alias("sentence_ids"), F.array_join("_found", ",").alias("licenses"), F.size("_found").cast("long").alias("n_licenses")
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
