"""License scans by ordered signature rules, native Spark only.

Texts are lower-cased (A-Z) and reduced to words joined by single spaces.
Hundreds of signature expressions, sentences of license texts and notices and
forms built from license names and versions, run only on texts that hold one of a few keywords, and there
only the rules whose own keyword is present. Matches become intervals;
an interval inside another is suppressed, equal intervals go to the rule with
the higher priority, and the labels of the rest are kept. SPDX expressions are
read whole from the raw text, where their line ends.

Defined results: null and empty texts have no words, null first_word and
last_word, empty labels and score 0; every row keeps one output row; an empty
input gives an empty output. Whole texts are scanned. Other columns are
ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickflow.llm.common import text_of

#: Base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Fixed values: (label, keyword, name expression over normalised words, versions).
#: A version V stands for "version V", "v V", "vV" or "V" after the name.
FAMILIES = (
    ("mit", "mit", r"mit(?: x11)?", ()),
    ("mit", "expat", r"expat(?: x11)?", ()),
    ("apache", "apache", r"apache(?: software)?(?: foundation)?", ("1 0", "1 1", "2 0", "2")),
    ("gpl", "general public", r"(?:gnu )?general public", ("1", "2", "3", "2 0", "3 0")),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1", "2", "3", "2 0", "3 0")),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public", ("2", "2 1", "3", "3 0")),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2", "2 1", "3", "3 0")),
    ("agpl", "affero", r"(?:gnu )?affero general public", ("1", "3", "3 0")),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1", "3", "3 0")),
    ("gfdl", "documentation", r"(?:gnu )?free documentation", ("1 1", "1 2", "1 3")),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause", ()),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified|3 clause|three clause) bsd|bsd (?:3|three) clause", ()),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd|bsd (?:4|four) clause", ()),
    ("bsd", "bsd", r"bsd", ()),
    ("mpl", "mozilla", r"mozilla public", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", r"mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", r"eclipse public", ("1 0", "2 0")),
    ("epl", "epl", r"epl", ("1 0", "2 0")),
    ("cddl", "common development", r"common development and distribution", ("1 0", "1 1")),
    ("cddl", "cddl", r"cddl", ("1 0", "1 1")),
    ("eupl", "european union", r"european union public", ("1 0", "1 1", "1 2")),
    ("eupl", "eupl", r"eupl", ("1 0", "1 1", "1 2")),
    ("cpl", "common public", r"common public", ("1 0",)),
    ("artistic", "artistic", r"(?:perl )?artistic", ("1 0", "2 0")),
    ("bsl", "boost", r"boost software", ("1 0",)),
    ("ms-pl", "microsoft", r"microsoft public", ()),
    ("ms-rl", "microsoft", r"microsoft reciprocal", ()),
    ("isc", "isc", r"isc", ()),
    ("zlib", "zlib", r"zlib(?: libpng)?", ()),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", r"wtfpl", ("2",)),
    ("ofl", "open font", r"(?:sil )?open font", ("1 0", "1 1")),
    ("python", "python", r"python(?: software foundation)?", ("2", "2 0")),
    ("php", "php", r"php", ("3 0", "3 01")),
    ("ruby", "ruby", r"ruby", ()),
    ("postgresql", "postgresql", r"postgresql", ()),
    ("openssl", "openssl", r"openssl", ()),
    ("odbl", "open database", r"(?:odc )?open database", ("1 0",)),
    ("afl", "academic free", r"academic free", ("2 1", "3 0")),
    ("osl", "open software", r"open software", ("2 1", "3 0")),
    ("ecl", "educational community", r"educational community", ("1 0", "2 0")),
    ("upl", "universal permissive", r"universal permissive", ("1 0",)),
    ("sspl", "server side public", r"server side public", ("1",)),
    ("busl", "business source", r"business source", ("1 1",)),
    ("elastic", "elastic", r"elastic", ("2 0",)),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", ()),
    ("cecill", "cecill", r"cecill(?: [bc])?", ("1 0", "2 0", "2 1")),
    ("zpl", "zope", r"zope public", ("2 0", "2 1")),
)
#: Families whose notices name the version after the publisher.
GNU = frozenset(("gpl", "lgpl", "agpl", "gfdl"))
#: SPDX identifiers whose label is another one than their name and version.
SPDX_LABELS = {"cc0-1": "cc0", "python-2.0.1": "python-2", "psf-2": "python-2", "mit-modern-variant": "mit", "bsd-2-clause-views": "bsd-2-clause"}
#: An SPDX expression in a raw text; it ends with its last identifier.
_ID = r"[A-Za-z0-9][A-Za-z0-9.+-]*"
SPDX = rf"(?i)spdx-license-identifier:[ \t]*([( \t]*{_ID}[) \t]*(?:(?<=[) \t])(?:or|and|with)[ \t]+[( \t]*{_ID}[) \t]*)*)"
#: Creative Commons elements; every form is a family of its own.
CC_ELEMENTS = (("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"), ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
               ("by-nc", "by nc", "attribution non ?commercial"), ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s"),
               ("by-sa", "by sa", "attribution share ?alike"), ("by", "by", "attribution"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Fixed values: (label, keyword, expression): sentences that stand in one license's text or notice.
SENTENCES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?"),
    ("mit-0", "no attribution", r"mit no attribution(?: license)?"),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used"),
    ("json", "used for good", r"the software shall be used for good not evil"),
    ("bsl-1", "any person or organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("ofl-1.1", "font software", r"this font software is licensed under the sil open font license version 1 1|permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("ncsa", "deal with the software", r"to deal with the software without restriction"),
    ("isc", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose(?: with or without fee is hereby granted)?"),
    ("isc", "permission to use copy", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "zero clause", r"(?:bsd zero clause|zero clause bsd) licen[sc]e"),
    ("hpnd", "supporting documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted provided that the above copyright notice appears? in all copies and that both that copyright notice and this permission notice appear in supporting documentation"),
    ("postgresql", "without a written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted provided that the following conditions are met)?"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of (?:\w+ ){1,12}?nor the names of (?:its|his|her|their|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause", "freebsd project", r"should not be interpreted as representing official policies either expressed or implied of the freebsd project"),
    ("bsd-3-clause-clear", "express or implied licenses", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache-2", "apache", r"licensed under the apache license version 2 0 the license you may not use (?:this file|these files) except in compliance with the license"),
    ("apache-2", "apache", r"apache org licenses license 2 0"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("gpl", "free software foundation", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "free software foundation", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("agpl", "free software foundation", r"you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gpl-2", "general public license", r"gnu general public license version 2 june 1991"),
    ("gpl-3", "general public license", r"gnu general public license version 3 29 june 2007"),
    ("lgpl-2.1", "lesser general public", r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", "lesser general public", r"gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3", "affero", r"gnu affero general public license version 3 19 november 2007"),
    ("gfdl", "document under the terms", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0"),
    ("cpl-1", "common public", r"this program and the accompanying materials are made available under the terms of the common public license v1 0"),
    ("cddl", "common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
        ("zlib", "as is without", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng-2", "png reference library", r"the png reference library is supplied as is"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "neighboring rights", r"to the extent possible under law (?:\w+ ){1,12}?(?:has|have) waived all copyright and related or neighboring rights"),
    ("pddl-1", "public domain dedication", r"(?:odc )?public domain dedication and license"),
    ("odbl", "open database", r"made available under the open database license"),
    ("odc-by", "open data commons attribution", r"open data commons attribution license"),
    ("wtfpl", "what the", r"do what the fuck you want to public license"),
    ("beerware", "buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("artistic", "package may be copied", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", "package may be copied", r"this license establishes the terms under which a given free software package may be copied"),
    ("python", "python software foundation", r"this license agreement is between the python software foundation"),
    ("php-3.01", "php license", r"this source file is subject to version 3 01 of the php license"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young"),
    ("ruby", "either the terms", r"you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl)"),
    ("ms-pl", "accompanying software", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("vim", "vim", r"vim license"),
    ("curl", "curl license", r"curl license"),
    ("tcl", "tcl", r"tcl tk license"),
    ("unicode", "unicode", r"unicode (?:inc )?license(?: agreement)?"),
    ("icu", "icu", r"icu license"),
    ("sspl-1", "server side public", r"server side public license version 1"),
    ("busl", "business source", r"use of this software is governed by the business source license"),
    ("elastic", "hosted or managed", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "commons clause", r"commons clause license condition"),
    ("polyform-noncommercial", "polyform", r"polyform noncommercial license"),
    ("polyform-small-business", "polyform", r"polyform small business license"),
    ("bigscience-openrail-m", "openrail", r"(?:bigscience |creativeml )?openrail m(?: license)?"),
    ("llama-community", "llama", r"llama (?:\d ){0,2}community license(?: agreement)?"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "license agreement", r"use of this software is subject to the terms of your (?:commercial )?license agreement"),
)
_GRANT = (r"(?:(?:licensed|released|distributed|available|published|provided|covered|redistributed|redistribute it and or modify it) under|(?:licensed|covered|governed) by)"
          r"(?: the)?(?: terms of)?(?: the)? ")
#: A grant that is denied, with what it denies.
_DENIED = rf" (?:not|never|isn t|aren t|nor) (?:be |been )?{_GRANT}(?:(?:[^ ]+ ){{0,4}}?licen[sc]es?|[^ ]+)(?= )"
#: What else a grant lists: ``licensed under MIT or Apache-2.0``, ``under either the X license or the Y``.
_LISTED = r"licensed under (?:either |both |the |of |terms )*+(?:[^ ]+ ){1,7}?(?:or|and) (?:the |at your option )?((?:[^ ]+ ?){1,5})"
#: A heading in the raw text: ``License: MIT``, ``"license": "Apache-2.0"``, ``## Licence - GPL v3``; a line holds one.
_HEADING = r"(?im)(?:^[ \t\"'*#/;>.-]*(?:project |code |software )?|[,{][ \t]*[\"'])licen[sc]es?[\"']?[ \t]*(?:[:=]|-|\u2013)[ \t]*[\"'\[]*([^\n\"']{2,60})"
#: Families named by an everyday word: they count with a grant and the word license only.
_EVERYDAY = frozenset(("python", "php", "ruby", "elastic", "postgresql", "openssl", "bsl"))
_LICENSE = r" licen[sc]e"


def signatures() -> list[tuple[str, str, str, float]]:
    """(label, keyword, expression, weight) in order of priority, made from the tables above."""
    exact, named, loose = [], [], []
    for label, keyword, name, versions in FAMILIES:
        body = f"(?:{name})"
        for v in versions:
            forms = rf"(?:public )?(?:licen[sc]e )?(?:version |v ?)?{v}"
            exact.append((f"{label}-{v.replace(' ', '.').removesuffix('.0')}", keyword, rf"{_GRANT}{body} ?{forms}", 1.0))
            named.append((f"{label}-{v.replace(' ', '.').removesuffix('.0')}", keyword, rf"{body}{_LICENSE} ?(?:version |v ?)?{v}", 0.9))
            if label in GNU and " " not in keyword:
                named.append((f"{label}-{v.replace(' ', '.').removesuffix('.0')}", keyword, rf"{body} ?(?:version |v ?){v}", 0.8))
            if label in GNU:
                exact.append((f"{label}-{v.replace(' ', '.').removesuffix('.0')}", keyword, rf"(?:you can redistribute it and or modify it under the terms of the )?{body}{_LICENSE} as published by the free software foundation (?:either )?(?:version |v ?){v}(?: of the license)?", 1.0))
        if label in _EVERYDAY:
            exact.append((label, keyword, rf"{_GRANT}{body}{_LICENSE}", 0.9))
            continue
        exact.append((label, keyword, rf"{_GRANT}{body}(?:{_LICENSE})?", 0.9))
        loose.append((label, keyword, rf"{body}(?: public)?{_LICENSE}", 0.7))
    for label, short, long in CC_ELEMENTS:
        for v in CC_VERSIONS:
            tagged = f"cc-{label}-{v.replace(' ', '.').removesuffix('.0')}"
            exact.append((tagged, "cc by", rf"cc {short} {v}", 1.0))
            exact.append((tagged, "creative commons", rf"creative commons {long} (?:international )?{v}", 1.0))
            exact.append((tagged, "creative commons", rf"creative commons {long}(?: international)? licen[sc]e (?:version )?{v}", 1.0))
            exact.append((tagged, "creativecommons", rf"creativecommons org licenses {short} {v}", 1.0))
        loose.append((f"cc-{label}", "cc by", rf"cc {short}", 0.8))
        loose.append((f"cc-{label}", "creative commons", rf"creative commons {long}", 0.8))
    sentences = [(label, keyword, body, 1.0 if label != "proprietary" else 0.5) for label, keyword, body in SENTENCES]
    return exact + sentences + named + loose


#: Texts without any of these hold no match of any rule: every expression needs a
#: licence word, a grant ("... under", "... by"), a Creative Commons
#: name or one of the sentences.
GATE = ("licen", " under ", "creative", "cc by", "cc0", "public domain", "rights reserved", "proprietary", "permission", "redistribut",
        "provided", "do what the", "covered by", "licensed by", "governed by", "gpl v", "gplv", "gpl version",
        "freebsd project", "advertising materials", "acknowledg", "product includes", "used for good", "deal with the software", "origin of this software", "png reference", "package may be copied",
        "without restriction", "x consortium", "endorse or promote", "neighboring rights", "buy me a beer", "either the terms", "hosted or managed", "unauthorized copying", "openrail", "mit no attribution", "apache org", "supplied as is")


def words_only(text: Column) -> Column:
    """The words of a text, each between single spaces, with a space at either end."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), F.lit(" ")), F.lit(" "))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else, which ``lower`` would not leave alone."""
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        text = F.replace(text, F.lit(c), F.lit(c.lower()))
    return text


def _any(text: Column, keywords) -> Column:
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(text, F.lit(k))
    return hit


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, inside an expression."""
    return F.get(F.transform(F.array(value), body), 0)


def _places(t: Column, phrase: str) -> Column:
    """How often a phrase stands in normalised text, and its smallest and largest start.

    A word follows each space, so starts are counts of spaces; the phrases
    can't overlap themselves, so splitting meets every place.
    """
    n = len(phrase.split())
    return _let(F.split(t, f" {phrase}(?= )", -1), lambda p: F.struct(
        (F.size(p) - 1).cast("long").alias("n"),
        F.when(F.size(p) > 1, _spaces(F.get(p, 0))).cast("long").alias("first"),
        F.when(F.size(p) > 1, _spaces(t) - _spaces(F.element_at(p, -1)) - n).cast("long").alias("last")))


def spdx_labels(text: Column) -> Column:
    """Labels of all identifiers in a text's SPDX expressions, exceptions left out.

    A label is the identifier in lower case without ``-only``, ``-or-later``, ``+`` and a final ``.0``.
    """
    expressions = F.regexp_extract_all(text, F.lit(SPDX), F.lit(1))
    ids = F.flatten(F.transform(expressions, lambda x: F.regexp_extract_all(F.regexp_replace(F.lower(x), rf"[ \t]with[ \t]+{_ID}", " "), F.lit(f"({_ID})"), F.lit(1))))
    plain = F.transform(F.filter(ids, lambda x: ~x.isin("or", "and")), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?:-only|-or-later|\+)$", ""), r"\.0$", ""))
    known = F.create_map(*[F.lit(x) for kv in SPDX_LABELS.items() for x in kv])
    return F.when(F.contains(F.lower(text), F.lit("spdx-license-identifier:")), F.transform(plain, lambda x: F.coalesce(F.get(F.array(known[x]), 0), x))).otherwise(F.array().cast("array<string>"))


def _rule_table() -> Column:
    """All signatures as one constant array, expressions bound to whole words."""
    rules = [{"prio": k, "label": label, "kw": kw, "re": rf"(?<= )(?:{body})(?= )", "w": w} for k, (label, kw, body, w) in enumerate(signatures())]
    return F.from_json(F.lit(json.dumps(rules)), "array<struct<prio:int,label:string,kw:string,re:string,w:double>>")


_SPANS = "array<struct<s:int,neg:int,prio:int,label:string,w:double>>"


def _rule_spans(t: Column, r: Column) -> Column:
    """Intervals of one rule: lengths of matches and of what lies between, summed up."""
    hits = F.regexp_extract_all(t, r["re"], F.lit(0))
    gaps = F.split(t, r["re"], -1)
    steps = F.zip_with(hits, gaps, lambda h, g: F.when(h.isNotNull(), F.struct(F.length(g).alias("g"), F.length(h).alias("h"))))

    def step(acc: Column, x: Column) -> Column:
        at = F.when(F.size(acc) > 0, -F.element_at(acc, -1)["neg"]).otherwise(0) + x["g"]
        return F.when(x.isNull(), acc).otherwise(F.concat(acc, F.array(F.struct(at.alias("s"), (-(at + x["h"])).alias("neg"), r["prio"].alias("prio"), r["label"].alias("label"), r["w"].alias("w")))))

    return F.aggregate(steps, F.array().cast(_SPANS), step)


def _kept_spans(spans: Column) -> Column:
    """Intervals in no earlier one: sorted by start, longest first, then priority."""
    empty = F.struct(F.lit(-1).alias("end"), F.array().cast(_SPANS).alias("kept"))
    swept = F.aggregate(F.sort_array(spans), empty, lambda acc, x: F.when(-x["neg"] <= acc["end"], acc).otherwise(
        F.struct((-x["neg"]).alias("end"), F.concat(acc["kept"], F.array(x)).alias("kept"))))
    return swept["kept"]


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, normalised text ``t`` (null unless some keyword is in it), n_words, labels of SPDX expressions and kept intervals.

    Intervals are in characters of the normalised text (without denied grants, and with headings and lists after its end), with a negated end.
    """
    text = text_of(docs, text_col)
    # Headings are read as grants of each license they name.
    headed = F.when(F.contains(F.lower(text), F.lit("licen")), F.regexp_extract_all(text, F.lit(_HEADING), F.lit(1))).otherwise(F.array().cast("array<string>"))
    base = docs.select(F.col(id_col).alias("doc_id"), words_only(text).alias("x"), spdx_labels(text).alias("spdx"), headed.alias("headed"))
    gated = base.select("doc_id", "spdx", "headed", F.when(F.length("x") > 2, _spaces(F.col("x")) - 1).otherwise(0).cast("long").alias("n_words"), F.when(_any(F.lower("x"), GATE), F.col("x")).alias("x"))
    lowered = gated.select("doc_id", "n_words", "spdx", "headed", F.when(F.col("x").isNotNull(), lower_ascii(F.col("x"))).alias("t"))
    # Denied grants go; what headings and lists grant is said once more after the text, as a grant of its own.
    said = F.when(F.contains("t", F.lit(" under ")) | F.contains("t", F.lit("ed by ")), F.regexp_replace("t", _DENIED, " ")).otherwise(F.col("t"))
    listed = F.when(F.contains("t", F.lit("licensed under ")), F.regexp_extract_all("t", F.lit(_LISTED), F.lit(1))).otherwise(F.array().cast("array<string>"))
    named = F.flatten(F.transform("headed", lambda h: F.split(lower_ascii(words_only(h)), " (?:or|and) ")))
    granted = F.transform(F.concat(listed, named), lambda g: F.concat(F.lit("licensed under "), F.btrim(g, F.lit(" ")), F.lit(" . ")))
    lowered = lowered.withColumn("u", F.when(F.col("t").isNotNull(), F.concat(said, F.array_join(granted, ""))))
    u = F.col("u")
    present = F.filter(_rule_table(), lambda r: F.contains(u, r["kw"]))
    spans = F.when(u.isNotNull(), _kept_spans(F.flatten(F.transform(present, lambda r: _rule_spans(u, r)))))
    return lowered.select("doc_id", "n_words", "t", "spdx", F.coalesce(spans, F.array().cast(_SPANS)).alias("spans"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; see the module. One pass over the texts, no shuffle."""
    spans = license_spans(docs, id_col, text_col)
    places = {p: f"p{k}" for k, p in enumerate(BASE_PHRASES)}
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    met = spans.select("doc_id", "n_words", "spans", "spdx", *[F.coalesce(F.when(F.contains(F.col("t"), F.lit(p)), _places(F.col("t"), p)), none).alias(k) for p, k in places.items()])
    n = sum(F.col(k)["n"] for k in places.values())
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.col(k)["n"] > 0, F.lit(BASE_PHRASES[p])) for p, k in places.items()])))
    labels = F.array_sort(F.array_distinct(F.concat(base, "spdx", F.transform("spans", lambda x: x["label"]))))
    best = F.array_max(F.transform("spans", lambda x: x["w"]))
    return met.select(
        "doc_id", "n_words", n.cast("long").alias("n_base"),
        F.least(*[F.col(k)["first"] for k in places.values()]).alias("first_word"),
        F.greatest(*[F.col(k)["last"] for k in places.values()]).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("spdx") > 0, 1.0).otherwise(0.0), F.when(n > 0, 0.9).otherwise(0.0)).alias("score"))
