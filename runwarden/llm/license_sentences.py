"""Licences of software components by sentence recognition, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence notices in lower case, words and digits only, and
# the identifier of each.  Several wordings may share an identifier.
SENTENCES = {
    "released under the mit license": "mit_name",
    "licensed under the mit license": "mit_name",
    "this project is licensed under the mit license": "mit_name",
    "the mit license": "mit_name",
    "mit license": "mit_name",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation "
    "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
    "permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the software": "mit_notice",
    "licensed under the apache license version 2 0": "apache2_name",
    "licensed under the apache license version 2 0 the license": "apache2_name",
    "this work is licensed under the apache license version 2 0": "apache2_name",
    "you may not use this file except in compliance with the license": "apache2_comply",
    "you may obtain a copy of the license at": "apache2_copy",
    "this work is licensed under the gnu general public license version 3": "gpl3_name",
    "licensed under the gnu general public license version 3": "gpl3_name",
    "this work is licensed under the gnu general public license version 2": "gpl2_name",
    "licensed under the gnu general public license version 2": "gpl2_name",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation either version 3 of the license or at your "
    "option any later version": "gpl3_later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation either version 2 of the license or at your "
    "option any later version": "gpl2_later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
    "free software foundation either version 3 of the license or at your option any later version": "gpl3_later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
    "free software foundation either version 2 of the license or at your option any later version": "gpl2_later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
    "free software foundation": "gpl_terms",
    "either version 3 of the license or at your option any later version": "gnu3_later",
    "either version 2 of the license or at your option any later version": "gnu2_later",
    "licensed under the gnu lesser general public license version 3": "lgpl3_name",
    "licensed under the mozilla public license version 2 0": "mpl2_name",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2_name",
    "licensed under cc by 4 0": "cc_by4_name",
    "licensed under cc by nc 4 0": "cc_by_nc4_name",
    "licensed under cc by sa 4 0": "cc_by_sa4_name",
    "licensed under the bsd 3 clause license": "bsd3_name",
    "licensed under the bsd 2 clause license": "bsd2_name",
    "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the "
    "following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission": "bsd_names",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "licensed under the isc license": "isc_name",
    "this is free and unencumbered software released into the public domain": "unlicense_grant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to "
    "alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
    "accompanying documentation covered by this license the software to use reproduce display distribute execute and "
    "transmit the software and to prepare derivative works of the software and to permit third parties to whom the "
    "software is furnished to do so all subject to the following": "boost_grant",
    "distributed under the boost software license version 1 0": "boost_name",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general "
    "public license as published by the free software foundation either version 3 of the license or at your option any "
    "later version": "agpl3_later",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by "
    "the free software foundation either version 3 of the license or at your option any later version": "agpl3_later",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by "
    "the free software foundation": "agpl_terms",
    "licensed under the gnu affero general public license version 3": "agpl3_name",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
    "public license as published by the free software foundation either version 2 1 of the license or at your option "
    "any later version": "lgpl21_later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
    "the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21_later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
    "the free software foundation either version 3 of the license or at your option any later version": "lgpl3_later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
    "the free software foundation": "lgpl_terms",
    "either version 2 1 of the license or at your option any later version": "gnu21_later",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 "
    "which is available at https www eclipse org legal epl 2 0": "epl2_name",
    "licensed under the eclipse public license version 2 0": "epl2_name",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to "
    "this software to the public domain worldwide": "cc0_grant",
    "licensed under cc0 1 0": "cc0_name",
}

# Rules in the order in which they are tried; each uses up the sentences it matches.
RULES = (
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("MIT", ("mit_name", "mit_grant", "mit_notice")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("MIT", ("mit_name",)),
    ("Apache-2.0", ("apache2_name", "apache2_comply", "apache2_copy")),
    ("Apache-2.0", ("apache2_name",)),
    ("GPL-3.0-or-later", ("gpl_terms", "gnu3_later")),
    ("GPL-2.0-or-later", ("gpl_terms", "gnu2_later")),
    ("GPL-3.0-or-later", ("gpl3_later",)),
    ("GPL-2.0-or-later", ("gpl2_later",)),
    ("GPL-3.0-only", ("gpl3_name",)),
    ("GPL-2.0-only", ("gpl2_name",)),
    ("LGPL-3.0-only", ("lgpl3_name",)),
    ("AGPL-3.0-or-later", ("agpl_terms", "gnu3_later")),
    ("AGPL-3.0-or-later", ("agpl3_later",)),
    ("AGPL-3.0-only", ("agpl3_name",)),
    ("LGPL-2.1-or-later", ("lgpl_terms", "gnu21_later")),
    ("LGPL-3.0-or-later", ("lgpl_terms", "gnu3_later")),
    ("LGPL-2.1-or-later", ("lgpl21_later",)),
    ("LGPL-3.0-or-later", ("lgpl3_later",)),
    ("MPL-2.0", ("mpl2_name",)),
    ("CC-BY-NC-4.0", ("cc_by_nc4_name",)),
    ("CC-BY-SA-4.0", ("cc_by_sa4_name",)),
    ("CC-BY-4.0", ("cc_by4_name",)),
    ("BSD-3-Clause", ("bsd3_name",)),
    ("BSD-2-Clause", ("bsd2_name",)),
    ("ISC", ("isc_grant",)),
    ("ISC", ("isc_name",)),
    ("Unlicense", ("unlicense_grant",)),
    ("Zlib", ("zlib_grant",)),
    ("BSL-1.0", ("boost_grant",)),
    ("BSL-1.0", ("boost_name",)),
    ("EPL-2.0", ("epl2_name",)),
    ("CC0-1.0", ("cc0_grant",)),
    ("CC0-1.0", ("cc0_name",)),
)
#: Stands where a rule has used up sentences, so that what was apart stays apart.
_USED = " - "
INCOMPLETE = "incomplete"
#: Every known sentence has one of these words, so texts without them need no cutting.
_HINT = r"(?i)licen[cs]e|permission|redistribution|free software|terms of|copyright|public domain|boost software|cc0"
_END = r"(?<=[.!?;:])\s+"
#: The dot of "v. 2.0" ends no sentence.
_WHOLE_END = r"(?<=[.!?;:])(?<!\b[vV]\.)\s+"
#: A line without letters and digits ends a paragraph, also within a comment.
_BLANK = r"\n[^\p{L}\p{N}\n]*\n\s*"
#: The holder that the last clause of the BSD notices names may be of any length and hold dots ("Inc.").
_NEITHER = r"(?i)\bneither\W+the\W+name\W+of(?=\W)"
_HOLDER = r"(?is)^\W.+?\Wnor\W+the\W+names\W+of\W+its\W+contributors\b"
_HELD = " the copyright holder nor the names of its contributors"


def _one_holder(text: Column) -> Column:
    """The text with the same holder in all clauses that name one; each clause is read up to the next one only."""
    pieces = F.split(text, _NEITHER)
    held = F.transform(pieces, lambda piece, i: F.when(i == 0, piece).otherwise(F.regexp_replace(piece, _HOLDER, _HELD)))
    return F.when(F.size(pieces) > 1, F.array_join(held, "Neither the name of")).otherwise(text)


def _identifiers(text: Column, cut: str) -> Column:
    """Identifiers of the known sentences of a text, in order, as `` id id ``."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    words = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    # The number of a clause belongs to no sentence.
    plain = lambda s: F.regexp_replace(words(s), "^([0-9]+|[a-d]) (?=redistributions |neither )", "")
    found = F.filter(F.transform(F.split(text, cut), lambda s: F.try_element_at(known, plain(s))), lambda x: x.isNotNull())
    return F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))


def _apply_rules(sequence: Column) -> Column:
    """(rest, licences): rules in order; a rule that matches removes its sentences."""
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(" " + "  ".join(s) + " ").alias("ids")) for n, s in RULES])
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("licences"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["ids"])
        rest = F.when(hit, F.replace(state["rest"], rule["ids"], F.lit(_USED))).otherwise(state["rest"])
        more = F.when(hit, F.array(rule["name"])).otherwise(F.array().cast("array<string>"))
        return F.struct(rest.alias("rest"), F.concat(state["licences"], more).alias("licences"))

    done = F.aggregate(rules, start, step)
    left = F.when(F.regexp_replace(done["rest"], "[ -]+", "") != "", F.array(F.lit(INCOMPLETE))).otherwise(F.array().cast("array<string>"))
    return F.concat(done["licences"], left)


def component_licenses(components: DataFrame) -> DataFrame:
    """Licences stated in the text of each software component.

    ``components``: ``purl`` (identifies the component) and ``license_text``.  Returns ``purl,
    license`` for every licence found in a text, once each.

    Method: the text is cut into sentences, at sentence ends across line breaks, also at blank
    lines, and also line by line, as notices come all these ways.  A notice with a semicolon or colon
    inside is a rule over its pieces.  Normalised sentences (lower case, words and digits) are
    looked up among known licence sentences.  The sequence of identifiers is matched against
    ordered rules; a rule uses up the sentences it matches, and those on both sides of them do not become
    neighbours.  Known sentences that no rule uses
    give ``incomplete`` if the text has no licence.  All steps are column functions in one pass
    without a shuffle.

    Defined cases: null, empty and texts without a known sentence give no row; repeated rows are
    each reported; null ids are kept; an empty table gives no rows; other columns are ignored.
    """
    held = _one_holder(F.col("license_text")).alias("license_text")
    texts = components.select("purl", "license_text").where(F.col("license_text").rlike(_HINT)).select("purl", held)
    cut = texts.select(
        "purl",
        _identifiers(F.col("license_text"), _END).alias("across"),
        _identifiers(F.col("license_text"), _BLANK + "|" + _WHOLE_END).alias("paragraphs"),
        _identifiers(F.col("license_text"), r"\n\s*|" + _WHOLE_END).alias("lines"),
    ).where("trim(across) <> '' OR trim(paragraphs) <> '' OR trim(lines) <> ''")
    readings = [_apply_rules(F.col(c)) for c in ("across", "paragraphs", "lines")]
    found = F.array_distinct(F.concat(*readings))
    named = F.filter(found, lambda x: x != INCOMPLETE)
    result = F.when(F.size(named) > 0, named).otherwise(found)
    return cut.select("purl", F.explode(result).alias("license"))
