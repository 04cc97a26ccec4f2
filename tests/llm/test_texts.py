"""Language model, token counts, mixture, licences, archives against brute force and round trips."""

import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest

from runwarden.llm.command_model import score_command_lines
from runwarden.llm.elias_fano import EliasFano
from runwarden.llm.feed_archive import DICTIONARY_FRAME, archive_pages, write_archives
from runwarden.llm.license_sentences import RULES, SENTENCES, _HINT, component_licenses
from runwarden.llm.mixture import mix_executions, training_order
from runwarden.llm.token_counts import count_tokens

random.seed(9)


@pytest.mark.parametrize("top,count", [(10, 30), (1 << 60, 500), (5000, 4000), (1, 1)])
def test_elias_fano_round_trip(top, count):
    rng = np.random.default_rng(count)
    values = np.sort(rng.integers(0, top, count).astype(np.uint64))
    held = EliasFano(EliasFano.build(values))
    assert (held.access(np.arange(count)) == values).all()
    asked = np.concatenate([values, rng.integers(0, top + 5, 300).astype(np.uint64)])
    assert (held.successor(asked) == np.searchsorted(values, asked)).all()
    assert ((held.find(asked) >= 0) == np.isin(asked, values)).all()


def tokens(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def test_scores_equal_brute_force(spark):
    pool = [f"t{i}" for i in range(60)]
    train = [" ".join(random.choices(pool, k=random.randint(0, 40))) for _ in range(120)] + [None, "É é A a"]
    texts = [*train[:30], "unseen words t1", "", None, "t1 " * 3000, "T2\x0bt3"]
    got = score_command_lines(
        spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(None, "t1", 1.0)], "event_id bigint, command_line string, score double"),
        spark.createDataFrame([(t, 0) for t in train], "command_line string, event_id int"),
    ).collect()
    assert len(got) == len(texts) + 1
    single = Counter(w for t in train for w in tokens(t))
    pairs = Counter(p for t in train for p in zip(["^", *tokens(t)], tokens(t)))
    followers = Counter(a for a, _ in pairs)
    total, distinct = sum(single.values()), len(single)
    context = {**single, "^": len(train)}
    p1 = lambda w: (single[w] + 0.1) / (total + 0.1 * (distinct + 1))

    def p2(a, w):
        if not followers[a]:
            return p1(w)
        return (max(pairs[a, w] - 0.75, 0) + 0.75 * followers[a] * p1(w)) / context[a]

    for r in got:
        seq = tokens("t1" if r.event_id is None else texts[r.event_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(seq), sum(single[w] > 0 for w in seq), total)
        assert math.isclose(r.base_score, sum(math.log10(p1(w)) for w in seq), rel_tol=1e-9)
        exact = sum(math.log10(p2(a, w)) for a, w in zip(["^", *seq], seq))
        assert abs(r.score - exact) <= 0.06 * len(seq)
    assert all(math.isclose(sum(p2(a, w) for w in [*single, "never"]), 1, rel_tol=1e-9) for a in ("t1", "^", "t7"))
    nothing = score_command_lines(spark.createDataFrame([(1, "a")], "event_id int, command_line string"), spark.createDataFrame([], "command_line string"))
    assert nothing.first().n_known == 0


def test_token_counts_equal_the_library(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    texts = ["a\x1cb", "x<|endoftext|>Y <|ENDOFTEXT|>", "İx ΑΣ Σ'S don't", "中文 テスト", "हिन्दी ½ ﬁ", "ab" * 4000, "", None, " \n", "the " * 700]
    frame = spark.createDataFrame([(i % 9, t, 3) for i, t in enumerate(texts)], "event_id int, command_line string, n_tokens int")
    library = tokenizers.Tokenizer.from_file(path)
    want = sorted((i % 9, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in enumerate(texts))
    got = count_tokens(frame, path, limit=600).collect()
    assert sorted((r.event_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 600) for r in got)
    assert count_tokens(frame.limit(0), path).count() == 0


def test_mixture_meets_its_targets(spark):
    rows = [(i, random.choice(["a", "b", "c", "d", None]) if i % 3 else "hot", "w " * random.randint(0, 20), 0) for i in range(600)]
    rows += [rows[1], rows[1], (None, "a", "x y", 0), (7777, "only", None, 0)]
    frame = spark.createDataFrame(rows, "event_id bigint, docker_host_id string, command_line string, size int")
    got = mix_executions(frame).collect()
    assert sorted(map(str, got)) == sorted(map(str, mix_executions(frame).collect())) and len(got) == len(rows)
    sizes = Counter()
    for _, host, text, _ in rows:
        sizes[host] += len((text or "").split())
    order = sorted(sizes, key=lambda h: (h is None, h))
    weight = {h: i % 3 + 1 for i, h in enumerate(order)}
    target, free = {}, set(order)
    while True:
        left = sum(sizes.values()) - sum(target.values())
        level = left / sum(weight[h] for h in free)
        over = {h for h in free if level * weight[h] >= 3 * sizes[h]}
        if not over:
            break
        target |= {h: 3 * sizes[h] for h in over}
        free -= over
    target |= {h: level * weight[h] for h in free}
    taken = Counter()
    for r in got:
        assert math.isclose(r.target, target[r.docker_host_id], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.copies * r.size <= 3 * r.size and (r.position is None) == (r.copies == 0)
        assert r.position is None or 0 <= r.position <= 1
        taken[r.docker_host_id] += r.taken
    assert all(abs(taken[h] - target[h]) <= 20 for h in order)
    ordered = training_order(mix_executions(frame)).collect()
    assert len(ordered) == sum(r.copies for r in got)
    assert [r.position for r in ordered] == sorted(r.position for r in ordered)
    assert mix_executions(frame.limit(0)).count() == 0


def test_license_rules(spark):
    assert all(re.search(_HINT.replace("(?i)", ""), s) for s in SENTENCES) and {i for _, r in RULES for i in r} == set(SENTENCES.values()) - set()
    bsd = (
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the "
        "following conditions are met:\n\nRedistributions of source code must retain the above copyright notice, this list of "
        "conditions and\nthe following disclaimer.\n"
    )
    cases = {
        1: ("Junk &&& here\nReleased under the MIT License.\nMore", ["MIT"]),
        2: ("x. Licensed under the Apache License, Version 2.0. y. LICENSED UNDER CC BY-NC 4.0!", ["Apache-2.0", "CC-BY-NC-4.0"]),
        3: (bsd, ["incomplete"]),
        4: (bsd + "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
            "disclaimer in the documentation and/or other materials provided with the distribution.", ["BSD-2-Clause"]),
        5: ("the license of a permission", []), 6: (None, []), 7: ("", []), 8: ("MIT License\n" + "long text " * 50000, ["MIT"]),
    }
    frame = spark.createDataFrame([(i, t, "x") for i, (t, _) in cases.items()], "purl int, license_text string, license string")
    got = component_licenses(frame).collect()
    for i, (_, want) in cases.items():
        assert sorted(r.license for r in got if r.purl == i) == want
    assert component_licenses(frame.limit(0)).count() == 0


GNU = (
    "This program is free software{0} you can redistribute it and/or modify\nit under the terms of the GNU General Public "
    "License as published by\nthe Free Software Foundation{1} either version {2} of the License, or\n(at your option) any later version.\n"
)
BSD = (
    "Copyright (c) 2020, Someone\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\n"
    "modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer "
    "in the documentation\n   and/or other materials provided with the distribution.\n\n"
)
NAMES = (
    "3. Neither the name of {} nor the names of its\n   contributors may be used to endorse or promote products derived from\n"
    "   this software without specific prior written permission.\n"
)
MIT = (
    "Copyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and "
    'associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\n'
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the "
    "Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be "
    "included in all\ncopies or substantial portions of the Software.\n"
)
MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\n"
    "file, You can obtain one at https://mozilla.org/MPL/2.0/.\n"
)


def test_published_notices(spark):
    notices = [
        (GNU.format(":", ",", 3), "GPL-3.0-or-later"), (GNU.format(";", ";", 2), "GPL-2.0-or-later"),
        (GNU.format(";", ";", 3), "GPL-3.0-or-later"), (GNU.format(":", ",", 2), "GPL-2.0-or-later"),
        (MPL, "MPL-2.0"), (BSD, "BSD-2-Clause"), (BSD + NAMES.format("the copyright holder"), "BSD-3-Clause"),
        (BSD + NAMES.format("Some Company, Inc."), "BSD-3-Clause"), (MIT, "MIT"),
    ]
    shapes = [lambda t: t, lambda t: "Copyright (c) 2020 X\n\n" + t, lambda t: "/*\n" + "".join(f" * {x}\n" for x in ("X", "", *t.split("\n")))]
    cases = {(i, k): (shape(t), want) for i, (t, want) in enumerate(notices) for k, shape in enumerate(shapes)}
    # Every known sentence on its own, as it is in the table, is recognised.
    cases |= {(s, 0): (f"First words.\n\n{s[0].upper()}{s[1:]}\n\nlast", None) for s in SENTENCES}
    frame = spark.createDataFrame([(str(k), t) for k, (t, _) in cases.items()], "purl string, license_text string")
    got = {}
    for r in component_licenses(frame).collect():
        got.setdefault(r.purl, []).append(r.license)
    for k, (_, want) in cases.items():
        assert got.get(str(k)) == [want] if want else got.get(str(k)), k


def recognised(text):
    """Licences of a text, by the definition: sentences of each reading, then rules in order."""
    known = re.compile(r"licen[cs]e|permission|redistribution|free software|terms of|copyright|public domain|boost software|cc0", re.I)
    if not known.search(text or ""):
        return []
    clause = r"(neither\W+the\W+name\W+of)\W(?:(?!\bneither\W+the\W+name\W+of\W).)+?\W(nor\W+the\W+names\W+of\W+its\W+contributors)\b"
    text = re.sub(r"(?is)\b" + clause, r"\1 the copyright holder \2", text)
    end, blank = r"(?<=[.!?;:])(?<!\bv\.)(?<!\bV\.)\s+", r"\n[^a-zA-Z0-9\n]*\n\s*"
    found = []
    for cut in (r"(?<=[.!?;:])\s+", f"{blank}|{end}", rf"\n\s*|{end}"):
        ids = []
        for sentence in re.split(cut, text):
            words = " ".join(re.findall("[a-z0-9]+", sentence.lower()))
            words = re.sub("^([0-9]+|[a-d]) (?=redistributions |neither )", "", words)
            ids += [SENTENCES[words]] if words in SENTENCES else []
        for name, rule in RULES:
            at = 0
            while at + len(rule) <= len(ids):
                if tuple(ids[at : at + len(rule)]) == rule:
                    ids[at : at + len(rule)] = [None]
                    found.append(name)
                at += 1
        found += ["incomplete"] if any(ids) else []
    return sorted(set(found) - {"incomplete"} or set(found))


def test_licences_equal_the_definition(spark):
    """Random mixtures of known sentences, notices and other text against a matcher in plain Python."""
    rng = random.Random(12)
    parts = [*SENTENCES, "Some other words.", "The end", "copyright 2020 x", "", "v. 2.0", BSD, MIT, NAMES.format("A. B. Inc."), NAMES.format("x " * 2000)]
    texts = ["".join(rng.choice(parts) + rng.choice([". ", "; ", "\n", "\n\n", ": ", ".\n * ", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    texts += [BSD + NAMES.format("the " + "long " * 3000), NAMES.format("X") * 3, "neither the name of X. " * 2000 + BSD]
    frame = spark.createDataFrame(list(enumerate(texts)), "purl int, license_text string")
    got = {}
    for r in component_licenses(frame).collect():
        got.setdefault(r.purl, []).append(r.license)
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == recognised(text), text[:500]


def test_sentences_apart_stay_apart(spark):
    grant = next(s for s, i in SENTENCES.items() if i == "mit_grant")
    notice = next(s for s, i in SENTENCES.items() if i == "mit_notice")
    text = f"{grant}.\n\nlicensed under cc0 1 0.\n\n{notice}."
    got = component_licenses(spark.createDataFrame([("p", text)], "purl string, license_text string")).collect()
    assert [r.license for r in got] == ["CC0-1.0"]


@pytest.mark.parametrize("notice,name", [
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as "
     "published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n", "LGPL-2.1-or-later"),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published "
     "by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n", "AGPL-3.0-or-later"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
     "copyright notice and this permission notice appear in all copies.\n", "ISC"),
    ("This is free and unencumbered software released into the public domain.\n", "Unlicense"),
])
def test_more_published_notices(spark, notice, name):
    shapes = [notice, "Copyright (c) 2020 X\n\n" + notice, "/*\n" + "".join(f" * {x}\n" for x in ("X", "", *notice.split("\n")))]
    frame = spark.createDataFrame(list(enumerate(shapes)), "purl int, license_text string")
    assert [(r.purl, r.license) for r in component_licenses(frame).orderBy("purl").collect()] == [(i, name) for i in range(3)]


def test_archives_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}\r\n", "".join(random.choices("abc <>é", k=random.choice((5, 400, 3000))))) for i in range(60)]
    same = "<p>same page</p>" * 100
    rows += [(100 + i, None, same) for i in range(9)] + [(200, "u", None), (201, "u", ""), (300, "u", "short"), (301, "u", "short"), (None, "u", same)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, document string, record_type string")
    got = archive_pages(frame).collect()
    import hashlib

    assert len(got) == len(rows)
    for r in got:
        text = next(d for i, _, d in rows if i == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), hashlib.sha1(text.encode()).hexdigest())
        revisit = text == same and r.page_id != 108
        assert (r.record_type, r.refers_to) == (("revisit", 108) if revisit else ("response", None))
        assert revisit or bytes(r.document).decode() == text
    files = write_archives(frame.select("page_id", "url", "document"), str(tmp_path), archive_bytes=2000).collect()
    assert sum(f.records for f in files) == len(rows) and len(files) > 3
    for f in files:
        with open(f.path, "rb") as file:
            assert struct.unpack("<I", file.read(4))[0] == DICTIONARY_FRAME
    assert archive_pages(frame.limit(0)).count() == 0
