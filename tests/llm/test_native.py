"""Exact dedup, licence scan, quality rules and preference formatting against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracekiln.llm import chat_format, exact_dedup, license_scan, quality_rules

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n\t", "a b", "ab", "a\tb ", "ab\n", "É x", "Éx", "x" * 30_000, "one two three one two three", "new\nline", "tail ", "tail"]
CLASHING = "doc_id long, text string, digest string, best string, kept string, words string, item string, n long, signature string, norm string"


def documents(spark, texts, extra=()):
    rows = [(i, t, *["?"] * 5, 0, "?", "?") for i, t in enumerate(texts)]
    rows = [(r[0], r[1], "d", "b", "k", "w", "i", 1, "s", "n") for r in rows]
    return spark.createDataFrame([*rows, *extra], CLASHING)


def expected_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id))
    return {i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


def test_exact_groups(spark):
    df = documents(spark, TEXTS)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(df).collect()}
    assert got == expected_groups(list(enumerate(TEXTS)))


def test_exact_groups_when_digests_collide(spark):
    """One hexadecimal digit as digest: the full bytes decide."""
    r = random.Random(4)
    texts = ["".join(r.choice("ab ") for _ in range(r.randint(0, 5))) for _ in range(80)]
    weak = lambda norm: F.substring(F.sha2(norm.cast("binary"), 256), 1, 1)
    got = {x["doc_id"]: (x["keep_id"], x["group_size"], x["kept"], x["text_sha256"]) for x in exact_dedup.exact_groups(documents(spark, texts), weak).collect()}
    want = expected_groups(list(enumerate(texts)))
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}


def test_exact_groups_of_a_large_group(spark):
    """More copies than HOT_LEAST beside small groups and single texts."""
    texts = ["copy" + " " * (i % 3) for i in range(exact_dedup.HOT_LEAST + 44)] + [f"t{i // 2}" for i in range(20)] + [f"s{i}" for i in range(20)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(documents(spark, texts)).collect()}
    assert got == expected_groups(list(enumerate(texts)))
    assert exact_dedup.deduplicated(documents(spark, texts)).count() == 31


def test_different_bytes_of_hit_digests_are_found(spark):
    """Bits of hit digests leave every hit text in, wherever its bit lies."""
    texts = [f"{i % 500}{'' if i < 500 else '!'}" for i in range(1000)]
    docs = documents(spark, texts)
    by_number = lambda norm: F.sha2(F.replace(norm, F.lit("!"), F.lit("")).cast("binary"), 256)
    groups = docs.groupBy(by_number(exact_dedup.normalised("text")).alias("digest")).agg(F.count(F.lit(1)).alias("group_size"))
    assert exact_dedup.colliding(docs, groups, by_number).count() == 500


def test_exact_groups_with_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "z")], "doc_id long, text string")
    rows = exact_dedup.exact_groups(df).collect()
    assert len(rows) == 4 and sum(r["kept"] for r in rows) == 2
    assert [r["keep_id"] for r in rows if r["doc_id"] == 1] == [1, 1] and {r["group_size"] for r in rows} == {3, 1}
    left = exact_dedup.deduplicated(df)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == [(0, "z"), (1, "a")]


@pytest.mark.parametrize("make", [exact_dedup.exact_groups, exact_dedup.deduplicated, license_scan.licenses, quality_rules.quality, quality_rules.cleaned])
def test_empty_table(spark, make):
    assert make(documents(spark, []).limit(0)).count() == 0


def test_state_goes_on_with_more_files(spark, tmp_path):
    log, state, out = (str(tmp_path / x) for x in ("log", "state", "out"))
    seen = []
    for part in (["a", "b"], ["a ", "c", "a"]):
        rows = exact_dedup.fingerprints(spark.createDataFrame([(len(seen) + i, t) for i, t in enumerate(part)], "doc_id long, text string"))
        seen += part
        rows.write.mode("append").parquet(log)
        last = exact_dedup.keyed_state(spark, log, rows, state, out).collect()
    sizes = {r["digest"]: (r["keep_id"], r["group_size"]) for r in last}
    assert sizes[hashlib.sha256(b"a").hexdigest()] == (2, 3) and len(sizes) == 3


def quality_of(text):
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {p + k for at in windows.values() if len(at) > 1 for p in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_state_stores_are_closed_with_their_tasks(spark):
    manager = spark._jvm.org.apache.spark.sql.execution.streaming.state.RocksDBMemoryManager
    before = manager.getNumRocksDBInstances(True)
    rows = documents(spark, ["a b", "ab", "c"])
    assert sorted(r["keep_id"] for r in exact_dedup.exact_groups(rows).collect()) == [0, 0, 2]
    assert manager.getNumRocksDBInstances(True) <= before


def test_quality_figures(spark):
    r = random.Random(6)
    texts = list(TEXTS)
    for n in (10, 60, 300, 4000):
        for size in (3, 30, 3000):
            texts.append("".join(r.choice([f"w{r.randrange(size)} ", f"w{r.randrange(size)}.\n", "# ", "\t"]) for _ in range(n)))
    got = {x["doc_id"]: x for x in quality_rules.quality(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == quality_of(t), (i, t)
        assert not (x["kept"] and x["base_failed"])


def test_line_rules(spark):
    prose = "\n".join(" ".join(f"word{i}x{j}" for j in range(9)) + "." for i in range(8))
    menu = "\n".join(f"home{i} | about{i} | more{i} | contact{i} | this | that | other | last{i}." for i in range(12))
    got = [r["kept"] for r in quality_rules.quality(documents(spark, [prose, menu, prose + "\nAll rights reserved."])).orderBy("doc_id").collect()]
    assert got == [True, False, True]
    assert quality_rules.cleaned(documents(spark, ["Stays.\n\nAll rights reserved.\nno end"])).first()["text"] == "Stays.\n"


def test_licenses(spark):
    notice = "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License! "
    rest = "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    texts = [None, "", "Prose.\nReleased under the MIT License.\nMore. All rights reserved.", notice, notice.upper() + rest, "Released under the MIT License. " * 3, "x. " * 20_000 + "Licensed under CC BY-NC 4.0.", "the license is nice"]
    got = [(r["sentence_ids"], r["licenses"], r["unruled"], r["n_licenses"]) for r in license_scan.licenses(documents(spark, texts)).orderBy("doc_id").collect()]
    assert got == [
        ("", "", "", 0),
        ("", "", "", 0),
        ("M1 R1", "MIT all-rights-reserved", "", 2),
        ("A1 A2", "Apache-2.0", "A2", 1),
        ("A1 A2 A3 A4", "Apache-2.0-notice", "", 1),
        ("M1 M1 M1", "MIT", "", 1),
        ("C1", "CC-BY-NC-4.0", "", 1),
        ("", "", "", 0),
    ]


def test_preferences_like_brute_force(spark):
    r = random.Random(8)
    rows = []
    for c in range(40):
        for t in range(r.randint(0, 5)):
            rows.append((c, t, r.choice(["user", "assistant", None]) if t else "user", r.choice(["a", "bb", None, "é"]), "x"))
    rows += [(3, 0, "user", "again", "x"), (None, 0, "user", "lost", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rejected string")
    got = {x["pair_id"]: x for x in chat_format.preferences(chat_format.neighbours(df.repartition(3))).collect()}
    sides = defaultdict(list)
    for c, t, role, text, _ in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1], x[2] or "", x[3] or "")):
        sides[c].append((role or "", text or ""))
    show = lambda turns: "".join(f"<|{a}|>\n{b}\n<|end|>\n" for a, b in turns)

    def spans(turns):
        at, out = 0, []
        for a, b in turns:
            begin, end = at + len(f"<|{a}|>\n"), at + len(show([(a, b)]))
            out += [f"{begin}:{end}"] if a == "assistant" else []
            at = end
        return ",".join(out)

    for p in {c // 2 for c in sides}:
        a, b = sides.get(2 * p, []), sides.get(2 * p + 1, [])
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        x = got.pop(p)
        assert (x["n_prefix"], x["prompt"], x["chosen"], x["rejected"]) == (n, show(a[:n]), show(a[n:]), show(b[n:]))
        assert (x["chosen_mask"], x["rejected_mask"]) == (spans(a[n:]), spans(b[n:]))
    assert not got
    assert chat_format.preferences(chat_format.neighbours(df.limit(0))).count() == 0
    assert Counter(x["pair_id"] for x in chat_format.neighbours(df).collect())


APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
"""
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer."""


def test_wrapped_licenses(spark):
    texts = [APACHE, MIT, GPL, BSD, " ".join(APACHE.replace("*", "").split()), " ".join(MIT.split()), " ".join(BSD.split()), APACHE.replace("\n", "\r\n")]
    texts += ["Released under\n\nthe MIT License.", "Released under the. MIT License.", "Prose\nReleased under the MIT\nLicense"]
    got = [(r["sentence_ids"], r["licenses"]) for r in license_scan.licenses(documents(spark, texts)).orderBy("doc_id").collect()]
    apache, mit, bsd = ("A1 A2 A3 A4", "Apache-2.0-notice"), ("M2 M3 M4", "MIT-text"), ("B1 B2", "BSD-text")
    assert got == [apache, mit, ("G2 G3", "GPL-3.0-or-later-notice"), bsd, apache, mit, bsd, apache, ("", ""), ("", ""), ("M1", "MIT")]


def test_reserved_by_any_space(spark):
    texts = ["All rights  reserved.", "All rights\treserved.", "All rights reserved.", "All rights\nreserved."]
    assert [r["sentence_ids"] for r in license_scan.licenses(documents(spark, texts)).collect()] == ["R1"] * 4
