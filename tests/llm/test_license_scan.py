import re

import pytest

from prefixspark.llm import license_scan as S


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = [(i, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


@pytest.mark.parametrize("which", ["small_docs", "odd_docs"])
def test_matches_plain(which, request, texts):
    docs = request.getfixturevalue(which)
    rows = S.scan_licenses(docs).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows), key=key) == sorted(((i, *plain(t)) for i, t in texts(docs)), key=key)
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} for r in rows)


def test_places_and_labels():
    a = S._automaton()
    text = "the MIT-License, mit license; GNU General Public\nLicense version 3. Permit license mit"
    assert S.scan_text(text, a)[:5] == (14, 3, 1, 6, "gpl,mit") == plain(text)
    assert S.scan_text(text, a)[5:] == ("gpl,gpl-3.0,mit", 0.75)
    assert S.scan_text("", a) == (0, 0, None, None, "", "", 0.0)


@pytest.mark.parametrize(
    ("expression", "ids", "value"),
    [
        ("mit", ["mit"], 0.25),
        ("gpl-3.0 or mit", ["gpl-3.0", "mit"], 0.25),
        ("gpl-3.0 and mit", ["gpl-3.0", "mit"], 0.75),
        ("mit or gpl-2.0 and mpl-2.0", ["mit", "gpl-2.0", "mpl-2.0"], 0.25),
        ("(mit or gpl-2.0) and mpl-2.0", ["mit", "gpl-2.0", "mpl-2.0"], 0.5),
        ("gpl-2.0 with classpath-exception-2.0", ["gpl-2.0"], 0.6),
        ("mit and gpl-2.0 with classpath-exception-2.0 or isc", ["mit", "gpl-2.0", "isc"], 0.25),
        ("unheard-of", ["unheard-of"], 0.9),
    ],
)
def test_expressions(expression, ids, value):
    got = S.evaluate(S.to_postfix(expression))
    assert got[0] == ids and got[1] == pytest.approx(value)


@pytest.mark.parametrize("bad", ["", "and", "mit or", "(mit", "mit)", "( )", "or mit"])
def test_malformed(bad):
    with pytest.raises(ValueError):
        S.to_postfix(bad)


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("GNU Lesser General Public License", "gpl,lgpl", 0.5),
        ("GNU Lesser General Public License and the General Public License", "gpl,lgpl", 0.75),
        ("the General Public License. GNU Lesser General Public License", "gpl,lgpl", 0.75),
        ("Creative Commons Attribution 4.0", "cc-by", 0.25),
        ("Creative Commons Attribution-NonCommercial 4.0", "cc-by,cc-by-nc", 0.75),
        ("Creative Commons Attribution-ShareAlike", "cc-by,cc-by-sa", 0.5),
        ("SPDX-License-Identifier: CC-BY-NC-ND-4.0", "spdx:cc-by-nc-nd-4.0", 0.75),
        ("SPDX-License-Identifier: CC-BY-4.0", "spdx:cc-by-4.0", 0.25),
        ("SPDX-License-Identifier: MIT and see the file", "spdx:mit", 0.25),
        ("SPDX-License-Identifier: (MIT or see the file", "spdx:malformed", 0.9),
        ("SPDX-License-Identifier: GPL-2.0-or-later.", "spdx:gpl-2.0-or-later", 0.75),
        ("SPDX-License-Identifier: LGPL-2.1+ AND BSD-3-Clause", "spdx:bsd-3-clause,spdx:lgpl-2.1+", 0.5),
        ("SPDX-License-Identifier: mittens-1.0", "spdx:mittens-1.0", 0.9),
        ("SPDX-License-Identifier: Proprietary", "spdx:proprietary", 0.9),
    ],
)
def test_the_longest_phrase_and_whole_identifiers_count(text, labels, score):
    assert S.scan_text(text, S._automaton())[5:] == (labels, score)


def test_tag_adds_labels():
    row = S.scan_text("// SPDX-License-Identifier: (Apache-2.0 OR MIT) AND GPL-2.0\n# SPDX-License-Identifier: mit or", S._automaton())
    assert row[4] == "" and row[5] == "spdx:apache-2.0,spdx:gpl-2.0,spdx:malformed,spdx:mit" and row[6] == 0.9


def test_empty_table(no_docs):
    assert S.scan_licenses(no_docs).count() == 0
