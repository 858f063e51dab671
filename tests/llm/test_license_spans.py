"""Licences inside other words, over lines, and at several corpus sizes."""

import pytest

from tests.llm.conftest import words
from verity.llm import licenses

SIZES = (100, 10_000, 1_000_000)


def matcher(texts):
    """Terms of the templates in the shares that they have in a corpus of any size."""
    held = {t: texts // (2 if t in ("the", "of", "is", "to", "in", "and", "this") else 50 + 10 * (len(t) % 7)) for some in licenses.TEMPLATES.values() for x in some for t in licenses.terms(x)}
    return licenses.Matcher(licenses.TEMPLATES, texts, held)


@pytest.mark.parametrize("texts", SIZES)
def test_each_licence_inside_other_words(texts):
    m = matcher(texts)
    for name, some in licenses.TEMPLATES.items():
        for k, template in enumerate(some):
            around = words(30 + k, 40)
            inside = " ".join(template.split()[: len(template.split()) // 2]), " ".join(template.split()[len(template.split()) // 2:])
            for text in (f"{' '.join(around[:20])} {template} {' '.join(around[20:])}", f"Copyright (c) 2024 Jane Doe. {template}",
                         f"# {inside[0]}\n# {inside[1]}\n{' '.join(around)}", f"{' '.join(around * 20)} {template} {' '.join(around * 20)}"):
                found, cosine = m.best(text)
                assert found == name and cosine >= licenses.THRESHOLD, (texts, name, text, found, cosine)


def test_scores_do_not_depend_on_the_corpus_size():
    for text in ("The text of this page is Released under the MIT License.", "Copyright (c) 2024 Jane Doe. Licensed under the MIT License.",
                 "This file is licensed, to you, under the Apache License, Version 2.0"):
        scores = [matcher(n).best(text) for n in SIZES]
        assert len({s[0] for s in scores}) == 1 and scores[0][0] and max(s[1] for s in scores) - min(s[1] for s in scores) < 0.02, scores
        assert min(s[1] for s in scores) >= licenses.THRESHOLD


def test_spdx_identifiers_name_the_licence():
    for line, name in (("SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: (GPL-2.0-or-later OR Foo)", "GPL-2.0"), ("# spdx-license-identifier: apache-2.0", "Apache-2.0"),
                       ("/* SPDX-License-Identifier: LGPL-3.0-only */", "LGPL-3.0"), ("SPDX-License-Identifier: AGPL-3.0+", "AGPL-3.0")):
        assert matcher(10_000).best(f"code\n{line}\nmore") == (name, 1.0)


def test_other_texts_have_no_licence():
    m = matcher(10_000)
    for text in ("Licensed under the Foo License.", "The driving licence is valid in the public domain of roads.", "copyright " + " ".join(words(5, 300)), "SPDX-License-Identifier: Foo-1.0"):
        assert m.best(text)[1] < licenses.THRESHOLD, (text, m.best(text))


def test_notices_over_several_lines():
    notice = ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n"
              " * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\nint main() {}")
    assert [matcher(n).best(notice)[0] for n in SIZES] == ["MPL-2.0"] * 3 and matcher(10_000).best(notice)[1] > 0.9


def test_rulers_and_links_between_cue_and_wording():
    """Words are counted, not characters: nothing that is no word hides a licence."""
    m = matcher(10_000)
    for gap in ("-" * 3000, " " * 5000 + "\n" * 50, "https://example.org/" + "/".join("~" * 900) + " "):
        for text in (f"Copyright 2024 Jane Doe\n{gap}\nReleased under the MIT License.", f"{gap}Released under the MIT{gap} License.{gap}",
                     f"Permission is hereby granted,{gap} free of charge, to any person obtaining a copy of this software"):
            assert m.best(text)[0] == "MIT" and m.best(text)[1] >= licenses.THRESHOLD, text[:60]
