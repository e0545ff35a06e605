import pytest

from pairlab.llm import licenses

INDEX = licenses.Index(licenses.TEMPLATES)


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_finds_itself(name):
    text = f"Some words before, {licenses.TEMPLATES[name].upper()}\nand after the end."
    found = licenses.find_licenses(text, INDEX)
    assert [m.template for m in found] == [name]
    (m,) = found
    assert m.coverage == 1.0
    assert text[m.start : m.end] == licenses.TEMPLATES[name].upper().rstrip('."/')


def test_edited_and_partial_texts():
    words = licenses.TEMPLATES["MIT"].split()
    edited = " ".join(w for i, w in enumerate(words) if i % 25 != 7)  # some words left out
    (m,) = licenses.find_licenses(f"é {edited}", INDEX)
    assert m.template == "MIT" and 0.9 < m.coverage < 1
    more = " ".join(w + (" indeed" if i % 30 == 5 else "") for i, w in enumerate(words))
    (m,) = licenses.find_licenses(more, INDEX)
    assert m.template == "MIT" and m.coverage == 1.0
    assert licenses.find_licenses(" ".join(words[: len(words) // 2]), INDEX) == []
    assert licenses.find_licenses(" ".join(words[: len(words) // 2]), INDEX, 0.4)[0].template == "MIT"


def test_many_matches_and_places():
    line = licenses.TEMPLATES["Apache-2.0-line"]
    text = "\n".join(["filler words of no use"] * 5 + [line] * 40)
    found = licenses.find_licenses(text, INDEX)
    assert len(found) == 40 and len({m.start for m in found}) == 40
    both = licenses.TEMPLATES["MIT"] + " " + licenses.TEMPLATES["GPL-3.0-notice"]
    assert [m.template for m in licenses.find_licenses(both, INDEX)] == ["MIT", "GPL-3.0-notice"]


GNU = "GPL-2.0-or-later GPL-2.0-only GPL-3.0 GPL-3.0-only AGPL-3.0 LGPL-2.1 LGPL-3.0 LGPL-3.0-library".split()


@pytest.mark.parametrize("a", GNU)
@pytest.mark.parametrize("b", GNU)
def test_relatives_side_by_side(a, b):
    text = "\n\n".join(licenses.TEMPLATES[f"{x}-notice"].replace("software:", "software;") for x in (a, b))
    assert [m.template for m in licenses.find_licenses(text, INDEX)] == [f"{a}-notice", f"{b}-notice"]


def test_bsd_clauses():
    two = licenses.TEMPLATES["BSD-2-Clause"].replace("met: ", "met: 1. ").replace("disclaimer. R", "disclaimer. 2. R")
    end = ' THIS SOFTWARE IS PROVIDED "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'
    third = (
        " 3. Neither the name of the <organization> nor the names of its contributors may be used to endorse or"
        " promote products derived from this software without specific prior written permission."
    )
    assert [m.template for m in licenses.find_licenses(two + end, INDEX)] == ["BSD-2-Clause"]
    assert [m.template for m in licenses.find_licenses(two + third + end, INDEX)] == ["BSD-3-Clause"]


def brute_align(words, text):
    """Longest run of matches by the full local alignment, as score."""
    best, above = 0, [0] * (len(text) + 1)
    for w in words:
        row = [0]
        for j, t in enumerate(text):
            row.append(max(0, above[j] + (2 if t == w else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max([best, *row]), row
    return best


def test_alignment_equals_the_full_matrix():
    import random

    import numpy as np

    rng = random.Random(4)
    for _ in range(200):
        words = [rng.randint(1, 4) for _ in range(rng.randint(1, 9))]
        text = [rng.randint(0, 4) for _ in range(rng.randint(1, 12))]
        matched, first, last = licenses.align(words, np.array(text), 0, band=30)
        score = brute_align(words, text)
        assert (matched > 0) == (score > 0)
        assert 2 * matched >= score and matched <= min(len(words), len(text))


def test_rows(frame, odd):
    rows = licenses.scan(frame([*odd, (20, "Licensed under CC BY-NC 4.0.", "s")])).collect()
    assert len(rows) == len(odd) + 1
    by = {r.doc_id: r for r in rows}
    assert by[20].licenses == "CC-BY-NC-4.0-line" and by[20].matches[0]["coverage"] == 1.0
    assert all(r.n_licenses == 0 and r.licenses == "" and r.matches == [] for r in rows if r.doc_id != 20)
    assert licenses.scan(frame([])).count() == 0
