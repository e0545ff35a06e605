import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from pairlab.llm import spelling


def one_edit(a, b):
    """Whether one inserted, deleted or replaced code point tells them apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return out


def variants(spark, counts, **sizes):
    rows = [(w, n, 1, "x") for w, n in counts.items()]
    df = spark.createDataFrame(rows, "word string, n bigint, other int, root string")
    got = spelling.group_variants(df, **sizes)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_words(seed, n, letters="abé", longest=6):
    rng = random.Random(seed)
    return {
        "".join(rng.choice(letters) for _ in range(rng.randrange(longest + 1))): 10 ** rng.randrange(5) * rng.randrange(1, 4)
        for _ in range(n)
    }


@pytest.mark.parametrize("sizes", [{}, {"word_bits": 2}, {"word_bits": 64, "filter_bytes": 64, "round_bytes": 200}])
def test_against_brute_force(spark, sizes):
    """Small filters hold nearly everything, small rounds are many: the result is the same."""
    counts = some_words(1, 400)
    got = variants(spark, counts, **sizes)
    assert got == brute(counts)
    assert max(len({r[2]} | {r[1]}) for r in got if r[1]) == 2  # chains of several steps


def test_ties_and_odd_words(spark):
    counts = {"aaaaaaa": 1, "baaaaaa": 10, "aaaaaab": 10, "\U0001f600x": 20, "x": 1, "": 2, "zzzzzzz": 5}
    got = variants(spark, counts)
    assert got == brute(counts)
    assert {r[0]: r[1] for r in got}["aaaaaaa"] == "aaaaaab"
    assert variants(spark, {}) == set()
    df = spark.createDataFrame([("abc", 1), ("abc", 2), (None, 9)], "word string, n bigint")
    assert [tuple(r) for r in spelling.group_variants(df).collect()] == [("abc", None, "abc", 3, 0, None)]
    with pytest.raises(ValueError):
        spelling.group_variants(df, ratio=1)


def counted(rows, slip):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-z\xc0-\xff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


@pytest.mark.parametrize("slip", [0, 3])
def test_vocabulary(spark, frame, odd, slip):
    rng = random.Random(slip)
    words = ["Straßen", "GRÖSSEN", "grÖssen", "example", "EXAMPLES", "a1b", "short", "ExamplesandMore", "École×÷é", "日本"]
    rows = [*odd, *((100 + i, " ".join(rng.choices(words, k=30)), "a") for i in range(40)), (None, "example " * 50, "b")]
    got = {r.word: r.n for r in spelling.vocabulary(frame(rows), slip=slip).collect()}
    assert got == counted(rows, slip)
    assert spelling.vocabulary(frame([]), slip=slip).collect() == []


def test_edits_are_proposed_once():
    words = ["aabbcca"]
    alphabet = np.array(sorted(map(ord, "abcd")), dtype=np.uint32)

    class All:
        of_length = {7: None, 6: None}

        def hits(self, h, length):
            return np.arange(len(h))

    found = [w for _, made in spelling.edits(spelling._codes(words), alphabet, All()) for w in spelling._words(made)]
    want = {w for i in range(7) for w in [words[0][:i] + words[0][i + 1 :]]}
    want |= {words[0][:i] + c + words[0][i + 1 :] for i in range(7) for c in "abcd" if c > words[0][i]}
    assert len(found) == len(set(found)) and set(found) == want


def test_hashes_of_edits_equal_those_of_their_words():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcxyzé") for _ in range(9)) for _ in range(50)]
    alphabet = np.array(sorted(map(ord, "abcxyzé")), dtype=np.uint32)
    seen = []

    class Keep:
        of_length = {9: None, 8: None}

        def hits(self, h, length):
            seen.append(h)
            return np.arange(len(h))

    for (_, made), h in zip(spelling.edits(spelling._codes(words), alphabet, Keep()), seen):
        want = (spelling.letter_values(made) * spelling.powers(made.shape[1])).sum(axis=1, dtype=np.uint64)
        assert (want == h).all()
