import hashlib
import random
import re

import pytest

from pairlab.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).update([] if i is None else [str(i)])
    out = []
    for i, t, _ in docs:
        w, hit, names = words(t), set(), set()
        for win, own in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    names |= own
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "Alpha beta, gamma delta epsilon"), (2, "one-word"), (30, "É é x"), (4, None), (5, " ,;"), (None, "nobody owns this"), (1, "alpha beta again"), (30, "É é x")]
DOCS = [
    (1, "so ALPHA beta gamma\ndelta-epsilon zeta", "a"),
    (2, "alpha beta", "a"),
    (3, "One word. one  WORD", "a"),
    (4, "É é X", "a"),
    (5, "é é x", "a"),
    (6, "nobody owns this", "b"),
    (7, "alpha beta gamma alpha beta gamma", "b"),
]


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(*r, "c") for r in ITEMS], "item_id bigint, text string, window string")


@pytest.mark.parametrize("size", [1, 3, 10])
@pytest.mark.parametrize("held", [decontaminate.ROUND_HASHES, 3])
def test_equals_brute_force(spark, frame, odd, items, size, held):
    docs = DOCS + odd[:7]
    got = decontaminate.contamination(frame(docs), items, size, round_hashes=held).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, ITEMS, size)


def test_random_texts(spark, frame):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcAB") for _ in range(n))
    docs = [(i, text(rng.randint(0, 60)), "s") for i in range(60)]
    items = [(i, text(rng.randint(0, 9))) for i in range(12)]
    df = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(frame(docs), df, 5).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items, 5)


def test_empty_tables(spark, frame, items, odd):
    assert decontaminate.contamination(frame([]), items).count() == 0
    rows = decontaminate.contamination(frame(odd), items.limit(0)).collect()
    assert len(rows) == len(odd) and not any(r.contaminated for r in rows)
    assert decontaminate.decontaminate(frame(odd), items.limit(0)).count() == len(odd)


def test_removal(spark, frame, items, odd):
    df = frame(DOCS + odd)
    kept = decontaminate.decontaminate(df, items, size=3)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    clean = [i for i, _, _, _, _, c in brute(DOCS + odd, ITEMS, 3) if not c]
    assert sorted(ids, key=str) == sorted(clean, key=str)
    cut = decontaminate.decontaminate(frame([*DOCS, (None, None, "z")]), items, remove="spans", size=3)
    assert cut.columns == df.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {
        1: "so zeta", 2: "alpha beta", 3: "", 4: "", 5: "é é x", 6: "", 7: "", None: None
    }
    with pytest.raises(ValueError):
        decontaminate.decontaminate(df, items, remove="words")


def test_hash_set_is_probed_in_the_pass_that_makes_the_windows(spark, frame, items, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return durable(df)

    durable = decontaminate.durable
    monkeypatch.setattr(decontaminate, "durable", seen)
    decontaminate.scan(frame(DOCS), items, 3)
    plan = plans[-1]
    assert "BroadcastHashJoin" in plan and "Generate posexplode" in plan
    assert "SortMergeJoin" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_clashing_names(spark, items, remove):
    rows = [(1, "so alpha beta gamma", 7, "a", "b", "c", 2, 3), (2, "clean words", 8, "d", "e", "f", 4, 5)]
    df = spark.createDataFrame(
        rows, "doc_id bigint, text string, _hit int, _w string, _s string, _id string, _th bigint, c0 int"
    )
    got = sorted(tuple(r) for r in decontaminate.decontaminate(df, items, remove, size=3).collect())
    assert got == ([rows[1]] if remove == "documents" else [(1, "so", *rows[0][2:]), rows[1]])
    assert decontaminate.contamination(df, items, 3).where("contaminated").count() == 1
