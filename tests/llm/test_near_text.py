import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairlab.llm import near_text
from pairlab.session import durable


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_kept(rows):
    sets = [brute_set(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (n, _, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(n)
    return sorted(min(g) for g in groups.values())


def near_rows(seed):
    """Texts of 30 to 400 words, each with copies of which one to many words are changed."""
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 60, 120, 400]))]
        rows.append(" ".join(words))
        for changes in (0, 1, 2, len(words) // 60, len(words) // 40, len(words) // 25):
            copy = list(words)
            for i in rng.sample(range(len(copy)), changes):
                copy[i] = "changed"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return [(i, t, "a") for i, t in enumerate(rows)]


def test_stage_removes_pairs_at_the_similarity(spark, frame):
    rows = near_rows(3)
    want = brute_kept(rows)
    assert len(want) < len({t for _, t, _ in rows}) - 20  # many pairs differ
    kept = corpus_pipeline.remove_near_duplicates(spark, frame(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == want


@pytest.mark.parametrize(("tile_rows", "tile_shingles"), [(1, 1 << 20), (4, 1 << 20), (512, 150)])
def test_tiles_do_not_matter(spark, frame, tile_rows, tile_shingles):
    rows = near_rows(4)
    kept = near_text.keep_one(frame(rows), tile_rows=tile_rows, tile_shingles=tile_shingles)
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)


def test_similar_counts_exactly(monkeypatch):
    monkeypatch.setattr(near_text, "COLUMNS", 3)
    rng = random.Random(5)
    sets = [{rng.randrange(12) for _ in range(rng.randint(1, 12))} for _ in range(60)]
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    got = near_text.similar(arrays[:25], arrays[25:])
    want = [[5 * len(a & b) >= 4 * len(a | b) for b in sets[25:]] for a in sets[:25]]
    assert got.tolist() == want


def test_odd_rows(spark, frame, odd):
    more = [
        (4, "a quite different text under the same number", "b"),
        (None, "text without a number", "z"),
        (None, "text without a number", "z"),
    ]
    df = frame([*odd, *more])
    rows = near_text.keep_one(df).collect()
    got = sorted((r.doc_id or 0, (r.text or "")[:10]) for r in rows)
    assert got == [
        (0, "text witho"), (1, ""), (4, "a quite di"), (4, "same text "), (5, "wörd wörd "), (6, "xxxxxxxxxx")
    ]
    assert near_text.keep_one(frame([])).count() == 0


def test_clashing_names(spark):
    rows = [(1, "one two three four five six", 7, "a", "b", 1), (2, "ONE two three four five six", 8, "c", "d", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _row int, _cls string, _keys string, _n int")
    assert [tuple(r) for r in near_text.keep_one(df).collect()] == rows[:1]


def test_texts_are_not_shuffled(spark, frame):
    """Neither the rows to compare nor those to drop make the texts move, whatever the tables' sizes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = near_rows(6)
        kept = near_text.keep_one(frame(rows))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_marks_name_places_in_parts(spark):
    rows = spark.range(0, 1000, 1, 7).select("id", F.monotonically_increasing_id().alias("_row"))
    picked = durable(rows).where("id % 13 = 5 AND id < 700")
    stored = durable(rows)
    for inside in (True, False):
        got = near_text._marked(stored, picked.select("_row"), inside)
        assert sorted(r.id for r in got.collect()) == [i for i in range(1000) if (i % 13 == 5 and i < 700) == inside]
    assert near_text._marked(stored, picked.where("id < 0"), False).count() == 1000


def test_fingerprints_propose(spark):
    """Classes that share no band are still proposed if their fingerprints differ in two bits at most."""
    classes = spark.createDataFrame([(7, 0b1), (3, 0b1), (9, 0b110), (5, 0b1110000)], "_cls bigint, _fp bigint")
    edges = near_text._fingerprint_edges(classes)
    roots = {r.node: r.root for r in near_text.connected_components(edges).collect()}
    assert roots == {7: 3, 3: 3}
    wide = spark.createDataFrame([(7, 0b1), (3, 0b111), (9, -1)], "_cls bigint, _fp bigint")
    assert {r.node: r.root for r in near_text.connected_components(near_text._fingerprint_edges(wide)).collect()} == {7: 3, 3: 3}
    text = " ".join(f"w{i}" for i in range(300))
    assert near_text._fingerprint(near_text.shingles(text)) == near_text.simhash.simhash(text, 5)
