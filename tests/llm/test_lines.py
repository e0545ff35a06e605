from collections import defaultdict

from pairlab.llm import line_dedup


def brute(rows, min_sites, keep_first=True):
    sites, first = defaultdict(set), {}
    for i, text, site in rows:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            k = line.strip(" \t\r")
            if k:
                if site is not None:
                    sites[k].add(site)
                place = (i is None, i or 0, pos)
                first[k] = min(first.get(k, place), place)
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None, 0))
            continue
        kept, gone = [], 0
        for pos, line in enumerate(text.split("\n")):
            k = line.strip(" \t\r")
            if k and len(sites[k]) >= min_sites and not (keep_first and first[k] == (i is None, i or 0, pos)):
                gone += 1
            else:
                kept.append(line)
        out.append((i, "\n".join(kept), gone))
    return sorted(out, key=str)


ROWS = [
    (10, "footer\nbody of ten\n\nfooter", "s1"),
    (2, "footer \r\nbody of two", "s2"),
    (3, "\tfooter\nmine", "s3"),
    (4, "footer\nnear", "s4"),
    (5, "near\nfooter", "s5"),
    (6, "near\nfooter", None),
    (7, "near", "s5"),
    (8, "near", "s6"),
    (None, "footer\nx", "s7"),
]


def test_equals_brute_force(frame, odd):
    for rows in (ROWS, ROWS + odd, odd, []):
        for k in (1, 2, 3, 5, 7):
            for first in (True, False):
                df = frame(rows)
                got = line_dedup.remove_shared_lines(df, k, first)
                assert got.columns == [*df.columns, "n_lines", "n_removed"]
                assert sorted(((r.doc_id, r.text, r.n_removed) for r in got.collect()), key=str) == brute(rows, k, first)


def test_many_sites_are_not_counted_exactly(frame):
    rows = [(i, f"shared\nown {i}", f"site {i}") for i in range(300)]
    rows += [(1000 + i, "near", f"site {i}") for i in range(100)]
    got = {r.doc_id: r for r in line_dedup.remove_shared_lines(frame(rows), 100).collect()}
    assert got[0].text == "shared\nown 0" and all(got[i].text == f"own {i}" for i in range(1, 300))
    assert got[1000].text == "near" and all(got[1000 + i].text == "" for i in range(1, 100))
    less = {r.doc_id: r.text for r in line_dedup.remove_shared_lines(frame(rows), 101).collect()}
    assert all(less[1000 + i] == "near" for i in range(100))
