"""Benchmark decontamination: documents against a broadcast set of test n-grams, all in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.session import durable

WINDOW_WORDS = 10
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between the words of a lower-cased text
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # a word of a text as it is
# Hashes of test windows broadcast at once. The join's map takes at most 100 bytes a hash, so 50 MB;
# a larger set is asked part by part, one pass over the texts for each.
ROUND_HASHES = 500_000


def words(text: str) -> F.Column:
    """Words of a text in lower case (A-Z alone); a null text has none."""
    col = F.coalesce(F.col(text), F.lit(""))
    # Letters beyond A-Z must stay, so the built-in lower() serves pure ASCII texts only.
    low = F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.array_remove(F.split(low, BREAK), "")


def _digest(size: str, at: str) -> str:
    return f"xxhash64(slice(_w, {at} + 1, {size}))"


def _starts(size: str) -> str:
    return f"if(size(_w) < {size}, cast(array() as array<int>), sequence(0, size(_w) - {size}))"


def item_windows(
    items: DataFrame, size: int = WINDOW_WORDS, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """Distinct windows ``(window, size, h, items)`` of the test items.

    An item of fewer words than a window is one window; an item without words has none. Items with
    a null identifier have windows but name nobody.
    """
    w = items.select(F.col(id_col).cast("string").alias("item"), words(text_col).alias("_w"))
    w = w.where("size(_w) > 0").withColumn("_n", F.least(F.size("_w"), F.lit(size)))
    each = w.select("item", "_w", "_n", F.explode(F.expr(_starts("_n"))).alias("_at"))
    return (
        each.select(
            "item",
            F.expr("array_join(slice(_w, _at + 1, _n), ' ')").alias("window"),
            F.col("_n").alias("size"),
            F.expr(_digest("_n", "_at")).alias("h"),
        )
        .groupBy("window", "size", "h")
        .agg(F.collect_set("item").alias("items"))
    )


def scan(
    docs: DataFrame,
    items: DataFrame,
    size: int = WINDOW_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    round_hashes: int = ROUND_HASHES,
) -> tuple[DataFrame, DataFrame]:
    """``(rows, hits)``: the word count of every row, and the verified windows of rows that have any.

    A row of ``rows`` is ``(_id, _th, n_words)`` and of ``hits`` ``(_id, _th, at, size, items)``,
    where ``_th`` is a hash of the text. The hashes of all windows of a text are probed, in the pass
    that makes them, in the broadcast hash set of the test windows; only a window that the set holds
    gets its words joined to a string, and a join on equal strings settles each hit. A row also
    probes a window of no words, which the set holds, so that its word count comes from that pass.
    """
    stored = durable(item_windows(items, size))
    sizes = sorted(r[0] for r in stored.select("size").distinct().collect())  # ``size`` at most
    hashes = stored.select("h").distinct()
    rounds = max(1, -(-hashes.count() // round_hashes))
    arrays = ["struct(0 as size, array(0L) as found)"] + [
        f"struct({s} as size, transform({_starts(str(s))}, i -> {_digest(str(s), 'i')}) as found)" for s in sizes
    ]
    split = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), words(text_col).alias("_w"))
    probed = (
        split.select("_id", "_th", "_w", F.explode(F.expr(f"array({', '.join(arrays)})")).alias("c"))
        .select("_id", "_th", "_w", "c.size", F.posexplode("c.found").alias("at", "h"))
    )
    parts = []
    for k in range(rounds):
        part = hashes.where(F.pmod("h", F.lit(rounds)) == k)
        asked = probed.where(F.pmod("h", F.lit(rounds)) == k)
        if k == 0:
            part = part.unionByName(docs.sparkSession.range(1).toDF("h"))
        parts.append(
            asked.join(F.broadcast(part), "h", "left_semi").select(
                "_id",
                "_th",
                F.size("_w").cast("bigint").alias("n_words"),
                "at",
                "size",
                F.expr("array_join(slice(_w, at + 1, size), ' ')").alias("window"),
            )
        )
    passed = parts[0]
    for more in parts[1:]:
        passed = passed.unionByName(more)
    passed = durable(passed)
    hits = (
        passed.where("size > 0")
        .join(stored.select("window", "size", "items"), ["window", "size"])
        .select("_id", "_th", "at", "size", "items")
    )
    return passed.where("size = 0").select("_id", "_th", "n_words"), hits


def _by_row(hits: DataFrame) -> DataFrame:
    """Hit word positions and item names of each row that has hits."""
    covered = "array_distinct(flatten(transform(_spans, s -> sequence(s.at, s.at + s.size - 1))))"
    return (
        hits.groupBy("_id", "_th")
        .agg(
            F.collect_set(F.struct("at", "size")).alias("_spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"),
        )
        .select("_id", "_th", F.expr(covered).alias("_hit"), "_items")
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    size: int = WINDOW_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    round_hashes: int = ROUND_HASHES,
) -> DataFrame:
    """``id_col, n_words, n_hit, n_items, items_sha256, contaminated`` of every row.

    Null, empty and wordless texts have no words and no hits; long texts are read whole. Repeated
    rows and null identifiers come back as they came in; other columns are ignored, whatever their
    names. An empty table gives an empty result, and without test items nothing is contaminated.
    """
    rows, hits = scan(docs, items, size, id_col, text_col, round_hashes)
    found = _by_row(hits)
    same = rows["_id"].eqNullSafe(found["_id"]) & (rows["_th"] == found["_th"])
    n = F.coalesce(F.size("_hit"), F.lit(0)).cast("bigint")
    return rows.join(found, same, "left").select(
        rows["_id"].alias(id_col),
        "n_words",
        F.when(F.col("_hit").isNull(), F.lit(0)).otherwise(n).cast("bigint").alias("n_hit"),
        F.when(F.col("_hit").isNull(), F.lit(0)).otherwise(F.size("_items")).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("_hit").isNotNull().alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    remove: str = "documents",
    size: int = WINDOW_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    round_hashes: int = ROUND_HASHES,
) -> DataFrame:
    """``docs`` without its contaminated ``documents``, or without the hit ``spans`` of their texts.

    A removed span takes its words and the separators before them. All columns stay as they are,
    whatever their names, but for the texts that lose spans. Null, empty and wordless texts stay;
    long texts are read whole; repeated rows and rows with equal identifiers are judged by their own
    texts; an empty table gives an empty result, and without test items everything stays.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove documents or spans")
    # by place, so that no name of the table meets one used here
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    _, hits = scan(plain, items, size, key, text, round_hashes)
    found = durable(_by_row(hits).select("_id", "_th", "_hit"))
    same = plain[key].eqNullSafe(found["_id"]) & (F.xxhash64(plain[text]) == found["_th"])
    if remove == "documents":
        return plain.join(found, same, "left_anti").toDF(*docs.columns)
    joined = plain.join(found, same, "left").withColumns(
        {
            "_w": F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)),
            "_s": F.split(text, WORD),
        }
    )
    rest = "array_join(transform(_w, (x, i) -> if(array_contains(_hit, i), '', concat(_s[i], x))), '')"
    cut = F.when(F.col("_hit").isNull(), F.col(text)).otherwise(
        F.concat(F.expr(rest), F.element_at("_s", -1))
    )
    return joined.select(*[cut.alias(c) if c == text else F.col(c) for c in plain.columns]).toDF(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w, row_number() OVER () AS r FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, n WHERE len(w) >= n)),
hit AS (SELECT r, dw.n, i, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN own USING (r)
"""
