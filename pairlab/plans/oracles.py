"""Oracle SQL: independent formulations of the registered queries for an ANSI SQL engine."""

from __future__ import annotations

from pairlab import schema as S
from pairlab.operators.sequences import DESCRIPTORS
from pairlab.plans import derived
from pairlab.plans.derived import oracle_with
from pairlab.plans.registry import EXPECTED, POOL_FEATURES

ORACLES: dict[str, object] = {}
KEY = "strftime(MatchDate, '%Y-%m-%d') AS MatchDate, Division, HomeTeam, AwayTeam"
ONE = "CAST(1 AS DOUBLE)"


def oracle(fn):
    ORACLES[fn.__name__] = fn
    return fn


def build() -> dict[str, str]:
    return {name: fn() for name, fn in ORACLES.items()}


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def rnd(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + {dbl('0')} AS {name}"


def sides_sql(stats: bool = True) -> str:
    """Home and away rows with a sequence number and the count of strictly earlier rows."""
    cols = []
    for stat in S.ROLLED_STATS:
        h, a = ("FTHome", "FTAway") if stat == "Goals" else (f"Home{stat}", f"Away{stat}")
        cols.append((stat, h, a))

    def one(side: str) -> str:
        t, w, lo = ("HomeTeam", "H", "A") if side == "H" else ("AwayTeam", "A", "H")
        parts = [
            f"{x if side == 'H' else y} AS {stat}_for, {y if side == 'H' else x} AS {stat}_against"
            for stat, x, y in cols
        ]
        return (
            f"SELECT MatchDate, SeasonStartYear, Division, HomeTeam, AwayTeam, '{side}' AS side, {t} AS team, "
            f"CASE FTR WHEN '{w}' THEN {dbl('3')} WHEN 'D' THEN {ONE} WHEN '{lo}' THEN {dbl('0')} END AS points, "
            + ", ".join(parts)
            + " FROM matches"
        )

    return f"""sides AS (
SELECT *, row_number() OVER (PARTITION BY Division, SeasonStartYear, team ORDER BY MatchDate, HomeTeam, AwayTeam) AS seq,
  count(*) OVER (PARTITION BY Division, SeasonStartYear, team ORDER BY MatchDate
                 RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS prior_n,
  count(*) OVER (PARTITION BY Division, SeasonStartYear, team ORDER BY MatchDate
                 RANGE BETWEEN INTERVAL 13 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS n14,
  max(MatchDate) OVER (PARTITION BY Division, SeasonStartYear, team ORDER BY MatchDate
                 RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS last_date
FROM ({one('H')} UNION ALL {one('A')}) u)"""


def avg_k(expr: str, k: int) -> str:
    return (
        f"avg({expr}) OVER (PARTITION BY Division, SeasonStartYear, team ORDER BY MatchDate, HomeTeam, AwayTeam "
        f"ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    )


def rolling_sql() -> str:
    incl = []
    for stat, windows in S.ROLLED_STATS.items():
        for k in windows:
            incl.append(f"{avg_k(stat + '_for', k)} AS {stat}ForAvg{k}")
            incl.append(f"{avg_k(stat + '_against', k)} AS {stat}AgainstAvg{k}")
    incl.append(f"{avg_k('points', 3)} AS Form3")
    incl.append(f"{avg_k('points', 5)} AS Form5")
    return f"incl AS (SELECT Division, SeasonStartYear, team, seq, {', '.join(incl)} FROM sides)"


def joined_sql() -> str:
    """Match rows with the home (h) and away (a) side and their inclusive row at seq = prior_n."""
    on = "i{0}.Division = {0}.Division AND i{0}.SeasonStartYear = {0}.SeasonStartYear AND i{0}.team = {0}.team AND i{0}.seq = {0}.prior_n"
    match = "{0}.MatchDate = m.MatchDate AND {0}.Division = m.Division AND {0}.HomeTeam = m.HomeTeam AND {0}.AwayTeam = m.AwayTeam AND {0}.side = '{1}'"
    return (
        f" FROM matches m JOIN sides h ON {match.format('h', 'H')} JOIN sides a ON {match.format('a', 'A')}"
        f" LEFT JOIN incl ih ON {on.format('h')} LEFT JOIN incl ia ON {on.format('a')}"
    )


MKEY = "strftime(m.MatchDate, '%Y-%m-%d') AS MatchDate, m.Division, m.HomeTeam, m.AwayTeam"


def rolling_select(digits: int) -> list[str]:
    out = []
    for side, alias in (("H", "ih"), ("A", "ia")):
        for base, _stat, kind, k in S.rolling_bases():
            if kind == "Diff":
                expr = f"{alias}.GoalsForAvg{k} - {alias}.GoalsAgainstAvg{k}"
            else:
                expr = f"{alias}.{base}"
            out.append(rnd(expr, f"{base}_{side}_pre", digits))
    return out


def context_select(digits: int) -> list[str]:
    rest = {s: f"CAST(date_diff('day', {s}.last_date, m.MatchDate) AS DOUBLE)" for s in "ha"}
    expected = " ".join(f"WHEN '{d}' THEN {n}" for d, n in EXPECTED.items())
    progress = f"CAST(h.prior_n AS DOUBLE) / CASE m.Division {expected} END"
    return [
        f"{rest['h']} AS DaysSinceLast_H_pre",
        f"{rest['a']} AS DaysSinceLast_A_pre",
        f"{rest['h']} - {rest['a']} AS RestDiff_pre",
        "h.n14 AS Matches14d_H_pre",
        "a.n14 AS Matches14d_A_pre",
        "h.prior_n AS TeamMatchNum_H_pre",
        "a.prior_n AS TeamMatchNum_A_pre",
        rnd(progress, "SeasonProgress_pre", digits),
        rnd("ih.Form3", "Form3Home_pre", digits),
        rnd("ih.Form5", "Form5Home_pre", digits),
        rnd("ia.Form3", "Form3Away_pre", digits),
        rnd("ia.Form5", "Form5Away_pre", digits),
        rnd("ih.Form5 - ia.Form5", "Form5Diff_pre", digits),
    ]


def label_select(m: str = "m.") -> list[str]:
    return [
        f"{m}FTR AS target_1x2",
        *[
            f"CAST({m}FTR = '{v}' AS INT) AS {c}"
            for c, v in zip(S.TARGETS[1:4], S.CLASSES, strict=True)
        ],
        f"CASE WHEN {m}FTHome + {m}FTAway IS NULL THEN NULL WHEN {m}FTHome + {m}FTAway > 2.5 THEN 1 ELSE 0 END AS target_ou25",
    ]


ELO = """
b AS (SELECT *, dense_rank() OVER (PARTITION BY Division ORDER BY MatchDate) AS k FROM matches),
seas AS (SELECT Division, k, min(SeasonStartYear) AS yr, lag(min(SeasonStartYear)) OVER (PARTITION BY Division ORDER BY k) AS prev FROM b GROUP BY Division, k),
teams AS (SELECT Division, HomeTeam AS team FROM matches UNION SELECT Division, AwayTeam FROM matches),
st AS (
  SELECT Division, team, CAST(1500 AS DOUBLE) AS rating, CAST(1 AS BIGINT) AS k FROM teams
  UNION ALL
  SELECT s.Division, s.team,
         CASE WHEN nx.yr <> nx.prev THEN (s.rating + coalesce(dl.delta, 0)) * CAST(0.7 AS DOUBLE) + CAST(450 AS DOUBLE)
              ELSE s.rating + coalesce(dl.delta, 0) END, s.k + 1
  FROM st s JOIN seas nx ON nx.Division = s.Division AND nx.k = s.k + 1
  LEFT JOIN (
    SELECT Division, CASE side WHEN 1 THEN HomeTeam ELSE AwayTeam END AS team, sum(side * ch) AS delta
    FROM (SELECT b.Division, b.HomeTeam, b.AwayTeam,
                 CAST(40 AS DOUBLE) * (CAST(CASE b.FTR WHEN 'H' THEN 1 WHEN 'D' THEN 0.5 ELSE 0 END AS DOUBLE)
                   - CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + pow(CAST(10 AS DOUBLE), (sa.rating - (sh.rating + 60)) / CAST(400 AS DOUBLE)))) AS ch
          FROM b JOIN st sh ON sh.Division = b.Division AND sh.k = b.k AND sh.team = b.HomeTeam
                 JOIN st sa ON sa.Division = b.Division AND sa.k = b.k AND sa.team = b.AwayTeam) x
         CROSS JOIN (VALUES (1), (-1)) v(side)
    GROUP BY 1, 2) dl ON dl.Division = s.Division AND dl.team = s.team),
elo AS (
  SELECT b.MatchDate, b.Division, b.HomeTeam, b.AwayTeam, h.rating AS home, a.rating AS away
  FROM b JOIN st h ON h.Division = b.Division AND h.k = b.k AND h.team = b.HomeTeam
         JOIN st a ON a.Division = b.Division AND a.k = b.k AND a.team = b.AwayTeam)"""


def elo_select(alias: str = "", digits: int = 4) -> list[str]:
    return [
        rnd(f"{alias}home", "HomeElo_pre", digits),
        rnd(f"{alias}away", "AwayElo_pre", digits),
        rnd(f"{alias}home - {alias}away", "EloDiff_pre", digits),
    ]


@oracle
def feature_table() -> str:
    select = [MKEY, "m.SeasonStartYear", "m.FTR", *label_select(), *elo_select("e."),
              *context_select(4), *rolling_select(4)]
    return (
        f"{oracle_with('matches')}, {sides_sql()}, {rolling_sql()}, {ELO} SELECT {', '.join(select)}"
        f"{joined_sql()} JOIN elo e ON e.MatchDate = m.MatchDate AND e.Division = m.Division"
        " AND e.HomeTeam = m.HomeTeam AND e.AwayTeam = m.AwayTeam"
    )


@oracle
def rolling_features() -> str:
    return (
        f"{oracle_with('matches')}, {sides_sql()}, {rolling_sql()} "
        f"SELECT {', '.join([MKEY, *rolling_select(6)])}{joined_sql()}"
    )


@oracle
def context_features() -> str:
    return (
        f"{oracle_with('matches')}, {sides_sql()}, {rolling_sql()} "
        f"SELECT {', '.join([MKEY, *context_select(6)])}{joined_sql()}"
    )


@oracle
def elo_features() -> str:
    return f"{oracle_with('matches')}, {ELO} SELECT {KEY}, {', '.join(elo_select())} FROM elo"


@oracle
def label_targets() -> str:
    return f"{oracle_with('matches')} SELECT {MKEY}, {', '.join(label_select())} FROM matches m"


YEARS = (*derived.DEVELOPMENT, derived.FINAL)
FOLDS = (
    "folds(fold, test_year, fold_role) AS (VALUES "
    + ", ".join(
        f"('train_through_{y - 1}_test_{y}', CAST({y} AS BIGINT), "
        f"'{'historical_final' if y == derived.FINAL else 'development'}')"
        for y in YEARS
    )
    + ")"
)
TAGGED = (
    FOLDS
    + ", tagged AS (SELECT f.*, m.*, CASE WHEN m.SeasonStartYear = f.test_year THEN 'test' ELSE 'train' END AS part"
    " FROM matches m JOIN folds f ON m.SeasonStartYear <= f.test_year)"
)
PRIOR = (
    "prior AS (SELECT fold, "
    + ", ".join(
        f"avg(CAST(FTR = '{c}' AS DOUBLE)) AS {p}"
        for c, p in zip(S.CLASSES, S.PROBABILITIES, strict=True)
    )
    + " FROM tagged WHERE part = 'train' GROUP BY fold)"
)
# market rows with the two validity flags; AvgCH is never NULL and AvgCD may be
FLAGGED = (
    "flagged AS (SELECT *, (AvgCH IS NULL OR AvgCD IS NULL OR AvgCA IS NULL) AS incomplete, "
    "coalesce(AvgCH <= 1 OR AvgCD <= 1 OR AvgCA <= 1, false) AND NOT (AvgCH IS NULL OR AvgCD IS NULL OR AvgCA IS NULL) AS bad FROM market)"
)
DEVIG = (
    FLAGGED
    + ", devig AS (SELECT MatchDate, Division, HomeTeam, AwayTeam, "
    + ", ".join(
        f"(1 / {o}) / (1 / AvgCH + 1 / AvgCD + 1 / AvgCA) AS {p}"
        for o, p in zip(("AvgCH", "AvgCD", "AvgCA"), S.PROBABILITIES, strict=True)
    )
    + ", 1 / AvgCH + 1 / AvgCD + 1 / AvgCA AS market_overround FROM flagged WHERE NOT incomplete AND NOT bad)"
)
PRED_COLUMNS = "fold, fold_role, MatchDate, Division, HomeTeam, AwayTeam, label"
PREDICTIONS = f"""{TAGGED}, {PRIOR}, {DEVIG},
covered AS (SELECT t.fold, t.fold_role, t.MatchDate, t.Division, t.HomeTeam, t.AwayTeam, t.FTR AS label,
  d.probability_home AS mh, d.probability_draw AS md, d.probability_away AS ma
  FROM tagged t JOIN devig d ON t.MatchDate = d.MatchDate AND t.Division = d.Division AND t.HomeTeam = d.HomeTeam AND t.AwayTeam = d.AwayTeam
  WHERE t.part = 'test'),
predictions AS (
  SELECT {PRED_COLUMNS}, 'market' AS model, mh AS h, md AS d, ma AS a FROM covered
  UNION ALL SELECT {PRED_COLUMNS}, 'uniform', 1 / {dbl('3')}, 1 / {dbl('3')}, 1 / {dbl('3')} FROM covered
  UNION ALL SELECT c.fold, c.fold_role, MatchDate, Division, HomeTeam, AwayTeam, label, 'training_prior', probability_home, probability_draw, probability_away
    FROM covered c JOIN prior p ON p.fold = c.fold),
scored AS (SELECT *, -ln(greatest(CASE label WHEN 'H' THEN h WHEN 'D' THEN d ELSE a END, {dbl('1e-15')})) AS ll,
  (h - CAST(label = 'H' AS DOUBLE)) ** 2 + (d - CAST(label = 'D' AS DOUBLE)) ** 2 + (a - CAST(label = 'A' AS DOUBLE)) ** 2 AS bs,
  greatest(h, d, a) AS conf,
  CAST(label = CASE WHEN h = greatest(h, d, a) THEN 'H' WHEN d = greatest(h, d, a) THEN 'D' ELSE 'A' END AS DOUBLE) AS hit
  FROM predictions),
binned AS (SELECT *, least(9, {' + '.join(f"CAST(conf > {dbl(repr(e))} AS INT)" for e in
           [i * 0.1 for i in range(1, 11)])}) AS bin FROM scored),
bins AS (SELECT fold, fold_role, model, bin, count(*) AS n, avg(hit) AS accuracy, avg(conf) AS mean_confidence FROM binned GROUP BY ALL),
sizes AS (SELECT fold, model, sum(n) AS total FROM bins GROUP BY ALL),
eces AS (SELECT b.fold, b.model, sum(n / total * abs(accuracy - mean_confidence)) AS ece
  FROM bins b JOIN sizes s ON b.fold = s.fold AND b.model = s.model GROUP BY ALL),
fm AS (SELECT s.fold, s.fold_role, s.model, count(*) AS n_samples, avg(ll) AS log_loss, avg(bs) AS brier_score, any_value(ece) AS ece
  FROM scored s JOIN eces e ON s.fold = e.fold AND s.model = e.model GROUP BY s.fold, s.fold_role, s.model)"""
DATE = "strftime({0}, '%Y-%m-%d') AS {0}"


@oracle
def canonical_rows() -> str:
    text = "trim(Date)"
    short = (
        f"CASE WHEN CAST(substr({text}, 7, 2) AS INT) >= 69 THEN '19' ELSE '20' END || substr({text}, 7, 2)"
    )
    date = (
        f"CASE WHEN substr({text}, 5, 1) = '-' THEN {text} WHEN length({text}) = 10 "
        f"THEN substr({text}, 7, 4) || '-' || substr({text}, 4, 2) || '-' || substr({text}, 1, 2) "
        f"ELSE {short} || '-' || substr({text}, 4, 2) || '-' || substr({text}, 1, 2) END"
    )
    names = {"FTHome": "FTHG", "FTAway": "FTAG", **{c: a for a, c in S.SOURCE_ALIASES.items()}}
    counts = [
        f"CAST({'AS_' if names[c] == 'AS' else names[c]} AS BIGINT) AS {c}" for c in S.COUNT_COLUMNS
    ]
    return (
        f"{oracle_with('raw_csv')} SELECT {date} AS MatchDate, CAST(substr(Season, 1, 4) AS BIGINT) AS SeasonStartYear, "
        f"Div AS Division, trim(HomeTeam) AS HomeTeam, trim(AwayTeam) AS AwayTeam, FTR, {', '.join(counts)} FROM raw_csv"
    )


@oracle
def malformed_rows() -> str:
    return f"""{oracle_with('matches')},
r AS (SELECT *, game_id % 5 = 0 AS b_date, game_id % 7 <= 1 AS b_season, game_id % 11 = 0 AS b_home, game_id % 13 = 0 AS b_away,
  concat_ws('|', CASE WHEN game_id % 5 = 0 THEN NULL ELSE strftime(MatchDate, '%Y-%m-%d') END, Division, HomeTeam, AwayTeam) AS txt FROM matches),
u AS (SELECT 'MatchDate' AS issue, txt FROM r WHERE b_date UNION ALL SELECT 'SeasonStartYear', txt FROM r WHERE b_season
  UNION ALL SELECT 'FTHome', txt FROM r WHERE b_home UNION ALL SELECT 'FTAway', txt FROM r WHERE b_away),
n AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY txt) AS k FROM u)
SELECT issue, count(*) AS bad_rows, string_agg(CASE WHEN k <= 5 THEN txt END, ',' ORDER BY txt) AS preview,
  CAST(greatest(count(*) - 5, 0) AS BIGINT) AS more FROM n GROUP BY issue"""


FAULTY = f"""SELECT CASE WHEN game_id % 17 = 0 THEN NULL ELSE MatchDate END AS d, SeasonStartYear AS s,
  CASE WHEN game_id % 19 = 0 THEN ' ' ELSE Division END AS v, HomeTeam AS h, CASE WHEN game_id % 23 = 0 THEN HomeTeam ELSE AwayTeam END AS a,
  CASE WHEN game_id % 29 = 0 THEN 'X' ELSE FTR END AS r, CASE WHEN game_id % 31 = 0 THEN -1 ELSE FTHome END AS g,
  coalesce({' + '.join(f"coalesce(({c} < 0)::INT, 0)" for c in S.COUNT_COLUMNS[1:])}, 0) AS neg FROM matches"""
CLEAN = f"""SELECT MatchDate AS d, SeasonStartYear AS s, Division AS v, HomeTeam AS h, AwayTeam AS a, FTR AS r, FTHome AS g,
  coalesce({' + '.join(f"coalesce(({c} < 0)::INT, 0)" for c in S.COUNT_COLUMNS[1:])}, 0) AS neg FROM matches"""
ISSUE_COUNTS = """count(*) AS row_count, count(*) FILTER (d IS NULL) AS null_dates, count(*) FILTER (s IS NULL) AS null_seasons,
  count(*) FILTER (trim(v) = '' OR trim(h) = '' OR trim(a) = '') AS blank_strings, count(*) FILTER (h = a) AS same_team_rows,
  count(*) FILTER (r NOT IN ('H', 'D', 'A') OR r IS NULL) AS invalid_results,
  CAST(sum(neg + coalesce((g < 0)::INT, 0)) AS BIGINT) AS negative_counts, CAST(0 AS BIGINT) AS fractional_counts,
  CAST(sum((d IS NULL)::INT + (v IS NULL)::INT + (h IS NULL)::INT + (a IS NULL)::INT) AS BIGINT) AS null_key_cells,
  (SELECT count(*) FROM k) AS duplicate_keys, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM k) AS duplicate_rows"""


def _audit(rows: str) -> str:
    faults = (
        "null_dates null_seasons blank_strings same_team_rows invalid_results negative_counts "
        "fractional_counts null_key_cells duplicate_keys"
    ).split()
    noted = ", ".join(f"CASE WHEN {c} <> 0 THEN '{c}:' || {c} END" for c in faults)
    return f"""{oracle_with('matches')}, f AS ({rows}),
k AS (SELECT count(*) AS n FROM f GROUP BY d, v, h, a HAVING count(*) > 1),
c AS (SELECT {ISSUE_COUNTS}, count(DISTINCT v) AS divisions, count(DISTINCT s) AS seasons FROM f)
SELECT *, row_count AS input_rows, CAST(0 AS BIGINT) AS lost_rows, '' AS missing_columns, CAST(null_key_cells = 0 AS INT) AS can_be_ordered,
  concat_ws('; ', {noted}) AS issues, CAST({' + '.join(faults)} = 0 AS INT) AS passed FROM c"""


@oracle
def csv_round_trip() -> str:
    return canonical_rows().replace("trim(HomeTeam) AS HomeTeam", "'É' || trim(HomeTeam) AS HomeTeam")


@oracle
def canonical_round_trip() -> str:
    kept = ", ".join(c for c in S.CANONICAL if c != "MatchDate")
    return f"{oracle_with('matches')} SELECT CAST(MatchDate AS VARCHAR) AS MatchDate, {kept} FROM matches"


@oracle
def stored_summary() -> str:
    return (
        f"{oracle_with('matches')} SELECT Division, 'Division=' || Division AS path, 1 AS files, count(*) AS row_count,"
        " CAST((SELECT count(*) FROM matches) AS BIGINT) AS input_rows, CAST(sum(count(*)) OVER () AS BIGINT) AS output_rows"
        " FROM matches GROUP BY Division"
    )


@oracle
def key_set_difference() -> str:
    key = "MatchDate, Division, HomeTeam, AwayTeam"
    return f"""{oracle_with('market')}, l AS (SELECT DISTINCT {key} FROM matches WHERE day(MatchDate) % 10 <> 0), r AS (SELECT DISTINCT {key} FROM market)
SELECT {MKEY}, 1 AS missing_left, 0 AS missing_right FROM r m ANTI JOIN l USING ({key})
UNION ALL SELECT {MKEY}, 0, 1 FROM l m ANTI JOIN r USING ({key})"""


@oracle
def stored_order() -> str:
    return f"{oracle_with('matches')} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS out_of_order FROM matches"


@oracle
def stored_sql() -> str:
    return f"""{oracle_with('matches')} SELECT Division, FTR, count(*) AS n FROM matches
WHERE SeasonStartYear >= {YEARS[0]} AND Division <> 'N03' GROUP BY Division, FTR"""


@oracle
def ledger_round_trip() -> str:
    return population_ranking()


@oracle
def logistic_score_equations() -> str:
    named = ", ".join(f"('{c}')" for c in ("intercept", *S.FEATURES))
    return f"WITH {FOLDS} SELECT fold, feature, CAST(0 AS DOUBLE) AS gradient FROM folds, (VALUES {named}) v(feature)"


@oracle
def prediction_equations() -> str:
    return (
        f"{oracle_with('matches')}, {FOLDS} SELECT f.fold, 'base52' AS model, count(*) AS rows, {dbl('0')} AS gap"
        " FROM matches m JOIN folds f ON m.SeasonStartYear = f.test_year GROUP BY f.fold"
    )


@oracle
def network_equations() -> str:
    return (
        f"{oracle_with('matches')}, {FOLDS} SELECT f.fold, count(*) AS rows, count(*) AS most_rows, {dbl('0')} AS gap"
        " FROM matches m JOIN folds f ON m.SeasonStartYear = f.test_year GROUP BY f.fold"
    )


@oracle
def poisson_score_equations() -> str:
    zero = ", ".join(f"CAST(0 AS DOUBLE) AS {c}" for c in ("intercept", "sot", "off"))
    return f"""{oracle_with('matches')} SELECT SeasonStartYear, {zero} FROM (SELECT DISTINCT SeasonStartYear FROM matches) s
WHERE SeasonStartYear > (SELECT min(SeasonStartYear) FROM matches)"""


@oracle
def canonical_audit() -> str:
    return _audit(CLEAN)


@oracle
def canonical_audit_faults() -> str:
    return _audit(
        FAULTY.replace(
            "SeasonStartYear AS s",
            "CASE WHEN game_id % 17 <> 0 AND month(MatchDate) <> 7 THEN SeasonStartYear END AS s",
        )
    )


@oracle
def canonical_issue_counts() -> str:
    return f"""{oracle_with('matches')}, f AS ({FAULTY}),
k AS (SELECT count(*) AS n FROM f GROUP BY d, v, h, a HAVING count(*) > 1)
SELECT {ISSUE_COUNTS} FROM f"""


@oracle
def natural_key_check() -> str:
    return "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1"


@oracle
def target_check() -> str:
    zero = "CAST(count(*) FILTER ({}) AS BIGINT) AS {}"
    hot = [f"(CASE WHEN FTR = '{c}' THEN 1 ELSE 0 END)" for c in S.CLASSES]
    return f"{oracle_with('matches')} SELECT " + ", ".join(
        [
            zero.format("FTR IS NULL", "FTR_null"),
            zero.format("FTR NOT IN ('H', 'D', 'A')", "FTR_domain"),
            zero.format("FTR IS NULL", "target_1x2_null"),
            zero.format("FTR NOT IN ('H', 'D', 'A')", "target_1x2_domain"),
            *[zero.format("FTR IS NULL", f"{c}_null") for c in S.TARGETS[1:4]],
            *[zero.format("FTR IS NULL", f"{c}_domain") for c in S.TARGETS[1:4]],
            zero.format(f"{' + '.join(hot)} <> 1", "target_home_win_sum"),
        ]
    ) + " FROM matches"


@oracle
def feature_check() -> str:
    zero = "CAST(0 AS BIGINT) AS "
    return f"""{oracle_with('matches')} SELECT count(*) AS row_count,
  count(*) FILTER (MatchDate IS NULL OR Division IS NULL OR HomeTeam IS NULL OR AwayTeam IS NULL) AS null_keys,
  count(*) FILTER (SeasonStartYear IS NULL) AS null_seasons, count(*) FILTER (FTR NOT IN ('H', 'D', 'A')) AS invalid_results,
  {', '.join(zero + c for c in ('target_1x2_differs', 'one_hot_differs', 'invalid_over_under', 'infinite_cells', 'nan_cells'))}
  FROM matches"""


@oracle
def feature_check_faults() -> str:
    def on(day: str, name: str) -> str:
        return f"count(*) FILTER (day(MatchDate) IN ({day})) AS {name}"

    return f"""{oracle_with('matches')} SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS null_keys, {on('9', 'null_seasons')},
  {on('6, 8', 'invalid_results')}, {on('6, 8', 'target_1x2_differs')}, {on('3, 6, 8', 'one_hot_differs')},
  {on('5', 'invalid_over_under')}, {on('4', 'infinite_cells')}, {on('7', 'nan_cells')} FROM matches"""


@oracle
def column_roles() -> str:
    roles = {
        "label": ["FTR", *S.TARGETS],
        "metadata": ["MatchDate", "SeasonStartYear", "Division", "HomeTeam", "AwayTeam"],
        "same_match": [*S.COUNT_COLUMNS],
        "unknown": ["game_id", "home_club_id", "away_club_id", "nat", "q", "n", "price"],
    }
    made = {c: "FTR" for c in S.TARGETS[:4]} | {"target_ou25": "FTHome + FTAway"}
    parts = [
        f"SELECT '{c}' AS \"column\", '{r}' AS role, count({made.get(c, c)}) AS present_values FROM matches"
        for r, columns in roles.items()
        for c in columns
    ]
    return f"{oracle_with('matches')} {' UNION ALL '.join(parts)}"


@oracle
def sides_unpivot() -> str:
    return f"""{oracle_with('matches')}, {sides_sql()}
SELECT Division, SeasonStartYear, team, count(*) AS matches, sum(points) AS points,
  CAST(sum(Goals_for) AS BIGINT) AS goals_for, CAST(sum(Goals_against) AS BIGINT) AS goals_against FROM sides GROUP BY ALL"""


@oracle
def fold_assignment() -> str:
    return f"{oracle_with('matches')}, {TAGGED} SELECT fold, fold_role, part, {KEY} FROM tagged"


@oracle
def fold_bounds() -> str:
    out = []
    for part in ("train", "test"):
        for fn, name in (("min", "start"), ("max", "end")):
            out.append(
                f"strftime({fn}(CASE WHEN part = '{part}' THEN MatchDate END), '%Y-%m-%d') AS {part}_{name}_date"
            )
        out.append(f"count(*) FILTER (part = '{part}') AS {part}_rows")
    return (
        f"{oracle_with('matches')}, {TAGGED} SELECT fold, test_year, fold_role, {', '.join(out)}"
        " FROM tagged GROUP BY fold, test_year, fold_role"
    )


@oracle
def inner_time_split() -> str:
    return f"""{oracle_with('matches')}, {TAGGED}, tr AS (SELECT * FROM tagged WHERE part = 'train'),
dd AS (SELECT fold, MatchDate, row_number() OVER (PARTITION BY fold ORDER BY MatchDate DESC) AS back, count(*) OVER (PARTITION BY fold) AS n
  FROM (SELECT DISTINCT fold, MatchDate FROM tr)),
bo AS (SELECT fold, min(MatchDate) AS start FROM dd WHERE back <= least(greatest(1, floor(n * {dbl('0.1')})), n - 1) GROUP BY fold)
SELECT tr.fold, CASE WHEN MatchDate < start THEN 'fit' ELSE 'validation' END AS inner_part, count(*) AS "rows",
  strftime(min(MatchDate), '%Y-%m-%d') AS first_date, strftime(max(MatchDate), '%Y-%m-%d') AS last_date
FROM tr JOIN bo ON bo.fold = tr.fold GROUP BY 1, 2"""


@oracle
def date_batches() -> str:
    return f"{oracle_with('matches')} SELECT dense_rank() OVER (ORDER BY MatchDate) AS batch, {MKEY} FROM matches m"


@oracle
def training_prior() -> str:
    return (
        f"{oracle_with('matches')}, {TAGGED}, {PRIOR} SELECT fold, "
        + ", ".join(rnd(p, p) for p in S.PROBABILITIES)
        + " FROM prior"
    )


def _devig_select(prefix: str = "") -> str:
    return ", ".join(rnd(prefix + p, p) for p in (*S.PROBABILITIES, "market_overround"))


@oracle
def devig_market() -> str:
    return f"{oracle_with('market')}, {DEVIG} SELECT {KEY}, {_devig_select()} FROM devig"


MARKET_COUNTS = """count(*) AS supplied_market_rows, count(*) FILTER (NOT incomplete AND NOT bad) AS valid_market_rows,
  count(*) FILTER (incomplete) AS incomplete_odds_rows, count(*) FILTER (bad) AS invalid_odds_rows"""
MARKET_DUPES = (
    "(SELECT count(*) FROM (SELECT 1 FROM flagged GROUP BY MatchDate, Division, HomeTeam, AwayTeam"
    " HAVING count(*) > 1)) AS duplicate_market_keys"
)


@oracle
def market_audit() -> str:
    return (
        f"{oracle_with('market')}, {FLAGGED} SELECT {MARKET_COUNTS}, CAST(0 AS BIGINT) AS invalid_key_rows, "
        f"{MARKET_DUPES} FROM flagged"
    )


@oracle
def market_alignment() -> str:
    return (
        f"{oracle_with('market')}, {DEVIG} SELECT {MKEY}, m.SeasonStartYear, {_devig_select('d.')} FROM matches m JOIN devig d"
        " USING (MatchDate, Division, HomeTeam, AwayTeam)"
    )


@oracle
def market_coverage() -> str:
    return f"""{oracle_with('market')}, {DEVIG},
j AS (SELECT m.game_id IS NOT NULL AS inm, d.market_overround IS NOT NULL AS ind FROM matches m FULL JOIN devig d
  ON m.MatchDate = d.MatchDate AND m.Division = d.Division AND m.HomeTeam = d.HomeTeam AND m.AwayTeam = d.AwayTeam),
c AS (SELECT count(*) FILTER (inm) AS candidate_match_rows, count(*) FILTER (NOT ind) AS unmatched_match_keys,
  count(*) FILTER (NOT inm) AS unmatched_market_keys, count(*) FILTER (inm AND ind) AS aligned_rows FROM j),
a AS (SELECT {MARKET_COUNTS}, {MARKET_DUPES} FROM flagged)
SELECT *, round({dbl('100')} * aligned_rows / candidate_match_rows, 6) AS coverage_percentage FROM c, a"""


@oracle
def coverage_slices() -> str:
    base = "count(*) AS candidate_match_rows, count(d.market_overround) AS aligned_rows, round({0} * count(d.market_overround) / count(*), 6) AS coverage_percentage FROM matches m LEFT JOIN devig d USING (MatchDate, Division, HomeTeam, AwayTeam)".format(dbl("100"))
    return (
        f"{oracle_with('market')}, {DEVIG} SELECT 'Division' AS kind, Division AS name, {base} GROUP BY Division"
        f" UNION ALL SELECT 'SeasonStartYear', CAST(SeasonStartYear AS VARCHAR), {base} GROUP BY SeasonStartYear"
        f" UNION ALL SELECT 'all', 'all', {base}"
    )


@oracle
def probability_sanity() -> str:
    return f"""{oracle_with('market')}, {DEVIG},
s AS (SELECT Division, day(MatchDate) = 1 AS nan, CASE WHEN day(MatchDate) = 2 THEN probability_home + 1 ELSE probability_home END AS h,
  probability_draw AS d, probability_away AS a FROM devig)
SELECT Division, count(*) AS "rows", count(*) FILTER (nan) AS not_finite,
  count(*) FILTER (NOT nan AND (h > 1 OR h < 0)) AS outside_unit_interval,
  count(*) FILTER (NOT nan AND abs(h + d + a - 1) > 1e-8) AS not_summing_to_one FROM s GROUP BY Division"""


@oracle
def probability_metrics() -> str:
    return (
        f"{oracle_with('market')}, {PREDICTIONS} SELECT fold, model, n_samples, {rnd('log_loss', 'log_loss')}, "
        f"{rnd('brier_score', 'brier_score')}, {rnd('ece', 'ece')} FROM fm"
    )


@oracle
def calibration_bins() -> str:
    return (
        f"{oracle_with('market')}, {PREDICTIONS} SELECT fold, model, bin, n, {rnd('accuracy', 'accuracy')}, "
        f"{rnd('mean_confidence', 'mean_confidence')} FROM bins"
    )


@oracle
def weighted_views() -> str:
    weighted = ", ".join(rnd(f"sum({m} * n_samples) / sum(n_samples)", m) for m in ("log_loss", "brier_score", "ece"))
    return f"""{oracle_with('market')}, {PREDICTIONS},
v AS (SELECT *, fold_role AS view FROM fm UNION ALL SELECT *, 'all_historical_diagnostic' FROM fm)
SELECT model, view, count(*) AS fold_count, CAST(sum(n_samples) AS BIGINT) AS n_samples, {weighted} FROM v GROUP BY model, view"""


@oracle
def gate() -> str:
    dev = "CASE WHEN fold_role = 'development' THEN n_samples END"
    fin = "CASE WHEN fold_role <> 'development' THEN n_samples END"
    return f"""{oracle_with('market')}, {PREDICTIONS},
c AS (SELECT m.fold, m.fold_role, m.model AS candidate, m.n_samples, b.log_loss - m.log_loss AS gain
  FROM fm m JOIN fm b ON b.fold = m.fold AND b.model = 'training_prior' WHERE m.model <> 'training_prior'),
o AS (SELECT candidate, count(*) FILTER (fold_role = 'development') AS development_fold_count,
  sum(gain * {dev}) / sum({dev}) AS gain, count(*) FILTER (fold_role = 'development' AND gain > 0) AS improving_fold_count,
  sum(gain * {fin}) / sum({fin}) AS final_gain FROM c GROUP BY candidate)
SELECT candidate, development_fold_count, {rnd('gain', 'candidate_improvement_log_loss')}, improving_fold_count,
  {rnd('final_gain', 'historical_final_improvement_log_loss')},
  CAST(gain >= 0.005 AND improving_fold_count >= 2 AS INT) AS passed,
  CASE WHEN gain >= 0.005 AND improving_fold_count >= 2 THEN 'passed' ELSE 'failed' END AS verdict FROM o"""


@oracle
def report_round_trip() -> str:
    head, tail = gate().split("\nSELECT candidate", 1)
    return f"""{head},
gt AS (SELECT candidate{tail}),
j2 AS (SELECT m.game_id IS NOT NULL AND d.market_overround IS NOT NULL AS hit, m.game_id IS NOT NULL AS own FROM matches m FULL JOIN devig d
  ON m.MatchDate = d.MatchDate AND m.Division = d.Division AND m.HomeTeam = d.HomeTeam AND m.AwayTeam = d.AwayTeam),
c2 AS (SELECT count(*) FILTER (hit) AS aligned_rows, round({dbl('100')} * count(*) FILTER (hit) / count(*) FILTER (own), 6) AS coverage_percentage FROM j2)
SELECT 'closing_market' AS experiment, fm.fold, fm.fold_role, fm.model, fm.n_samples, {rnd('fm.log_loss', 'log_loss')},
  {rnd('fm.brier_score', 'brier_score')}, {rnd('fm.ece', 'ece')}, gt.verdict, aligned_rows, coverage_percentage
FROM fm LEFT JOIN gt ON gt.candidate = fm.model CROSS JOIN c2"""


@oracle
def path_context() -> str:
    codes, names = sorted(S.SEASON_CODES), sorted(S.DIVISION_NAMES)
    season = f"[{', '.join(repr(c) for c in codes)}][SeasonStartYear % {len(codes)} + 1]"
    division = f"[{', '.join(repr(c) for c in names)}][CAST(substr(Division, 2, 2) AS INT) % {len(names)} + 1]"
    start = "CASE season_code " + " ".join(f"WHEN '{c}' THEN {y}" for c, y in S.SEASON_CODES.items()) + " END"
    return f"""{oracle_with('matches')}, p AS (SELECT {season} AS season_code, {division} AS division, FTHome FROM matches)
SELECT season_code, division, CAST({start} AS BIGINT) AS season_start, count(*) AS rows, CAST(sum(FTHome) AS BIGINT) AS goals FROM p GROUP BY ALL"""


@oracle
def stored_features() -> str:
    return (
        f"{oracle_with('matches')} SELECT Division, count(*) AS rows, CASE WHEN Division = 'N03' THEN 0 ELSE 1 END AS kept"
        " FROM matches GROUP BY Division"
    )


@oracle
def best_candidate() -> str:
    return f"""{oracle_with('market')}, {PREDICTIONS},
p AS (SELECT model, sum(log_loss * n_samples) / sum(n_samples) AS ll FROM fm WHERE fold_role = 'development' GROUP BY model)
SELECT model AS selected, {rnd('ll', 'development_log_loss')} FROM p ORDER BY ll, model LIMIT 1"""


@oracle
def identical_rows() -> str:
    return f"""{oracle_with('market')}, {TAGGED}, {DEVIG}
SELECT t.fold, CAST(1 AS BIGINT) AS models, CAST(1 AS BIGINT) AS "rows", count(*) AS count
FROM tagged t ANTI JOIN devig d USING (MatchDate, Division, HomeTeam, AwayTeam) WHERE t.part = 'test' GROUP BY t.fold"""


def clean_name(x: str) -> str:
    """The derived names: accent, mark, blank and alias steps end at t00, t01 and so on."""
    plain = f"trim(regexp_replace(replace(lower(strip_accents({x})), '.', ''), '[- ]+', ' ', 'g'))"
    return f"CASE {plain} WHEN 'team zero' THEN 't00' WHEN 'team one' THEN 't01' ELSE {plain} END"


XG_JOIN = """x AS (SELECT Division, MatchDate, {h} AS hn, {a} AS an, home_xg, away_xg FROM {src}),
al AS (SELECT m.MatchDate, m.Division, m.HomeTeam, m.AwayTeam, m.SeasonStartYear, m.FTHome, m.FTAway, x.home_xg, x.away_xg,
  CAST(x.hn IS NOT NULL AS INT) AS aligned
  FROM {base} m LEFT JOIN x ON x.MatchDate = m.MatchDate AND x.Division = m.Division AND x.hn = lower(m.HomeTeam) AND x.an = lower(m.AwayTeam)
  WHERE m.Division IN (SELECT DISTINCT Division FROM {src}))"""


def xg_join(src: str = "external_xg", base: str = "matches") -> str:
    return XG_JOIN.format(h=clean_name("HomeTeam"), a=clean_name("AwayTeam"), src=src, base=base)


@oracle
def team_names() -> str:
    return (
        f"{oracle_with('external_xg')} SELECT HomeTeam, {clean_name('HomeTeam')} AS normalised, count(*) AS \"rows\""
        " FROM external_xg GROUP BY 1, 2"
    )


@oracle
def xg_audit() -> str:
    return f"""{oracle_with('external_xg')},
b AS (SELECT Division, MatchDate, HomeTeam, AwayTeam, CASE WHEN day(MatchDate) = 3 THEN -1 WHEN day(MatchDate) = 4 THEN NULL ELSE home_xg END AS hx, away_xg AS ax FROM external_xg),
u AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE day(MatchDate) = 5),
w AS (SELECT *, count(*) OVER (PARTITION BY MatchDate, Division, HomeTeam, AwayTeam) AS n, hx IS NULL OR hx < 0 AS bh, Division NOT IN ('N00', 'N01', 'N02', 'N03') AS fo FROM u)
SELECT count(*) AS supplied_rows, count(*) FILTER (NOT bh AND NOT fo AND n = 1 AND HomeTeam <> AwayTeam) AS valid_rows,
  count(*) FILTER (HomeTeam = AwayTeam) AS invalid_key_rows, count(*) FILTER (bh) AS invalid_xg_rows, count(*) FILTER (bh) AS invalid_xg_values,
  count(*) FILTER (fo) AS unsupported_division_rows,
  (SELECT count(*) FROM (SELECT 1 FROM u GROUP BY MatchDate, Division, HomeTeam, AwayTeam HAVING count(*) > 1)) AS duplicate_keys,
  count(*) FILTER (n > 1) AS duplicate_rows, 0 AS passed FROM w"""


@oracle
def xg_alignment() -> str:
    return f"{oracle_with('external_xg')}, {xg_join()} SELECT {KEY}, SeasonStartYear, FTHome, FTAway, home_xg, away_xg, aligned FROM al"


@oracle
def xg_unmatched() -> str:
    return f"""{oracle_with('external_xg')}, x AS (SELECT *, {clean_name('HomeTeam')} AS hn, {clean_name('AwayTeam')} AS an FROM external_xg)
SELECT {DATE.format('MatchDate')}, Division, hn AS HomeTeam, an AS AwayTeam, home_xg, away_xg FROM x WHERE day(MatchDate) % 10 = 0"""


@oracle
def xg_coverage() -> str:
    out = "count(*) AS canonical_rows, CAST(sum(aligned) AS BIGINT) AS aligned_rows, round(CAST(sum(aligned) AS DOUBLE) / count(*), 6) AS coverage"
    return (
        f"{oracle_with('external_xg')}, {xg_join()} SELECT Division, SeasonStartYear, {out} FROM al"
        " GROUP BY GROUPING SETS ((Division), (Division, SeasonStartYear), (SeasonStartYear), ())"
    )


def _quality_sql(src: str, base: str, tag: str) -> str:
    text = xg_join(src, base)
    for name in ("x", "al"):
        text = text.replace(f"{name} AS (", f"{name}_{tag} AS (").replace(f"JOIN {name} ON", f"JOIN {name}_{tag} ON")
    for c in ("home_xg", "away_xg", "hn", "an", "MatchDate", "Division"):
        text = text.replace(f" x.{c}", f" x_{tag}.{c}").replace(f"(x.{c}", f"(x_{tag}.{c}")
    return f"""{text},
s_{tag} AS (SELECT Division, SeasonStartYear, CAST(sum(aligned) AS DOUBLE) / count(*) AS cov, sum(aligned) AS m, avg(home_xg) AS mh, avg(away_xg) AS ma FROM al_{tag} GROUP BY 1, 2),
v_{tag} AS (SELECT home_xg AS xg, CAST(FTHome AS DOUBLE) AS g FROM al_{tag} WHERE aligned = 1 UNION ALL SELECT away_xg, CAST(FTAway AS DOUBLE) FROM al_{tag} WHERE aligned = 1),
q_{tag} AS (SELECT (SELECT count(*) FROM s_{tag} WHERE m > 0) AS covered_league_seasons, (SELECT min(cov) FROM s_{tag} WHERE m > 0) AS minimum_claimed_league_season_coverage,
  CAST(count(xg) AS DOUBLE) / count(*) AS value_coverage, min(xg) AS minimum_xg, max(xg) AS maximum_xg,
  (SELECT min(least(mh, ma)) FROM s_{tag}) AS minimum_side_mean, (SELECT max(greatest(mh, ma)) FROM s_{tag}) AS maximum_side_mean,
  CASE WHEN count(xg) >= 200 THEN corr(xg, g) END AS goals_correlation, '{src}' AS source FROM v_{tag})"""


@oracle
def xg_quality() -> str:
    names = (
        "minimum_claimed_league_season_coverage", "value_coverage", "minimum_xg", "maximum_xg",
        "minimum_side_mean", "maximum_side_mean", "goals_correlation",
    )
    return f"""{oracle_with('external_xg', 'external_xg_good', 'scored')}, {_quality_sql('external_xg', 'matches', 'a')}, {_quality_sql('external_xg_good', 'scored', 'b')},
q AS (SELECT * FROM q_a UNION ALL SELECT * FROM q_b)
SELECT source, covered_league_seasons, {', '.join(rnd(n, n) for n in names)},
  CAST(minimum_claimed_league_season_coverage >= 0.98 AND value_coverage >= 0.98 AND minimum_xg >= 0 AND maximum_xg <= 10
    AND minimum_side_mean >= 0.7 AND maximum_side_mean <= 2.3 AND goals_correlation BETWEEN 0.45 AND 0.95 AS INT) AS passed FROM q"""


def xg_history_sql(home: str, away: str, source: str) -> str:
    """Sides of a history table with the last five and ten rows averaged at seq = prior_n."""
    part = "PARTITION BY Division, SeasonStartYear, team"
    order = f"{part} ORDER BY MatchDate, HomeTeam, AwayTeam"
    ok = "xf IS NOT NULL AND xa IS NOT NULL"
    cols = []
    for k in (5, 10):
        w = f"OVER ({order} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        cols += [
            f"avg(CASE WHEN {ok} THEN xf END) {w} AS f{k}",
            f"avg(CASE WHEN {ok} THEN xa END) {w} AS a{k}",
            f"CASE WHEN count(CASE WHEN {ok} AND g IS NULL THEN 1 END) {w} = 0 THEN avg(CASE WHEN {ok} THEN g - xf END) {w} END AS d{k}",
        ]
    one = "SELECT MatchDate, SeasonStartYear, Division, HomeTeam, AwayTeam, '{s}' AS side, {t} AS team, {f} AS xf, {a} AS xa, CAST({g} AS DOUBLE) AS g FROM {src}"
    h = one.format(s="H", t="HomeTeam", f=home, a=away, g="FTHome", src=source)
    a = one.format(s="A", t="AwayTeam", f=away, a=home, g="FTAway", src=source)
    return f"""xs AS (SELECT *, row_number() OVER ({order}) AS seq, {', '.join(cols)},
  count(*) OVER ({part} ORDER BY MatchDate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS prior_n
  FROM ({h} UNION ALL {a}) u)"""


@oracle
def xg_rolling() -> str:
    out = []
    for s, i in (("H", "ih"), ("A", "ia")):
        for k in (5, 10):
            out += [
                rnd(f"{i}.f{k}", f"XgForAvg{k}_{s}_xg_pre"),
                rnd(f"{i}.a{k}", f"XgAgainstAvg{k}_{s}_xg_pre"),
                rnd(f"{i}.f{k} - {i}.a{k}", f"XgDiffAvg{k}_{s}_xg_pre"),
                rnd(f"{i}.d{k}", f"GminusXgForAvg{k}_{s}_xg_pre"),
            ]
    same = "{0}.MatchDate = m.MatchDate AND {0}.Division = m.Division AND {0}.HomeTeam = m.HomeTeam AND {0}.AwayTeam = m.AwayTeam AND {0}.side = '{1}'"
    prior = "{1}.Division = {0}.Division AND {1}.SeasonStartYear = {0}.SeasonStartYear AND {1}.team = {0}.team AND {1}.seq = {0}.prior_n"
    return (
        f"{oracle_with('external_xg')}, {xg_join()}, {xg_history_sql('home_xg', 'away_xg', 'al')} SELECT {MKEY}, {', '.join(out)} FROM al m"
        f" JOIN xs h ON {same.format('h', 'H')} JOIN xs a ON {same.format('a', 'A')}"
        f" LEFT JOIN xs ih ON {prior.format('h', 'ih')} LEFT JOIN xs ia ON {prior.format('a', 'ia')}"
    )


@oracle
def relation_quality() -> str:
    zero = "CAST(0 AS BIGINT) AS "
    return f"""{oracle_with('appearances', 'lineups', 'valuations')}
SELECT (SELECT count(*) FROM matches) AS supplied_match_rows, (SELECT count(*) FROM appearances) AS appearance_rows,
  (SELECT count(*) FROM lineups) AS lineup_rows, (SELECT count(*) FROM valuations) AS valuation_rows,
  (SELECT count(DISTINCT game_id) FROM appearances) AS appearance_games, (SELECT count(DISTINCT game_id) FROM lineups) AS lineup_games,
  (SELECT count(*) FROM valuations WHERE date IS NULL OR market_value_in_eur < 0) AS invalid_valuation_rows,
  {', '.join(zero + c for c in ('null_fixture_ids', 'invalid_minutes_rows', 'null_appearance_ids', 'invalid_role_rows', 'null_lineup_ids', 'null_valuation_ids', 'duplicate_match_keys', 'duplicate_game_ids', 'duplicate_appearance_rows', 'duplicate_lineup_rows', 'duplicate_valuation_rows', 'unmatched_appearance_games', 'unmatched_lineup_games'))}"""


ASOF = "(SELECT arg_max(v.market_value_in_eur, v.date) FROM valuations v WHERE v.player_id = {p} AND v.date < {d})"


@oracle
def valuation_asof() -> str:
    return f"""{oracle_with('appearances', 'valuations')},
q AS (SELECT DISTINCT player_id, MatchDate FROM appearances JOIN matches USING (game_id))
SELECT q.player_id, {DATE.format('MatchDate')}, round(v.market_value_in_eur, 6) AS value FROM q
ASOF LEFT JOIN valuations v ON q.player_id = v.player_id AND q.MatchDate > v.date"""


def fixture_sides_sql() -> str:
    one = "SELECT MatchDate, SeasonStartYear, Division, HomeTeam, AwayTeam, game_id, '{s}' AS side, {t} AS team, {c} AS club_id FROM matches"
    part = "PARTITION BY Division, SeasonStartYear, team"
    return f"""fs AS (SELECT *, row_number() OVER ({part} ORDER BY MatchDate, game_id, side) AS seq,
  count(*) OVER ({part} ORDER BY MatchDate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS prior_n
  FROM ({one.format(s='H', t='HomeTeam', c='home_club_id')} UNION ALL {one.format(s='A', t='AwayTeam', c='away_club_id')}) u),
gm AS (SELECT game_id, player_club_id AS club_id, sum(minutes_played) AS gmin FROM appearances GROUP BY 1, 2),
ld AS (SELECT f.*, {', '.join(_recent('count(*)', 'matches_30d', 30) if d == 0 else _recent('sum(coalesce(gmin, 0))', f'minutes_{d}d', d) for d in (0, 7, 14, 21, 30))},
  CAST(date_diff('day', max(f.MatchDate) OVER ({part} ORDER BY f.MatchDate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), f.MatchDate) AS DOUBLE) AS days_since_prev_match
  FROM fs f LEFT JOIN gm USING (game_id, club_id)),
recent AS (SELECT t.game_id AS tgame, t.side AS tside, t.MatchDate AS tdate, h.game_id, h.club_id, t.prior_n - h.seq + 1 AS back, h.seq
  FROM fs t JOIN fs h ON h.Division = t.Division AND h.SeasonStartYear = t.SeasonStartYear AND h.team = t.team AND h.seq > t.prior_n - 10 AND h.seq <= t.prior_n),
pl AS (SELECT tgame, tside, tdate, player_id, sum(CASE WHEN back <= 5 THEN minutes_played END) AS m5, sum(minutes_played) AS m10,
  min(CASE WHEN back <= 5 THEN r.seq END) AS f5, min(r.seq) AS f10
  FROM recent r JOIN appearances a ON a.game_id = r.game_id AND a.player_club_id = r.club_id GROUP BY 1, 2, 3, 4),
pv AS (SELECT pl.*, v.market_value_in_eur AS val, row_number() OVER (PARTITION BY tgame, tside ORDER BY f5 IS NULL, m5 DESC, f5, pl.player_id) AS r5,
  row_number() OVER (PARTITION BY tgame, tside ORDER BY m10 DESC, f10, pl.player_id) AS r10
  FROM pl ASOF LEFT JOIN valuations v ON pl.player_id = v.player_id AND pl.tdate > v.date),
po AS (SELECT tgame, tside, count(f5) AS u5, count(*) AS u10, sum(m5) AS t5, sum(m10) AS t10,
  sum(CASE WHEN r5 <= 5 THEN m5 END) AS a5, sum(CASE WHEN r5 <= 11 THEN m5 END) AS a11, sum(CASE WHEN r10 <= 11 THEN m10 END) AS b11,
  sum(CASE WHEN f5 IS NOT NULL THEN val END) AS v5, sum(CASE WHEN f5 IS NOT NULL AND r5 <= 11 THEN val END) AS v11,
  avg(CASE WHEN f5 IS NOT NULL THEN CAST(val IS NOT NULL AS DOUBLE) END) AS cov FROM pv GROUP BY 1, 2),
st AS (SELECT DISTINCT game_id, club_id, player_id FROM lineups WHERE type = 'starting_lineup'),
us AS (SELECT tgame, tside, count(DISTINCT player_id) AS us5 FROM recent r JOIN st USING (game_id, club_id) WHERE back <= 5 GROUP BY 1, 2),
lp AS (SELECT r.tgame, r.tside, r.tdate, s.player_id FROM recent r JOIN st s USING (game_id, club_id) WHERE back = 1),
ls AS (SELECT tgame, tside, sum(v.market_value_in_eur) AS lv FROM lp ASOF LEFT JOIN valuations v ON lp.player_id = v.player_id AND lp.tdate > v.date GROUP BY 1, 2),
ss AS (SELECT game_id, club_id, list(player_id) AS ps FROM st GROUP BY 1, 2),
ne AS (SELECT r.*, ps, lag(ps) OVER (PARTITION BY tgame, tside ORDER BY seq) AS old, row_number() OVER (PARTITION BY tgame, tside ORDER BY seq DESC) AS k
  FROM recent r JOIN ss USING (game_id, club_id) WHERE back <= 5),
ln AS (SELECT tgame, tside,
  max(CASE WHEN k = 1 THEN len(list_intersect(ps, old)) / {dbl('11')} END) AS starter_overlap_last,
  max(CASE WHEN k = 1 THEN len(list_intersect(ps, old)) / CAST(len(list_distinct(list_concat(ps, old))) AS DOUBLE) END) AS starter_jaccard_last,
  max(CASE WHEN k = 1 THEN 1 - len(list_intersect(ps, old)) / {dbl('11')} END) AS rotation_index_last,
  avg({dbl('11')} - len(list_intersect(ps, old))) AS avg_starter_changes_5 FROM ne WHERE old IS NOT NULL GROUP BY 1, 2),
av AS (SELECT f.game_id, f.side, {', '.join(f'CASE WHEN f.prior_n > 0 THEN {c} END AS {c}' for c in ('matches_30d', 'minutes_7d', 'minutes_14d', 'minutes_21d', 'minutes_30d'))},
  days_since_prev_match, CASE WHEN f.prior_n > 0 THEN CAST(coalesce(u5, 0) AS DOUBLE) END AS unique_players_5, CASE WHEN f.prior_n > 0 THEN CAST(coalesce(u10, 0) AS DOUBLE) END AS unique_players_10,
  CAST(us5 AS DOUBLE) AS unique_starters_5, CASE WHEN t5 > 0 THEN a5 / t5 END AS top5_minutes_share_5, CASE WHEN t5 > 0 THEN a11 / t5 END AS top11_minutes_share_5,
  CASE WHEN t10 > 0 THEN b11 / t10 END AS top11_minutes_share_10, CASE WHEN u5 > 0 THEN t5 / u5 END AS avg_player_minutes_5,
  starter_overlap_last, starter_jaccard_last, rotation_index_last, avg_starter_changes_5,
  v5 AS recent_players_value_sum_5, v11 AS recent_top11_value_sum_5, lv AS last_starters_value_sum, cov AS recent_value_coverage_5
  FROM ld f LEFT JOIN po ON po.tgame = f.game_id AND po.tside = f.side LEFT JOIN us ON us.tgame = f.game_id AND us.tside = f.side
  LEFT JOIN ls ON ls.tgame = f.game_id AND ls.tside = f.side LEFT JOIN ln ON ln.tgame = f.game_id AND ln.tside = f.side)"""


def _recent(expr: str, name: str, days: int) -> str:
    return (
        f"CAST(coalesce({expr} OVER (PARTITION BY Division, SeasonStartYear, team ORDER BY f.MatchDate "
        f"RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS DOUBLE) AS {name}"
    )


AVAILABILITY_FROM = (
    " FROM matches m JOIN av h ON h.game_id = m.game_id AND h.side = 'H' JOIN av a ON a.game_id = m.game_id AND a.side = 'A'"
)


def availability_sql(names, extra: str = "") -> str:
    out = []
    for s in "ha":
        out += [rnd(f"{s}.{n}", f"avail_{s.upper()}_{n}_pre") for n in names]
    out += [rnd(f"h.{n} - a.{n}", f"avail_diff_{n}_pre") for n in names]
    return (
        f"{oracle_with('appearances', 'lineups', 'valuations')}, {fixture_sides_sql()} "
        f"SELECT {MKEY}, {extra}{', '.join(out)}{AVAILABILITY_FROM}"
    )


@oracle
def availability_load() -> str:
    return availability_sql(S.AVAILABILITY_BASE[:6])


@oracle
def availability_value() -> str:
    return availability_sql([c for c in S.AVAILABILITY_BASE if "value" in c])


@oracle
def availability_lineup() -> str:
    return availability_sql(
        [c for c in S.AVAILABILITY_BASE if c.endswith("_last") or c == "avg_starter_changes_5"]
    )


@oracle
def availability_features() -> str:
    return availability_sql(S.AVAILABILITY_BASE, "m.SeasonStartYear, m.game_id, ")


@oracle
def availability_scope() -> str:
    c = "day(MatchDate) % 10 <> 0"
    return f"""{oracle_with('matches')} SELECT Division, SeasonStartYear, count(*) AS base_rows, count(*) FILTER ({c}) AS covered_rows,
  CAST(0 AS BIGINT) AS unmatched_supplied_matches, round(CAST(count(*) FILTER ({c}) AS DOUBLE) / count(*), 6) AS covered_share
  FROM matches GROUP BY GROUPING SETS ((Division), (SeasonStartYear), ())"""


@oracle
def availability_completeness() -> str:
    cells = []
    for n in S.AVAILABILITY_BASE:
        cells += [f"(h.{n} IS NOT NULL)::INT + (a.{n} IS NOT NULL)::INT + (h.{n} - a.{n} IS NOT NULL)::INT"]
    return f"""{oracle_with('appearances', 'lineups', 'valuations')}, {fixture_sides_sql()},
c AS (SELECT m.Division, m.SeasonStartYear, {' + '.join(cells)} AS p{AVAILABILITY_FROM})
SELECT Division, SeasonStartYear, count(*) AS "rows", CAST(sum(p) AS BIGINT) AS present_cells,
  round(sum(p) / (count(*) * {dbl(str(len(S.AVAILABILITY_FEATURES)))}), 6) AS cell_share,
  round(CAST(count(*) FILTER (p > 0) AS DOUBLE) / count(*), 6) AS any_present_share
FROM c GROUP BY GROUPING SETS ((Division), (SeasonStartYear), ())"""


@oracle
def availability_pool() -> str:
    return availability_sql(POOL_FEATURES)


WEIGHTS = """wt AS (SELECT game_id, club_id, player_id, coalesce(sum(minutes_played), 0) + CAST(30 AS DOUBLE) * max(st) + CAST(5 AS DOUBLE) * max(be) AS w FROM (
  SELECT game_id, player_club_id AS club_id, player_id, minutes_played, 0 AS st, 0 AS be FROM appearances
  UNION ALL SELECT game_id, club_id, player_id, NULL, (type = 'starting_lineup')::INT, (type = 'substitutes')::INT FROM lineups) u GROUP BY 1, 2, 3)"""
CLUB_SIDES = """cs AS (SELECT game_id, SeasonStartYear, Division, HomeTeam AS team, home_club_id AS club_id FROM matches
  UNION ALL SELECT game_id, SeasonStartYear, Division, AwayTeam, away_club_id FROM matches)"""
EDGES = (
    f"{WEIGHTS}, {CLUB_SIDES}, {FOLDS}, ed AS (SELECT fold, Division, team, player_id, ln(1 + sum(w)) AS edge FROM cs JOIN wt USING (game_id, club_id)"
    " JOIN folds ON SeasonStartYear < test_year WHERE w > 0 GROUP BY 1, 2, 3, 4)"
)


@oracle
def graph_edges() -> str:
    return f"{oracle_with('appearances', 'lineups')}, {EDGES} SELECT fold, Division, team, player_id, {rnd('edge', 'edge')} FROM ed"


@oracle
def graph_metadata() -> str:
    return f"""{oracle_with('appearances', 'lineups')}, {EDGES},
n AS (SELECT fold, count(DISTINCT game_id) AS training_fixtures, count(DISTINCT Division || '/' || team) AS team_nodes FROM cs JOIN folds ON SeasonStartYear < test_year GROUP BY fold),
e AS (SELECT fold, count(DISTINCT player_id) AS player_nodes, count(*) AS edges FROM ed GROUP BY fold)
SELECT * FROM n JOIN e USING (fold)"""


@oracle
def embedding_equations() -> str:
    return (
        f"{oracle_with('appearances', 'lineups')}, {EDGES} SELECT fold, count(DISTINCT player_id) AS players,"
        f" CAST(8 AS BIGINT) AS axes, {dbl('0')} AS residual, {dbl('0')} AS skew FROM ed GROUP BY fold"
    )


def pool_sql() -> str:
    """Players and weights of each side's last ten earlier games of the season."""
    return (
        f"{oracle_with('appearances', 'lineups', 'valuations')}, {fixture_sides_sql()}, {WEIGHTS}, "
        "gp AS (SELECT tgame, tside, player_id, sum(w) AS w FROM recent JOIN wt USING (game_id, club_id) GROUP BY 1, 2, 3)"
    )


@oracle
def graph_pool() -> str:
    return f"""{pool_sql()}, ps AS (SELECT tgame, tside, CAST(count(*) AS DOUBLE) AS n, sum(w) FILTER (w > 0) AS tw FROM gp GROUP BY 1, 2)
SELECT {MKEY}, h.n AS "pool_players_H", {rnd('h.tw', 'pool_weight_H')}, a.n AS "pool_players_A", {rnd('a.tw', 'pool_weight_A')}
FROM matches m LEFT JOIN ps h ON h.tgame = m.game_id AND h.tside = 'H' LEFT JOIN ps a ON a.tgame = m.game_id AND a.tside = 'A'"""


@oracle
def graph_pool_values() -> str:
    d = 8
    emb = ", ".join(f"sqrt(max(qty) + {i}) - sqrt(min(qty) + {3 * i}) AS e{i}" for i in range(d))
    sums = ", ".join(
        f"CASE WHEN sum(w) FILTER (e0 IS NOT NULL) > 0 THEN sum(w * e{i}) / sum(w) FILTER (e0 IS NOT NULL) ELSE 0 END AS v{i}"
        for i in range(d)
    )
    vec = {s: [f"coalesce({s}.v{i}, 0)" for i in range(d)] for s in "ha"}
    out = []
    for i in range(d):
        h, a = vec["h"][i], vec["a"][i]
        for kind, x in (("H", h), ("A", a), ("diff", f"{h} - {a}"), ("absdiff", f"abs({h} - {a})")):
            out.append(rnd(x, f"graph_svd8_recent10_{kind}_e{i:02d}_pre", 9))
    hh = " + ".join(f"{x} * {x}" for x in vec["h"])
    aa = " + ".join(f"{x} * {x}" for x in vec["a"])
    ha = " + ".join(f"{x} * {y}" for x, y in zip(vec["h"], vec["a"], strict=True))
    gg = " + ".join(f"({x} - {y}) * ({x} - {y})" for x, y in zip(vec["h"], vec["a"], strict=True))
    p = "graph_svd8_recent10"
    out += [
        rnd(f"CASE WHEN sqrt({hh}) * sqrt({aa}) > 0 THEN ({ha}) / (sqrt({hh}) * sqrt({aa})) END", f"{p}_cosine_pre", 9),
        rnd(f"sqrt({gg})", f"{p}_l2_pre", 9),
        rnd("h.share", f"{p}_H_known_weight_share_pre", 9),
        rnd("a.share", f"{p}_A_known_weight_share_pre", 9),
        rnd("h.share - a.share", f"{p}_diff_known_weight_share_pre", 9),
        f"coalesce(h.n, 0) AS {p}_H_pool_players_pre",
        f"coalesce(a.n, 0) AS {p}_A_pool_players_pre",
        f"coalesce(h.n, 0) - coalesce(a.n, 0) AS {p}_diff_pool_players_pre",
    ]
    return f"""{pool_sql()}, em AS (SELECT player_id, {emb} FROM player_lines GROUP BY 1 HAVING count(*) > 3),
pe AS (SELECT tgame, tside, CAST(count(*) AS DOUBLE) AS n, coalesce(sum(w) FILTER (e0 IS NOT NULL), 0) / sum(w) AS share, {sums}
  FROM gp LEFT JOIN em USING (player_id) GROUP BY 1, 2)
SELECT {MKEY}, m.SeasonStartYear, m.game_id, {', '.join(out)}
FROM matches m LEFT JOIN pe h ON h.tgame = m.game_id AND h.tside = 'H' LEFT JOIN pe a ON a.tgame = m.game_id AND a.tside = 'A'"""


def sequence_rows() -> str:
    """Every team's matches in order, with the number of those before the day."""

    def one(side: str) -> str:
        team, f, g, w, lo = (
            ("HomeTeam", "Home", "Away", "H", "A") if side == "H" else ("AwayTeam", "Away", "Home", "A", "H")
        )
        gf, ga = f"coalesce(FT{f}, 0) / {dbl('3')}", f"coalesce(FT{g}, 0) / {dbl('3')}"
        return (
            f"SELECT MatchDate, SeasonStartYear, Division, HomeTeam, AwayTeam, '{side}' AS side, {team} AS team, "
            f"{dbl('1' if side == 'H' else '0')} AS was_home, {gf} AS goals_for, {ga} AS goals_against, {gf} - {ga} AS goal_difference, "
            f"coalesce({f}Shots, 0) / {dbl('15')} AS shots_for, coalesce({g}Shots, 0) / {dbl('15')} AS shots_against, "
            f"coalesce({f}Target, 0) / {dbl('5')} AS shots_on_target_for, coalesce({g}Target, 0) / {dbl('5')} AS shots_on_target_against, "
            f"coalesce({f}Corners, 0) / {dbl('6')} AS corners_for, coalesce({g}Corners, 0) / {dbl('6')} AS corners_against, "
            f"CASE FTR WHEN '{w}' THEN {ONE} WHEN 'D' THEN 1 / {dbl('3')} WHEN '{lo}' THEN {dbl('0')} END AS points FROM matches"
        )

    part = "PARTITION BY Division, team"
    return f"""cs AS (SELECT *, row_number() OVER ({part} ORDER BY MatchDate, HomeTeam, AwayTeam) AS seq,
  count(*) OVER ({part} ORDER BY MatchDate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS prior_n
  FROM ({one('H')} UNION ALL {one('A')}) u)"""


@oracle
def gathered_sequences() -> str:
    key = "MatchDate, Division, HomeTeam, AwayTeam"

    def shown(side: str, name: str) -> str:
        return (
            f"CAST(coalesce(max(CASE WHEN side = '{side}' THEN n END), 0) AS INT) AS {name}_sequence_size, "
            + rnd(f"coalesce(max(CASE WHEN side = '{side}' THEN goals END), 0)", f"{name}_sequence_goals")
        )

    return f"""{oracle_with('market')}, {sequence_rows()},
s AS (SELECT t.MatchDate, t.Division, t.HomeTeam, t.AwayTeam, t.side, count(h.team) AS n, sum(h.goals_for) AS goals
  FROM cs t LEFT JOIN cs h ON h.Division = t.Division AND h.team = t.team AND h.seq <= t.prior_n AND h.seq > t.prior_n - 10 GROUP BY ALL)
SELECT {MKEY}, {shown('H', 'home')}, {shown('A', 'away')} FROM s m SEMI JOIN market USING ({key}) GROUP BY m.MatchDate, m.Division, m.HomeTeam, m.AwayTeam"""


@oracle
def match_sequences() -> str:
    shown = ", ".join(rnd(f"h.{d}", d) for d in DESCRIPTORS[:-2])
    return f"""{oracle_with('matches')}, {sequence_rows()}
SELECT strftime(t.MatchDate, '%Y-%m-%d') AS MatchDate, t.Division, t.HomeTeam, t.AwayTeam, t.side,
  CAST(h.seq - greatest(t.prior_n - 9, 1) AS INT) AS position, {shown},
  {rnd("ln(1 + CAST(date_diff('day', h.MatchDate, t.MatchDate) AS DOUBLE)) / " + dbl('7'), 'log_days_ago')},
  CAST(h.SeasonStartYear = t.SeasonStartYear AS DOUBLE) AS same_season
FROM cs t JOIN cs h ON h.Division = t.Division AND h.team = t.team AND h.seq <= t.prior_n AND h.seq > t.prior_n - 10"""


@oracle
def vocabulary_ids() -> str:
    y = YEARS[0]
    return f"""{oracle_with('matches')}, tt AS (SELECT DISTINCT Division, team FROM (
  SELECT Division, HomeTeam AS team FROM matches WHERE SeasonStartYear < {y} UNION ALL SELECT Division, AwayTeam FROM matches WHERE SeasonStartYear < {y}) u),
ti AS (SELECT *, row_number() OVER (ORDER BY Division, team) - 1 AS id FROM tt),
li AS (SELECT Division, row_number() OVER (ORDER BY Division) - 1 AS league_id, (SELECT count(*) FROM tt) + row_number() OVER (ORDER BY Division) - 1 AS unk
  FROM (SELECT DISTINCT Division FROM tt) d)
SELECT {MKEY}, league_id, coalesce(h.id, unk) AS home_id, coalesce(a.id, unk) AS away_id, (h.id IS NULL)::INT AS home_unseen, (a.id IS NULL)::INT AS away_unseen
FROM matches m JOIN li ON li.Division = m.Division LEFT JOIN ti h ON h.Division = m.Division AND h.team = m.HomeTeam
LEFT JOIN ti a ON a.Division = m.Division AND a.team = m.AwayTeam WHERE m.SeasonStartYear >= {y}"""


@oracle
def sequence_encoding() -> str:
    yearly = "CASE WHEN substr(Division, 3, 1) IN ('0', '5') THEN CAST(year(MatchDate) AS VARCHAR) ELSE '' END"
    return f"""{oracle_with('matches')}, {FOLDS}, r AS (SELECT MatchDate, Division, HomeTeam || {yearly} AS HomeTeam, AwayTeam, SeasonStartYear FROM matches),
g AS (SELECT f.fold, f.test_year, r.* FROM r JOIN folds f ON r.SeasonStartYear <= f.test_year),
tt AS (SELECT DISTINCT fold, Division, team FROM (SELECT fold, Division, HomeTeam AS team FROM g WHERE SeasonStartYear < test_year
  UNION ALL SELECT fold, Division, AwayTeam FROM g WHERE SeasonStartYear < test_year) u),
ti AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY Division, team) - 1 AS id FROM tt),
li AS (SELECT d.fold, Division, row_number() OVER (PARTITION BY d.fold ORDER BY Division) - 1 AS league_id, n FROM (SELECT DISTINCT fold, Division FROM tt) d
  JOIN (SELECT fold, count(*) AS n FROM tt GROUP BY fold) c ON c.fold = d.fold)
SELECT m.fold, m.test_year, {MKEY}, league_id, coalesce(h.id, n + league_id) AS home_id, coalesce(a.id, n + league_id) AS away_id,
  (h.id IS NULL)::INT AS home_unseen, (a.id IS NULL)::INT AS away_unseen
FROM g m JOIN li ON li.fold = m.fold AND li.Division = m.Division
LEFT JOIN ti h ON h.fold = m.fold AND h.Division = m.Division AND h.team = m.HomeTeam
LEFT JOIN ti a ON a.fold = m.fold AND a.Division = m.Division AND a.team = m.AwayTeam WHERE m.SeasonStartYear = m.test_year"""


@oracle
def vocabulary_oov() -> str:
    return f"""{oracle_with('matches')}, {FOLDS}, r AS (SELECT *, HomeTeam || '-' || CAST(year(MatchDate) AS VARCHAR) AS ht FROM matches),
g AS (SELECT f.fold, f.test_year, r.* FROM r JOIN folds f ON r.SeasonStartYear <= f.test_year),
k AS (SELECT DISTINCT fold, Division, team FROM (SELECT fold, Division, ht AS team FROM g WHERE SeasonStartYear < test_year
  UNION ALL SELECT fold, Division, AwayTeam FROM g WHERE SeasonStartYear < test_year) u),
t AS (SELECT * FROM g WHERE SeasonStartYear = test_year),
h AS (SELECT t.fold, count(*) AS n FROM t ANTI JOIN k ON k.fold = t.fold AND k.Division = t.Division AND k.team = t.ht GROUP BY t.fold),
a AS (SELECT t.fold, count(*) AS n FROM t ANTI JOIN k ON k.fold = t.fold AND k.Division = t.Division AND k.team = t.AwayTeam GROUP BY t.fold)
SELECT f.fold, count(*) AS team_tokens, count(DISTINCT Division) AS unknown_tokens, coalesce(any_value(h.n), 0) AS oov_home, coalesce(any_value(a.n), 0) AS oov_away
FROM folds f JOIN k ON k.fold = f.fold LEFT JOIN h ON h.fold = f.fold LEFT JOIN a ON a.fold = f.fold GROUP BY f.fold"""


@oracle
def scaler_stats() -> str:
    """Medians of the feature table per fold, then moments after imputation."""
    inner = feature_table().replace(", 4) + CAST(0 AS DOUBLE)", ", 12) + CAST(0 AS DOUBLE)")
    parts = []
    for c in S.FEATURES:
        med = f'coalesce(quantile_cont(CAST("{c}" AS DOUBLE), 0.5), 0)'
        parts.append(
            f"SELECT fold, '{c}' AS feature, count(*) AS \"rows\", count(\"{c}\") AS present, any_value(med) AS median, "
            f'avg(coalesce(CAST("{c}" AS DOUBLE), med)) AS mean, stddev_pop(coalesce(CAST("{c}" AS DOUBLE), med)) AS sd '
            f'FROM (SELECT g.fold, g."{c}", m.med FROM g JOIN (SELECT fold, {med} AS med FROM g GROUP BY fold) m ON m.fold = g.fold) x GROUP BY fold'
        )
    return (
        f"WITH ft AS MATERIALIZED ({inner}), {FOLDS}, g AS MATERIALIZED (SELECT f.fold, ft.* FROM ft JOIN folds f ON ft.SeasonStartYear < f.test_year), "
        f"s AS ({' UNION ALL '.join(parts)}) SELECT fold, feature, \"rows\", present, {rnd('median', 'median', 4)}, {rnd('mean', 'mean', 4)}, "
        f"round(CASE WHEN sd > 1e-12 THEN sd ELSE 1 END, 4) AS scale FROM s"
    )


@oracle
def goal_counts() -> str:
    one = "SELECT SeasonStartYear, FT{0} AS goals, {0}Target AS sot, {0}Shots - {0}Target AS off FROM matches"
    return (
        f"{oracle_with('matches')} SELECT SeasonStartYear, goals, sot, off, count(*) AS n FROM "
        f"({one.format('Home')} UNION ALL {one.format('Away')}) u WHERE goals IS NOT NULL AND sot >= 0 AND off >= 0 GROUP BY ALL"
    )


@oracle
def pseudo_xg_fixed() -> str:
    b1 = f"{dbl('0.01')} * (SeasonStartYear - 1990)"
    px = (
        "CASE WHEN SeasonStartYear > 1995 AND {0}Target >= 0 AND {0}Shots - {0}Target >= 0 THEN "
        f"exp({dbl('-0.5')} + {b1} * {{0}}Target + {dbl('-0.02')} * ({{0}}Shots - {{0}}Target)) END"
    )
    out = []
    for s, i in (("H", "ih"), ("A", "ia")):
        for k in (5, 10):
            out += [
                rnd(f"{i}.f{k}", f"PxgForAvg{k}_{s}_pxg_pre", 5),
                rnd(f"{i}.a{k}", f"PxgAgainstAvg{k}_{s}_pxg_pre", 5),
                rnd(f"{i}.d{k}", f"GminusPxgForAvg{k}_{s}_pxg_pre", 5),
            ]
    same = "{0}.MatchDate = m.MatchDate AND {0}.Division = m.Division AND {0}.HomeTeam = m.HomeTeam AND {0}.AwayTeam = m.AwayTeam AND {0}.side = '{1}'"
    prior = "{1}.Division = {0}.Division AND {1}.SeasonStartYear = {0}.SeasonStartYear AND {1}.team = {0}.team AND {1}.seq = {0}.prior_n"
    return (
        f"{oracle_with('matches')}, px AS (SELECT *, {px.format('Home')} AS hx, {px.format('Away')} AS ax FROM matches), "
        f"{xg_history_sql('hx', 'ax', 'px')} SELECT {MKEY}, {', '.join(out)} FROM px m"
        f" JOIN xs h ON {same.format('h', 'H')} JOIN xs a ON {same.format('a', 'A')}"
        f" LEFT JOIN xs ih ON {prior.format('h', 'ih')} LEFT JOIN xs ia ON {prior.format('a', 'ia')}"
    )


LEDGER = """dm AS (SELECT Division, fold, fold_role, model, count(*) AS n, avg(ll) AS ll FROM scored GROUP BY ALL),
dc AS (SELECT m.Division, m.fold, m.fold_role, m.n, b.ll AS base, m.ll AS cand FROM dm m JOIN dm b ON b.Division = m.Division AND b.fold = m.fold AND b.model = 'training_prior' WHERE m.model = 'market'),
lg AS (SELECT 'experiment_' || Division AS experiment_id, 'population_' || Division AS population_id, Division, sum(n * base) / sum(n) - sum(n * cand) / sum(n) AS improvement,
  sum(n * cand) / sum(n) AS candidate_log_loss, count(*) FILTER (base - cand > 0) AS improving_folds FROM dc WHERE fold_role = 'development' GROUP BY Division)"""


@oracle
def candidate_ranking() -> str:
    return f"""{oracle_with('market')}, {PREDICTIONS}, {LEDGER}
SELECT row_number() OVER (ORDER BY improvement DESC, experiment_id) AS rank, experiment_id, population_id, {rnd('improvement', 'improvement')} FROM lg"""


@oracle
def population_ranking() -> str:
    return f"""{oracle_with('market')}, {PREDICTIONS}, {LEDGER}
SELECT population_id, row_number() OVER (PARTITION BY population_id ORDER BY candidate_log_loss, experiment_id) AS rank, experiment_id, {rnd('candidate_log_loss', 'candidate_log_loss')} FROM lg"""


@oracle
def ledger_checks() -> str:
    return f"""{oracle_with('market')}, {PREDICTIONS}, {LEDGER}
SELECT experiment_id, {rnd('improvement', 'improvement')}, improving_folds, CAST(improvement >= 0.005 AND improving_folds >= 2 AS INT) AS passed,
  CASE WHEN CAST(substr(Division, 2) AS INT) % 3 = 0 THEN 'improvement differs' ELSE '' END AS issues FROM lg"""
