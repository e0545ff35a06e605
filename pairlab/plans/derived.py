"""Match-shaped relations derived from the star-schema tables.

Each is one SQL text that Spark and an ANSI SQL engine run unchanged; ``{name}`` marks an input.
Every order is a match: where a day would repeat a pair of teams, the division gets further teams,
so the number of teams grows with the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairlab.session import durable

DEVELOPMENT = (1998, 1999, 2000)
FINAL = 2001

MATCHES = """
WITH li AS (
  SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM {lineitem} GROUP BY l_orderkey),
raw AS (
  SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS MatchDate, CAST(year(o_orderdate) AS BIGINT) AS SeasonStartYear,
         concat('N', lpad(CAST(c_nationkey AS STRING), 2, '0')) AS Division, CAST(c_nationkey AS BIGINT) AS nat,
         o_custkey % 12 AS h0, (o_custkey % 12 + 1 + o_orderkey % 11) % 12 AS a0, n, q, o_totalprice AS price,
         CASE o_orderkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'D' ELSE 'A' END AS fallback
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey LEFT JOIN li ON l_orderkey = o_orderkey),
g AS (SELECT *, q % 5 AS FTHome, (q + n * 3 + game_id) % 4 AS FTAway,
             12 * (row_number() OVER (PARTITION BY MatchDate, Division, h0, a0 ORDER BY game_id) - 1) AS more FROM raw),
t AS (SELECT *, h0 + more AS h, a0 + more AS a FROM g)
SELECT MatchDate, SeasonStartYear, Division,
       concat(CASE WHEN h < 10 THEN 'T0' ELSE 'T' END, CAST(h AS STRING)) AS HomeTeam,
       concat(CASE WHEN a < 10 THEN 'T0' ELSE 'T' END, CAST(a AS STRING)) AS AwayTeam,
       CASE WHEN FTHome IS NULL THEN fallback WHEN FTHome > FTAway THEN 'H' WHEN FTHome = FTAway THEN 'D' ELSE 'A' END AS FTR,
       FTHome, FTAway,
       FTHome + q % 6 + 1 + n AS HomeShots, FTAway + q % 7 + 1 + n AS AwayShots,
       FTHome + q % 6 AS HomeTarget, FTAway + q % 7 AS AwayTarget,
       q % 11 AS HomeCorners, (q + n) % 10 AS AwayCorners, 6 + q % 12 AS HomeFouls, 6 + (q + n) % 13 AS AwayFouls,
       CASE WHEN game_id % 19 = 0 THEN NULL ELSE n % 6 END AS HomeYellow, (n + q) % 6 AS AwayYellow,
       CASE WHEN q % 17 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS HomeRed,
       CASE WHEN q % 13 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS AwayRed,
       game_id, nat * 100000 + h AS home_club_id, nat * 100000 + a AS away_club_id, nat, q, n, price
FROM t
"""

PLAYER_LINES = """
SELECT m.game_id, CASE WHEN l_linenumber % 2 = 1 THEN home_club_id ELSE away_club_id END AS club_id,
       (CASE WHEN l_linenumber % 2 = 1 THEN home_club_id ELSE away_club_id END) * 100 + l_partkey % 16 AS player_id,
       l_quantity AS qty, l_returnflag AS flag, CAST(l_shipdate AS DATE) AS ship, l_extendedprice AS eur
FROM {matches} m JOIN {lineitem} ON l_orderkey = m.game_id
"""

APPEARANCES = """
SELECT game_id, player_id, club_id AS player_club_id, CAST(least(90, CAST(sum(qty) AS BIGINT)) AS DOUBLE) AS minutes_played
FROM {player_lines} GROUP BY game_id, player_id, club_id
"""

LINEUPS = """
SELECT game_id, player_id, club_id, CASE WHEN min(flag) = 'R' THEN 'substitutes' ELSE 'starting_lineup' END AS type
FROM {player_lines} GROUP BY game_id, player_id, club_id
"""

VALUATIONS = """
SELECT player_id, ship AS date, max(eur) AS market_value_in_eur FROM {player_lines} GROUP BY player_id, ship
"""

MARKET = """
SELECT MatchDate, Division, HomeTeam, AwayTeam,
       CASE WHEN game_id % 13 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(105 + CAST(floor(price) AS BIGINT) % 400 AS DOUBLE) / 100 END AS AvgCH,
       CASE WHEN game_id % 11 = 0 THEN NULL ELSE CAST(250 + game_id % 200 AS DOUBLE) / 100 END AS AvgCD,
       CAST(105 + (game_id * 7 + nat) % 600 AS DOUBLE) / 100 AS AvgCA
FROM {matches} WHERE game_id % 7 <> 0
"""

XG_FORM = """
SELECT Division, MatchDate,
       CASE HomeTeam WHEN 'T00' THEN 'Ťeam-Zero' WHEN 'T01' THEN 'Ťeam  One' ELSE concat('Ť', substr(HomeTeam, 2), '.') END AS HomeTeam,
       CASE AwayTeam WHEN 'T00' THEN 'Ťeam-Zero' WHEN 'T01' THEN 'Ťeam  One' ELSE concat('Ť', substr(AwayTeam, 2), '.') END AS AwayTeam,
       CAST(FTHome * 6 + game_id % {h} AS DOUBLE) / 10 AS home_xg, CAST(FTAway * 6 + game_id % {a} AS DOUBLE) / 10 AS away_xg
FROM {{matches}} WHERE FTHome IS NOT NULL{more}
"""
EXTERNAL_XG = XG_FORM.format(h=9, a=7, more=" AND game_id % 17 <> 0")
EXTERNAL_XG_GOOD = XG_FORM.format(h=17, a=19, more="")
SCORED = "SELECT * FROM {matches} WHERE FTHome IS NOT NULL"

RAW_CSV = """
SELECT Division AS Div, CASE game_id % 3
    WHEN 0 THEN concat(CAST(year(MatchDate) AS STRING), '-', lpad(CAST(month(MatchDate) AS STRING), 2, '0'), '-', lpad(CAST(day(MatchDate) AS STRING), 2, '0'))
    WHEN 1 THEN concat(lpad(CAST(day(MatchDate) AS STRING), 2, '0'), '/', lpad(CAST(month(MatchDate) AS STRING), 2, '0'), '/', CAST(year(MatchDate) AS STRING))
    ELSE concat(lpad(CAST(day(MatchDate) AS STRING), 2, '0'), '/', lpad(CAST(month(MatchDate) AS STRING), 2, '0'), '/', substr(CAST(year(MatchDate) AS STRING), 3, 2)) END AS Date,
  CASE WHEN game_id % 2 = 0 THEN CAST(SeasonStartYear AS STRING) ELSE concat(CAST(SeasonStartYear AS STRING), '-', CAST(SeasonStartYear + 1 AS STRING)) END AS Season,
  concat(' ', HomeTeam) AS HomeTeam, AwayTeam, FTR, CAST(FTHome AS STRING) AS FTHG, CAST(FTAway AS STRING) AS FTAG,
  CAST(HomeShots AS STRING) AS HS, CAST(AwayShots AS STRING) AS AS_, CAST(HomeTarget AS STRING) AS HST, CAST(AwayTarget AS STRING) AS AST,
  CAST(HomeCorners AS STRING) AS HC, CAST(AwayCorners AS STRING) AS AC, CAST(HomeFouls AS STRING) AS HF, CAST(AwayFouls AS STRING) AS AF,
  CAST(HomeYellow AS STRING) AS HY, CAST(AwayYellow AS STRING) AS AY, CAST(HomeRed AS STRING) AS HR, CAST(AwayRed AS STRING) AS AR
FROM {matches}
"""


class Tables:
    """The derived relations of one data directory, built on first use."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory
        self._made: dict[str, DataFrame] = {}
        self._kept: set[str] = set()

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def _sql(self, text: str, **inputs: DataFrame) -> DataFrame:
        return self.spark.sql(text, **inputs)

    def _make(self, name: str) -> DataFrame:
        if name == "matches":
            return self._sql(
                MATCHES,
                lineitem=self.base("lineitem"),
                orders=self.base("orders"),
                customer=self.base("customer"),
            )
        if name == "player_lines":
            return self._sql(PLAYER_LINES, matches=self.matches, lineitem=self.base("lineitem"))
        on_lines = {"appearances": APPEARANCES, "lineups": LINEUPS, "valuations": VALUATIONS}
        if name in on_lines:
            return self._sql(on_lines[name], player_lines=self.player_lines)
        on_matches = {
            "market": MARKET,
            "external_xg": EXTERNAL_XG,
            "external_xg_good": EXTERNAL_XG_GOOD,
            "scored": SCORED,
            "raw_csv": RAW_CSV,
        }
        return self._sql(on_matches[name], matches=self.matches)

    def stored(self, *names: str) -> Tables:
        """Store relations, in this order, that a query reads several times; others build on them."""
        for name in names:
            if name not in self._kept:
                self._made[name] = durable(getattr(self, name))
                self._kept.add(name)
        return self

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    @property
    def canonical(self) -> DataFrame:
        from pairlab import schema as S

        return self.matches.select(*S.CANONICAL)

    @property
    def fixtures(self) -> DataFrame:
        from pairlab import schema as S

        return self.matches.select(*S.FIXTURE_COLUMNS)


def oracle_with(*names: str) -> str:
    """A WITH clause that builds the named relations for the oracle engine."""
    texts = {
        "matches": (MATCHES, ()),
        "player_lines": (PLAYER_LINES, ("matches",)),
        "appearances": (APPEARANCES, ("player_lines",)),
        "lineups": (LINEUPS, ("player_lines",)),
        "valuations": (VALUATIONS, ("player_lines",)),
        "market": (MARKET, ("matches",)),
        "external_xg": (EXTERNAL_XG, ("matches",)),
        "external_xg_good": (EXTERNAL_XG_GOOD, ("matches",)),
        "scored": (SCORED, ("matches",)),
        "raw_csv": (RAW_CSV, ("matches",)),
    }
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in texts[name][1]:
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    known = {n: n for n in (*texts, "lineitem", "orders", "customer")}
    return "WITH RECURSIVE " + ",\n".join(
        f"{n} AS MATERIALIZED ({texts[n][0].format(**known)})" for n in ordered
    )
