"""Team-name normalisation: the one text rule Spark has no built-in for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F

# Explicit team aliases on normalised names; there is no fuzzy matching.
TEAM_ALIASES = {
    "ac milan": "milan",
    "arminia": "bielefeld",
    "arminia bielefeld": "bielefeld",
    "athletic club": "ath bilbao",
    "atletico madrid": "ath madrid",
    "bayer leverkusen": "leverkusen",
    "borussia dortmund": "dortmund",
    "borussia mgladbach": "mgladbach",
    "borussia monchengladbach": "mgladbach",
    "celta vigo": "celta",
    "clermont foot": "clermont",
    "darmstadt 98": "darmstadt",
    "dusseldorf": "fortuna dusseldorf",
    "eintracht frankfurt": "ein frankfurt",
    "espanyol": "espanol",
    "fc cologne": "fc koln",
    "fc heidenheim": "heidenheim",
    "fortuna duesseldorf": "fortuna dusseldorf",
    "gladbach": "mgladbach",
    "greuther fuerth": "greuther furth",
    "hamburger sv": "hamburg",
    "hellas verona": "verona",
    "hertha berlin": "hertha",
    "hertha bsc": "hertha",
    "ipswich town": "ipswich",
    "koln": "fc koln",
    "leeds united": "leeds",
    "leicester city": "leicester",
    "luton town": "luton",
    "mainz 05": "mainz",
    "manchester city": "man city",
    "manchester united": "man united",
    "manchester utd": "man united",
    "newcastle united": "newcastle",
    "norwich city": "norwich",
    "nottingham forest": "nottm forest",
    "paderborn 07": "paderborn",
    "paris saint germain": "paris sg",
    "parma calcio 1913": "parma",
    "rasenballsport leipzig": "rb leipzig",
    "rayo vallecano": "vallecano",
    "real betis": "betis",
    "real sociedad": "sociedad",
    "real valladolid": "valladolid",
    "saint etienne": "st etienne",
    "sd huesca": "huesca",
    "spal 2013": "spal",
    "tottenham hotspur": "tottenham",
    "vfb stuttgart": "stuttgart",
    "west bromwich albion": "west brom",
    "west ham united": "west ham",
    "wolverhampton wanderers": "wolves",
}


def normalize_team_name(name: str, aliases: dict[str, str] = TEAM_ALIASES) -> str:
    """Decompose, drop accents and punctuation, lower-case, squeeze blanks, resolve aliases."""
    plain = []
    for ch in unicodedata.normalize("NFKD", name):
        if unicodedata.combining(ch):
            continue
        for low in ch.lower():
            if low.isalnum():
                plain.append(low)
            elif low == "-" or low.isspace():
                plain.append(" ")
    text = " ".join("".join(plain).split())
    return aliases.get(text, text)


def team_name_udf(aliases: dict[str, str] = TEAM_ALIASES):
    """Arrow-batched normaliser; each distinct name of a batch is normalised once.

    It is map-only: no name dimension is shuffled or broadcast, so a hot team costs nothing.
    """

    @F.pandas_udf("string")
    def normalised(names: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(names)
        table = pd.Series([normalize_team_name(n, aliases) for n in distinct], dtype="object")
        return pd.Series([table[c] if c >= 0 else None for c in codes], dtype="object")

    return normalised
