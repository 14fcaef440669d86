"""Parameters that the reference hard-codes.

The reference fixes two languages, three sites, two prediction types and a
year list in code.  Here they are parameters so that the same operators run
on any domain, including the test fixtures.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed values of the original application: chart grains and the trailing
# moving-average width per grain (rows, not calendar units).
GRAINS = ("day", "week", "month")
SMA_WIDTH = {"day": 7, "week": 4, "month": 3}


@dataclass(frozen=True)
class Params:
    # Defaults are fixed values of the original deployment (languages, sites,
    # prediction types, emotion labels in chart order, import years,
    # region codes); the test fixtures pass their own.
    languages: tuple[str, ...] = ("lv", "ru")
    sites: tuple[str, ...] = ("tvnet", "delfi", "apollo")
    prediction_types: tuple[str, ...] = ("normal", "ekman")
    emotions: tuple[str, ...] = ("neutral", "joy", "surprise", "anger", "sadness", "fear", "disgust")
    years: tuple[str, ...] = ("2020", "2021", "2022", "2023", "2024")
    region_lang: tuple[tuple[str, str], ...] = (("rus", "ru"), ("lat", "lv"))
    default_lang: str = "lv"
    all_scope: str = "all"
    # lexicon-hit limits used by broadcast checks (rows)
    broadcast_max_rows: int = 2_000_000
    extra: dict = field(default_factory=dict)

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)

    @property
    def primary_language(self) -> str:
        return self.languages[0]

    @property
    def secondary_language(self) -> str:
        return self.languages[1] if len(self.languages) > 1 else self.languages[0]


def check_grain(grain: str) -> str:
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}; expected one of {GRAINS}")
    return grain


def check_prediction_type(kind: str, params: Params) -> str:
    if kind not in params.prediction_types:
        raise ValueError(f"unknown prediction type {kind!r}; expected one of {params.prediction_types}")
    return kind
