"""Parameters, label lists and user selections.

Every constant of the statistics lives in :class:`Params` with the default the
original application uses, so that nothing is hard-wired and tests can move the
date window (the test tables run from 1995 to 2001).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values of the original application (must stay as they are: position in
# each list is the code stored in the tables, 1-based).
# ---------------------------------------------------------------------------
SITES = (
    "Viqueque", "Lautem", "Manatuto", "Liquica", "Bobonaro", "Covalima",
    "Manufahi", "Ainaro", "Baucau", "Dili", "Oe-Cusse", "Atauro",
)
HABITATS = (
    "Reef/Ahu ruin", "FAD/Rumpon", "Deep/Tasi kle'an", "Beach/Tasi ninin",
    "Mangrove/Aiparapa", "Gleaning/Meti",
)
GEARS = (
    "Gillnet/Redi", "Handline/Hakail", "Longline/Hakail naruk", "Spear/Kilat",
    "Cast net/Dai", "Manual/Meti", "Beach seine/Redi tasi ninin",
    "Seine net/Lampara", "Trap/Bubur",
)
BOAT_TYPES = ("Canoe", "Motor")
# Habitat codes were renumbered once: 5 -> 2, 6 -> 5, 7 -> 6 (one map, no cascade).
HABITAT_RECODE = {5: 2, 6: 5, 7: 6}
# Landing flags that keep a trip.
OK_FLAGS = (0, 4, 5)
# Species code that collects the species outside the top list.
OTHER_SPECIES = 300
# Colour given to the polygons of the selected places.
SELECTED_COLOUR = "cornflowerblue"
# IMEI correction: a device whose IMEI is 9376082 reports as 6738430 after day 17691.
PATCH_IMEI_FROM = "9376082"
PATCH_IMEI_TO = "6738430"
PATCH_IMEI_AFTER = 17691.0
# Latitude band whose points exclude a whole tracked trip (the dot is a wildcard).
POINT_EXCLUDE_PATTERN = "^-8.11"
# Tick labels of the log-scaled daily charts: value v is drawn at log10(v + 1).
LOG_AXIS_TICKS = (0, 1, 2, 3, 4, 5, 10, 20, 30, 40, 50)


@dataclass(frozen=True)
class Labels:
    """Ordered label lists; position (1-based) is the code."""

    sites: tuple[str, ...] = SITES
    habitats: tuple[str, ...] = HABITATS
    gears: tuple[str, ...] = GEARS
    boats: tuple[str, ...] = BOAT_TYPES

    @staticmethod
    def codes(names, labels) -> list[int]:
        """Codes (1-based positions) of the selected names; unknown names are ignored."""
        pos = {n: i + 1 for i, n in enumerate(labels)}
        return sorted({pos[n] for n in names if n in pos})


@dataclass(frozen=True)
class Params:
    """Every constant of the cleaning and reporting rules, with the original defaults."""

    min_date: dt.date = dt.date(2016, 9, 1)
    as_of: dt.date = field(default_factory=dt.date.today)
    ok_flags: tuple[int, ...] = OK_FLAGS
    hours_zero_to: float = 3.0
    hours_max: float = 72.0
    effort_zero_to: float = 3.0
    effort_max: float = 144.0
    cpue_cap: float = 100.0
    min_trips: int = 30
    min_days: int = 5
    top_n: int = 9
    other_code: int = OTHER_SPECIES
    hours_per_trip_canoe: float = 4.0
    hours_per_trip_motor: float = 10.0
    hours_per_trip_shore: float = 3.0  # stored by the original, never used
    trips_per_month_canoe: float = 8.2
    trips_per_month_motor: float = 15.3
    point_pattern: str = POINT_EXCLUDE_PATTERN
    patch_imei_from: str = PATCH_IMEI_FROM
    patch_imei_to: str = PATCH_IMEI_TO
    patch_after: float = PATCH_IMEI_AFTER
    cell_half: float = 0.002
    heat_bins: int = 7
    donor_cap: float = 0.2
    habitat_recode: tuple[tuple[int, int], ...] = tuple(sorted(HABITAT_RECODE.items()))
    dedupe: bool = True
    labels: Labels = field(default_factory=Labels)

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


@dataclass(frozen=True)
class Selection:
    """What the user picked: a date window (both ends exclusive), places,
    habitats, gears and boat types by label, and the smoothing strength."""

    start: dt.date
    end: dt.date
    sites: tuple[str, ...] = SITES
    habitats: tuple[str, ...] = HABITATS
    gears: tuple[str, ...] = GEARS
    boats: tuple[str, ...] = BOAT_TYPES
    spar: float = 0.0

    def __post_init__(self):
        if self.end < self.start:
            raise ValueError(f"end {self.end} is before start {self.start}")
        if not 0.0 <= self.spar <= 1.0:
            raise ValueError("spar must lie in [0, 1]")

    def codes(self, labels: Labels) -> dict[str, list[int]]:
        return {
            "sites": Labels.codes(self.sites, labels.sites),
            "habitats": Labels.codes(self.habitats, labels.habitats),
            "gears": Labels.codes(self.gears, labels.gears),
            "boats": Labels.codes(self.boats, labels.boats),
        }

    def is_empty(self, labels: Labels) -> bool:
        """True when any dimension has nothing selected: no result at all."""
        return any(len(v) == 0 for v in self.codes(labels).values())

    def all_gears(self, labels: Labels) -> bool:
        return set(range(1, len(labels.gears) + 1)) <= set(self.codes(labels)["gears"])

    def all_habitats(self, labels: Labels) -> bool:
        return set(range(1, len(labels.habitats) + 1)) <= set(self.codes(labels)["habitats"])

    def raising_enabled(self, labels: Labels) -> bool:
        """National catch is raised only when every gear and habitat is selected."""
        return self.all_gears(labels) and self.all_habitats(labels)
