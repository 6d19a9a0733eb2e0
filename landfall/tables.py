"""A bundle of the fishery tables one report works on."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame


@dataclass
class Tables:
    trips: DataFrame | None = None
    landings: DataFrame | None = None
    pds_trips: DataFrame | None = None
    pds_points: DataFrame | None = None
    municipalities: DataFrame | None = None
    stations: DataFrame | None = None
    species: DataFrame | None = None
    shape: DataFrame | None = None

    def replace(self, **kw) -> "Tables":
        d = {f.name: getattr(self, f.name) for f in fields(self)}
        d.update(kw)
        return Tables(**d)

    def items(self):
        return [(f.name, getattr(self, f.name)) for f in fields(self)
                if getattr(self, f.name) is not None]
