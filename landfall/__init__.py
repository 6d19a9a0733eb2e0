"""landfall: small-scale-fishery statistics as Spark DataFrame jobs.

Refresh trip, landing and vessel-track tables from a snapshot plus a newer
delta, clean them by trip-level quality rules, slice them by date, place,
habitat, gear and boat type, and compute catch-per-unit-effort reports, raised
national catch, top species, smoothed daily series, a position density grid
and nearest-track donor matching.
"""

from landfall.config import Labels, Params, Selection

__all__ = ["Labels", "Params", "Selection"]
