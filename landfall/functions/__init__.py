from landfall.functions.columns import (clamp, clip_low, fill_zero, log_axis, parse_date, patch,
                                        recode, species_label, split_latlng, to_tonnes)
from landfall.functions.dates import (default_window, default_window_cols, month_floor,
                                      month_spine)

__all__ = [
    "clamp", "clip_low", "fill_zero", "log_axis", "parse_date", "patch", "recode",
    "species_label", "split_latlng", "to_tonnes", "default_window",
    "default_window_cols", "month_floor", "month_spine",
]
