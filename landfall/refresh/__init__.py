"""Incremental refresh: a snapshot plus the rows newer than its high-water mark, in one go
(delta) or as versions of a stored snapshot that rewrite only changed months (versions).

The original application refreshes once per session from a database; there is
no unbounded stream, so these are batch operators over a growing table.
"""

from landfall.refresh.delta import (dedupe, high_water, read_delta, read_delta_child,
                                    refresh, refresh_tables)
from landfall.refresh.versions import (Facts, create_store, latest_version, read_version,
                                       refresh_store)

__all__ = ["Facts", "create_store", "latest_version", "read_version", "refresh_store",
           "dedupe", "high_water", "read_delta", "read_delta_child", "refresh", "refresh_tables"]
