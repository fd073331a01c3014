"""Load strategies: functions of (target, source) that return the new rows.

None of them writes, so each is one plan for the optimizer and can be checked
by itself.
"""

from .columns import delete_by_query, keep_by_query, refresh_columns, update_by_key, update_by_query, upsert_by_query
from .full import append, replace_all, united
from .history import Scd2, scd2
from .merge import merge, upsert
from .ranges import drop_range, load_partitions, swap_default, truncate_range

__all__ = [
    "Scd2", "append", "delete_by_query", "drop_range", "keep_by_query", "load_partitions", "merge", "refresh_columns", "replace_all",
    "scd2", "swap_default", "truncate_range", "united", "update_by_key", "update_by_query", "upsert", "upsert_by_query",
]
