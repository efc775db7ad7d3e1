"""Reading and writing tables."""

from tillscope.sources.saved import (
    key_part,
    save_by_month,
    save_by_part,
    save_table,
    save_view,
    update_in_place,
)
from tillscope.sources.tables import (
    intermediate_name,
    intermediate_path,
    intermediate_tables,
    read_jdbc,
    read_parquet,
    read_table,
    register_view,
    rewrite_where,
    shared_folder,
    update_where,
    written_table,
)

__all__ = [
    "intermediate_name",
    "intermediate_path",
    "intermediate_tables",
    "key_part",
    "read_jdbc",
    "read_parquet",
    "read_table",
    "register_view",
    "rewrite_where",
    "save_by_month",
    "save_by_part",
    "save_table",
    "save_view",
    "shared_folder",
    "update_in_place",
    "update_where",
    "written_table",
]
