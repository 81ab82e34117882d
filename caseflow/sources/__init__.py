from caseflow.sources.counted import write_filtered
from caseflow.sources.result_csv import read_result_csv, write_result_csv
from caseflow.sources.tables import (
    bucketed_by,
    read_catalog,
    read_table,
    register_view,
    shared_folder,
    stage_table,
    write_bucketed,
    write_table,
)

__all__ = [
    "bucketed_by",
    "read_catalog",
    "read_result_csv",
    "read_table",
    "register_view",
    "shared_folder",
    "stage_table",
    "write_bucketed",
    "write_filtered",
    "write_result_csv",
    "write_table",
]
