from coffer.sources.calendar import date_dim, day_spine, with_calendar
from coffer.sources.schemas import SCHEMAS, conform, schema
from coffer.sources.seeds import lookup_id, seed_reference, values
from coffer.sources.sheets import expand_breakdown, unpivot_sheet
from coffer.sources.statements import parse_statement, read_statement
from coffer.sources.tables import load_ledger, read_table, write_ledger, write_table

__all__ = [
    "SCHEMAS",
    "conform",
    "date_dim",
    "day_spine",
    "expand_breakdown",
    "load_ledger",
    "lookup_id",
    "parse_statement",
    "read_statement",
    "read_table",
    "schema",
    "seed_reference",
    "unpivot_sheet",
    "values",
    "with_calendar",
    "write_ledger",
    "write_table",
]
