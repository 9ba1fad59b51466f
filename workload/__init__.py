"""Queries over the test tables, each beside the SQL that must give the same rows."""

from workload import filters, grouped, ingest, messy, ordering, scalars, text

AREAS = (filters, scalars, grouped, ordering, ingest, text, messy)


def all_cases():
    return {name: case for area in AREAS for name, case in area.CASES.items()}
