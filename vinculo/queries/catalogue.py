"""All queries of the core and the SQL that says the same."""

from . import graph, processing, training

QUERIES: dict = {**graph.QUERIES, **processing.QUERIES, **training.QUERIES}
SQL: dict = {**graph.SQL, **processing.SQL}
