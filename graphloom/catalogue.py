"""All queries of the engine with their SQL twins."""

from graphloom.plans import queries_code, queries_files, queries_graph, queries_text

QUERIES: dict = {**queries_graph.QUERIES, **queries_code.QUERIES, **queries_files.QUERIES, **queries_text.QUERIES}
ORACLES: dict = {**queries_graph.ORACLES, **queries_code.ORACLES, **queries_files.ORACLES, **queries_text.ORACLES}
