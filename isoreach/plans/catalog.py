"""All registered queries and their SQL, collected from the modules beside it."""

from isoreach.plans import access, files, network, outputs, shapes, streets, tables

_ALL = access.QUERIES | network.QUERIES | tables.QUERIES | shapes.QUERIES | streets.QUERIES | files.QUERIES | outputs.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
