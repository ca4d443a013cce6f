"""Catalogue of the time-series queries: one callable and, where SQL can express it, one DuckDB text a name."""

from . import alignment, analysis, decompositions, exports, feature_queries, forecasting, hierarchies, quality, resampling, schemas

MODULES = (resampling, hierarchies, quality, feature_queries, analysis, forecasting, schemas, alignment, exports, decompositions)
QUERIES: dict = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES: dict = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
