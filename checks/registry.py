"""All queries under one roof."""

from . import charts, cleaning, periods, plans, safety, segments, similarity, statistics, text

MODULES = (statistics, charts, periods, segments, cleaning, similarity, text, plans, safety)
ALL = {name: pair for module in MODULES for name, pair in module.QUERIES.items()}
