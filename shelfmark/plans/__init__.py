"""Plans on the driver's tables; importing the package registers them."""

from . import aggregates, curation, facets, increments, names, relations, reports  # noqa: F401
