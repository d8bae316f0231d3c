"""Evidence-based attribute integration on Spark."""

from . import queries  # noqa: F401  (first, as it loads the modules that register queries)
