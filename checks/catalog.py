"""Import every query module so that it registers."""

from . import forecasts, panels, posts, sources, tables  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
