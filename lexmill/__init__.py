"""lexmill: corpus feature tables and large-scale text-data operators on Spark."""

from lexmill.session import make_session

__all__ = ["make_session"]
__version__ = "0.1.0"
