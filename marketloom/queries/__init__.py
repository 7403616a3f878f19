"""All registered queries; importing the package registers them."""

from marketloom.queries.registry import ORACLES, QUERIES  # noqa: F401
from marketloom.queries import (  # noqa: F401,E402
    cleaning, documents, evaluation, features, incremental, learning, sentiment, sources)
