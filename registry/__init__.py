"""All registered queries: name -> (callable(spark, folder), SQL or None)."""

from registry.expression_queries import QUERIES as _EXPRESSION
from registry.ratings_queries import QUERIES as _RATINGS

ALL = {**_RATINGS, **_EXPRESSION}
