"""All queries of the library; importing this registers them."""

from . import answer_queries, experiment_queries, model_queries, stat_queries, text_queries  # noqa: F401
from .catalog import QUERIES, SQL  # noqa: F401
