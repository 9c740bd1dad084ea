"""The core's queries and their SQL."""

from loomstat.queries import comparison, corpus, evaluation, files, transcripts  # noqa: F401
from loomstat.queries.registry import QUERIES, SQL  # noqa: F401
