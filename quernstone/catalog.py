"""All queries of the library, with their SQL counterparts."""

from .plans.codec_queries import ORACLES as CODEC_ORACLES
from .plans.codec_queries import QUERIES as CODEC_QUERIES
from .plans.index_queries import ORACLES as INDEX_ORACLES
from .plans.index_queries import QUERIES as INDEX_QUERIES
from .plans.table_queries import ORACLES as TABLE_ORACLES
from .plans.table_queries import QUERIES as TABLE_QUERIES

QUERIES = {**INDEX_QUERIES, **CODEC_QUERIES, **TABLE_QUERIES}
ORACLES = {**INDEX_ORACLES, **CODEC_ORACLES, **TABLE_ORACLES}
