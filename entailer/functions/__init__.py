"""Column-level building blocks: vocabulary constants and expressions."""

from entailer.functions.vocab import *  # noqa: F401,F403
from entailer.functions.vocab import expand_curie, expand_curie_sql  # noqa: F401
