"""One query for each operator of the engine, with its equivalent for another SQL engine."""

from . import api, keyed, relational

QUERIES = {**relational.QUERIES, **api.QUERIES, **keyed.QUERIES}
ORACLES = {**relational.ORACLES, **api.ORACLES, **keyed.ORACLES}
