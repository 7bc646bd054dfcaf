"""SQL counterparts of the registered queries, by query name."""

from . import layouts, relations, scalars

ORACLES = {**scalars.O, **relations.O, **layouts.O}
