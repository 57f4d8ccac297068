"""Every registered query over the driver's tables, and its SQL."""

from __future__ import annotations

from chartlode.plans import changes, inputs, matching, parsing, registries, relational, scalars

QUERIES, ORACLES = {}, {}
for part in (relational, scalars, matching, parsing, changes, inputs, registries):
    QUERIES |= part.query.queries
    ORACLES |= part.query.oracles
