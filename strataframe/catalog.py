"""All registered queries of the engine proper, and the DuckDB SQL that checks them."""

from __future__ import annotations

from .plans import grids, learning, physics, solutions, sources, spectral, traces

FAMILIES = (grids, traces, physics, spectral, solutions, learning, sources)
FLAGSHIP = "zonal_gradient"
QUERIES: dict = {k: f for m in FAMILIES for k, f in m.C.queries.items()}
ORACLES: dict = {k: s for m in FAMILIES for k, s in m.C.oracles.items()}
