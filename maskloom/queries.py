"""The registered queries of the masking engine and their SQL."""

from __future__ import annotations

from maskloom.plans import masking, structure

QUERIES: dict = {**masking.QUERIES, **structure.QUERIES}
ORACLES: dict[str, str] = {**masking.ORACLES, **structure.ORACLES}
