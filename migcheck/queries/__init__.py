"""The library's queries over the driver tables, by key, with the SQL that checks them."""

from __future__ import annotations

from migcheck.queries import comparing, discovering, files, growing, metadata, modelling, profiling

QUERIES = comparing.R.queries | profiling.R.queries | metadata.R.queries | files.R.queries | modelling.R.queries | discovering.R.queries | growing.R.queries
ORACLES = comparing.R.oracles | profiling.R.oracles | metadata.R.oracles | files.R.oracles | modelling.R.oracles | discovering.R.oracles | growing.R.oracles
