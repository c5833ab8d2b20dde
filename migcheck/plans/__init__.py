"""Compositions of operators: scores, load order, rationalisation, monitoring, run history."""
