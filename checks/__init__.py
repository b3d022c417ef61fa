"""Queries over the given tables, each with the SQL that must give the same result."""

from __future__ import annotations


def catalogs():
    from checks import fitted, grids, learning, missing, reports, samples, scores, series, times

    return [c.catalog for c in (series, times, grids, scores, samples, learning, reports, missing, fitted)]
