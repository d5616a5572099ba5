"""Bounded samples by hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def below(place: Column, wanted: int, total: Column | int, spare: int = 4) -> Column:
    """Whether a row's 64-bit hash ``place`` is among the smallest of ``total`` rows, about ``spare * wanted`` of them.

    A cheap cut ahead of taking exactly the ``wanted`` smallest: what is left to be sorted does not grow with the table.
    That fewer than ``wanted`` pass, and the sample is smaller than its bound, has no practical chance from 100 wanted rows on.
    """
    share = F.least(F.lit(1.0), F.lit(float(spare * wanted)) / total)
    return place.cast("double") <= F.lit(-(2.0**63)) + share * F.lit(2.0**64)
