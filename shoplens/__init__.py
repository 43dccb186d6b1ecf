"""Retail customer analytics as Spark DataFrame jobs.

Public entry points::

    clean_and_process(customers, transactions, store) -> (transactions, profiles)
    segment(profiles, store)                          -> segmented customers
    dashboard(transactions, segmented, choice, store) -> dict of report DataFrames
"""

from shoplens.operators.slicing import DashboardFilter
from shoplens.plans.dashboard import dashboard
from shoplens.plans.processing import clean_and_process
from shoplens.plans.segmentation import segment
from shoplens.sources.stages import StageStore

__all__ = ["DashboardFilter", "StageStore", "clean_and_process", "dashboard", "segment"]
