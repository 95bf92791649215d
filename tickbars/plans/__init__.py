"""Whole jobs made of the operators."""

from tickbars.plans.backfill import backfill, backfill_day, run_job
from tickbars.plans.batch import run_batch

__all__ = ["backfill", "backfill_day", "run_batch", "run_job"]
