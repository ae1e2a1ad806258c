"""Loads every module that registers queries."""

from __future__ import annotations

from stepline.plans import episode_queries, jobs, metric_queries, page_queries, privacy_queries, row_queries, sample_queries, stream_queries, text_queries  # noqa: F401
from stepline.plans.registry import QUERIES, SQL  # noqa: F401
