"""Analyses of drive logs: features, events and reports.

A log is identified by ``log_id`` and ordered by ``row_idx``. All windows and
aggregates are partitioned by log, so one shuffle by ``log_id`` serves a whole
query and many logs are analysed in parallel.
"""
