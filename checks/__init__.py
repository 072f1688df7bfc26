"""Registered queries with the SQL that gives the same rows."""

from checks import basics, changes, monitoring, reports, storage

MODULES = [reports, basics, changes, monitoring, storage]
