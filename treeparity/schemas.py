"""Statuses of differences."""

from __future__ import annotations

# Statuses in the order of reports on trees and on content.
TREE_ORDER = ["MISSING", "EXTRA", "SIZE", "TYPE", "ERR-SRC", "ERR-DST"]
CONTENT_ORDER = ["HASH", *TREE_ORDER]
