"""Every registered query of the signal-research operators, with its SQL twin."""

from __future__ import annotations

from quantloom.plans import accounts, candidates, exports, live, market, more, research, study, windows

BOOKS = [study.book, research.book, candidates.book, accounts.book, windows.book, exports.book, market.book, more.book, live.book]

QUERIES = {name: query for b in BOOKS for name, query in b.queries.items()}
ORACLES = {name: sql for b in BOOKS for name, sql in b.oracles.items()}
