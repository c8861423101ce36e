"""Plain forms of the operators, shared by tests."""

from __future__ import annotations

from test_decontaminate import plain_matches as plain_leaks
from test_simhash import plain_fingerprint, plain_groups

__all__ = ["plain_fingerprint", "plain_groups", "plain_leaks"]
