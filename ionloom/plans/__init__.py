"""Registered queries (``QUERIES``) and their SQL counterparts (``ORACLES``) by topic."""
