"""Every query of the library by name."""

from __future__ import annotations

from . import content, crawl, exchange, sessions, site_profile

FLAGSHIP = site_profile.host_profile
QUERIES = {**site_profile.QUERIES, **crawl.QUERIES, **content.QUERIES, **sessions.QUERIES, **exchange.QUERIES}
ORACLE_SQL = {**site_profile.ORACLE_SQL, **crawl.ORACLE_SQL, **content.ORACLE_SQL, **sessions.ORACLE_SQL, **exchange.ORACLE_SQL}
