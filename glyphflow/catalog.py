"""All registered queries of the page-text engine, with their SQL twins."""

from __future__ import annotations

from .plans import artifacts, boxes, caching, discovery, models, pages, pixels, requests, session, stats, streams, texts

MODULES = (boxes, texts, pages, stats, discovery, caching, requests, models, streams, session, artifacts, pixels)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
