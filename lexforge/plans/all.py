"""Imports every module of queries, which registers them."""

from lexforge.plans import evaluation, relational, retrieval, routing, streams, text_pack, vectors, audits  # noqa: F401
