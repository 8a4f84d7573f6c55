"""The registry of queries and of the SQL that checks them."""

from __future__ import annotations

from . import answers, chunks, conversation, corpus, hooks, links, retrieve, scalars, state, storage, streams
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "answers", "chunks", "conversation", "corpus", "hooks", "links", "retrieve", "scalars", "state", "storage", "streams"]
