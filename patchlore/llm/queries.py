"""Imports every query module of this subpackage so that its registry is full."""

from patchlore.llm import divergence, language, lines, neardup, packing, pages, pieces, quality, shards, spelling, toxicity, vectors, warc  # noqa: F401
from patchlore.llm.registry import QUERIES, SQL  # noqa: F401
