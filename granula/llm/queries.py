"""Loads every query module of the subpackage."""

from . import alignment, audit, bpe, chat, exact_copies, lines, mixing, near_copies, passages, personal, quality, token_counts, topk  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
