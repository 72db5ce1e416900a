"""All queries of this subpackage."""

from logquarry.llm.common import ORACLES, QUERIES
from logquarry.llm import alignment, bpe, exact_dedup, lm_scores, manifest, mixing, pii, quality, secrets, simhash, substrings, token_counts, vector_joins  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
