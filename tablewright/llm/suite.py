"""All queries of the subpackage; importing the modules registers them."""

from tablewright.llm import bpe_transducer, chosen_path, context_mixing, filter_audit, lattice_near_dedup, packing, quality_rules, suffix_dedup, token_alignment, token_files, toxicity, url_filters, warc  # noqa: F401
from tablewright.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
