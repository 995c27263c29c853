"""Importing this module registers the queries of every document operator."""

from __future__ import annotations

from geotext.llm import (  # noqa: F401  (they register)
    chunk_recipes,
    context_trees,
    kernel_quality,
    kneser_ney,
    popcount_simhash,
    size_aware_join,
    skip_list_fim,
    suffix_levels,
    token_alignment,
    token_counts,
    two_fit,
    url_rules,
    window_search,
)
