"""All registered queries of this package."""

from tradebook.llm import (  # noqa: F401
    chat,
    decontamination,
    hard_negatives,
    html_text,
    jaccard_join,
    language_id,
    license_templates,
    mixing,
    quality_classifier,
    quality_rules,
    sharded_lloyd,
    token_counts,
    toxicity,
)
from tradebook.llm.common import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
