"""The buckets lose no more pairs than the confidence bound."""

import math

from flowtables.llm import vector_dedup


def test_a_pair_at_the_threshold_shares_a_bucket():
    agree = 1 - math.acos(vector_dedup.THRESHOLD) / math.pi
    assert (1 - agree**vector_dedup.SIGNS) ** vector_dedup.TABLES < 1e-6
