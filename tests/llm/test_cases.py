"""Every operator over nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import cases
import pytest

from carecheck.llm import (exact_dedup, jaccard_join, language_id, line_dedup, lm_trie, merkle, mixing, pii, piece_tokens, quality,
                           resample, secrets, sharding)
from carecheck.llm.queries import piece_model

OPERATORS = {
    "pii": pii.pii,
    "pieces": lambda d: piece_tokens.round_trip(d, piece_model()),
    "jaccard": jaccard_join.jaccard_join,
    "mixing": mixing.mixing,
    "secrets": secrets.secrets,
    "language": language_id.language_id,
    "lm": lm_trie.lm_scores,
    "quality": quality.quality,
    "lines": line_dedup.line_dedup,
    "exact": exact_dedup.exact_dedup,
    "resample": lambda d: resample.resample(d, d),
    "merkle": merkle.proofs,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_and_clashing_columns(spark, name):
    plain = cases.collected(OPERATORS[name](cases.docs(spark)))
    assert len(plain) == len(cases.ROWS)
    assert cases.collected(OPERATORS[name](cases.clashing(spark))) == plain


@pytest.mark.parametrize("name", [*OPERATORS, "sharding"])
def test_empty_table(spark, name):
    out = (OPERATORS | {"sharding": sharding.sharded})[name](cases.empty(spark))
    assert out.collect() == []


def test_pipeline_stages_take_awkward_rows_and_an_empty_table(spark):
    import corpus_pipeline as P
    from carecheck.llm.common import stored
    for table in (cases.docs(spark), cases.clashing(spark), cases.empty(spark)):
        d = table
        for k, (name, stage) in enumerate(P.STAGES):
            d = stored(stage(spark, d, "/root/testdata/sf0.001"), "test")
            if k < len(P.STAGES) - 1:
                assert d.columns == table.columns
        d.collect()
