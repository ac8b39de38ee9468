"""Terms that reveal a rare entity, wherever they stand in its document."""

import cases

from carecheck.llm import pii


def test_rare_entity_and_second_place_of_the_term(spark):
    plain = "ask about the bill now and say plain words here"
    rows = [(i, plain, None, None, None) for i in range(4000)]
    text = "Zanzibar said hello\nask zanzibar about the bill: q@r.st now\nplain words for Zanzibar here"
    rows += [(9300, text, None, None, None), (9301, "hello said about plain words", None, None, None)]
    found = {r.doc_id: r for r in pii.sanitise(cases.docs(spark, rows)).collect()}
    assert [text[x.s:x.e] for x in found[9300].terms] == ["Zanzibar", "zanzibar", "Zanzibar"]
    assert {x.m for x in found[9300].terms} == {"remove"}
    assert not found[9301].terms and not found[5].terms
