"""Inputs that once lost rows, time or the job: shared item ids, clashing columns, broken markup, addresses without a dot word."""

from __future__ import annotations

import random
import time

import pytest

from fieldspark.llm import bpe, common, decontaminate, html, jaccard, pii

FIRST = "the quick brown fox jumps over the lazy dog near a quiet river in spring"
SECOND = "every morning seven old sailors carried heavy baskets from the harbour to the market square"


def test_items_that_share_an_id_are_each_found(spark):
    items = spark.createDataFrame([(7, FIRST), (7, SECOND), (7, SECOND), (8, None), (None, FIRST)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before this {FIRST} after that"), (2, f"some words {SECOND} and more"), (3, "nothing of the kind here at all, only some other plain words"), (4, f"{FIRST} then {SECOND}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()) == [(1, 7), (2, 7), (4, 7)]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, _key string, __id string, text_key string, item_id string, template string"
    rows = [(1, f"so {FIRST} it was", "en", "s", 1, *"abcdef"), (2, "a plain text of some words that nobody else has written so far", "en", "s", 1, *"abcdef"), (3, "a plain text of some words that nobody else has written so far", "en", "s", 1, *"abcdef"), (None, None, None, None, None, *"abcdef"), (4, "", "en", "s", 0, *"abcdef")]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(5, FIRST)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = decontaminate.drop_leaks(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "4", "None"]
    one = jaccard.one_of_each(spark, docs, str(tmp_path))
    assert one.columns == docs.columns and sorted(str(r.doc_id) for r in one.collect()) == ["1", "2", "4", "None"]
    assert common.unused(docs, "_id", "_KEY", "new") == ["___id", "__KEY", "new"]


@pytest.mark.parametrize("unit", ["<a ", "<b>x</i>", "<a =\" ", "<a =\"'>", "</", "<!-", "<p ='", "<i><b>x</i>", "<a href=x\n", "<script", "&amp"])
def test_time_is_linear_in_broken_pages(unit):
    took = []
    for n in (100_000, 400_000):
        page = "<article><p>first words</p>" + unit * (n // len(unit)) + "<p>last"
        began = time.perf_counter()
        html.blocks(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5 and took[1] < 10


def test_blocks_of_broken_pages():
    texts = lambda page: [b[0] for b in html.blocks(page)]
    assert texts("<p>one</i> two</p><p>three") == ["one two", "three"]
    assert texts('<p class="a>b">kept</p>') == ["kept"]
    assert texts('<p>a</p><p title=">broken quote</p><p>c</p>') == ["a", "broken quote", "c"]
    assert texts("<p>1 < 2 and 3 > 2</p>") == ["1 < 2 and 3 > 2"]
    assert texts("<p>ends in <b") == ["ends in <b"]
    assert texts("<div><b><p>x</b>y</div>z") == ["x", "y", "z"] or texts("<div><b><p>x</b>y</div>z") == ["xy", "z"]


def test_every_well_formed_span_has_a_hint():
    for t in ("jane.doe [at] example.org", "jane at example.org", "jane.doe (at) example . org", "jane { AT } host [.] net", "a@b.c", "x at y dot z"):
        assert pii.plausible(0, t) and pii.HINT.search(f"write to {t} soon"), t
    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice(["jane", "doe", ".", " ", " at ", "[at]", "(at) ", "host", "org", " dot ", "[.]", "-", "AT"]) for _ in range(r.randint(2, 7)))
        if pii.plausible(0, t):
            assert pii.HINT.search(t), t


def test_places_of_pieces_have_room():
    assert bpe.PLACE >= 2**31 - 1 and (1 << 28) << bpe.BITS <= bpe.NONE
