from lodestone.plans.queries import QUERIES
from lodestone.sources import tables as S


def test_whole_answers_are_normalised(spark, data):
    content = {r.id: r.content for r in S.messages(spark, data).filter("role = 'assistant'").collect()}
    assert any(len(c) > 300 for c in content.values())
    got = {r.id: r.text for r in QUERIES["citation_normalise"](spark, data).collect()}
    head = "[citation](1) [citation](2) [citation](3)[citation](4) "
    assert got == {i: f"{head}{c} [citation]({i % 9})" for i, c in content.items()}


def test_whole_texts_are_migrated(spark, data):
    text = {r.item_id: r.text for r in S.items(spark, data).select("item_id", "text").collect()}
    assert {r.item_id: r.chunk_text for r in QUERIES["metadata_json_backfill"](spark, data).collect()} == text
