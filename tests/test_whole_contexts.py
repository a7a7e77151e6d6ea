from lodestone.plans.queries import QUERIES
from lodestone.sources import tables as S


def expected(spark, data):
    """query_id to the whole texts of its search hits, in order."""
    texts = {r.item_id: r.text for r in S.items(spark, data).select("item_id", "text").collect()}
    out = {}
    for r in sorted(QUERIES["hybrid_search"](spark, data).select("query_id", "rank", "item_id").collect()):
        out.setdefault(r.query_id, []).append((r.item_id, texts[r.item_id]))
    assert any(len(t) > 200 for x in out.values() for _, t in x)
    return out


def test_whole_texts_of_search_hits(spark, data):
    want = expected(spark, data)
    context = {q: "\n\n".join(f"[{i}] {t}" for i, (_, t) in enumerate(x, 1)) for q, x in want.items()}
    got = {r.query_id: r for r in QUERIES["context_pack"](spark, data).collect()}
    assert {q: (r.context, r.passages) for q, r in got.items()} == {q: (context[q], len(x)) for q, x in want.items()}
    prompts = {r.query_id: r.system for r in QUERIES["prompt_render"](spark, data).collect()}
    assert set(prompts) == set(want) and all(context[q] in p for q, p in prompts.items())
    opened = {r.query_id: (r.passages, r.first) for r in QUERIES["context_envelope"](spark, data).collect()}
    assert opened == {q: (len(x), x[0][1]) for q, x in want.items()}
    cited = {(r.answer_id, r.number, r.document_id) for r in QUERIES["citation_enrich"](spark, data).collect()}
    assert cited == {(q, n, i if i % 5 else None) for q, x in want.items() for n, (i, _) in enumerate(x[:2], 1)}
