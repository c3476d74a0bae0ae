"""The stages one by one against brute-force versions of their decisions, and the run."""

import pytest

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from gridstone.llm.common import table, written
    from test_operators import brute_join, brute_words

    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF))
        seen[name] = (before, docs)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near copies", "decontamination", "mixing", "token output"]
    assert all(seen[n][1].columns == columns for n in list(seen)[:-1])

    before, after = (x.select("doc_id", "text").collect() for x in seen["near copies"])
    comp = brute_join([(r.doc_id, r.text) for r in sorted(before, key=lambda r: r.doc_id)], 5, 80)
    assert {r.doc_id for r in after} == {i for i, (_, c, _) in comp.items() if c == i}

    before, after = (x.select("doc_id", "text").collect() for x in seen["decontamination"])
    wins = set()
    for r in table(spark, SF, "benchmark").collect():
        w = brute_words(r.text)
        n = min(10, len(w))
        wins |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
    leak = lambda t: (lambda w: any(tuple(w[i:i + n]) in wins for n in {len(x) for x in wins} for i in range(len(w) - n + 1)))(brute_words(t))
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not leak(r.text)}

    before, after = (x.select("doc_id").collect() for x in seen["mixing"])
    assert {r.doc_id for r in after} == {r.doc_id for r in before} and len(after) >= len(before)
    assert seen["token output"][1].count() == len(after)
    assert pipeline.ORACLE_SQL is None


CLASHES = ["gone", "_id", "_th", "_perhaps", "th", "perhaps", "id", "once", "score", "predicted", "posterior", "n_tokens", "rate", "copies", "copy", "_block", "_word", "component_id", "odd name"]


def odd_docs(spark, rows):
    """Rows of (doc_id, text, lang) with columns whose names the stages use themselves."""
    schema = ", ".join(["doc_id bigint", "text string", "lang string", "source string", "n_chars bigint", *[f"`{c}` string" for c in CLASHES]])
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), *[f"{c}{k}" for c in CLASHES]) for k, (i, t, g) in enumerate(rows)], schema)


def test_stages_on_odd_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from gridstone.llm.common import table

    item = table(spark, SF, "benchmark").orderBy("item_id").first().text
    words = [f"word{i}" for i in range(60)]
    base, near, other = " ".join(words), " ".join([*words[:59], "new"]), " ".join(f"other{i}" for i in range(40))
    rows = [(1, base, "en"), (2, near, "en"), (3, other, "en"), (3, base, "en"), (4, None, "en"), (5, "", "de"), (6, other, "en"), (6, other, "en"), (None, "no id at all", "fr"), (None, None, None),
            (7, f"before it {item} after it", "en"), (7, "a clean text of that id", "en"), (8, "lonely words here", "es"), (8, "lonely words here", "es"), (9, "long " * 30_000, "en")]
    docs = odd_docs(spark, rows)
    show = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    stages = dict(pipeline.STAGES)
    empty = docs.where("doc_id > 99")
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, SF)
        assert out.columns == docs.columns, name
        values = {tuple(r) for r in docs.collect()}
        assert {tuple(r) for r in out.collect()} <= values, name  # columns of any name keep their values
        assert stages[name](spark, empty, SF).count() == 0, name

    kept = [(1, base), (3, other), (4, None), (5, ""), (None, "no id at all"), (None, None), (7, f"before it {item} after it"), (7, "a clean text of that id"), (8, "lonely words here"), (9, "long " * 30_000)]
    assert show(stages["near copies"](spark, docs, SF)) == sorted(kept, key=repr)
    assert show(stages["decontamination"](spark, docs, SF)) == sorted([(i, t) for i, t, _ in rows if item not in (t or "")], key=repr)
    assert {(i, t) for i, t in show(stages["mixing"](spark, docs, SF))} == {(i, t) for i, t, _ in rows}
    assert show(stages["toxicity"](spark, docs, SF)) == sorted([(i, t) for i, t, _ in rows], key=repr)
    assert stages["token output"](spark, docs, SF).count() == len(rows) and stages["token output"](spark, empty, SF).count() == 0


def test_mixing_stage_meets_its_shares(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from gridstone.llm.common import table

    docs = table(spark, SF, "documents")
    mixed = pipeline.mix(spark, docs, SF).selectExpr("lang", "size(split(trim(text), '[ \\t\\n\\r]+')) as n").groupBy("lang").sum("n").collect()
    total = sum(r["sum(n)"] for r in mixed)
    for r in mixed:  # soft memberships against true labels on 200 rows
        assert abs(r["sum(n)"] / total - pipeline.TARGETS[r.lang]) < 0.12, (r.lang, r["sum(n)"] / total)
