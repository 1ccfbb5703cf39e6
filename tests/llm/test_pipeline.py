"""The pipeline's stages against plain versions, on a small corpus; and the registry."""

import collections

import corpus_pipeline
import pytest
from tests.llm.test_operators import brute_components, rows

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("docs")
    data = [(*x, len(x[1] or "")) for x in rows(120, 9)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
        seen.append((name, [tuple(r) for r in before.collect()], docs))
    _, first, kept = seen[0]
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in first if any(c.isalpha() for c in r[1] or "")}
    _, first, kept = seen[1]
    last = collections.defaultdict(int)
    for r in first:
        last[r[1]] = max(last[r[1]], r[0])
    assert {r["doc_id"] for r in kept.collect()} == set(last.values())
    _, first, kept = seen[2]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in brute_components(first, 5, 80).items() if i == c}
    _, first, mixed = seen[3]
    size = {r[0]: len(r[1].split()) for r in first}
    taken = sum(size[r["doc_id"]] for r in mixed.collect())
    assert abs(taken - 1.5 * sum(size.values())) <= 5 * max(size.values())
    pieces = docs.where("piece = 0").count()
    assert pieces == mixed.count()


def test_run_and_registry(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_columns_keep_their_values_whatever_their_names(spark):
    """Names that the stages use inside, and that they used once, in each stage, with ids that repeat."""
    names = ["_hash", "_at", "_row_key", "_keep", "_good", "_id", "_copies", "_copy", "ROW_KEY", "row_at", "row_hash", "Chosen", "mixed_id", "mixed_times", "mixed_copy", "key", "component_id", "kept", "n_shingles", "size", "target", "taken"]
    texts = ["some words of one text", "some words of one text", "another text with other words", "a third of them"]
    for ids in ([1, 1, 2, None], [1, 2, 3, 4]):
        data = [(i, t, "en", "s", len(t), *(77 + k for k in range(len(names)))) for i, t in zip(ids, texts, strict=True)]
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names))
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            got = [tuple(r) for r in out.collect()]
            assert got and all(r in data for r in got), name
        assert corpus_pipeline.packed(spark, docs, "").count() >= 4


def test_stages_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_rows_of_one_id_are_told_apart(spark):
    """Stages decide on rows, also where ids are null or repeat."""
    base = " ".join(f"word{k}" for k in range(60))
    near, other = base.replace("word59", "end"), " ".join(f"term{k}" for k in range(40))
    data = [(1, base, "en", "a"), (1, base, "en", "a"), (1, other, "en", "b"), (1, "12 34", "en", "a"), (7, near, "en", "a"), (None, base, "en", "a"), (None, other + " tail", "en", "b"), (None, near, "en", "b"), (None, "alone here", "en", "a"), (None, "alone here", "en", "a"), (None, "56", "en", "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(3)
    take = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
    first = corpus_pipeline.language_id(spark, docs, "")
    assert first.columns == docs.columns
    assert take(first) == collections.Counter(x[:2] for x in data if any(c.isalpha() for c in x[1]))
    second = corpus_pipeline.exact(spark, first, "")
    assert take(second) == {(1, base): 1, (1, other): 1, (7, near): 1, (None, other + " tail"): 1, (None, "alone here"): 1}
    third = corpus_pipeline.near(spark, first, "")
    assert take(third) == {(1, base): 1, (1, other): 1, (None, "alone here"): 1}
    same = [(None if k % 2 else 5, f"one two {k // 20}", "en", "a") for k in range(40)]
    mixed = take(corpus_pipeline.mixture(spark, spark.createDataFrame(same, docs.schema).repartition(3), ""))
    assert max(n / 10 for n in mixed.values()) <= 2 and 60 <= sum(mixed.values()) <= 61
    from tensorloom.llm.near_dedup import near_duplicates

    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_duplicates(spark.createDataFrame([(3, other), (3, base), (9, near), (9, other), (None, near)], "doc_id long, text string")).collect())
    assert got == [(0, 0, True), (3, 3, True), (3, 3, True), (9, 3, False), (9, 3, False)]
