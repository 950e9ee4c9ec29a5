import hashlib

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import corpus
from transit_spark.llm import language, mixing
from transit_spark.llm.queries import vocabulary

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], KIND).repartition(3)


def with_foreign(rows):
    """The corpus, in two languages so that there is something to learn."""
    more = [(500 + k, " ".join(["ñandú", "cigüeña", "leche", "jamón", "queso"][(k + j) % 5] + "s" * (j % 3) for j in range(40)), "es", "s1") for k in range(12)]
    return rows + more


@pytest.fixture(scope="module")
def rows():
    return [r for r in with_foreign(corpus()) if r[0] not in (75, 80)]


def run_stage(spark, name, docs):
    stage = dict(corpus_pipeline.STAGES)[name]
    return stage(spark, docs, "")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "source_mixing", "sentencepiece"]


def test_language_stage_keeps_what_has_a_language(spark, rows):
    docs = table(spark, rows)
    found = {r.doc_id: r.lang_pred for r in language.identify(docs, language.labelled_sample(docs)).collect()}
    kept = run_stage(spark, "language_id", docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, lang in found.items() if lang != "und")
    assert not {70, 71, 72} & {r.doc_id for r in kept.collect()}


def test_line_stage_equals_brute_force(spark, rows):
    gone = brute.repeated_lines(rows)
    want = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone.get(i, ()))
        if i not in gone:
            want.append((i, text))
        elif kept.strip(" \t\n\x0b\x0c\r"):
            want.append((i, kept))
    out = run_stage(spark, "line_dedup", table(spark, rows))
    assert out.columns == KIND.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_join_stage_keeps_one_of_each_group(spark, rows):
    want = sorted(i for i, (_, c) in brute.near_duplicates(rows, 5, 80).items() if i == c)
    out = run_stage(spark, "ngram_jaccard_join", table(spark, rows))
    assert sorted(r.doc_id for r in out.collect()) == want


def test_mixing_and_encoding_stages(spark, rows):
    import sentencepiece

    docs = table(spark, rows)
    taken = {r.doc_id: int((r.taken + r["size"] / 2) // r["size"]) for r in mixing.mix(docs, mixing.F.array("source")).collect() if r["size"]}
    mixed = run_stage(spark, "source_mixing", docs)
    want = sorted((i, t) for i, t, *_ in rows for _ in range(taken.get(i, 0)))
    assert sorted((r.doc_id, r.text) for r in mixed.collect()) == want

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    for r in run_stage(spark, "sentencepiece", docs).collect():
        ids = model.encode(next(t for i, t, *_ in rows if i == r.doc_id) or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_whole_pipeline_and_an_empty_table(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/full/documents.parquet")
    docs = table(spark, rows)
    for name, _ in corpus_pipeline.STAGES:
        docs = run_stage(spark, name, docs)
    whole = corpus_pipeline.run(spark, f"{tmp_path}/full")
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect())) and whole.count() > 20
    table(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_shuffle_files_of_a_stage_go_before_the_next(spark, rows, tmp_path, monkeypatch):
    steps = []

    def step(name):
        def change(spark, docs, sf_dir):
            steps.append(name)
            return docs.repartition(2)

        return name, change

    monkeypatch.setattr(corpus_pipeline, "STAGES", [step("a"), step("b"), step("c")])
    monkeypatch.setattr(corpus_pipeline, "tidy", lambda df: steps.append("tidy"), raising=False)
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows)
    assert steps == ["a", "tidy", "b", "tidy", "c"]
