from collections import Counter

import corpus_pipeline as P
from tests.llm import test_op6, test_op8, test_op9
from tricklake.llm import piece_codec
from tricklake.llm.common import written

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "near-duplicates", "mixing", "encoding"]
    clean = written(P.drop_toxic(spark, docs, SF), "t")
    assert clean.columns == docs.columns
    labels = dict(map(tuple, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect()))
    gone = {d for d, _ in rows(docs)} - {d for d, _ in rows(clean)}
    assert all(labels.get(d, 1) for d in gone)  # too few labels here to learn much; the next test has more

    lines = written(P.drop_repeated_lines(spark, clean, SF), "t")
    assert lines.columns == docs.columns
    assert sorted(rows(lines), key=str) == sorted(((d, t) for d, t, _, _ in test_op9.brute(rows(clean), 40)), key=str)

    single = written(P.drop_near_duplicates(spark, lines, SF), "t")
    assert single.columns == docs.columns
    assert sorted(d for d, _ in rows(single)) == [d for d, _, _, kept in test_op6.brute(rows(lines), 5, 80, 100) if kept]

    mixed = written(P.mix_sources(spark, single, SF), "t")
    assert mixed.columns == docs.columns
    read = Counter(d for d, _ in rows(mixed))
    assert max(read.values()) <= 2 and set(read) <= {d for d, _ in rows(single)}
    size = {d: len((t or "").split()) for d, t in rows(single)}
    assert abs(sum(size[d] * n for d, n in read.items()) - 1.5 * sum(size.values())) < 0.1 * sum(size.values())

    out = P.encode_pieces(spark, mixed, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(read.elements()) and all(r.round_trip for r in out)
    v = piece_codec.PieceVocabulary()
    for r in out[:15]:
        text = dict(rows(single))[r.doc_id]
        if text and len(text) < 1500:
            assert abs(test_op8.score(r.ids, v)[0] - test_op8.whole(" " + text, v)) < 1e-6


def test_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = dict(map(tuple, spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect()))
    kept = {d for d, _ in rows(P.drop_toxic(spark, docs, sf))}
    toxic = {d for d, t in labels.items() if t}
    assert len(toxic - kept) >= 0.5 * len(toxic) and len(labels.keys() - toxic - kept) <= 0.02 * len(labels)


def test_run_on_odd_documents(spark, tmp_path):
    odd = [(1, None, "en", "a", 0), (2, "", None, None, None), (None, "null id\nnull id", "en", "a", 3), (3, "x" * 30000, "en", "b", 1), (3, "x" * 30000, "en", "b", 1), (4, "one line that is long enough to be cut out of others", "en", "a", 2), (5, "one line that is long enough to be cut out of others", "en", "a", 2)]
    for name, data in (("odd", odd), ("none", [])):
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = P.run(spark, f"{tmp_path}/{name}").collect()
        assert all(r.round_trip is not False for r in got) and (len(got) > 0) == bool(data)
