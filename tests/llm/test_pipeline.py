"""The pipeline's stages one after the other, each against what its own input asks for."""
from collections import Counter

import corpus_pipeline as P
from cases import awkward, table


def test_stages(spark, tmp_path):
    words = {"en": "the and of to in is that for with was", "de": "der die und das ist nicht mit auf ein zu"}
    rows = [(i, " ".join(words[l].split() * 3 + [f"n{i}x{k}" for k in range(40)]) + "\nshared menu line\n" + f"own {i}", l, f"s{i % 3}", 0)
            for i, l in enumerate(["en", "de"] * 20)]
    rows += [(100, rows[0][1] + " tail", "en", "s0", 0), (101, rows[0][1], "en", "s0", 0), (102, "12 34", "en", "s0", 5), (103, None, "en", "s1", None)]
    docs, kept = table(spark, rows, clash=True), []
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        if i < len(P.STAGES) - 1:
            assert new.columns == docs.columns and [f.dataType for f in new.schema] == [f.dataType for f in docs.schema]
        docs = new
        kept.append([r.asDict() for r in new.collect()])
    lang, line, near, mixed, toks = kept
    assert {r["doc_id"] for r in lang} == {r[0] for r in rows} - {102, 103}
    assert len(line) == len(lang) and not any("shared menu" in r["text"] for r in line)
    assert all(r["n_chars"] == len(r["text"]) for r in line)
    assert {r["doc_id"] for r in near} == {r["doc_id"] for r in line} - {100, 101}
    times = Counter(r["doc_id"] for r in mixed)
    assert set(times) <= {r["doc_id"] for r in near} and set(times.values()) <= {1, 2} and len(times) > 10
    assert Counter(r["doc_id"] for r in toks) == times and all(r["parity"] and r["round_trip"] for r in toks)


def test_awkward_tables(spark, tmp_path):
    for k, rows in enumerate((awkward(13), [])):
        docs = table(spark, rows)
        for name, stage in P.STAGES:
            stage(spark, docs, "").write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
        if not rows:
            assert docs.count() == 0


def test_run_reads_the_whole_table(spark):
    got = P.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 100 and got.where("parity and round_trip").count() == got.count()
