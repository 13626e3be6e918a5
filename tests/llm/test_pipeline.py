"""The pipeline's stages on a small corpus."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = spark.createDataFrame([(90001, None, None, None, 0), (90002, "12345 ...", None, "src1", 9), (90003, docs.first()["text"], "en", "src2", 5)], docs.schema)
    now, sizes = docs.union(extra), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, data)
        assert now.columns == docs.columns
        now = now.cache()
        sizes.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert not sizes[0] & {90001, 90002} and 90003 in sizes[0] and 90003 not in sizes[1]
    assert sizes[0] == {r["doc_id"] for r in docs.collect()} | {90003}
    assert sizes[3] <= sizes[2] <= sizes[1] <= sizes[0] and len(sizes[3]) > len(sizes[2]) / 2
    out = corpus_pipeline.STAGES[-1][1](spark, now, data)
    assert out.count() == len(sizes[3]) and out.where("n_tokens > 0").count() == len(sizes[3])


def test_registered(spark, data):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, data).count() > 100


def test_mixing_stage_keeps_every_document(spark):
    """A source with most rows, small ones and a null one: none is cut, and none ends the mixture."""
    rows = [(i, f"text {i}", "en", "small" if i % 50 == 0 else None if i == 7 else "hot", 6) for i in range(503)]
    got = corpus_pipeline.mixed_sources(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_mixture_sets_where_tokens_lie(spark, tmp_path):
    """Places and first tokens follow the mixture, also after the stage's rows were written by others and read in another order, and with equal
    rows; without the stage there are none."""
    rows = [(i, f"text {i} " + "word " * (i % 7), "en", "small" if i % 20 == 0 else None if i == 7 else "hot", 6) for i in range(203)] + [(5, "twice", "en", "hot", 5)] * 2 + [(None, "no id", "en", "hot", 5)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mixed_sources(spark, docs, "")
    mixed.write.parquet(str(tmp_path / "m"))
    there = spark.read.parquet(str(tmp_path / "m")).repartition(5)
    got = sorted(corpus_pipeline.tokens(spark, there, "").collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(len(rows)))
    sums = 0
    for r in got:
        assert r["first_token"] == sums
        sums += r["n_tokens"]
    key = lambda r: (r["position"], r["doc_id"], r["source"])
    assert [key(r) for r in got] == sorted(map(key, corpus_pipeline.mixing.mix(docs, carry=("text",)).collect()))
    plain = corpus_pipeline.tokens(spark, docs, "").collect()
    assert {(r["position"], r["first_token"]) for r in plain} == {(None, None)} and sorted(r["ids_sha256"] for r in plain) == sorted(r["ids_sha256"] for r in got)


def test_near_duplicate_stage_from_80(spark):
    """Copies of 300 words with 6 (Jaccard 0.816) and 5 scattered edits (0.844) go, those with 7 (0.788) stay; op2 starts at 0.85."""
    rows = []
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(300)]
        rows.append((g * 10, " ".join(base)))
        for edits in (5, 6, 7):
            copy = list(base)
            for e in range(edits):
                copy[20 + 40 * e] = f"edit{edits}x{e}"
            rows.append((g * 10 + edits, " ".join(copy)))
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == {g * 10 + k for g in range(30) for k in (0, 7)}
    assert corpus_pipeline.near_dedup.near_duplicates(docs).where("kept").count() == 120


def test_odd_tables(spark, tmp_path):
    """Empty tables, repeated and null ids, null columns and further columns with clashing names run through every stage."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, k long, v string, component_id long, kept boolean, position long"
    more = (1, "x", 1, True, 1)
    prose = " ".join(f"alpha{i} beta{i % 7} gamma{i % 11}" for i in range(150))
    rows = [(1, prose, "en", "a", 9, *more), (1, prose, "en", "a", 9, *more), (1, "another text of letters", None, None, None, *more), (None, "no key here", "en", "a", 11, *more), (2, prose + " end", "en", None, 9, *more), (3, "", "en", "a", 0, *more), (4, None, None, None, None, *more), (5, "short text", "en", "b", 10, *more)]
    for n, table in enumerate((rows, [])):
        spark.createDataFrame(table, kind).write.parquet(str(tmp_path / f"{n}" / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / f"{n}")).collect()
        ids = [r["doc_id"] for r in got]
        assert len(ids) == len(set(ids)) and set(ids) <= {None, 1, 2, 5} and (len(ids) >= 2 if table else not ids)


def test_texts_reach_workers_in_small_batches(spark, monkeypatch):
    """No stage that reads texts in Python gets more than the batch and one row at a time, whatever is left to be run by the stage's caller."""
    most, held = 1 << 16, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(corpus_pipeline, "BATCH", most, raising=False)
    monkeypatch.setattr(corpus_pipeline.repeats, "BATCH", most)
    seen = spark.sparkContext.accumulator(0)
    frame = type(spark.range(0))
    plain = frame.mapInArrow

    def watched(self, func, schema, *more):
        def run(batches):
            def told():
                for b in batches:
                    size = max((b.column(i).get_total_buffer_size() for i, f in enumerate(b.schema) if str(f.type) == "string" and len(b)), default=0)
                    assert size <= 2 * most, size
                    seen.add(size > most // 2)
                    yield b

            yield from func(told())

        return plain(self, run, schema, *more)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    docs = spark.range(60).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 1000), x -> concat('word ', hex(hash(x, id))))) as text", "'en' as lang", "'s' as source", "1L as n_chars").coalesce(1).cache()
    try:
        for stage in (corpus_pipeline.language_id, corpus_pipeline.near_duplicates, corpus_pipeline.repeated_strings, corpus_pipeline.tokens):
            before = seen.value
            assert stage(spark, docs, "").count() == 60 and seen.value > before, stage
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", held)
        docs.unpersist()
