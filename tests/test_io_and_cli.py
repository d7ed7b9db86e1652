import json

import pytest
from pyspark.sql import functions as F

from querysieve import __main__ as cli
from querysieve.operators import balance
from querysieve.sources import io
from querysieve.streaming import builder


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"query": "q", "context": "c"}\nbroken\n')
    rows = io.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()
    assert [(r.query, r._corrupt) for r in rows] == [("q", None), (None, "broken")] and rows[0].file == "a.jsonl"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.json").write_text('["a {query}", "b"]')
    assert [(r.file, r.pos, r.template) for r in io.read_templates(spark, str(tmp_path / "t")).collect()] == [("x.json", 0, "a {query}"), ("x.json", 1, "b")]
    (tmp_path / "i.json").write_text('{"x.json": {"description": "d", "tags": ["t"]}}')
    assert io.read_template_info(spark, str(tmp_path / "i.json")).first().tags == ["t"]
    io.write_csv(spark.createDataFrame([('a "b"\nc', 1)], "x string, y int"), str(tmp_path / "c"), ["y", "x"])
    assert io.read_csv(spark, str(tmp_path / "c")).first().asDict() == {"y": "1", "x": 'a "b"\nc'}


def test_writers_and_catalog(spark, tmp_path):
    path = str(tmp_path / "p")
    assert io.write_if_absent(spark.range(3), path) and not io.write_if_absent(spark.range(5), path)
    assert io.read_parquet(spark, path).count() == 3
    with pytest.raises(Exception):
        io.write_parquet(spark.range(1), path)
    io.write_parquet(spark.range(1), path, overwrite=True)
    with pytest.raises(ValueError):
        io.path_of("x", "unknown")
    io.remove(spark, path)
    assert not io.is_done(spark, path)


def test_chunks_share_folders_and_files(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("block_id"), F.floor(F.col("id") / 2).alias("chunk_id")).repartition(4)
    io.write_chunks(rows, str(tmp_path / "all"), "clean", most=100)
    assert sorted(p.name for p in (tmp_path / "all").glob("chunk_dir=*")) == [f"chunk_dir=chunk_{i * 100:06d}" for i in range(5)]
    assert len(list((tmp_path / "all").rglob("*.parquet"))) == 5  # not one for each chunk and task
    got = io.read_chunks(spark, str(tmp_path / "all"), "side=clean", pattern="chunk_dir=chunk_*").collect()
    assert sorted((r.block_id, r.chunk_id) for r in got) == [(i, i // 2) for i in range(1000)]


def test_stream_restarts_with_the_same_result(spark, tmp_path, sf_dir):
    from querysieve.functions import detect
    from querysieve.operators import tokens
    from querysieve.plans.corpus import corpus

    docs = corpus(spark, sf_dir)
    want = balance.targets(200 * 32, 0.3, 32)
    made = []
    for name, steps in (("once", [2]), ("twice", [1, 2])):
        b = builder.Builder(str(tmp_path / name / "out"), want, size=32, sample_size=3)
        for i in steps:  # the second run finds one more file, and goes on
            for j in range(i):
                docs.where(f"doc_id div 100 = {j}").coalesce(1).write.mode("ignore").parquet(str(tmp_path / name / "in" / f"part={j}"))
            b.run(io.read_stream(spark, str(tmp_path / name / "in" / "*")))
        made.append({s: sorted((r.block_id, tuple(r.input_ids)) for r in b.blocks(spark, s).collect()) for s in builder.SIDES})
        assert b.samples(spark).count() > 0
    batch = balance.build(detect.annotate(docs), tokens.WordTokenizer(), detect.clean_side(), detect.dirty_by("regex"), want, 32)
    made.append({s: sorted((r.block_id, tuple(r.input_ids)) for r in batch.where(f"side = '{s}'").collect()) for s in builder.SIDES})
    assert made[0] == made[1] == made[2] and made[0]["dirty"]


def test_commands(spark, tmp_path, sf_dir, capsys):
    from querysieve.plans.corpus import corpus

    assert cli.main(["--list"]) == 0 and cli.main(["nothing"]) == 1
    with pytest.raises(ValueError):
        cli.dataset("unknown")
    docs = str(tmp_path / "docs")
    corpus(spark, sf_dir).write.parquet(docs)
    capsys.readouterr()
    assert cli.main(["audit", docs, str(tmp_path / "audit"), "--sample-size", "3"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["n_total"] == 200 and told["generated_at_utc"].endswith("Z")
    assert cli.main(["prepare", docs, str(tmp_path / "made"), "--block-size", "32", "--test-size", "20"]) == 0
    assert io.read_parquet(spark, str(tmp_path / "made" / "final_clean_grouped")).count() > 0
    assert cli.main(["hydrate", "--review", str(tmp_path / "audit" / "manual_review"), "--corpus", docs, "--output", str(tmp_path / "full")]) == 0
    assert cli.main(["inject", "--blocks", str(tmp_path / "made" / "final_clean_grouped"), "--pool", str(tmp_path / "made" / "final_dirtymatched_grouped"), "--output", str(tmp_path / "inj")]) == 0


def test_commands_with_a_tokenizer_file(spark, tmp_path, sf_dir, capsys):
    import public_tokenizers

    from querysieve.plans.corpus import corpus

    tool = public_tokenizers.path("piece_bpe_32k.model")
    docs, made = str(tmp_path / "docs"), str(tmp_path / "made")
    corpus(spark, sf_dir).write.parquet(docs)
    assert cli.main(["prepare", docs, made, "--block-size", "64", "--test-size", "20", "--tokenizer", tool]) == 0
    blocks = f"{made}/final_dirtymatched_grouped"
    assert cli.main(["audit", docs, str(tmp_path / "audit"), "--max-docs", "50", "--sample-size", "2", "--audit-grouped", f"dirty={blocks}", "--tokenizer", tool]) == 0
    out = capsys.readouterr().out
    assert json.loads(out[out.rindex("{\n") :])["n_total"] == 50
    grouped = spark.read.json(str(tmp_path / "audit" / "grouped_dirty")).first()
    assert grouped.n == io.read_parquet(spark, blocks).count() and grouped.n_with_query > 0
    with pytest.raises(ValueError):
        cli.main(["audit", docs, str(tmp_path / "x"), "--audit-grouped", f"dirty={blocks}"])


def test_commands_of_the_label_loop(spark, tmp_path):
    pairs, asked, told = (str(tmp_path / x) for x in ("pairs", "asked", "told"))
    rows = [("q b", "c", None), ("q a", "", ""), ("q c", "c", "there")]
    spark.createDataFrame(rows, "query string, context string, target string").coalesce(1).write.json(pairs)
    assert cli.main(["batch-requests", pairs, asked, "--template", "Explain {query}", "--models", "m"]) == 0
    found = {r.custom_id: r.body.messages[0].content for r in spark.read.json(asked).collect()}
    assert found == {"0": "Explain q a", "1": "Explain q b"}
    answer = lambda i, t: json.dumps({"custom_id": i, "response": {"body": {"model": "m", "choices": [{"message": {"content": t}}]}}})
    (tmp_path / "answers.jsonl").write_text("\n".join([answer("1", " told "), "broken"]))
    assert cli.main(["merge-answers", "--pairs", pairs, "--answers", str(tmp_path / "answers.jsonl"), "--output", told]) == 0
    assert {(r.query, r.target, r.error) for r in spark.read.json(told).collect()} == {("q a", "", "missing"), ("q b", "told", ""), ("q c", "there", "")}
    assert cli.main(["batch-requests", pairs, f"{asked}2", "--template", "A {query}", "--more-templates", "B {query}", "--models", "m", "n", "--temperatures", "0.5"]) == 0
    assert spark.read.json(f"{asked}2").count() == 4


def test_commands_of_extraction(spark, tmp_path):
    from querysieve.plans import corpus as c

    at = lambda x: str(tmp_path / x)
    c.values(spark, c.FORUM_QUESTIONS, "question_id, title, body, tags").write.parquet(at("q"))
    c.values(spark, c.FORUM_ANSWERS, "answer_id, question_id, body").write.parquet(at("a"))
    c.values(spark, c.WIKI, "title, content").write.parquet(at("w"))
    spark.createDataFrame([(1, "<h1>Head</h1><p>near</p><pre>SELECT 1</pre>")], "page_id int, html string").write.parquet(at("p"))
    spark.createDataFrame([("u", "```sparql\nSELECT ?x WHERE {?x ?p ?y} # more of it\n```")], "author string, body string").write.parquet(at("f"))
    for kind, source, n in (("forum", "q", 3), ("wiki", "w", 2), ("pages", "p", 1), ("posts", "f", 1)):
        assert cli.main(["extract", at(source), at(f"out_{kind}"), "--kind", kind, "--answers", at("a")]) == 0
        assert spark.read.json(at(f"out_{kind}")).count() == n
