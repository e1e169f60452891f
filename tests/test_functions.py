"""Scalar functions, scores, samples, sources and the stream, on small inputs."""

import json
import math
import random
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import scores, tokens
from factloom.functions import text as T
from factloom.operators import decode, facts, qa, report, series, trie
from factloom.sources import readers, served, writers
from factloom.streaming import modes


def column(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expr(F.col("x"))).collect()]


def test_extract_answer(spark):
    got = column(spark, ["Answer: Paris.<|im_end|>x", "a\nAnswer: B\rC D.", "none", "Answer: 1. Answer: 2", "", None], T.extract_answer)
    assert got == ["Paris", "B\rC D", None, "1. Answer: 2", None, None]


def test_matches(spark):
    df = spark.createDataFrame([("Paris", "paris"), ("", "x"), ("New York", "york"), ("a", "b")], "a string, b string")
    assert [tuple(r) for r in df.select(T.exact_match(F.col("a"), F.col("b")), T.inclusion_match(F.col("a"), F.col("b"))).collect()] == [(1, 1), (0, 1), (0, 1), (0, 0)]
    assert [r[0] for r in df.select(T.word_jaccard(F.lit(""), F.lit(" "))).limit(1).collect()] == [None]


def test_small_functions(spark):
    assert column(spark, ["I have 3 and 1,200", "none", "4 . .", "."], T.last_number) == ["1,200", None, "4", "."]
    assert column(spark, ["so #### 1,200", "x"], T.marked_number) == ["1200", None]
    assert column(spark, ["/a/b_c_model.json"], T.model_name) == ["b c"]
    assert column(spark, ["Yes, it is", "no", None], T.fix_judge) == ["yes", "no", "no"]
    assert column(spark, ["['a', 'b']", "plain"], T.list_text) == ["a, b", "plain"]
    df = spark.createDataFrame([("", "xx<pad>"), ("", "<pad>"), ("a", "b")], "p string, f string")
    assert [r[0] for r in df.select(T.reached_max(F.col("p"), F.col("f"), "<pad>")).collect()] == [True, False, False]


def test_common_subsequence_against_the_table():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.choice("abcde") for _ in range(r.choice([0, 1, 5, 70]))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert scores.common_subsequence(a, b) == table[-1][-1]


def test_scores():
    assert scores.bleu("a b c d".split(), "a b c d".split(), 4) == 1.0
    assert scores.bleu("a b c d".split(), "a b".split(), 1) == pytest.approx(2.718281828 ** (1 - 2))
    assert [scores.stem(w) for w in "caresses ponies relational hopping filing happy electricity adoption".split()] == "caress poni relat hop file happi electr adopt".split()
    assert scores.rouge_l("the cats sat", "the cat sat down") == pytest.approx((3 / 4, 1.0, 6 / 7))
    assert scores.meteor("a b c".split(), "a b c".split()) == pytest.approx(1 - 0.5 / 27)
    assert scores.bleu(["a"], [], 1) == scores.meteor(["a"], []) == 0.0


def test_quotas():
    assert qa.quotas({("a",): 5, ("b",): 3, ("c",): 2}, size=5) == {("a",): 3, ("b",): 1, ("c",): 1}
    assert sum(qa.quotas({("a",): 7, (None,): 6}, fraction=0.5).values()) == 7
    with pytest.raises(ValueError):
        qa.quotas({}, 1, 0.5)


def test_report_alignment(spark):
    a = spark.createDataFrame([(0, "q", "x"), (1, "r", "y")], "idx int, question string, p string")
    assert report.aligned(a, a.select("idx", "question", F.lit(1).alias("j")), "idx", ["question"]).count() == 2
    with pytest.raises(ValueError):
        report.aligned(a, a.where("idx = 0"), "idx", ["question"])
    assert "\\hline" in report.latex(a)
    assert report.ranked_columns(["b|y", "a|x", "z|x", "a|y"], ["a", "b"], ["x", "y"]) == ["a|x", "a|y", "b|y", "z|x"]


def test_beams(spark):
    df = spark.createDataFrame([([3, -1, 4, -1],), ([-1],), ([],)], "x array<int>")
    assert [r[0] for r in df.select(decode.last_filled(F.col("x"))).collect()] == [2, -1, -1]
    assert [r[0] for r in df.select(decode.new_tokens(F.col("x"), -1)).collect()] == [1, 0, 0]
    assert [r[0] for r in df.select(decode.constrained_part(F.col("x"), F.least(F.size("x"), F.lit(2)))).collect()] == [[4, -1], [-1], []]


def test_label_lines(spark):
    line = '<http://www.wikidata.org/entity/Q7> <http://schema.org/description> "a \\"river\\""@en .'
    rows = facts.label_statements(spark.createDataFrame([(line, 1), ("x", 2)], "value string, n int")).collect()
    assert [(r["kind"], r["id"], r["what"]) for r in rows] == [("Q", 7, "description")]


def test_index_round_trip(spark, tmp_path):
    seqs = spark.createDataFrame([(["a", "b", "c"],), (["a", "b", "d"],), (["a", "x"],)], "tokens array<string>")
    writers.build_index(seqs, str(tmp_path / "index"), switch=2, config={"tokenizer": "words"})
    assert writers.index_config(spark, str(tmp_path / "index")) == {"switch": 2, "tokenizer": "words"}
    edges = readers.open_index(spark, str(tmp_path / "index"))
    assert {(*r["prefix"], r["next_token"]): r["numleaves"] for r in edges.collect()} == {("a",): 3, ("a", "b"): 2, ("a", "x"): 1}
    assert dict(writers.disk_usage(spark, str(tmp_path / "index")))["edges"] > 0


def test_readers(spark, tmp_path):
    writers.facts(spark.createDataFrame([("<a> <b> <c> .",)], "fact string"), str(tmp_path / "f"))
    assert readers.fact_lines(spark, str(tmp_path / "f"), prefix=" ").first()["fact"] == " <a> <b> <c> ."
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(x) for x in ({"experiment_name": "e"}, {"question": "q0", "triples": ["t"]}, {"question": "q1"})) + "\n")
    head, rows = readers.log(spark, str(tmp_path / "log.jsonl"), readers.PREDICTION)
    assert head.first()["header"] == {"experiment_name": "e"}
    assert [(r["idx"], r["question"], r["triples"]) for r in rows.orderBy("idx").collect()] == [(0, "q0", ["t"]), (1, "q1", None)]
    with zipfile.ZipFile(tmp_path / "bi.zip", "w") as z:
        z.writestr("x.csv", "query_type:,question:,answer:\nlist,Who?,\"['a', 'b']\"\n")
    bi = qa.bi(readers.zipped_csv(spark, str(tmp_path / "bi.zip"), ["query_type:", "question:", "answer:"]))
    assert bi.first().asDict() == {"question": "Who?", "answer": "a, b", "question_type": "list", "answer_type": "list"}
    (tmp_path / "m.json").write_text(json.dumps([{"question": "q", "answer": {"mention": "m", "answerType": "entity", "answer": ["a", "b"]}, "complexityType": "yesno"}]))
    assert readers.questions(spark, str(tmp_path / "m.json"), "mintaka").first()["answer_type"] == "entity,list"
    assert readers.parse_url("postgresql://u:p@h/db?tablename=t&switch=7")["options"] == {"tablename": "t", "switch": "7"}
    with pytest.raises(ValueError):
        readers.parse_url("postgresql://h/db")
    with pytest.raises(ValueError):
        readers.parse_url("ftp://h/db")


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f"{k} " + "x" * (k % 90) for k in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("one\n\nthree")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = readers.numbered_lines(spark, f"{tmp_path}/*.txt").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {(r["path"][-5:], r["line"]): r["value"] for r in rows}
    assert got == {**{("a.txt", k): x for k, x in enumerate(lines)}, ("b.txt", 0): "one", ("b.txt", 1): "", ("b.txt", 2): "three"} and len(rows) == len(got)


def test_resume_refuses_another_run(spark):
    todo, done = spark.range(5), spark.range(2)
    head = spark.createDataFrame([({"model": "a", "note": "x"},)], "header map<string,string>")
    assert report.resume_run(todo, done, "id", head, {"model": "a", "note": "y"}, ["model"]).count() == 3
    with pytest.raises(ValueError):
        report.resume_run(todo, done, "id", head, {"model": "b"}, ["model"])


def test_samples_follow_their_quotas(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["a", "b", None]), r.choice([1, 2, 3, None])) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, x string, y int")
    for wanted in ({"size": 73}, {"fraction": 0.31}, {"size": 900}, {"size": 0}):
        counts = Counter((x, y) for _, x, y in rows)
        want = {k: n for k, n in qa.quotas(dict(counts), **wanted).items() if n}
        got = Counter((x["x"], x["y"]) for x in qa.stratified_sample(df, ["x", "y"], "id", **wanted).collect())
        assert got == want
    assert qa.stratified_sample(df.limit(0), ["x"], "id", size=5).count() == 0


def test_quantiles_by_rank(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(20)])) for _ in range(700)] + [("one", 3)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {x["k"]: tuple(x[2:]) for x in series.summary(df, "v", ["k"], (0.0, 0.25, 0.9, 1.0)).select("k", "num", "q0", "q25", "q90", "q100").collect()}
    for k in ("a", "b", None, "one"):
        values = [v for key, v in rows if key == k and v is not None]
        assert got[k] == pytest.approx([float(np.quantile(values, q)) for q in (0.0, 0.25, 0.9, 1.0)])
    assert got["none"] == (None,) * 4
    whole = series.summary(df, "v", quantiles=(0.5,)).first()
    assert whole["q50"] == np.quantile([v for _, v in rows if v is not None], 0.5)


def test_served_index_retries_and_refuses(spark, monkeypatch):
    import threading
    import urllib.error

    class Shaky:
        calls = 0

        def next_tokens(self, prefix):
            Shaky.calls += 1
            if Shaky.calls == 1:
                raise RuntimeError("once")
            return {"a": len(prefix)}

    http = served.server({"t": Shaky()})
    monkeypatch.setattr(http, "handle_error", lambda *a: None)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{http.server_address[1]}"
    assert served.open_served(spark, f"{url}/t").next_tokens(["x", "y"]) == {"a": 2} and Shaky.calls == 2
    with pytest.raises(urllib.error.HTTPError):
        served.HttpIndex(url, "other").next_tokens([])
    http.shutdown()
    http.server_close()
    with pytest.raises(ValueError):
        served.open_served(spark, "postgresql://h/db?tablename=t")
    memory = served.MemoryIndex(trie.maximal_leaves(spark.createDataFrame([(["a", "b"],), (["a", "c"],)], "tokens array<string>")))
    assert memory.next_tokens([]) == {"a": 2} and memory.next_tokens(["a"]) == {"b": 1, "c": 1} and memory.next_tokens(["z"]) == {}


def test_dataset_paths(spark, tmp_path, monkeypatch):
    (tmp_path / "x.json").write_text("[]")
    monkeypatch.setenv("DATA_PATH", str(tmp_path))
    for session in (None, spark):
        assert readers.dataset_path("x.json", session) == f"{tmp_path}/x.json"
        with pytest.raises(FileNotFoundError):
            readers.dataset_path("y.json", session)


def test_tokenizers_by_name(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("<a> <b c> .",), (None,), ("",)], "t string")
    rows = df.select(tokens.tokenizer("words")("t").alias("w"), tokens.tokenizer("utf8")("t").alias("u"), tokens.tokenizer(path)("t").alias("s")).collect()
    assert rows[0]["w"] == ["<a>", "<b", "c>", "."] and bytes(rows[0]["u"]) == b"<a> <b c> ."
    assert rows[0]["s"] == Tokenizer.from_file(path).encode("<a> <b c> .", add_special_tokens=False).ids and rows[1]["s"] is None and rows[2]["s"] == []


def test_stream_modes(spark, tmp_path):
    rows = [(1, k, w) for k, w in enumerate("Fact: a b Fact: c".split())] + [(2, 0, "x")]
    spark.createDataFrame(rows, "key long, seq long, token string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, seq long, token string").parquet(str(tmp_path / "in"))
    q = modes.stream_modes(stream, "Fact:").writeStream.format("memory").queryName("modes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = [(r["seq"], r["starts"], r["run"]) for r in spark.table("modes").where("key = 1").orderBy("seq").collect()]
    assert got == [(0, False, 0), (1, False, 0), (2, False, 0), (3, True, 1), (4, False, 1)]


def test_decode_exhausts(spark):
    leaves = trie.maximal_leaves(spark.createDataFrame([(["a", "b"],), (["a", "c"],)], "tokens array<string>"))
    states = spark.createDataFrame([(1, 3)], "state int, n int")
    out = decode.constrained_decode(states, leaves, 20).orderBy("ordinal").collect()
    assert [r["status"] for r in out] == ["COMPLETE", "COMPLETE", "EXHAUSTED"]
    assert {tuple(r["tokens"]) for r in out[:2]} == {("a", "b"), ("a", "c")}


def test_decode_marks_what_it_leaves(spark):
    leaves = trie.maximal_leaves(spark.createDataFrame([(["a", "b", "c"],)], "tokens array<string>"))
    out = decode.constrained_decode(spark.createDataFrame([(1, 1)], "state int, n int"), leaves, 2).collect()
    assert [(r["ordinal"], r["tokens"], r["status"]) for r in out] == [(0, ["a", "b"], "UNFINISHED")]


def test_command_lines(spark, tmp_path):
    from factloom import build_index, walk

    (tmp_path / "facts.txt").write_text("<a> <p> <b> .\n<a> <p> <c> .\n<d> <p> <e> .\n")
    out = walk.main([str(tmp_path / "facts.txt"), "--initial", "<a> <p>", "--n", "3"])
    assert sorted(out) == ["COMPLETE: <a> <p> <b> .", "COMPLETE: <a> <p> <c> .", out[-1]] and out[-1].startswith(("EXHAUSTED", "REFUSED"))
    assert walk.main([str(tmp_path / "facts.txt"), "--initial", "<x>"]) == ["REFUSED: "]
    build_index.main([str(tmp_path / "facts.txt"), str(tmp_path / "index"), "--switch", "2"])
    assert readers.open_index(spark, str(tmp_path / "index")).where("depth = 0").agg(F.sum("numleaves")).first()[0] == 3


def test_analyses_pivot(spark, tmp_path):
    for k, v in enumerate((0.5, 0.25)):
        meta = {"experiment_name": "e", "model_config_path": f"/m/m{k}_model.json", "dataset_config_path": "/d/qa.json"}
        (tmp_path / f"{k}.json").write_text(json.dumps({"metadata": meta, "em_im_metrics": {"EM": v}, "answered_metrics": {"n": 3}}))
    rows = readers.analyses(spark, str(tmp_path / "*.json"))
    out = report.pivot_first(rows.where("metric = 'EM'").withColumn("c", F.concat_ws("|", "dataset", "metric")), "model", "c", "value", "path", scale=100.0)
    assert {r["model"]: r["qa|EM"] for r in out.collect()} == {"m0": 50.0, "m1": 25.0}
    assert report.concatenated([rows.select("model"), rows.select("metric")]).count() == 8


def test_scores_of_long_answers_take_no_square_of_them():
    """An answer of 200,000 words against an item of ten: the rows of the table are as long as the item (over a minute before)."""
    import time

    item = [f"w{k}" for k in range(10)]
    said = [f"v{k}" for k in range(200_000)]
    said[50_000:50_010] = item
    said[7], said[199_999] = "w3", "w9"
    began = time.process_time()
    assert scores.common_subsequence(item, said) == scores.common_subsequence(said, item) == 10
    assert scores.bleu(said, item, 4) == math.exp(1 - 200_000 / 10)
    assert math.isclose(scores.bleu(item, said, 2), math.sqrt(10 / 200_000 * 9 / 199_999))
    assert time.process_time() - began < 5


def test_decode_meets_a_wide_root_in_lots(spark, monkeypatch):
    """Prefixes with many edges are dealt out in lots (one task met all of the root's before), with the same facts; taken edges stay away, whether they are sent to all tasks or joined."""
    leaves = trie.maximal_leaves(spark.createDataFrame([([f"a{k}", f"b{k % 3}", "."],) for k in range(300)], "tokens array<string>"))
    states = spark.createDataFrame([(k, 3) for k in range(5)], "state int, n int")
    found = lambda: sorted((r["state"], r["ordinal"], tuple(r["tokens"]), r["status"]) for r in decode.constrained_decode(states, leaves, 20, seed=4).collect())
    want = found()
    monkeypatch.setattr(decode, "WIDE", 7)
    monkeypatch.setattr(decode, "FEW", 0)
    edge, wide = decode._in_lots(trie.edges(leaves, leaves=True))
    assert [r["lots"] for r in wide.collect()] == [43] and edge.groupBy("prefix", "lot").count().agg(F.max("count")).first()[0] < 25
    assert found() == want and len({x[:3] for x in want}) == 15 and {x[3] for x in want} == {"COMPLETE"}
