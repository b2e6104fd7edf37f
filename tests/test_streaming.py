import json

from loomspan.streaming.incremental import add_to_index, append_new, rebuild, shards


def test_appended_once_over_batches_and_replays(spark, tmp_path):
    doc = lambda i, t: json.dumps({"id": i, "text": t, "evidence_type": "hadith", "citation": {"source_id": "k"}})
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("# c\n" + doc("1", "one rope") + "\n" + doc("1", "one again") + "\n" + doc("", "named by content"))
    run = lambda: append_new(shards(spark, str(tmp_path / "in")), str(tmp_path / "corpus"), str(tmp_path / "ck")).awaitTermination()
    run()
    (tmp_path / "in/b.jsonl").write_text(doc("1", "late") + "\n" + doc("2", "two ropes"))
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "corpus")).collect())[:2] == ["1", "2"]
    assert spark.read.parquet(str(tmp_path / "corpus")).count() == 3
    append_new(shards(spark, str(tmp_path / "in")), str(tmp_path / "corpus"), str(tmp_path / "other")).awaitTermination()
    index = rebuild(spark, str(tmp_path / "corpus"), str(tmp_path / "index"))
    assert index.n == 3 and index.vectors.select("id").distinct().count() == 3


def line(i, t):
    return json.dumps({"id": i, "text": t, "evidence_type": "hadith", "citation": {"source_id": "k", "surah": 3}, "tags": ["a", "b"]})


def test_a_replayed_batch_is_there_once_and_the_index_grows(spark, tmp_path):
    """A batch whose commit is lost runs again: its folder is written over. Another batch doesn't read the corpus."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join(line(str(i), f"rope {i} holds") for i in range(30)) + "\n" + line("3", "another"))
    run = lambda: append_new(shards(spark, str(tmp_path / "in")), str(tmp_path / "corpus"), str(tmp_path / "ck")).awaitTermination()
    run()
    first = sorted(map(tuple, spark.read.parquet(str(tmp_path / "corpus")).select("id", "text", "citation.surah", "tags").collect()))
    assert len(first) == 30 and first[0] == ("0", "rope 0 holds", 3, ["a", "b"])
    index = rebuild(spark, str(tmp_path / "corpus"), str(tmp_path / "index"))
    (tmp_path / "ck/commits/0").unlink()
    for crc in (tmp_path / "ck/commits").glob(".0.crc"):
        crc.unlink()
    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "corpus")).select("id", "text", "citation.surah", "tags").collect())) == first
    (tmp_path / "in/b.jsonl").write_text(line("7", "late") + "\n" + line("new", "fresh rope"))
    run()
    got = {r.id: r.text for r in spark.read.parquet(str(tmp_path / "corpus")).collect()}
    assert len(got) == 31 and got["new"] == "fresh rope" and got["7"] == "rope 7 holds"
    assert spark.read.parquet(str(tmp_path / "corpus")).count() == 31
    more = add_to_index(spark, str(tmp_path / "corpus"), str(tmp_path / "index"), 0.9)
    assert more.n == 31 and len(more.segments) == 2 and more._read("vectors", [more.segments[1][0]]).count() == 1 and index.n == 30
