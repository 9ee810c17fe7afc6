import pytest

from countylens.operators import words
from countylens.sources import readers
from countylens.streaming import word_counts

from test_sources import write


def table(df):
    return {(r.state, r.word): r["count"] for r in df.collect()}


def test_counts_grow_with_the_folder(spark, tmp_path):
    texts, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run():
        word_counts.start(word_counts.read_stream(spark, texts), out, checkpoint).awaitTermination()

    write(tmp_path / "in" / "FL.txt", "stay home\nhome\n")
    run()
    assert table(word_counts.counts_so_far(spark, out)) == {("FL", "stay"): 1, ("FL", "home"): 2}
    run()
    write(tmp_path / "in" / "CA.txt", "stay https://a.com safe\n")
    run()
    stored = table(word_counts.counts_so_far(spark, out))
    batch = readers.read_tweet_text(spark, texts)
    assert stored == table(words.word_counts(words.words(batch, keep=("state",)), ("state",)))
    assert stored["CA", "safe"] == 1


def test_repeated_batch_is_counted_once(spark, tmp_path):
    """A batch that is run again, as after a lost driver, replaces what it wrote."""
    texts, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    write(tmp_path / "in" / "FL.txt", "stay home\n")
    for attempt in range(2):
        word_counts.start(word_counts.read_stream(spark, texts), out, checkpoint).awaitTermination()
        for done in (tmp_path / "checkpoint" / "commits").glob("*0*"):
            done.unlink()  # as if the driver had been lost before it noted the batch as done
    assert table(word_counts.counts_so_far(spark, out)) == {("FL", "stay"): 1, ("FL", "home"): 1}
    word_counts.compact(spark, out, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all")).count() == 2


def batches(spark, out, first, behind):
    """Batches as the query would write them: one word of their own, one of all."""
    for n in range(first, behind):
        rows = [("FL", f"word{n}", 1), ("FL", "all", 2)]
        spark.createDataFrame(rows, word_counts.COUNTS).coalesce(1).write.mode("overwrite").parquet(
            f"{out}/query=q/batch={n}")
        word_counts.merge(spark, out, "q", n + 1)


def whole(n):
    return {("FL", f"word{k}"): 1 for k in range(n)} | {("FL", "all"): 2 * n}


def test_merges_hold_each_batch_once(spark, tmp_path, monkeypatch):
    """With three to a merge: levels of 3, 9 and 27 batches, few folders to read, all counts right."""
    monkeypatch.setattr(word_counts, "FOLD", 3)
    out = str(tmp_path)
    batches(spark, out, 0, 32)
    assert [u[:2] for u in word_counts._live(spark, out, "q")] == [(0, 27), (27, 30), (30, 31), (31, 32)]
    assert table(word_counts.counts_so_far(spark, out)) == whole(32)
    batches(spark, out, 4, 5)  # a batch that is run again after it was merged
    assert table(word_counts.counts_so_far(spark, out)) == whole(32)
    word_counts.clean(spark, out)
    assert sorted(p.name for p in (tmp_path / "query=q").glob("batch=*")) == ["batch=30", "batch=31"]
    assert len([p for p in (tmp_path / "query=q" / "merged").iterdir() if p.is_dir()]) == 2
    batches(spark, out, 32, 36)
    assert table(word_counts.counts_so_far(spark, out)) == whole(36)
    assert len(word_counts.counts_so_far(spark, out).inputFiles()) < 10


def test_merge_cut_short_before_its_record(spark, tmp_path, monkeypatch):
    """The folder of a merge without a record is not read; the next batch merges again."""
    monkeypatch.setattr(word_counts, "FOLD", 3)
    out = str(tmp_path)
    batches(spark, out, 0, 2)
    put = word_counts.storage.put_record
    monkeypatch.setattr(word_counts.storage, "put_record", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        batches(spark, out, 2, 3)
    monkeypatch.setattr(word_counts.storage, "put_record", put)
    assert len(word_counts._live(spark, out, "q")) == 3
    assert table(word_counts.counts_so_far(spark, out)) == whole(3)
    batches(spark, out, 3, 4)
    assert [u[:2] for u in word_counts._live(spark, out, "q")] == [(0, 3), (3, 4)]
    assert table(word_counts.counts_so_far(spark, out)) == whole(4)
    word_counts.clean(spark, out)
    assert len([p for p in (tmp_path / "query=q" / "merged").iterdir() if p.is_dir()]) == 1
    assert table(word_counts.counts_so_far(spark, out)) == whole(4)


def test_a_thousand_batches_are_one_folder(spark, tmp_path):
    """Of the records of a thousand and three batches, four folders are live."""
    home = tmp_path / "query=q"
    for n in range(1003):
        (home / f"batch={n}").mkdir(parents=True)
    (home / "merged").mkdir()
    for size in (10, 100, 1000):
        for first in range(0, 1000, size):
            (home / "merged" / f"{first}-{first + size}.json").write_text('{"folder": "m%d-%d"}' % (size, first))
    live = word_counts._live(spark, str(tmp_path), "q")
    assert [u[:2] for u in live] == [(0, 1000), (1000, 1001), (1001, 1002), (1002, 1003)]
    assert live[0][2].endswith("m1000-0")


def test_nothing_counted(spark, tmp_path):
    assert word_counts.counts_so_far(spark, str(tmp_path / "none")).count() == 0


def test_other_checkpoint_is_refused(spark, tmp_path):
    """A query that would count all files anew does not touch another's counts."""
    texts, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(tmp_path / "in" / "FL.txt", "stay home\n")
    word_counts.start(word_counts.read_stream(spark, texts), out,
                      str(tmp_path / "a")).awaitTermination()
    with pytest.raises(Exception, match="another query"):
        word_counts.start(word_counts.read_stream(spark, texts), out,
                          str(tmp_path / "b")).awaitTermination()
    assert table(word_counts.counts_so_far(spark, out)) == {("FL", "stay"): 1, ("FL", "home"): 1}


def test_running_counts(spark, tmp_path):
    write(tmp_path / "in" / "FL.txt", "stay home home\n")
    counts = word_counts.running_counts(word_counts.read_stream(spark, str(tmp_path / "in")))
    query = (counts.writeStream.outputMode("complete").format("memory").queryName("running")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert table(spark.table("running")) == {("FL", "stay"): 1, ("FL", "home"): 2}


def test_running_counts_as_a_table(spark, tmp_path):
    """Each batch's counts are whole, the newest are read, state lies in files of RocksDB, settings stay."""
    texts, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    assert word_counts.running_so_far(spark, out).count() == 0
    for k, (state, text) in enumerate([("FL", "stay home home"), ("CA", "stay safe"), ("NY", "stay home")]):
        write(tmp_path / "in" / f"{state}.txt", text + "\n")
        word_counts.start_running(word_counts.read_stream(spark, texts), out, checkpoint).awaitTermination()
        assert table(word_counts.running_so_far(spark, out))[state, "stay"] == 1
    assert table(word_counts.running_so_far(spark, out)) == {
        ("FL", "stay"): 1, ("FL", "home"): 2, ("CA", "stay"): 1, ("CA", "safe"): 1, ("NY", "stay"): 1, ("NY", "home"): 1}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["batch=1", "batch=2"]
    assert list((tmp_path / "checkpoint" / "state").rglob("*.zip")) and spark.conf.get(provider, None) == before


def test_running_query_keeps_counts_off_the_driver(spark, tmp_path, plan):
    from checks.queries import QUERIES
    from checks.tables import Data

    spark.createDataFrame([(0, "stay home", "src1"), (7, "home home", "src1"), (14, None, "src2")],
                          "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["running_word_counts"](Data(spark, str(tmp_path)))
    assert "LocalTableScan" not in plan(found)
    rows = {r.word: r["count"] for r in found.collect()}
    assert rows["home"] == 3 and rows["stay"] == 1
