from datetime import date

import pytest

from countylens import catalog
from countylens.sources import readers, writers


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_state_dim(spark, tmp_path):
    path = write(tmp_path / "s.csv", ",State FIPS,Name\n0,0,Northeast Region\n1,12,Florida\n2,x,Bad\n")
    assert [tuple(r) for r in readers.read_state_dim(spark, path).collect()] == [(12, "Florida")]


def test_county_dim(spark, tmp_path):
    path = write(tmp_path / "c.csv", ",State FIPS,County FIPS,FIPS,State Name,Area Name\n"
                                     "0,1,1,1001,Alabama,Autauga County\n")
    df = readers.county_labels(readers.read_county_dim(spark, path))
    assert df.first() == (1, 1001, "Autauga County")


SIGNAL = (",FIPS,time_value,issue,value,State Name,Area Name\n"
          "0,1001,2020-11-01,2020-11-03,5.5,Alabama,A\n"
          "1,1001,2020-11-02,2020-11-03,6.5,Alabama,A\n"
          "2,1003,2020-11-02,2020-11-03,,Alabama,B\n"
          "3,1003,2020-11-01,2020-11-03,-1.0,Alabama,B\n"
          "4,1005,bad,2020-11-03,0.0,Alabama,\n")


def test_signal(spark, tmp_path):
    path = write(tmp_path / "x.csv", SIGNAL)
    daily = readers.read_signal(spark, path, "Daily x").collect()
    assert {(r.fips, r.time_value, r.value) for r in daily} == {
        (1001, date(2020, 11, 1), 5.5), (1001, date(2020, 11, 2), 6.5), (1005, None, 0.0)}
    newest = readers.read_signal(spark, path, "Cumulative x").collect()
    assert {(r.fips, r.value) for r in newest} == {(1001, 6.5), (1005, 0.0)}


def test_columns_go_by_name(spark, tmp_path):
    """A reordered file gives the same rows; a missing column is an error."""
    rows = [line.split(",") for line in SIGNAL.strip().split("\n")]
    moved = "\n".join(",".join([r[0], r[4], *r[1:4], *r[5:]]) for r in rows) + "\n"
    same = readers.read_signal(spark, write(tmp_path / "a.csv", SIGNAL), "Daily x")
    other = readers.read_signal(spark, write(tmp_path / "b.csv", moved), "Daily x")
    assert sorted(map(str, same.collect())) == sorted(map(str, other.collect())) and same.count() == 3
    cut = "\n".join(",".join(r[:4] + r[5:]) for r in rows) + "\n"
    with pytest.raises(ValueError, match="value"):
        readers.read_signal(spark, write(tmp_path / "c.csv", cut), "Daily x")


def test_files_of_a_folder_have_their_own_headers(spark, tmp_path):
    """Other columns, order, line ends, marks and packing; every file's rows by name."""
    import gzip

    write(tmp_path / "in" / "a.csv", SIGNAL)
    write(tmp_path / "in" / "b [x].csv", "value,extra,Area Name,FIPS,issue,time_value,State Name\n"
                                       "7.25,q,\"C, D\",2001,2020-11-03,2020-11-01,Alaska\n")
    (tmp_path / "in" / "c.csv").write_bytes(b"\xef\xbb\xbf" + SIGNAL.replace("1001", "3001").replace("\n", "\r\n").encode())
    (tmp_path / "in" / "d.csv.gz").write_bytes(gzip.compress(SIGNAL.replace("1001", "4001").encode()))
    write(tmp_path / "in" / "empty.csv", "")
    got = readers.read_signal(spark, str(tmp_path / "in"), "Daily x")
    assert {(r.fips, r.value, r.area_name) for r in got.collect()} >= {
        (1001, 5.5, "A"), (2001, 7.25, "C, D"), (3001, 5.5, "A"), (4001, 6.5, "A")}
    assert got.count() == 3 * 3 + 1
    assert got.filter("fips = 2001").first().time_value == date(2020, 11, 1)
    assert len(readers.layouts(spark, str(tmp_path / "in"), ["FIPS"])) == 2  # one scan for each
    both = [str(tmp_path / "in" / n) for n in ("a.csv", "d.csv.gz")]
    assert readers.read_signal(spark, both, "Daily x").count() == 6
    write(tmp_path / "in" / "e.csv", "FIPS,value\n1,2\n")
    with pytest.raises(ValueError, match="e.csv"):
        readers.read_signal(spark, str(tmp_path / "in"), "Daily x")
    with pytest.raises(ValueError, match="no file"):
        readers.read_signal(spark, write(tmp_path / "none.csv", ""), "Daily x")


def test_all_signals(spark, tmp_path):
    for s in catalog.SIGNALS:
        write(tmp_path / f"{s.file}_fips.csv", SIGNAL)
    rows = readers.read_signals(spark, str(tmp_path)).groupBy("signal").count().collect()
    counts = {r.signal: r["count"] for r in rows}
    assert len(counts) == 9
    assert {n for n, c in counts.items() if c == 2} == {s.name for s in catalog.SIGNALS
                                                         if s.is_cumulative}


def test_indicators(spark, tmp_path):
    for i in catalog.INDICATORS:
        names = list(i.measures.values())
        head = ",".join(["", "FIPS", "State Abrv", "Area Name", *names])
        write(tmp_path / f"{i.file}.csv",
              head + "\n0,1001,AL,A," + ",".join("1.5" for _ in names)
              + "\n1,1003,AL,B," + ",".join("NaN" for _ in names) + "\n")
    tables = readers.read_indicators(spark, str(tmp_path))
    assert list(tables) == [i.category for i in catalog.INDICATORS]
    assert catalog.measures(tables["Education"]) == list(
        catalog.indicator("Education").measures.values())
    long = readers.indicators_long(tables)
    assert long.count() == 20 and long.filter("measure_value is null").count() == 10


def test_raw_signal_with_more_columns(spark, tmp_path):
    path = write(tmp_path / "r.csv", ",geo_value,signal,time_value,issue,lag,value,stderr\n"
                                     "0,1001,a,2020-11-01,2020-11-03,2,5.5,\n")
    row = readers.read_signal_raw(spark, path).first()
    assert tuple(row) == (1001, date(2020, 11, 1), date(2020, 11, 3), 5.5)


def test_sheet_with_preamble(spark, tmp_path):
    path = write(tmp_path / "p.csv",
                 "Estimates,,,\nnote,,,\n,,,\n\"a, b\",,,\nFIPStxt,Stabr,Area_name,Other,"
                 "PCTPOVALL_2018,PCTPOV017_2018\n1000,AL,Alabama,9,16.8,24.0\n"
                 "1001.0,AL,\"Autauga, X\",9,13.8,\nfootnote,,,,,\n")
    df = readers.read_indicator_sheet(spark, path, "Poverty")
    assert df.columns[:3] == list(catalog.AREA_KEYS)
    assert [tuple(r) for r in df.collect()] == [
        (1000, "AL", "Alabama", 16.8, 24.0), (1001, "AL", "Autauga, X", 13.8, None)]
    with pytest.raises(ValueError, match="no columns"):
        readers.read_indicator_sheet(spark, path, "Education")


def test_tweet_text(spark, tmp_path):
    write(tmp_path / "WY.txt", "one\ntwo\n")
    write(tmp_path / "sample.txt", "three\n")
    df = readers.read_tweet_text(spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == {("WY", "one"), ("WY", "two"), (None, "three")}
    assert readers.read_tweet_text(spark, str(tmp_path), "WY").count() == 2


def test_tweet_ids_of_a_folder_only(spark, tmp_path):
    write(tmp_path / "a.txt", "1\n\n 2 \nx\n1\n")
    write(tmp_path / "geo" / "FL.txt", "7\n")
    assert sorted(r.id for r in readers.read_tweet_ids(spark, str(tmp_path)).collect()) == [1, 1, 2]
    assert readers.read_tweet_ids(spark, str(tmp_path / "geo")).first() == ("FL", 7)


def test_embeds_one_row_per_file(spark, tmp_path):
    for name, text in (("VI/a.html", "<p>\nx\n</p>\n"), ("VI/b.html", "<p>"), ("FL/c.html", "<p>")):
        write(tmp_path / name, text)
    rows = readers.read_embeds(spark, str(tmp_path)).collect()
    assert sorted(r.state for r in rows) == ["FL", "VI", "VI"]
    assert max(r.html for r in rows) == "<p>\n\nx\n\n</p>\n"
    assert readers.read_embeds(spark, str(tmp_path), "FL").count() == 1


def test_tweets_json(spark, tmp_path):
    path = write(tmp_path / "t.json",
                 '{"id": 5, "lang": "en", "place": {"country_code": "US", "place_type": "city", '
                 '"full_name": "Reno, NV"}, "full_text": "hi", "extra": 1}\n{"id": 6}\n')
    rows = readers.read_tweets_json(spark, path).orderBy("id").collect()
    assert rows[0].place.full_name == "Reno, NV" and rows[1].place is None


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_write_table(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a", 2), ("b", 1)], "k string, v long")
    for _ in range(2):
        writers.write_table(df, str(tmp_path / "t"), fmt, ("k",), ("v",))
    back = spark.read.schema("v long, k string").format(fmt).option("header", True).load(
        str(tmp_path / "t"))
    assert sorted((r.k, r.v) for r in back.collect()) == [("a", 2), ("b", 1)]
    assert (tmp_path / "t" / "k=a").is_dir()


def test_append_unseen_never_stores_twice(spark, tmp_path):
    path = str(tmp_path / "ids")
    first = spark.createDataFrame([("FL", 1), ("FL", 1), ("CA", 2)], "state string, id long")
    writers.append_unseen(first, None, path)
    more = spark.createDataFrame([("CA", 2), ("CA", 3)], "state string, id long")
    for _ in range(2):
        writers.append_unseen(more, spark.read.parquet(path), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_consolidated_files(spark, tmp_path):
    write(tmp_path / "in" / "New York.txt", "a\nb\n")
    write(tmp_path / "in" / "NY.txt", "c\n")
    lines = readers.read_filed_lines(spark, str(tmp_path / "in"))
    assert {r.state for r in lines.collect()} == {"New York", "NY"}
    writers.write_consolidated(lines, str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.state, r.text) for r in rows) == [("NY", "a"), ("NY", "b"), ("NY", "c")]


def test_catalogue(spark):
    signals = catalog.signals_table(spark)
    assert signals.count() == 10 and signals.filter("is_cumulative").count() == 2
    assert catalog.indicators_table(spark).count() == 10
    assert catalog.state_codes(spark).count() == 53
    assert catalog.signal("Daily Deaths per 100K people").source == "usa-facts"


def test_embeds_are_listed_by_folder(spark, tmp_path, plan):
    """Forty files in two folders: two paths to list; a file beside the folders is none of theirs."""
    for k in range(40):
        write(tmp_path / "in" / ("FL" if k % 2 else "a[b]") / f"{k}.html", f"<p>{k}</p>\n")
    write(tmp_path / "in" / "note.html", "no embed")
    found = readers.read_embeds(spark, str(tmp_path / "in"))
    assert "InMemoryFileIndex(2 paths)" in plan(found)
    rows = {(r.state, r.html.strip()) for r in found.collect()}
    assert rows == {("FL" if k % 2 else "a%5Bb%5D", f"<p>{k}</p>") for k in range(40)}
    assert readers.read_embeds(spark, str(tmp_path / "in"), "FL").count() == 20
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_embeds(spark, str(tmp_path / "none"))
