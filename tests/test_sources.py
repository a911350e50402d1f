import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidewatch.operators import clean
from tidewatch.sources import files, ledger


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def archive_lines():
    ok = "a text that is long enough"
    recs = [
        {"id": "a1", "created_utc": 1546300800, "selftext": ok, "subreddit": "Depression", "author": "u1", "is_self": True},
        {"id": "a2", "created_utc": 1546300801, "selftext": "[deleted]", "subreddit": "depression", "author": "u2", "is_self": True},
        {"id": "a3", "created_utc": 1546300802, "selftext": ok, "subreddit": "depression", "author": "u3", "is_self": False},
    ]
    lines = [json.dumps(r) for r in recs] + ["{broken json"]
    lines.append(json.dumps({"id": "a5", "created_utc": "1546300803", "selftext": ok, "subreddit": "depression", "author": "[deleted]", "is_self": True}))
    return "\n".join(lines) + "\n"


def test_archive_scan_and_counters(spark, tmp_path):
    write(f"{tmp_path}/in/arctic_shift_depression_201805_201810.jsonl", archive_lines())
    ruled = files.read_archive(spark, f"{tmp_path}/in")
    posts = files.archive_posts(ruled)
    assert rows(posts, "post_id", "author", "community") == [("a1", "u1", "depression"), ("a5", "", "depression")]
    c = files.archive_counts(ruled).first().asDict()
    assert c == {"file": "arctic_shift_depression_201805_201810.jsonl", "parsed": 4, "kept": 2, "skipped_json": 1, "skipped_non_self": 1,
                 "skipped_body": 1, "skipped_community": 0}


def test_archive_other_community_is_skipped(spark, tmp_path):
    write(f"{tmp_path}/in/x.jsonl", archive_lines())
    c = files.archive_counts(files.read_archive(spark, f"{tmp_path}/in", "anxiety")).first()
    assert (c["kept"], c["skipped_community"]) == (0, 2)


def test_archive_names(spark):
    df = spark.createDataFrame([("arctic_shift_Depression_201805_201810.jsonl",), ("wrong_name.jsonl",)], "f string")
    assert [r[0] for r in df.select(files.archive_community(F.col("f"))).collect()] == ["depression", None]


def test_csv_with_extra_columns(spark, tmp_path):
    write(f"{tmp_path}/depression_2019_features_x.csv",
          "subreddit,post,date,author_hash,tfidf_fake,liwc_fake\ndepression,hello world,2019-01-01T00:00:00Z,aaa,0.1,0.2\nanxiety,other,2019-01-01T00:00:00Z,bbb,0.1,0.2\n")
    posts = files.load_community(files.read_files(spark, str(tmp_path)), "depression")
    assert posts.columns == ["post_id", "created_utc", "selftext", "community", "author", "data_source", "created_utc_dt"]
    r = posts.first()
    assert posts.count() == 1 and r["created_utc"] == 1546300800 and r["post_id"].startswith("hash_")


def test_date_filter_keeps_range(spark, tmp_path):
    write(f"{tmp_path}/lonely_a.csv", "subreddit,post,date,post_id\nlonely,old,2019-01-01,1\nlonely,new,2020-06-01,2\n")
    posts = files.load_community(files.read_files(spark, str(tmp_path)), "lonely", "2020-01-01", "2020-12-31")
    assert [r["selftext"] for r in posts.collect()] == ["new"]


@pytest.mark.parametrize("body", ['[\n {"subreddit": "lonely", "body": "one text", "created": 1546300800, "id": "7"},\n {"subreddit": "x", "body": "b", "created": 1, "id": "8"}\n]',
                                  '{"subreddit": "lonely", "body": "one text", "created": 1546300800, "id": "7"}\n'])
def test_json_files(spark, tmp_path, body):
    write(f"{tmp_path}/lonely_a.json", body)
    write(f"{tmp_path}/sub/lonely_b.jsonl", '{"subreddit": "Lonely", "body": "two text", "created": 1546300801, "id": "9"}\n')
    posts = files.load_community(files.read_files(spark, str(tmp_path)), "lonely")
    assert rows(posts, "post_id", "selftext", "created_utc") == [("7", "one text", 1546300800), ("9", "two text", 1546300801)]


def test_every_file_is_read_by_its_own_layout(spark, tmp_path):
    write(f"{tmp_path}/a.csv", "date,subreddit,post,author,id\n2020-01-01,lonely,first text,u1,p1\n")
    write(f"{tmp_path}/b.csv", "id,author,body,created_utc,subreddit\np2,u2,\"second\ntext\",1577836800,lonely\n")
    write(f"{tmp_path}/c.json", '{"subreddit": "lonely", "body": "third", "created": 1577836800, "id": "p3"}\n{"subreddit": "lonely", "body": "fourth", "created": 1577836800, "id": "p4"}\n')
    write(f"{tmp_path}/d.json", '\n[\n {"subreddit": "lonely", "body": "fifth", "created": 1577836800, "id": "p5"},\n {"subreddit": "lonely", "body": "sixth", "created": 1577836800, "id": "p6"}\n]')
    spark.createDataFrame([("lonely", "seventh", 1577836800, "p7")], "community string, selftext string, created_utc long, post_id string").write.parquet(f"{tmp_path}/e.parquet")
    spark.createDataFrame([(1577836800, "eighth", 8, "lonely")], "timestamp long, text string, id int, subreddit string").write.parquet(f"{tmp_path}/f.parquet")
    write(f"{tmp_path}/g.csv", "")
    write(f"{tmp_path}/h.parquet", "not parquet")
    frames = files.read_files(spark, str(tmp_path))
    posts = files.load_community(frames, "lonely")
    assert rows(posts, "post_id", "selftext", "created_utc") == sorted(
        [(i, t, 1577836800) for i, t in zip(["p1", "p2", "p3", "p4", "p5", "p6", "p7", "8"], ["first text", "second\ntext", "third", "fourth", "fifth", "sixth", "seventh", "eighth"])], key=repr)
    status = {r.file: (r.rows, r.status) for r in files.file_status(spark, str(tmp_path), frames).collect() if not r.file.startswith("part-")}
    assert status == {"a.csv": (1, "read"), "b.csv": (1, "read"), "c.json": (2, "read"), "d.json": (2, "read"), "h.parquet": (0, "skipped")}


def test_manifest_streams_files(spark, tmp_path, monkeypatch):
    import hashlib

    monkeypatch.setattr(ledger, "HASH_BYTES", 7)
    p = write(f"{tmp_path}/a b%20é.txt", "some text that takes several pieces")
    got = ledger.file_manifest(spark, str(tmp_path), "*.txt").collect()
    assert [(r.size_bytes, r.sha256) for r in got] == [(35, hashlib.sha256(open(p, "rb").read()).hexdigest())]


def test_file_selection(spark):
    names = ["lonely_2019_features_tfidf.csv", "lonely_2021_features_tfidf.csv", "lonely_2019_plain.csv", "anxiety_2019_features_x.csv"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    kept = df.where(files.selected_files(F.col("f"), "Lonely", ["2018", "2019", "pre"])).collect()
    assert [r[0] for r in kept] == [names[0]]


def test_dump_aliases_and_errors(spark, tmp_path):
    p = write(f"{tmp_path}/d.csv", "id,body,created,ups\n1,text one,1546300800,5\n2,text two,never,6\n")
    d = files.read_dump(spark, p, "lonely")
    assert rows(d, "post_id", "selftext", "score", "community") == [("1", "text one", "5", "lonely")]
    bad = write(f"{tmp_path}/bad.csv", "id,title\n1,x\n")
    with pytest.raises(ValueError, match="created_utc"):
        files.read_dump(spark, bad)


def test_store_round_trip_and_pruning(spark, tmp_path):
    posts = spark.createDataFrame([("1", 10, "x", "a"), ("2", 20, "y", "b")], "post_id string, created_utc long, selftext string, community string")
    files.save_posts(posts, f"{tmp_path}/raw")
    back = files.load_posts(spark, f"{tmp_path}/raw", ["a"])
    assert rows(back.select(*posts.columns)) == [("1", 10, "x", "a")]
    assert "PartitionFilters: [isnotnull(community" in back._jdf.queryExecution().toString()
    with pytest.raises(FileNotFoundError):
        files.load_posts(spark, f"{tmp_path}/raw", ["zzz"])
    assert files.load_artifact(spark, f"{tmp_path}/absent") is None


def test_contracts(spark):
    with pytest.raises(ValueError, match="missing required"):
        clean.validate(spark.createDataFrame([("1",)], "post_id string"), "raw")
    with pytest.raises(ValueError, match="at least one feature"):
        clean.validate(spark.createDataFrame([("a", 2024, 1, None)], "community string, iso_year int, iso_week int, week_start date"), "features")
    bad = spark.createDataFrame([(" ", "x", "t", "a")], "post_id string, created_utc string, selftext string, community string")
    with pytest.raises(ValueError, match="blank_post_id"):
        clean.validate(bad, "raw")


def test_manifest_detects_change(spark, tmp_path):
    p = write(f"{tmp_path}/in/a.txt", "one")
    write(f"{tmp_path}/in/b.txt", "two")
    ledger.rewrite(ledger.file_manifest(spark, f"{tmp_path}/in"), f"{tmp_path}/manifest")
    known = ledger.load_table(spark, f"{tmp_path}/manifest")
    assert ledger.changed_files(ledger.file_manifest(spark, f"{tmp_path}/in"), known).count() == 0
    write(p, "changed")
    assert ledger.changed_files(ledger.file_manifest(spark, f"{tmp_path}/in"), known).count() == 1


def test_fingerprint_follows_files_and_config(spark, tmp_path):
    write(f"{tmp_path}/in/a.txt", "one")
    m = ledger.file_manifest(spark, f"{tmp_path}/in")
    first = ledger.fingerprint(m, "{}")
    ledger.rewrite(first, f"{tmp_path}/fp")
    assert ledger.is_current(spark, f"{tmp_path}/fp", ledger.fingerprint(ledger.file_manifest(spark, f"{tmp_path}/in"), "{}"))
    assert not ledger.is_current(spark, f"{tmp_path}/fp", ledger.fingerprint(m, '{"a":1}'))
    write(f"{tmp_path}/in/b.txt", "two")
    assert not ledger.is_current(spark, f"{tmp_path}/fp", ledger.fingerprint(ledger.file_manifest(spark, f"{tmp_path}/in"), "{}"))


def test_upsert_keeps_one_row_and_latest(spark, tmp_path):
    new = lambda ts: spark.createDataFrame([("a", "2024-01-01", "s", ts)], "community string, week string, source string, at string")
    keys = ["community", "week", "source"]
    ledger.rewrite(ledger.upsert(None, new("1"), keys, "at"), f"{tmp_path}/p")
    ledger.rewrite(ledger.upsert(ledger.load_table(spark, f"{tmp_path}/p"), new("2"), keys, "at"), f"{tmp_path}/p")
    assert rows(ledger.load_table(spark, f"{tmp_path}/p")) == [("a", "2024-01-01", "s", "2")]


def test_lexicon_and_legacy_briefs(spark, tmp_path):
    write(f"{tmp_path}/lex/hopelessness.txt", "Hopeless\n\n  No Point  \n")
    assert files.lexicon_terms(files.read_lexicon(spark, f"{tmp_path}/lex")) == {"hopelessness": ["hopeless", "no point"]}
    write(f"{tmp_path}/rep/lonely/weekly_briefs/2024-W03.txt", "A brief.\n")
    assert rows(files.read_legacy_briefs(spark, f"{tmp_path}/rep")) == [("lonely", "2024-W03", "A brief.")]


def test_prediction_log_skips_malformed(spark, tmp_path):
    write(f"{tmp_path}/log.jsonl", '{"community":"a","tabular_prob":0.6,"has_drift":true}\nnot json\n')
    assert rows(files.read_prediction_log(spark, f"{tmp_path}/log.jsonl"), "community", "tabular_prob") == [("a", 0.6)]


def test_report_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-W01", "text")], "community string, week_key string, text string")
    files.write_csv(df, f"{tmp_path}/c")
    files.write_json(df, f"{tmp_path}/j")
    files.write_briefs_text(df, f"{tmp_path}/t")
    ledger.append_json(df, f"{tmp_path}/log")
    ledger.append_json(df, f"{tmp_path}/log")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 1
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    assert spark.read.text(f"{tmp_path}/t").first()["value"] == "text"


def test_export_latest(spark, tmp_path):
    df = spark.range(30).select(F.col("id").alias("timestamp"))
    ledger.export_latest(df, f"{tmp_path}/x", 10)
    assert sorted(r[0] for r in spark.read.json(f"{tmp_path}/x").collect()) == list(range(20, 30))


def test_rewrite_survives_a_lost_writer(spark, tmp_path):
    t = f"{tmp_path}/t"
    for i in range(3):
        old = ledger.load_table(spark, t)
        new = spark.createDataFrame([(i,)], "x int")
        ledger.rewrite(new if old is None else old.unionByName(new), t)
    assert rows(ledger.load_table(spark, t)) == [(0,), (1,), (2,)]
    fail = ledger.load_table(spark, t).select(F.raise_error(F.lit("executor lost")).cast("int").alias("x"))
    with pytest.raises(Exception, match="executor lost"):
        ledger.rewrite(fail, t)
    assert rows(ledger.load_table(spark, t)) == [(0,), (1,), (2,)]


def test_recent_falls_back_to_export(spark, tmp_path):
    df = spark.range(5).select(F.col("id").alias("timestamp"))
    assert ledger.recent_or(spark, f"{tmp_path}/log", f"{tmp_path}/json") is None
    df.write.json(f"{tmp_path}/json")
    assert [r[0] for r in ledger.recent_or(spark, f"{tmp_path}/log", f"{tmp_path}/json", 2).collect()] == [4, 3]
    ledger.append(df.where("timestamp < 2"), f"{tmp_path}/log")
    assert ledger.recent_or(spark, f"{tmp_path}/log", f"{tmp_path}/json").count() == 2


def test_inserted_rows(spark):
    before = spark.createDataFrame([("a",), ("a",)], "community string")
    after = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "community string")
    assert rows(ledger.inserted_rows(before, after)) == [("a", 1), ("b", 1)]


def test_nested_results(spark, tmp_path):
    write(f"{tmp_path}/r.json", json.dumps({
        "lonely": {"xgb": {"recall": 0.5, "per_week": {"predictions": [float("nan"), 1.0], "probabilities": [float("nan"), 0.7], "actuals": [0.0, 1.0]}},
                   "lstm": {"recall": 0.25, "per_week": {"predictions": [2.0], "probabilities": [0.4], "actuals": [3.0]}}},
        "anxiety": {"xgb": {"error": "Too few valid predictions"}}}))
    res = files.read_results(spark, f"{tmp_path}/r.json")
    assert rows(res, "community", "model", "recall") == [("anxiety", "tabular", None), ("lonely", "sequence", 0.25), ("lonely", "tabular", 0.5)]
    long = files.result_series(res)
    assert rows(long) == [("lonely", "sequence", 0, 2.0, 0.4, 3.0), ("lonely", "tabular", 0, None, None, 0.0), ("lonely", "tabular", 1, 1.0, 0.7, 1.0)]


def test_status_tells_equal_names_apart(spark, tmp_path):
    for folder, text in (("a", "id,body\n1,x\n2,y\n"), ("b", "id,body\n3,z\n"), ("c d", "id\n"), ("e", "id,body\n4,ä\n5,b\n6,c\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "posts.csv").write_text(text)
    frames = files.read_files(spark, str(tmp_path))
    got = {r.path.split("/")[-2]: (r.file, r.rows, r.status) for r in files.file_status(spark, str(tmp_path), frames).collect()}
    assert got == {"a": ("posts.csv", 2, "read"), "b": ("posts.csv", 1, "read"), "c d": ("posts.csv", 0, "skipped"), "e": ("posts.csv", 3, "read")}


def test_manifest_status_writes_no_file_of_the_whole_input(spark, tmp_path, monkeypatch):
    from tidewatch.plans import checks_files

    rows_in = [(k, "text %d " % k * 20, "en", None if k % 7 else "web", 160) for k in range(600)] + [(None, None, None, None, None)] * 2
    spark.createDataFrame(rows_in, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    size = sum(os.path.getsize(f"{tmp_path}/documents.parquet/{f}") for f in os.listdir(f"{tmp_path}/documents.parquet") if f.endswith(".parquet"))
    monkeypatch.setattr(checks_files, "work_folder", lambda _: f"{tmp_path}/work")
    monkeypatch.setattr(checks_files, "FILE_BYTES", size // 8, raising=False)
    assert rows(checks_files.manifest_status(spark, str(tmp_path))) == [(0, 1, 64)]
    kept = spark.read.parquet(f"{tmp_path}/work/files")
    copies = kept.groupBy(*kept.columns).count()
    assert {(r.doc_id, r["count"]) for r in copies.collect()} == {(k, 2) for k in range(600)} | {(None, 4)}
    late = max((f for f in os.scandir(f"{tmp_path}/work/files") if f.name.endswith(".parquet")), key=lambda f: f.stat().st_mtime_ns)
    assert 0 < spark.read.parquet(late.path).count() < 200
