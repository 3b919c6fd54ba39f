import json

import pytest

from erashift import fixed_values as fv
from erashift.operators import cleaning
from erashift.plans.edge_sets import edges_for_dataset
from erashift.session import fresh_dir, shared_dir
from erashift.sources import readers, writers
from erashift.streaming import tweets as streaming


def test_users_csv_keeps_ids_as_text(spark, tmp_path):
    path = tmp_path / "users.csv"
    path.write_text('user_id,followers_count,description\n1234567890123456789,5,"two\nlines, ""quoted"""\n7.0,,\n')
    got = readers.read_users(spark, str(path)).collect()
    assert [r["user_id"] for r in got] == ["1234567890123456789", "7.0"]
    assert got[0]["description"] == 'two\nlines, "quoted"' and got[1]["description"] is None


def test_subset_csv_with_latin_1(spark, tmp_path):
    for subset, name in (("TFP", "é"), ("FSF", "x")):
        (tmp_path / f"{subset}.csv").mkdir()
        (tmp_path / f"{subset}.csv" / "users.csv").write_bytes(f"id,screen_name\n1,{name}\n".encode("latin-1"))
    df = readers.read_subset_csv(spark, str(tmp_path), {"TFP": "human", "FSF": "bot"}, "users.csv", "ISO-8859-1", ".csv")
    assert {(r["screen_name"], r["label"], r["subset"]) for r in df.collect()} == {("é", "human", "TFP"), ("x", "bot", "FSF")}


RECORDS = [
    {"ID": "1", "label": "1", "profile": {"id": "1", "screen_name": "a", "followers_count": "3 "}, "tweet": ["RT @x", "y"],
     "neighbor": {"follower": ["2", "3"], "following": ["2"]}},
    {"ID": "2", "label": "0", "profile": {"id": "2", "screen_name": "b"}, "tweet": None, "neighbor": None},
]


def test_nested_release(spark, tmp_path, rows):
    (tmp_path / "train.json").write_text(json.dumps(RECORDS))
    records = readers.read_nested_records(spark, str(tmp_path))
    users = cleaning.nested_users(records)
    assert [c for c in fv.USER_KEEP_COLS if c in users.columns] == fv.USER_KEEP_COLS
    assert rows(users, "user_id", "label", "subset") == [("1", "bot", "train"), ("2", "human", "train")]
    assert rows(cleaning.nested_tweets(records), "user_id", "text", "is_retweet", "is_reply") == [("1", "RT @x", 1, None), ("1", "y", 0, None)]
    assert rows(edges_for_dataset(spark, "twibot_2020", str(tmp_path)), "source_id", "target_id", "relation") == [
        ("1", "2", "following"), ("2", "1", "follower"), ("3", "1", "follower")]


def test_edge_directories_accept_three_layouts(spark, tmp_path, rows):
    files = {"A/friends.csv": "source_id,target_id\n1,2\n", "B/friends.csv": "user_id,Friend_ID,x\n3,4,z\n",
             "B/followers.csv": "user_id,follower_id\n5,6\n", "C/followers.csv": "p,q\n7,8\n", "C/users.csv": "id\n1\n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = rows(readers.read_edge_dirs(spark, str(tmp_path)), "source_id", "target_id", "relation", "subset")
    assert got == [("1", "2", "friend", "A"), ("3", "4", "friend", "B"), ("6", "5", "follower", "B"), ("7", "8", "follower", "C")]
    tweets = spark.createDataFrame([("1", "2"), ("1", "0"), ("9", "1.0")], "user_id string, in_reply_to_user_id string")
    combined = edges_for_dataset(spark, "cresci_2015", str(tmp_path), tweets=tweets)
    assert ("cresci_2015", "9", "1", "reply") in rows(combined) and combined.count() == 5


def test_edge_file_and_dispatch(spark, tmp_path, rows):
    (tmp_path / "edge.csv").write_text("source_id,relation,target_id\nu1,following,u2\nu3,followers,u4\nu1,likes,u5\n")
    users = spark.createDataFrame([("u1",), ("u4",)], "user_id string")
    got = rows(edges_for_dataset(spark, "twibot_2022", str(tmp_path / "edge.csv"), users=users), "source_id", "target_id", "relation")
    assert got == [("u1", "u2", "following"), ("u3", "u4", "followers")]
    reply = spark.createDataFrame([("1", "2")], "user_id string, in_reply_to_user_id string")
    assert rows(edges_for_dataset(spark, "cresci_2017", tweets=reply)) == [("cresci_2017", "1", "2", "reply")]
    with pytest.raises(ValueError):
        edges_for_dataset(spark, "elsewhere")


def test_two_column_files(spark, tmp_path, rows):
    (tmp_path / "label.csv").write_text("id,label\nu1,bot\n")
    assert rows(readers.read_pairs_csv(spark, str(tmp_path / "label.csv"), "label")) == [("u1", "bot")]


def test_frames_and_edge_cache(spark, tmp_path, rows):
    df = spark.createDataFrame([("e", "1", None), ("e", "2", 0.0)], "dataset string, user_id string, x double")
    path = writers.save_frame(df, str(tmp_path / "frame"))
    assert rows(writers.load_frame(spark, path), "dataset", "user_id", "x") == rows(df)
    writers.save_frame(df, str(tmp_path / "frame.csv"))
    assert writers.load_frame(spark, str(tmp_path / "frame.csv")).count() == 2
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("e", "a", "b", "follows")], "dataset string, source_id string, target_id string, relation string")

    for _ in range(2):
        assert writers.cached_edges(spark, str(tmp_path / "edges"), build).count() == 1
    assert built == [1]


def test_shared_folder_is_the_session_s(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_dir(spark, "x").startswith(shared_dir(spark))


SHARDS = [
    [{"id": "1", "author_id": "7", "text": "a", "referenced_tweets": [{"type": "retweeted", "id": "9"}]},
     {"id": "2", "author_id": "8", "text": "b"}],
    [{"id": "3", "author_id": "7", "in_reply_to_user_id": "5"}, {"id": "4", "author_id": "99", "text": "stranger"}],
    [{"id": "5", "author_id": "8", "referenced_tweets": []}],
]


def test_stream_equals_batch_and_resumes(spark, tmp_path, rows):
    shards = tmp_path / "shards"
    shards.mkdir()

    def put(i):
        (shards / f"tweet_{i}.json").write_text("\n".join(json.dumps(r) for r in SHARDS[i]))

    labels = spark.createDataFrame([("u7", "bot"), ("u8", "human")], "user_id string, label string")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    put(0), put(1)
    for _ in range(2):  # a second run finds nothing new
        streaming.stream_tweet_ingest(streaming.shard_stream(spark, str(shards)), labels, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    put(2)
    streaming.stream_tweet_ingest(streaming.shard_stream(spark, str(shards)), labels, out, state).awaitTermination()
    batch = cleaning.v2_tweets(readers.read_v2_tweets(spark, str(shards), multi_line=False), labels)
    assert rows(spark.read.parquet(out), *batch.columns) == rows(batch)

    clean = streaming.known_only(cleaning.v2_tweet_columns(streaming.shard_stream(spark, str(shards))), labels)
    totals = str(tmp_path / "totals")
    streaming.stream_running_totals(clean, totals, str(tmp_path / "state2")).awaitTermination()
    got = [(r["tweets"], r["retweets"], r["replies"]) for r in streaming.running_totals(spark, totals).orderBy("batch").collect()]
    assert len(got) == 3 and got[-1] == (4, 1, 1)


@pytest.mark.parametrize("limit", [0, 10])
def test_stream_join_with_many_labels(spark, tmp_path, rows, monkeypatch, limit):
    monkeypatch.setattr(streaming, "MAX_STATIC_IDS", limit)
    shards = tmp_path / "shards"
    shards.mkdir()
    for i, shard in enumerate(SHARDS):
        (shards / f"{i}.json").write_text("\n".join(json.dumps(r) for r in shard))
    labels = spark.createDataFrame([("u7", "bot"), ("u8", "human")], "user_id string, label string")
    out = str(tmp_path / "out")
    streaming.stream_tweet_ingest(
        streaming.shard_stream(spark, str(shards)), labels, out, str(tmp_path / "state")).awaitTermination()
    assert rows(spark.read.parquet(out), "tweet_id") == [("1",), ("2",), ("3",), ("5",)]


def test_v2_users(spark, rows):
    raw = spark.createDataFrame(
        [("u1", "n", (1.0, 2.0, 3.0, 4.0), "http://x/default_profile_1.png"), ("u2", "m", None, None), ("u3", "o", None, None)],
        "id string, username string, public_metrics struct<followers_count:double,following_count:double,tweet_count:double,listed_count:double>, profile_image_url string",
    ).selectExpr("*", "cast(null as string) created_at", "'true' verified", "'d' description", "cast(null as string) location")
    labels = spark.createDataFrame([("u1", "bot"), ("u2", "human")], "user_id string, label string")
    splits = spark.createDataFrame([("u1", "train")], "user_id string, subset string")
    users = cleaning.v2_users(raw, labels, splits)
    assert users.columns == fv.USER_KEEP_COLS
    assert rows(users, "user_id", "label", "subset", "friends_count", "default_profile_image") == [
        ("u1", "bot", "train", 2.0, 1), ("u2", "human", None, None, 0)]
