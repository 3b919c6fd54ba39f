import datetime as dt

from pyspark.sql import functions as F

from erashift.functions import ids, text, values


def one(spark, inputs, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_ids(spark):
    messy = ["123.0", "-5.00", "1.5", "", "nan", "None", "NaN", None]
    assert one(spark, messy, "string", ids.canonical_id) == ["123", "-5", "1.5", None, None, None, None, None]
    assert one(spark, messy, "string", ids.edge_id) == ["123", "-5", "1.5", None, None, None, "NaN", None]


def test_float_ids_keep_every_digit(spark):
    assert one(spark, [4.5e18, None, 12.0], "double", ids.float_id) == ["4500000000000000000", None, "12"]
    long = ["1234567890123456789", "7.0", "x"]
    assert one(spark, long, "string", ids.float_id) == ["1234567890123456789", "7", None]


def test_numbers(spark):
    given = ["1.5", " 7 ", "1e3", "abc", "", "NaN", "1d", None]
    assert one(spark, given, "string", values.numeric) == [1.5, 7.0, 1000.0, None, None, None, None, None]
    df = spark.createDataFrame([(float("nan"),), (2.0,), (None,)], "v double")
    assert [r[0] for r in df.select(values.number_column(df, "v")).collect()] == [None, 2.0, None]


def test_flags_and_labels(spark):
    assert one(spark, ["1", "True", " false", "0", "1.0", "", None], "string", values.flag) == [
        1, 1, 0, 0, None, None, None]
    assert one(spark, ["Bot ", "\thuman\n", "BOT", "spam", None], "string", values.label_code) == [1, 0, 1, None, None]
    assert one(spark, ["Bot", "Bot ", None, "human"], "string", values.is_bot_loose) == [1, 0, 0, 0]


def test_blank_text_counts_every_kind_of_white_space(spark):
    assert one(spark, ["  ", " ", "\t\n", "x", None], "string", values.has_text) == [0, 0, 0, 1, 0]


def test_times(spark):
    given = ["2020-01-02T03:04:05.000Z", "Wed Aug 27 13:08:45 +0000 2008", "x", None]
    got = one(spark, given, "string", lambda c: F.unix_micros(values.parse_time(c)))
    want = [dt.datetime(2020, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc), dt.datetime(2008, 8, 27, 13, 8, 45, tzinfo=dt.timezone.utc)]
    assert got == [int(w.timestamp() * 1e6) for w in want] + [None, None]
    strict = one(spark, given, "string", lambda c: values.parse_time(c, strict=True).isNotNull())
    assert strict == [True, False, False, False]
    assert one(spark, ["1183552203000L", "2020", None], "string", values.long_suffix_time) == [
        "2007-07-04 12:30:03+00:00", "2020", None]


def test_days_are_elapsed_time(spark):
    df = spark.sql("select timestamp'2020-01-03 00:00:00' as a, timestamp'2020-01-01 12:00:00' as b")
    assert df.select(values.whole_days_between(F.col("a"), F.col("b"))).first()[0] == 1


def test_clip_keeps_null(spark):
    assert one(spark, [-1.0, 3.0, None], "double", lambda c: values.clip_low(c, 0.0)) == [0.0, 3.0, None]


def test_references(spark):
    def refs(*kinds):
        return [(k, "1") for k in kinds]

    given = [None, [], refs("retweeted"), refs("replied_to"), refs("retweeted", "replied_to"), refs("quoted")]
    kind = "array<struct<type:string,id:string>>"
    assert one(spark, given, kind, text.v2_retweet_flag) == [0, 0, 1, 0, 1, 0]
    none = F.lit(None).cast("string")
    assert one(spark, given, kind, lambda c: text.v2_reply_flag(c, none)) == [0, 0, 0, 1, 1, 0]
    assert one(spark, given, kind, lambda c: text.v2_reply_flag(c, F.lit("9"))) == [1] * 6


def test_tweet_text(spark):
    assert one(spark, ["RT @a", "rt @a", None], "string", text.retweet_flag) == [1, 0, 0]
    assert one(spark, ["5", " 0 ", "", "nan", "None", None], "string", text.reply_flag) == [1, 0, 0, 0, 0, 0]
    assert one(spark, ["#a #b_1 #", None], "string", text.hashtags) == [2, 0]
    assert one(spark, ["@a,@b http://x https://y", None], "string", text.urls) == [2, 0]
