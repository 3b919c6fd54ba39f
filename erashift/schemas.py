"""Explicit schemas. IDs are strings everywhere and nothing is inferred."""

from pyspark.sql import types as T

_S, _D = T.StringType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


# One CSV account per row; counts stay text until numeric() has looked at them.
USERS_CSV = _struct(
    user_id=_S, screen_name=_S, label=_S, subset=_S,
    followers_count=_S, friends_count=_S, statuses_count=_S, listed_count=_S,
    created_at=_S, verified=_S, description=_S, location=_S,
    default_profile_image=_S, source=_S,
)

TWEETS_CSV = _struct(
    tweet_id=_S, user_id=_S, text=_S, created_at=_S, in_reply_to_user_id=_S,
    is_retweet=_S, is_reply=_S,
)

PROFILE = _struct(
    id=_S, screen_name=_S, followers_count=_S, friends_count=_S, statuses_count=_S,
    listed_count=_S, created_at=_S, verified=_S, description=_S, location=_S,
    default_profile_image=_S,
)

NEIGHBOR = _struct(follower=T.ArrayType(_S), following=T.ArrayType(_S))

# Nested release: one record per account with its texts and neighbours inside.
NESTED_RECORD = _struct(
    ID=_S, label=_S, profile=PROFILE, tweet=T.ArrayType(_S), neighbor=NEIGHBOR,
)

PUBLIC_METRICS = _struct(
    followers_count=_D, following_count=_D, tweet_count=_D, listed_count=_D,
)

V2_USER = _struct(
    id=_S, username=_S, public_metrics=PUBLIC_METRICS, created_at=_S, verified=_S,
    description=_S, location=_S, profile_image_url=_S,
)

V2_TWEET = _struct(
    id=_S, author_id=_S, text=_S, created_at=_S, in_reply_to_user_id=_S,
    referenced_tweets=T.ArrayType(_struct(type=_S, id=_S)),
)

EDGES = _struct(dataset=_S, source_id=_S, target_id=_S, relation=_S)
