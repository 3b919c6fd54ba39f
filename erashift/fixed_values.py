"""Fixed values.

Everything in this file is a value that must be exactly this for results to
be right: column names, token lists, patterns, thresholds, hyper-parameters
and message texts. No logic lives here.
"""

# Columns.
META_COLS = ["dataset", "user_id", "label", "subset", "source"]

ACCOUNT_COLS = [
    "followers_count",
    "friends_count",
    "statuses_count",
    "listed_count",
    "log1p_followers",
    "log1p_friends",
    "log1p_statuses",
    "log1p_listed",
    "followers_per_day",
    "friends_per_day",
    "statuses_per_day",
    "listed_per_day",
    "account_age_days",
    "ff_ratio",
    "has_bio",
    "has_location",
    "has_default_pic",
    "verified",
]

TWEET_COLS = [
    "tweet_count_actual",
    "log1p_tweet_count",
    "tweets_per_day",
    "tweet_active_days",
    "avg_text_length",
    "retweet_ratio",
    "avg_hashtags",
    "avg_mentions",
    "avg_urls",
    "reply_ratio",
    "has_tweet_data",
]

ROUND1_COLS = ACCOUNT_COLS + TWEET_COLS

GRAPH_COLS = [
    "graph_in_degree",
    "graph_out_degree",
    "graph_degree_total",
    "graph_ff_ratio",
    "graph_reciprocity_count",
    "graph_reciprocity_ratio",
    "graph_pagerank",
    "graph_pagerank_sampled",
    "graph_component_size",
    "graph_neighbor_avg_in_degree",
    "graph_neighbor_avg_out_degree",
    "graph_neighbor_avg_degree_total",
    "graph_neighbor_avg_ff_ratio",
    "graph_neighbor_std_degree_total",
    "graph_ego_node_count",
    "graph_ego_edge_count",
    "graph_ego_density",
]

# Graph columns where a missing row means a measured zero.
GRAPH_ZERO_COLS = [
    "graph_in_degree",
    "graph_out_degree",
    "graph_degree_total",
    "graph_ff_ratio",
    "graph_reciprocity_count",
    "graph_reciprocity_ratio",
    "graph_component_size",
]

# A user with zero in all of these is isolated.
ISOLATION_COLS = [
    "graph_in_degree",
    "graph_out_degree",
    "graph_degree_total",
    "graph_reciprocity_count",
]

COUNT_COLS = ["followers_count", "friends_count", "statuses_count", "listed_count"]

USER_KEEP_COLS = [
    "user_id",
    "screen_name",
    "label",
    "subset",
    "followers_count",
    "friends_count",
    "statuses_count",
    "listed_count",
    "created_at",
    "verified",
    "description",
    "location",
    "default_profile_image",
]

TWEET_KEEP_COLS = [
    "tweet_id",
    "user_id",
    "text",
    "created_at",
    "in_reply_to_user_id",
    "is_retweet",
    "is_reply",
]

# The four eras and the day account ages are measured at.
ERAS = ["cresci_2015", "cresci_2017", "twibot_2020", "twibot_2022"]

# Features an era cannot support unless its tweets carry the
# column that proves otherwise.
UNAVAILABLE = {
    "twibot_2020": ["reply_ratio", "tweet_active_days"],
    "twibot_2022": ["retweet_ratio"],
}
PROOF_COLUMN = {
    "retweet_ratio": "is_retweet",
    "reply_ratio": "is_reply",
    "tweet_active_days": "created_at",
}

# Subsets of the two CSV releases and their labels.
SUBSET_LABELS = {
    "cresci_2015": {
        "TFP": "human",
        "TWT": "human",
        "FSF": "bot",
        "INT": "bot",
        "E13": "bot",
    },
    "cresci_2017": {
        "genuine_accounts.csv": "human",
        "fake_followers.csv": "bot",
        "social_spambots_1.csv": "bot",
        "social_spambots_2.csv": "bot",
        "social_spambots_3.csv": "bot",
        "traditional_spambots_1.csv": "bot",
        "traditional_spambots_2.csv": "bot",
        "traditional_spambots_3.csv": "bot",
        "traditional_spambots_4.csv": "bot",
    },
}
SUBSETS_WITHOUT_TWEETS = [
    "traditional_spambots_2.csv",
    "traditional_spambots_3.csv",
    "traditional_spambots_4.csv",
]
SPLITS = ["train", "test", "dev"]
LABEL_CODES = {"0": "human", "1": "bot"}

# Tokens and patterns.
NULL_ID_TOKENS = ["", "nan", "None", "NaN"]
NULL_EDGE_TOKENS = ["", "nan", "None"]
NULL_REPLY_TOKENS = ["", "0", "nan", "None"]
NO_REPLY_EDGE_TOKENS = ["", "0"]
FLOAT_ID_PATTERN = r"^(-?\d+)\.0+$"
LONG_TIME_PATTERN = r"^\d+L$"
RETWEET_PREFIX = "RT @"
HASHTAG_PATTERN = "#[A-Za-z0-9_]+"
MENTION_PATTERN = "@[A-Za-z0-9_]+"
URL_PATTERN = "http[^ ]+"
URL_PREVIEW_PATTERN = r"http\S+"
DEFAULT_PICTURE_MARK = "default_profile"
FOLLOW_RELATIONS = ["following", "followers", "followed"]

# Contract rules and the texts of their reasons.
CROSS_ERA_DENY_COLS = [
    "followers_count",
    "friends_count",
    "statuses_count",
    "listed_count",
    "account_age_days",
    "tweet_count_actual",
]
CROSS_ERA_DENY_PREFIXES = ["emb_"]
MAX_NULL_RATE = 0.99
REASON_ABSENT = "not in frame"
REASON_DENY_COL = "deny_cols (reference-date sensitive)"
REASON_DENY_PREFIX = "deny_prefixes (e.g. unaligned embeddings)"
REASON_NULLS = "NaN rate ≥ {rate} in: [{eras}]"
REASON_CONSTANT = "zero variance in: [{eras}]"
SCOPE_WITHIN = "within-dataset"
SCOPE_CROSS = "cross-era"

# Split, graph and model parameters.
SPLIT_SIZE = 0.20
SEED = 42
TWEET_SAMPLE_SIZE = 250_000
STRATUM_SAMPLE_SIZE = 25
PREVIEW_SIZE = 10
PAGERANK_DAMPING = 0.85
PAGERANK_TOLERANCE = 1e-6
PAGERANK_MAX_ITER = 100
EMBEDDING_DIM = 64
WALK_LENGTH = 10
WALKS_PER_NODE = 10
WALK_WINDOW = 5
WALK_MIN_COUNT = 1
SCORE_EPSILON = 1e-8
DECISION_THRESHOLD = 0.5
LINEAR_MODELS = ["logreg", "ridge", "lasso", "svm"]
MODEL_FAMILIES = [*LINEAR_MODELS, "rf", "xgb"]
