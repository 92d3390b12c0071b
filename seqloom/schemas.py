"""Fixed schemas (DDL) of the files the library reads and writes."""

REVIEW = (
    "reviewerID string, asin string, overall double, unixReviewTime bigint, reviewText string, summary string"
)
LISTEN_REVIEW = (
    "reviewerID string, asin string, overall double, unixReviewTime bigint, reviewTime string, "
    "summary string, reviewText string, orig_item_id bigint, is_organic int, played_ratio_pct double, "
    "track_length_seconds int, event_type string"
)
# categories and description keep their raw JSON text: the files mix text, lists and nested lists
ITEM_META = "asin string, title string, description string, brand string, categories string"
LISTEN = (
    "uid bigint, item_id bigint, timestamp bigint, is_organic int, played_ratio_pct double, "
    "track_length_seconds int, event_type string"
)
USER_SEQUENCE = (
    "uid bigint, item_ids array<bigint>, timestamps array<bigint>, track_length_seconds array<int>"
)
COMPACT_SAMPLE = "user_id bigint, item_id_list string, item_id bigint"
ITEM_FEATURE = "struct<title: string, description: string, brand: string, categories: string>"
ID_MAP = "orig string, idx bigint"
CATALOGUE = "sid string, title string, item_id bigint"
PREFERENCE = (
    "user string, user_preference string, split string, "
    "context struct<history_items: array<bigint>, target_item: bigint>"
)
PREDICTION = "input string, output string, predict array<string>"
CODEBOOK = "level int, code int, centroid array<double>"
EMBEDDING = "item_id bigint, embedding array<float>"
SID_SAMPLE_CSV = (
    "user_id string, history_item_title string, item_title string, history_item_id string, "
    "item_id bigint, history_item_sid string, item_sid string"
)
