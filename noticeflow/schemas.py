"""Column layouts of the tables the operators read and write."""

from pyspark.sql import types as T


def text_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


REGISTRY_COLUMNS = (
    "progressive", "area", "school_code", "school_name", "region", "school_type", "cup", "clp",
    "amount", "website", "funded_date", "vendor", "albo_id", "albo_url",
)
NOTICE_COLUMNS = (
    "school_code", "vendor", "item_id", "title", "url", "published", "expires", "category",
    "pdf_url", "detail_ref",
)
EXPORT_COLUMNS = (
    "school_code", "school_name", "region", "cup", "clp", "title", "url", "deadline", "status",
    "opportunity_type", "confidence", "published", "first_seen", "last_seen",
)
STATE_COLUMNS = {
    "processed_items": ("item_key", "school_code", "title", "published", "first_seen"),
    "alerts": ("alert_key", "school_code", "url", "status", "message_id", "subject",
               "created_at", "updated_at"),
    "opportunities": ("opp_key", "school_code", "school_name", "region", "cup", "clp", "title", "url",
                      "published", "deadline", "opportunity_type", "confidence", "first_seen", "last_seen"),
    "decisions": ("item_key", "school_code", "title", "url", "stage", "reason", "updated_at"),
    "call_threads": ("thread_id", "school_code", "cup", "clp", "role_signature", "protocol_ref", "status",
                     "subject", "message_id", "last_item_key", "last_title", "created_at", "updated_at"),
    "outcomes": ("group_key", "delivered", "message_id", "subject"),
    "result_acts": ("school_code", "last_result", "undated_result"),
}
STATE_KEYS = {
    "processed_items": "item_key", "alerts": "alert_key", "opportunities": "opp_key", "decisions": "item_key",
    "call_threads": "thread_id", "outcomes": "group_key", "result_acts": "school_code",
}
APPENDED = ("processed_items", "outcomes")   # runs only add keys to these
COLUMN_TYPES = {
    **dict.fromkeys(("first_seen", "last_seen", "created_at", "updated_at"), T.TimestampType()),
    "role_signature": T.ArrayType(T.StringType()), "delivered": T.BooleanType(),
    "last_result": T.DateType(), "undated_result": T.BooleanType(),
}

REGISTRY = text_schema(*REGISTRY_COLUMNS)
NOTICES = text_schema(*NOTICE_COLUMNS)


def state_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(n, COLUMN_TYPES.get(n, T.StringType())) for n in STATE_COLUMNS[table]])
