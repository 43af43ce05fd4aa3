"""Explicit schemas; no reader in this package infers one."""

from pyspark.sql import types as T

RECORD_META = T.StructType(
    [
        T.StructField("record_num", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("record_content_type", T.StringType()),
        T.StructField("block_digest", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("warc_concurrent_to", T.ArrayType(T.StringType())),
        T.StructField("sub_collection", T.StringType()),
    ]
)

REQUEST_META = T.StructType(
    [
        T.StructField("execution_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("record_meta", T.MapType(T.IntegerType(), RECORD_META)),
        T.StructField("fetch_ts", T.TimestampType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField(
            "collection_ref",
            T.StructType(
                [
                    T.StructField("kind", T.StringType()),
                    T.StructField("id", T.StringType()),
                ]
            ),
        ),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("record_num", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("meta", REQUEST_META),
        T.StructField("cancel_reason", T.StringType()),
    ]
)

COLLECTION_CONFIG = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField(
            "meta",
            T.StructType(
                [
                    T.StructField("name", T.StringType()),
                    T.StructField("description", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "collection",
            T.StructType(
                [
                    T.StructField("collectionDedupPolicy", T.StringType()),
                    T.StructField("fileRotationPolicy", T.StringType()),
                    T.StructField("compress", T.BooleanType()),
                    T.StructField("fileSize", T.LongType()),
                ]
            ),
        ),
    ]
)

CRAWLED_CONTENT = T.StructType(
    [
        T.StructField("digest", T.StringType()),
        T.StructField("warc_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("date", T.TimestampType()),
        T.StructField("request_id", T.LongType()),
        T.StructField("record_num", T.IntegerType()),
        T.StructField("bucket", T.StringType()),
    ]
)
