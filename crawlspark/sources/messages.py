"""Write messages, as a table or as a file stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlspark.schemas import MESSAGE, RECORD_META, REQUEST_META


def message_schema(ingested: str | None = None) -> T.StructType:
    """Schema of messages, with the columns that ingestion adds: a clock, an order of arrival."""
    return T.StructType(MESSAGE.fields + (T.StructType.fromDDL(ingested).fields if ingested else []))


def _json_schema(ingested: str | None = None) -> T.StructType:
    """Message schema with text as the key of record metadata: JSON has no other keys."""
    meta = T.StructType([*REQUEST_META.fields])
    meta.fields[meta.names.index("record_meta")] = T.StructField(
        "record_meta", T.MapType(T.StringType(), RECORD_META)
    )
    message = message_schema(ingested)
    message.fields[message.names.index("meta")] = T.StructField("meta", meta)
    return message


def _with_numbers(messages: DataFrame) -> DataFrame:
    numbered = F.transform_keys("meta.record_meta", lambda number, _: number.cast("int"))
    return messages.withColumn("meta", F.col("meta").withField("record_meta", numbered))


def read_messages(spark: SparkSession, path: str, form: str = "parquet", ingested: str | None = None) -> DataFrame:
    """Messages stored as parquet, or as JSON lines with base64 data; ``ingested`` declares further columns."""
    if form == "json":
        return _with_numbers(spark.read.schema(_json_schema(ingested)).json(path))
    return spark.read.schema(message_schema(ingested)).format(form).load(path)


def stream_messages(spark: SparkSession, path: str, form: str = "parquet", ingested: str | None = None, **options) -> DataFrame:
    """The same as a file stream; ``options`` bound what one micro-batch takes in."""
    reader = spark.readStream.options(**options)
    if form == "json":
        return _with_numbers(reader.schema(_json_schema(ingested)).json(path))
    return reader.schema(message_schema(ingested)).format(form).load(path)
