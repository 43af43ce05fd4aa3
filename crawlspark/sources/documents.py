"""JSON documents at the storage boundary: lenient, strict and writing."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_lenient(doc: Column, schema: T.StructType) -> Column:
    """Struct of a document; unknown fields are dropped, absent ones are NULL."""
    return F.from_json(doc, schema, {"mode": "PERMISSIVE"})


def _unknown(value: Column, schema: T.DataType) -> Column:
    """Whether JSON text holds a field, at any depth, that ``schema`` does not name."""
    no = F.lit(False)
    if isinstance(schema, T.StructType):
        keys = F.array_except(F.json_object_keys(value), F.array(*[F.lit(name) for name in schema.names]))
        found = F.coalesce(F.size(keys) > 0, no)
        parts = F.from_json(value, T.MapType(T.StringType(), T.StringType()))
        for field in schema.fields:
            if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
                found = found | _unknown(parts[field.name], field.dataType)
        return found
    if isinstance(schema, T.ArrayType):
        items = F.from_json(value, T.ArrayType(T.StringType()))
        return F.coalesce(F.exists(items, lambda item: _unknown(item, schema.elementType)), no)
    if isinstance(schema, T.MapType):
        items = F.map_values(F.from_json(value, T.MapType(T.StringType(), T.StringType())))
        return F.coalesce(F.exists(items, lambda item: _unknown(item, schema.valueType)), no)
    return no


def decode_status(doc: Column, schema: T.StructType) -> Column:
    """``OK``, ``UNKNOWN_FIELD`` or ``MALFORMED`` for the strict reading of a document.

    A document that does not parse, or holds a value of the wrong type, is
    malformed. ``from_json`` accepts unknown fields in silence, so the keys
    are compared with the schema, in every struct at every depth.
    """
    corrupt = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(doc, corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    broken = parsed.isNull() | parsed["_corrupt"].isNotNull() | F.json_object_keys(doc).isNull()
    return (
        F.when(broken, F.lit("MALFORMED"))
        .when(_unknown(doc, schema), F.lit("UNKNOWN_FIELD"))
        .otherwise(F.lit("OK"))
    )


def decode_strict(doc: Column, schema: T.StructType) -> Column:
    """Struct of a document that is ``OK``, NULL for any other."""
    return F.when(decode_status(doc, schema) == "OK", decode_lenient(doc, schema))


def encode(**fields: Column) -> Column:
    """JSON document of the given fields, unset fields left out."""
    return F.to_json(
        F.struct(*[value.alias(name) for name, value in fields.items()]),
        {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"},
    )


def crawled_content_document(digest: Column, warc_id: Column, target_uri: Column, date: Column) -> Column:
    """Document of a dedup index row, with the index's own field names."""
    return encode(date=date, digest=digest, targetUri=target_uri, warcId=warc_id)
