"""The write session used throughout: one request, one response."""

import base64
import datetime
import hashlib


def hex_digest(data):
    return "sha1:" + hashlib.sha1(data).hexdigest().upper()


def base32_digest(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


REQUEST_HEADER = b"GET /museum/tickets HTTP/1.1\r\nHost: visit.test\r\nAccept: */*\r\n\r\n"
RESPONSE_HEADER = (
    b"HTTP/1.1 200 OK\r\nServer: testbench\r\nContent-Type: text/html\r\nContent-Length: 31\r\n\r\n"
)
PAYLOAD = b"<p>Open daily from ten to six.\n"

REQUEST_BLOCK = hex_digest(REQUEST_HEADER)
EMPTY_PAYLOAD = hex_digest(b"")
RESPONSE_BLOCK = hex_digest(RESPONSE_HEADER + PAYLOAD)
RESPONSE_PAYLOAD = hex_digest(PAYLOAD)
REVISIT_BLOCK = base32_digest(RESPONSE_HEADER)
REQUEST_SIZE, REVISIT_SIZE = len(REQUEST_HEADER), len(RESPONSE_HEADER)
RESPONSE_SIZE = REVISIT_SIZE + len(PAYLOAD)

FETCHED = datetime.datetime(2023, 3, 5, 17, 20, 11)
HOUR = FETCHED.strftime("%Y%m%d%H")


def record_meta(num, kind="RESPONSE", size=RESPONSE_SIZE, block=RESPONSE_BLOCK, payload=RESPONSE_PAYLOAD):
    content_type = f"application/http;msgtype={kind.lower()}"
    return (num, kind, size, content_type, block, payload, None, "UNDEFINED")


REQUEST_META = record_meta(0, "REQUEST", REQUEST_SIZE, REQUEST_BLOCK, EMPTY_PAYLOAD)


def meta(collection="c1", uri="http://visit.test/museum/tickets", ip="192.0.2.7", records=None):
    described = {0: REQUEST_META, 1: record_meta(1)} if records is None else records
    reference = None if collection is None else ("collection", collection)
    return ("run-7", uri, described, FETCHED, ip, reference)


def session(request_id=1, meta_value=None):
    """Messages of one session; the metadata comes last."""
    return [
        (request_id, 0, "header", 0, REQUEST_HEADER, None, None),
        (request_id, 1, "header", 1, RESPONSE_HEADER, None, None),
        (request_id, 2, "payload", 1, PAYLOAD, None, None),
        (request_id, 3, "meta", None, None, meta_value or meta(), None),
    ]


CONFIG_DOCUMENTS = [
    '{"id": "c1", "meta": {"name": "c1"}, "collection": {"collectionDedupPolicy": "HOURLY",'
    ' "fileRotationPolicy": "MONTHLY"}}',
    '{"id": "c2", "meta": {"name": "c2"}, "collection": {"collectionDedupPolicy": "HOURLY",'
    ' "fileRotationPolicy": "MONTHLY", "compress": true}, "apiVersion": "v1"}',
    '{"id": "c3", "meta": {"name": "c3"}}',
]


def config(spark):
    from crawlspark.sources.config import decode_config

    return decode_config(spark.createDataFrame([(doc,) for doc in CONFIG_DOCUMENTS], "doc string"))


def messages(spark, rows):
    from crawlspark.schemas import MESSAGE

    return spark.createDataFrame(rows, MESSAGE)
