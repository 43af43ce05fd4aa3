"""The same results as ANSI SQL over the driver's tables, one statement per query."""

from crawlspark.operators.metrics import HISTOGRAM_EDGES

CRLF = "chr(13)||chr(10)"
RESPONSE_HEAD = f"'HTTP/1.1 200 OK'||{CRLF}||{CRLF}"
REQUEST_HEAD = f"'GET / HTTP/1.1'||{CRLF}||{CRLF}"
STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
RECRAWL_SHIFT = 1_000_000_000_000


def sha1_hex(value: str) -> str:
    return f"'sha1:'||upper(sha1({value}))"


def octets(value: str) -> str:
    return f"CAST(octet_length(encode({value})) AS BIGINT)"


def uuid_of(value: str) -> str:
    digest = f"sha1({value})"
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return "||'-'||".join(f"substr({digest},{start},{width})" for start, width in cuts)


def record_uuid(request: str = "request_id", record: str = "record_num") -> str:
    return uuid_of(f"{request}||'|'||{record}")


def urn(value: str) -> str:
    return f"'<urn:uuid:'||({value})||'>'"


def base32(hex_digits: str) -> str:
    parts = []
    for piece in range(4):
        number = f"CAST('0x'||substr({hex_digits},{1 + 10 * piece},10) AS BIGINT)"
        for shift in range(35, -1, -5):
            parts.append(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',CAST(({number}>>{shift})&31 AS INTEGER)+1,1)")
    return "||".join(parts)


def bucket(ts: str, policy: str) -> str:
    return (
        f"CASE {policy} WHEN 'HOURLY' THEN strftime({ts},'%Y%m%d%H') WHEN 'DAILY' THEN strftime({ts},'%Y%m%d') "
        f"WHEN 'MONTHLY' THEN strftime({ts},'%Y%m') WHEN 'YEARLY' THEN strftime({ts},'%Y') ELSE '' END"
    )


def rank(policy: str) -> str:
    return (
        f"CASE {policy} WHEN 'HOURLY' THEN 1 WHEN 'DAILY' THEN 2 WHEN 'MONTHLY' THEN 3 WHEN 'YEARLY' THEN 4 ELSE 0 END"
    )


EFFECTIVE = (
    f"CASE WHEN {rank('dedup_policy')} > 0 AND {rank('dedup_policy')} < {rank('rotation_policy')} "
    "THEN dedup_policy ELSE rotation_policy END"
)


def final_name(collection: str, sub: str, key: str) -> str:
    return (
        f"{collection}||CASE WHEN {sub}<>'UNDEFINED' THEN '_'||{sub} ELSE '' END"
        f"||CASE WHEN {key}<>'' THEN '_'||{key} ELSE '' END"
    )


def firsts_of(table: str) -> str:
    return (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY revisit_key ORDER BY request_id, record_num) AS turn "
        f"FROM {table} WHERE revisit_key IS NOT NULL) WHERE turn = 1"
    )


def keyed_of(table: str) -> str:
    name = final_name("collection", "sub_collection", bucket("fetch_ts", "dedup_policy"))
    return f"""SELECT *, CASE WHEN record_type IN ('RESPONSE','RESOURCE') THEN payload_digest||':'||cfn END AS revisit_key
        FROM (SELECT r.*, c.collection, c.description, c.dedup_policy, c.rotation_policy, c.compress, c.file_size,
            {name} AS cfn, ({name})||'@'||{bucket('fetch_ts', EFFECTIVE)} AS file_group, {record_uuid()} AS warc_id
            FROM {table} r JOIN config c ON r.collection_id = c.collection_id)"""


HEADER_FIELDS = [
    ("WARC-Type", "lower(record_type)"),
    ("WARC-Record-ID", urn("warc_id")),
    ("WARC-Target-URI", "target_uri"),
    ("WARC-IP-Address", "ip_address"),
    ("WARC-Date", "strftime(fetch_ts,'%Y-%m-%dT%H:%M:%SZ')"),
    ("Content-Length", "CAST(size AS VARCHAR)"),
    ("Content-Type", "content_type"),
    ("WARC-Block-Digest", "block_digest"),
    ("WARC-Payload-Digest", "payload_digest"),
    ("WARC-Profile", "profile"),
    ("WARC-Refers-To", "refers_to"),
    ("WARC-Refers-To-Target-URI", "refers_to_uri"),
    ("WARC-Refers-To-Date", "refers_to_date"),
    ("WARC-Concurrent-To", urn("sibling")),
]
HEAD = f"'WARC/1.1'||{CRLF}||" + "||".join(
    f"coalesce('{name}: '||{value}||{CRLF},'')" for name, value in HEADER_FIELDS
) + f"||{CRLF}"

INFO_BODY = (
    f"'format: WARC File Format 1.1'||{CRLF}||'collection: '||collection||{CRLF}||'description: '||description||{CRLF}"
    f"||'isPartOf: '||cfn||{CRLF}||'host: host0'||{CRLF}"
)
INFO_RECORD = (
    f"'WARC/1.1'||{CRLF}||'WARC-Type: warcinfo'||{CRLF}||'WARC-Record-ID: '||{urn(uuid_of('file_name'))}||{CRLF}"
    f"||'WARC-Date: '||strftime(opened,'%Y-%m-%dT%H:%M:%SZ')||{CRLF}||'WARC-Filename: '||file_name||{CRLF}"
    f"||'Content-Length: '||{octets('body')}||{CRLF}||'Content-Type: application/warc-fields'||{CRLF}||{CRLF}"
    f"||body||{CRLF}||{CRLF}"
)


def offsets_of(table: str, size: str) -> str:
    """Start in the lane, volume of ``file_size`` bytes, serial and offset."""
    return f"""SELECT *, dense_rank() OVER (PARTITION BY file_group, lane ORDER BY volume) AS serial,
            start - min(start) OVER (PARTITION BY file_group, lane, volume) AS "offset",
            min(fetch_ts) OVER (PARTITION BY file_group, lane, volume) AS opened
        FROM (SELECT *, start // file_size AS volume
            FROM (SELECT *, CAST(coalesce(sum({size}) OVER (PARTITION BY file_group, lane ORDER BY request_id, record_num
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
                FROM (SELECT *, CAST(request_id % 2 AS INTEGER) AS lane FROM {table})))"""


CONTENT_TYPE = (
    "CASE record_type WHEN 'RESPONSE' THEN 'application/http;msgtype=response' "
    "WHEN 'REQUEST' THEN 'application/http;msgtype=request' ELSE 'text/plain' END"
)

# Common table expressions by name, each after those it reads.
TABLES = {
    "config": """SELECT 'c'||s_suppkey AS collection_id, 'c'||s_suppkey AS collection, s_name AS description,
        CASE WHEN s_suppkey % 10 = 7 THEN 'NONE'
            ELSE ['HOURLY','DAILY','NONE','MONTHLY','YEARLY'][s_suppkey % 5 + 1] END AS dedup_policy,
        CASE WHEN s_suppkey % 10 = 7 THEN 'NONE'
            ELSE ['MONTHLY','HOURLY','YEARLY','NONE','DAILY'][(s_suppkey + s_suppkey // 5) % 5 + 1] END AS rotation_policy,
        s_suppkey % 10 <> 7 AND s_suppkey % 3 = 2 AS compress,
        CAST(CASE WHEN s_suppkey % 10 = 7 THEN 0 WHEN s_suppkey < 3 THEN 1024 ELSE 1048576 END AS BIGINT)
            AS file_size,
        s_suppkey % 10 <> 7 AS sufficient FROM supplier""",
    "plain": f"""SELECT request_id, record_num, record_type, target_uri, ip_address, {CONTENT_TYPE} AS content_type,
        CASE record_type WHEN 'RESPONSE' THEN {RESPONSE_HEAD} WHEN 'REQUEST' THEN {REQUEST_HEAD} ELSE '' END AS header,
        payload, fetch_ts, 'c'||(first_user % 3) AS collection_id, 'UNDEFINED' AS sub_collection
        FROM (SELECT event_id // 2 AS request_id, CAST(event_id % 2 AS INTEGER) AS record_num,
            CASE event_type WHEN 'click' THEN 'REQUEST' WHEN 'error' THEN 'METADATA' WHEN 'signup' THEN 'RESOURCE'
                ELSE 'RESPONSE' END AS record_type,
            'http://example.com/u/'||user_id AS target_uri,
            '10.0.0.'||(first_value(user_id) OVER s % 256) AS ip_address,
            event_type||props AS payload, min(ts) OVER (PARTITION BY event_id // 2) AS fetch_ts,
            first_value(user_id) OVER s AS first_user
            FROM events WINDOW s AS (PARTITION BY event_id // 2 ORDER BY event_id))""",
    "records": f"""SELECT *, {sha1_hex('payload')} AS payload_digest, {sha1_hex('header||payload')} AS block_digest,
        {octets('header||payload')} AS size FROM plain""",
    "keyed": keyed_of("records"),
    "firsts": firsts_of("keyed"),
    "late": "SELECT * REPLACE (fetch_ts + INTERVAL 20 HOUR AS fetch_ts) FROM records",
    "late_keyed": keyed_of("late"),
    "decided": """SELECT k.*, coalesce(f.request_id <> k.request_id, false) AS is_revisit,
        CASE WHEN f.request_id <> k.request_id THEN f.request_id END AS ref_request_id,
        CASE WHEN f.request_id <> k.request_id THEN f.record_num END AS ref_record_num,
        f.warc_id AS ref_warc_id, f.target_uri AS ref_uri, f.fetch_ts AS ref_ts
        FROM keyed k LEFT JOIN firsts f ON k.revisit_key = f.revisit_key""",
    "rewritten": f"""SELECT request_id, record_num, warc_id, target_uri, ip_address, content_type, fetch_ts, collection,
        description, cfn, file_group, compress, file_size, payload_digest, is_revisit,
        CASE WHEN is_revisit THEN 'REVISIT' ELSE record_type END AS record_type,
        CASE WHEN is_revisit THEN {octets('header')} ELSE size END AS size,
        CASE WHEN is_revisit THEN 'sha1:'||{base32('header_sha1')} ELSE block_digest END AS block_digest,
        CASE WHEN is_revisit THEN 'http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' END AS profile,
        CASE WHEN is_revisit THEN {urn('ref_warc_id')} END AS refers_to,
        CASE WHEN is_revisit THEN ref_uri END AS refers_to_uri,
        CASE WHEN is_revisit THEN strftime(ref_ts,'%Y-%m-%dT%H:%M:%SZ') END AS refers_to_date
        FROM (SELECT *, sha1(header) AS header_sha1 FROM decided)""",
    "headed": f"""SELECT *, {octets('head')} + size + 4 AS stored_size FROM (SELECT *, {HEAD} AS head FROM (
        SELECT r.*, s.warc_id AS sibling FROM rewritten r LEFT JOIN rewritten s
            ON r.request_id = s.request_id AND r.record_num <> s.record_num))""",
    "offsets": offsets_of("headed", "stored_size"),
    "named": f"""SELECT *, {INFO_BODY} AS body FROM (SELECT *, cfn||'-'||strftime(opened,'%Y%m%d%H%M%S')||'-'
        ||printf('%04d', dense_rank() OVER (PARTITION BY cfn ORDER BY file_group, volume, lane))||'-host0.warc'||CASE WHEN compress THEN '.gz' ELSE '' END AS file_name
        FROM offsets)""",
    "placed": f"""SELECT *, CASE WHEN NOT compress THEN 'warcfile:'||file_name||':'||("offset" + {octets('info')}) END AS storage_ref
        FROM (SELECT *, {INFO_RECORD} AS info FROM named)""",
    "recrawl": f"""SELECT * REPLACE (request_id + {RECRAWL_SHIFT} AS request_id, fetch_ts + INTERVAL 1 DAY AS fetch_ts)
        FROM records""",
    "rekeyed": keyed_of("recrawl"),
    "refirsts": firsts_of("rekeyed"),
    "pairs": """SELECT a.request_id, a.request_id % 23 AS fault, a.header AS head0, a.payload AS body0,
        b.header AS head1, b.payload AS body1, b.request_id IS NOT NULL AS has1,
        a.record_type AS type0, b.record_type AS type1, a.payload_digest AS payload0, b.payload_digest AS payload1,
        a.block_digest AS block0, b.block_digest AS block1, a.size AS size0, b.size AS size1,
        a.content_type AS content0, b.content_type AS content1,
        a.target_uri, a.ip_address, a.fetch_ts, a.collection_id,
        CASE WHEN a.request_id % 23 = 11 THEN 2 ELSE 1 END AS second
        FROM records a LEFT JOIN records b ON a.request_id = b.request_id AND b.record_num = 1 WHERE a.record_num = 0""",
    "messages": """
        SELECT request_id, 10 AS seq, 'header' AS kind, 0 AS record_num, CASE WHEN fault = 17 THEN '' ELSE head0 END AS data
            FROM pairs WHERE fault <> 13
        UNION ALL SELECT request_id, 11, 'header', 0, 'X' FROM pairs WHERE fault IN (12, 16)
        UNION ALL SELECT request_id, 11, 'header', 0, head0 FROM pairs WHERE fault = 17
        UNION ALL SELECT request_id, 12, 'payload', 0, body0 FROM pairs
        UNION ALL SELECT request_id, 13, 'header', 0, head0 FROM pairs WHERE fault = 13
        UNION ALL SELECT request_id, 20, 'header', second, head1 FROM pairs WHERE has1
        UNION ALL SELECT request_id, 21, 'payload', second, substr(body1, 1, 6) FROM pairs WHERE has1
        UNION ALL SELECT request_id, 22, 'cancel', NULL, NULL FROM pairs WHERE fault = 14
        UNION ALL SELECT request_id, 23, 'trailer', NULL, NULL FROM pairs WHERE fault IN (14, 15)
        UNION ALL SELECT request_id, 24, 'payload', second, substr(body1, 7) FROM pairs WHERE has1
        UNION ALL SELECT request_id, 30, 'meta', NULL, NULL FROM pairs WHERE fault <> 0
        UNION ALL SELECT request_id, 31, 'meta', NULL, NULL FROM pairs WHERE fault = 18
        UNION ALL SELECT request_id, 40, 'cancel', NULL, NULL FROM pairs WHERE fault = 16""",
    "metas": """SELECT request_id, fault, 'e'||request_id AS execution_id,
        CASE WHEN fault IN (3, 9) THEN '' WHEN fault = 18 THEN target_uri||'?v=2' ELSE target_uri END AS target_uri,
        CASE WHEN fault IN (2, 9) THEN '' ELSE ip_address END AS ip_address, fetch_ts,
        CASE fault WHEN 1 THEN NULL WHEN 4 THEN 'nowhere' WHEN 5 THEN 'c7' ELSE collection_id END AS collection_id
        FROM pairs WHERE fault <> 0""",
    "record_metas": f"""SELECT request_id, 0 AS record_num, CASE WHEN fault = 7 THEN 'OTHER' ELSE type0 END AS record_type,
            size0 + CASE WHEN fault = 8 THEN 1 ELSE 0 END AS declared_size, block0 AS declared_block,
            CASE WHEN fault = 21 THEN '' ELSE payload0 END AS declared_payload, content0 AS content_type
            FROM pairs WHERE fault <> 0
        UNION ALL SELECT request_id, second, type1, size1, block1,
            CASE fault WHEN 21 THEN '' WHEN 10 THEN {sha1_hex("'tampered'")} ELSE payload1 END, content1
            FROM pairs WHERE has1 AND fault NOT IN (0, 6)
        UNION ALL SELECT request_id, 7, type0, size0, block0, payload0, content0 FROM pairs WHERE fault = 19""",
    "chunks": "SELECT * FROM messages WHERE kind IN ('header', 'payload')",
    "first_bytes": "SELECT request_id, record_num, min(seq) AS seq FROM chunks WHERE data <> '' GROUP BY ALL",
    "repeats": """SELECT h.request_id, h.record_num, h.seq FROM chunks h JOIN first_bytes b
        ON h.request_id = b.request_id AND h.record_num = b.record_num WHERE h.kind = 'header' AND h.seq > b.seq""",
    "ends": """SELECT request_id, seq, 'HEADER_TWICE' AS status FROM repeats
        UNION ALL SELECT request_id, seq, 'CANCELLED' FROM messages WHERE kind = 'cancel'
        UNION ALL SELECT request_id, seq, 'INVALID_ARGUMENT' FROM messages
            WHERE kind NOT IN ('meta', 'header', 'payload', 'cancel', 'eof')""",
    "outcomes": """SELECT m.request_id, coalesce(e.status, 'EOF') AS status FROM (SELECT DISTINCT request_id FROM messages) m
        LEFT JOIN (SELECT request_id, arg_min(status, seq) AS status FROM ends GROUP BY request_id) e
        ON m.request_id = e.request_id""",
    "assembled": f"""SELECT request_id, record_num, {octets('block')} AS size, {sha1_hex('block')} AS block_digest,
        {sha1_hex('payload')} AS payload_digest FROM (
            SELECT request_id, record_num, string_agg(data, '' ORDER BY seq) AS block,
            coalesce(string_agg(data, '' ORDER BY seq) FILTER (WHERE kind = 'payload'), '') AS payload
            FROM chunks GROUP BY request_id, record_num)""",
    "described": """SELECT a.*, m.record_type, m.content_type, m.request_id IS NOT NULL AS has_meta,
        coalesce(a.size = m.declared_size, false) AND coalesce(nullif(m.declared_block, ''), a.block_digest) = a.block_digest
        AND coalesce(nullif(m.declared_payload, ''), a.payload_digest) = a.payload_digest AS correct,
        coalesce(nullif(m.declared_payload, ''), a.payload_digest) AS kept_payload,
        coalesce(nullif(m.declared_block, ''), a.block_digest) AS kept_block
        FROM assembled a LEFT JOIN record_metas m ON a.request_id = m.request_id AND a.record_num = m.record_num""",
    "faults": """SELECT request_id, record_num, CASE WHEN NOT has_meta THEN 'missing metadata for record num: '||record_num
        WHEN record_type = 'OTHER' THEN 'failed to build record number '||record_num
        WHEN NOT correct THEN 'failed to validate record number '||record_num END AS error FROM described""",
    "first_faults": """SELECT request_id, arg_min(error, record_num) AS error FROM faults WHERE error IS NOT NULL
        GROUP BY request_id""",
    "lenient_faults": """SELECT request_id, arg_min(error, record_num) AS error FROM faults
        WHERE error IS NOT NULL AND error NOT LIKE 'failed to validate%' GROUP BY request_id""",
}

VALIDATED = """SELECT o.request_id, m.target_uri, m.ip_address, m.fetch_ts, m.collection_id, CASE
    WHEN m.request_id IS NULL THEN 'missing metadata object'
    WHEN m.collection_id IS NULL THEN 'missing collection ref'
    WHEN m.ip_address = '' THEN 'missing IP-address'
    WHEN m.target_uri = '' THEN 'missing target URI'
    WHEN c.collection_id IS NULL THEN 'failed to get collection config: '||m.collection_id
    WHEN NOT c.sufficient THEN 'collection with id '''||m.collection_id||''' is missing or insufficient'
    WHEN f.error IS NOT NULL THEN f.error
    WHEN NOT d.dense THEN 'non-contiguous record numbers' END AS error
    FROM (SELECT * FROM outcomes WHERE status = 'EOF') o LEFT JOIN metas m ON o.request_id = m.request_id
    LEFT JOIN config c ON m.collection_id = c.collection_id LEFT JOIN {faults} f ON o.request_id = f.request_id
    LEFT JOIN (SELECT request_id, min(record_num) = 0 AND max(record_num) = count(*) - 1 AS dense
        FROM assembled GROUP BY request_id) d ON o.request_id = d.request_id"""
TABLES["validated"] = VALIDATED.format(faults="first_faults")
TABLES["lenient"] = VALIDATED.format(faults="lenient_faults")
TABLES["statuses"] = """SELECT o.request_id, CASE WHEN o.status <> 'EOF' THEN o.status WHEN v.error IS NOT NULL THEN 'REJECTED'
    ELSE 'OK' END AS status FROM outcomes o LEFT JOIN validated v ON o.request_id = v.request_id"""
TABLES["accepted"] = """SELECT d.request_id, d.record_num, d.record_type, v.target_uri, v.fetch_ts, v.collection_id,
    'UNDEFINED' AS sub_collection, d.kept_payload AS payload_digest, d.kept_block AS block_digest, d.size,
    coalesce(h.header, '') AS header
    FROM described d JOIN lenient v ON d.request_id = v.request_id
    LEFT JOIN (SELECT request_id, record_num, string_agg(data, '' ORDER BY seq) AS header FROM chunks
        WHERE kind = 'header' GROUP BY ALL) h ON d.request_id = h.request_id AND d.record_num = h.record_num
    WHERE v.error IS NULL"""
TABLES["accepted_keyed"] = keyed_of("accepted")
TABLES["accepted_firsts"] = firsts_of("accepted_keyed")

_NEEDS = {
    "records": ["plain"],
    "keyed": ["config", "records"],
    "firsts": ["keyed"],
    "late": ["records"],
    "late_keyed": ["config", "late"],
    "decided": ["firsts"],
    "rewritten": ["decided"],
    "headed": ["rewritten"],
    "offsets": ["headed"],
    "named": ["offsets"],
    "placed": ["named"],
    "recrawl": ["records"],
    "rekeyed": ["config", "recrawl"],
    "refirsts": ["rekeyed"],
    "pairs": ["records"],
    "messages": ["pairs"],
    "metas": ["pairs"],
    "record_metas": ["pairs"],
    "chunks": ["messages"],
    "first_bytes": ["chunks"],
    "repeats": ["first_bytes"],
    "ends": ["repeats"],
    "outcomes": ["ends"],
    "assembled": ["chunks"],
    "described": ["assembled", "record_metas"],
    "faults": ["described"],
    "first_faults": ["faults"],
    "lenient_faults": ["faults"],
    "validated": ["outcomes", "metas", "config", "first_faults"],
    "lenient": ["outcomes", "metas", "config", "lenient_faults"],
    "statuses": ["validated"],
    "accepted": ["lenient"],
    "accepted_keyed": ["accepted"],
    "accepted_firsts": ["accepted_keyed"],
}


def _ordered(names: list[str], done: list[str]) -> list[str]:
    for name in names:
        _ordered(_NEEDS.get(name, []), done)
        if name not in done:
            done.append(name)
    return done


def over(names: str, select: str) -> str:
    """``select`` with the common tables it reads."""
    parts = ",\n".join(f"{name} AS ({TABLES[name]})" for name in _ordered(names.split(), []))
    return f"WITH {parts}\n{select}"


POLICY_ROWS = (
    "SELECT request_id, record_num, fetch_ts, unnest(['NONE','HOURLY','DAILY','MONTHLY','YEARLY']) AS policy FROM plain"
)
CONVERSATIONS = """SELECT conv_id AS request_id, turn AS seq, CASE WHEN role = 'system' THEN 'header' ELSE 'payload' END AS kind,
    CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS record_num, text AS data FROM conversations"""
ASSEMBLED_CONVERSATIONS = f"""SELECT request_id, record_num, n_chunks, {octets('block')} AS size, {sha1_hex('block')} AS digest
    FROM (SELECT request_id, record_num, count(*) AS n_chunks, string_agg(data, '' ORDER BY seq) AS block
    FROM ({CONVERSATIONS}) GROUP BY request_id, record_num)"""
DECISIONS = over("decided", "SELECT request_id, record_num, is_revisit, ref_request_id, ref_record_num FROM decided")
JOINED_CONFIG = over(
    "plain config",
    """SELECT DISTINCT r.request_id, c.collection, c.dedup_policy, c.rotation_policy
    FROM plain r LEFT JOIN config c ON r.collection_id = c.collection_id""",
)
DNS_SESSIONS = """SELECT p.* REPLACE (CASE WHEN f.record_type = 'METADATA' THEN 'DNS' ELSE 'UNDEFINED' END AS sub_collection)
    FROM records p JOIN records f ON p.request_id = f.request_id AND f.record_num = 0"""
RAW_DATE = f"""SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN strftime(ts,'%Y-%m-%dT%H:%M:%SZ')
    WHEN 1 THEN strftime(ts,'%Y-%m-%dT%H:%M:%S.%f')||'789+02:00' WHEN 2 THEN strftime(ts,'%Y') WHEN 3 THEN strftime(ts,'%Y%m%d')
    WHEN 4 THEN 'http://www.example.com/'||user_id WHEN 5 THEN strftime(ts,'%Y-13-%dT%H:%M:%SZ')
    WHEN 6 THEN strftime(ts,'%Y-%m-%dT%H:%M:%S.')||substr(strftime(ts,'%f'),1,1)||'-05:30'
    ELSE strftime(ts,'%Y-%m-%d %H:%M:%S') END AS raw,
    CASE event_id % 8 WHEN 0 THEN strftime(date_trunc('second', ts), {STAMP})
    WHEN 1 THEN strftime(ts - INTERVAL 2 HOUR, {STAMP})
    WHEN 6 THEN strftime(ts + INTERVAL 330 MINUTE,'%Y-%m-%d %H:%M:%S.')||substr(strftime(ts,'%f'),1,1)||'00000' END AS ts
    FROM events"""
TAMPERED = sha1_hex("'tampered'")
DECLARED_DIGESTS = f"""SELECT request_id, record_num, request_id % 5 <> 0 AS payload_ok, request_id % 5 <> 1 AS block_ok,
    request_id % 5 <> 4 AS size_ok, CASE request_id % 5 WHEN 0 THEN 'payload digest' WHEN 1 THEN 'block digest'
    WHEN 4 THEN 'content length' ELSE '' END AS warnings FROM plain"""
RAW_ID = f"""SELECT request_id, record_num, CASE request_id % 7 WHEN 1 THEN 'f'||id WHEN 2 THEN id WHEN 3 THEN '{{'||id||'}}'
    WHEN 4 THEN replace(id,'-','') WHEN 5 THEN upper({urn('id')}) WHEN 6 THEN '' ELSE {urn('id')} END AS raw,
    CASE WHEN request_id % 7 IN (1, 6) THEN '00000000-0000-0000-0000-000000000000' ELSE id END AS warc_id,
    request_id % 7 NOT IN (1, 6) AS ok FROM (SELECT *, {record_uuid()} AS id FROM plain)"""


def _page_digests() -> str:
    block = f"{RESPONSE_HEAD}||html"
    return f"""SELECT 'page' AS kind, page_id AS request_id, 0 AS record_num, {sha1_hex('html')} AS payload_digest,
        {sha1_hex(block)} AS block_digest, {octets(block)} AS size FROM pages"""


def _documents() -> str:
    empty = base32("sha1('')")
    return f"""SELECT doc_id AS request_id, 0 AS record_num, lang AS collection_final_name,
        CASE WHEN first = doc_id THEN 'RESOURCE' ELSE 'REVISIT' END AS record_type,
        CASE WHEN first = doc_id THEN {octets('text')} ELSE 0 END AS size,
        CASE WHEN first = doc_id THEN {sha1_hex('text')} ELSE 'sha1:'||{empty} END AS block_digest,
        CASE WHEN first <> doc_id THEN {urn(record_uuid('first', '0'))} END AS refers_to
        FROM (SELECT *, min(doc_id) OVER (PARTITION BY lang, text) AS first FROM documents)"""


def _headers() -> str:
    listed = ",".join(f"{{'name': '{name}', 'value': {value}}}" for name, value in HEADER_FIELDS)
    return over(
        "headed",
        f"""SELECT request_id, record_num, CAST(pos - 1 AS INTEGER) AS pos, fields[pos].name AS name, fields[pos].value AS value
        FROM (SELECT request_id, record_num, fields, unnest(range(1, len(fields) + 1)) AS pos FROM (
            SELECT request_id, record_num, list_filter([{listed}], lambda f: f.value IS NOT NULL) AS fields FROM headed))""",
    )


def _histogram() -> str:
    rows = [f"SELECT '{edge}' AS le, count(*) FILTER (WHERE value <= {float(edge)}) AS n FROM events" for edge in HISTOGRAM_EDGES]
    return "\nUNION ALL ".join([*rows, "SELECT '+Inf', count(value) FROM events"])


def _next_rotation() -> str:
    steps = {"HOURLY": "hour", "DAILY": "day", "MONTHLY": "month", "YEARLY": "year"}
    waits = " ".join(
        f"WHEN '{policy}' THEN epoch_us(date_trunc('{unit}', fetch_ts) + INTERVAL 1 {unit}) - epoch_us(fetch_ts)"
        for policy, unit in steps.items()
    )
    return over(
        "plain",
        f"""SELECT request_id, record_num, strftime(fetch_ts, {STAMP}) AS ts, policy, micros, micros // 1000000 AS seconds
        FROM (SELECT *, CASE policy {waits} END AS micros FROM ({POLICY_ROWS}))""",
    )


def _message_index() -> str:
    return over(
        "accepted_firsts",
        f"""SELECT k.request_id, k.record_num, CASE WHEN dup THEN 'REVISIT' ELSE k.record_type END AS record_type, k.warc_id,
        k.target_uri, CASE WHEN dup THEN {octets('k.header')} ELSE k.size END AS size,
        CASE WHEN dup THEN 'sha1:'||{base32('sha1(k.header)')} ELSE k.block_digest END AS block_digest, k.payload_digest,
        CASE WHEN dup THEN {urn('first_id')} END AS refers_to, k.cfn AS collection_final_name,
        concat_ws(',', CASE WHEN k.request_id % 23 = 20 THEN {record_uuid('k.request_id', "'extra'")} END,
            s.warc_id) AS concurrent_to
        FROM (SELECT k.*, coalesce(f.request_id <> k.request_id, false) AS dup, f.warc_id AS first_id
            FROM accepted_keyed k LEFT JOIN accepted_firsts f ON k.revisit_key = f.revisit_key) k
        LEFT JOIN accepted_keyed s ON s.request_id = k.request_id AND s.record_num <> k.record_num""",
    )


ORACLE: dict[str, str] = {
    "scan_messages": CONVERSATIONS,
    "scan_config": over("config", "SELECT * EXCLUDE (collection_id) FROM config"),
    "json_decode_lenient": """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS missing
        FROM events""",
    "json_decode_strict": """SELECT event_id AS doc_id,
        ['OK','UNKNOWN_FIELD','MALFORMED','MALFORMED'][event_id % 4 + 1] AS status,
        CASE WHEN event_id % 4 = 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events""",
    "json_decode_nested": """SELECT event_id AS doc_id,
        ['OK','UNKNOWN_FIELD','UNKNOWN_FIELD','UNKNOWN_FIELD'][event_id % 4 + 1] AS status,
        CASE WHEN event_id % 4 = 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events""",
    "json_encode": over(
        "keyed",
        """SELECT request_id, record_num, '{"date":"'||strftime(fetch_ts,'%Y-%m-%dT%H:%M:%S.%fZ')||'"'
        ||coalesce(',"digest":"'||revisit_key||'"','')||',"targetUri":"'||target_uri||'","warcId":"'||warc_id||'"}' AS doc
        FROM keyed""",
    ),
    "date_coerce": RAW_DATE,
    "last_meta": over("metas", "SELECT request_id, target_uri, execution_id FROM metas"),
    "header_twice": over("repeats", "SELECT * FROM repeats"),
    "session_outcome": over("outcomes", "SELECT * FROM outcomes"),
    "assemble_records": ASSEMBLED_CONVERSATIONS,
    "session_records": f"""SELECT request_id, count(*) AS n_records, min(record_num) = 0 AND max(record_num) = count(*) - 1
        AS is_dense FROM (SELECT DISTINCT request_id, record_num FROM ({CONVERSATIONS})) GROUP BY request_id""",
    "session_first_error": over("first_faults", "SELECT * FROM first_faults"),
    "validate_sessions": over("validated", "SELECT request_id, error FROM validated"),
    "session_counts": over(
        "statuses",
        """SELECT status, CASE status WHEN 'OK' THEN 'OK' WHEN 'CANCELLED' THEN 'OK' WHEN 'INVALID_ARGUMENT'
        THEN 'InvalidArgument' ELSE 'Unknown' END AS code, count(*) AS n FROM statuses GROUP BY status""",
    ),
    "join_config": JOINED_CONFIG,
    "join_record_meta": over(
        "assembled record_metas",
        """SELECT a.request_id, a.record_num, m.record_type, m.request_id IS NOT NULL AS has_meta
        FROM assembled a LEFT JOIN record_metas m ON a.request_id = m.request_id AND a.record_num = m.record_num""",
    ),
    "orphan_records": over("described", "SELECT request_id, record_num FROM described WHERE NOT has_meta"),
    "digest_audit": over("plain", DECLARED_DIGESTS),
    "record_type_map": over(
        "plain",
        """SELECT request_id, record_num, t AS record_type, CASE t WHEN 'RESPONSE' THEN 2 WHEN 'RESOURCE' THEN 4
        WHEN 'REQUEST' THEN 8 WHEN 'METADATA' THEN 16 ELSE 0 END AS code, CASE WHEN t = 'OTHER' THEN '' ELSE t END AS back
        FROM (SELECT *, CASE WHEN request_id % 7 = 0 THEN 'OTHER' ELSE record_type END AS t FROM plain)""",
    ),
    "effective_rotation": over(
        "config", f"SELECT collection_id, dedup_policy, rotation_policy, {EFFECTIVE} AS effective FROM config"
    ),
    "rotation_key": over(
        "plain",
        f"SELECT request_id, record_num, policy, {bucket('fetch_ts', 'policy')} AS rotation_key FROM ({POLICY_ROWS})",
    ),
    "next_rotation": _next_rotation(),
    "collection_final_name": over(
        "records config",
        f"""SELECT request_id, record_num, cfn, cfn||'-' AS prefix FROM (SELECT r.*,
        {final_name('c.collection', 'r.sub_collection', bucket('r.fetch_ts', 'c.dedup_policy'))} AS cfn
        FROM ({DNS_SESSIONS}) r JOIN config c ON r.collection_id = c.collection_id)""",
    ),
    "digests": over(
        "records",
        f"""SELECT 'event' AS kind, request_id, record_num, payload_digest, block_digest, size FROM records
        UNION ALL {_page_digests()}""",
    ),
    "digest_base32": over(
        "records",
        f"""SELECT request_id, record_num, 'sha1:'||{base32('header_sha1')} AS header_b32, {base32('block_sha1')} AS b32,
        true AS round_trip FROM (SELECT *, sha1(header) AS header_sha1, sha1(header||payload) AS block_sha1 FROM records)""",
    ),
    "parse_warc_id": over("plain", RAW_ID),
    "revisit_eligible": over(
        "plain", "SELECT request_id, record_num FROM plain WHERE record_type IN ('RESPONSE', 'RESOURCE')"
    ),
    "revisit_key": over(
        "keyed", "SELECT request_id, record_num, revisit_key FROM keyed WHERE revisit_key IS NOT NULL"
    ),
    "first_writer": over("firsts", "SELECT revisit_key, request_id, record_num, target_uri FROM firsts"),
    "first_writer_by_arrival": over(
        "late_keyed",
        f"""SELECT revisit_key, request_id, record_num, bucket FROM (SELECT *, {bucket('fetch_ts', 'dedup_policy')} AS bucket,
        row_number() OVER (PARTITION BY revisit_key ORDER BY request_id * 7919 % 10007, request_id, record_num) AS turn
        FROM late_keyed WHERE revisit_key IS NOT NULL) WHERE turn = 1""",
    ),
    "crawled_required": over(
        "keyed",
        """SELECT request_id, record_num, 'The required field '''||field||''' is missing from: ''crawledContent''' AS error
        FROM (SELECT request_id, record_num, CASE WHEN revisit_key IS NULL OR request_id % 6 = 1 THEN 'digest'
            WHEN request_id % 6 = 2 THEN 'warc_id' WHEN request_id % 6 = 3 THEN 'target_uri'
            WHEN request_id % 6 = 4 THEN 'date' END AS field FROM keyed)""",
    ),
    "crawled_lookup": over(
        "rekeyed firsts",
        """SELECT p.request_id, p.record_num, p.revisit_key, f.warc_id FROM rekeyed p
        LEFT JOIN firsts f ON p.revisit_key = f.revisit_key WHERE p.revisit_key IS NOT NULL""",
    ),
    "crawled_insert": over(
        "firsts refirsts",
        f"""SELECT revisit_key AS digest, warc_id, target_uri, strftime(fetch_ts, {STAMP}) AS date FROM firsts
        UNION ALL SELECT revisit_key, warc_id, target_uri, strftime(fetch_ts, {STAMP}) FROM refirsts
        WHERE revisit_key NOT IN (SELECT revisit_key FROM firsts)""",
    ),
    "crawled_merge": over(
        "firsts",
        f"""SELECT revisit_key AS digest, warc_id, target_uri, strftime(fetch_ts, {STAMP}) AS date FROM firsts""",
    ),
    "revisit_detect": DECISIONS,
    "revisit_documents": _documents(),
    "revisit_records": over(
        "rewritten",
        """SELECT request_id, record_num, record_type, size, block_digest, profile, refers_to, refers_to_uri, refers_to_date
        FROM rewritten""",
    ),
    "concurrent_to": over(
        "keyed",
        """SELECT a.request_id, a.record_num, b.warc_id AS sibling FROM keyed a JOIN keyed b
        ON a.request_id = b.request_id AND a.record_num <> b.record_num""",
    ),
    "warc_headers": _headers(),
    "rotation_groups": over(
        "rewritten",
        "SELECT file_group, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM rewritten GROUP BY file_group",
    ),
    "file_offsets": over(
        "rewritten",
        f"""SELECT file_group, lane, serial, request_id, record_num, "offset", size
        FROM ({offsets_of('rewritten', 'size')})""",
    ),
    "storage_ref": over("placed", "SELECT request_id, record_num, storage_ref FROM placed"),
    "warcinfo": over("named", "SELECT DISTINCT file_name, body FROM named"),
    "write_index": over(
        "placed",
        """SELECT request_id, record_num, record_type, warc_id, storage_ref, block_digest, payload_digest,
        coalesce(refers_to, '') AS revisit_ref, cfn AS collection_final_name FROM placed""",
    ),
    "reply_map": over("placed", "SELECT request_id, record_num, record_type, storage_ref FROM placed"),
    "message_index": _message_index(),
    "archive_batches": f"""SELECT request_id, record_num, true AS is_unique, true AS intact FROM ({_message_index()})""",
    "archive_ingest_clock": f"""SELECT request_id, record_num, true AS is_unique, true AS intact FROM ({_message_index()})""",
    "warc_write": over(
        "rewritten",
        """SELECT request_id, record_num, record_type, block_digest, upper(block_sha1) AS block_sha1, size,
        size AS content_length FROM (SELECT r.*, CASE WHEN r.is_revisit THEN sha1(p.header) ELSE sha1(p.header||p.payload) END
        AS block_sha1 FROM rewritten r JOIN plain p ON r.request_id = p.request_id AND r.record_num = p.record_num)""",
    ),
    "warc_write_pages": f"""SELECT page_id AS request_id, 0 AS record_num,
        CASE WHEN first = page_id THEN 'RESPONSE' ELSE 'REVISIT' END AS record_type,
        CASE WHEN first = page_id THEN {sha1_hex(f"{RESPONSE_HEAD}||html")} ELSE 'sha1:'||{base32(f"sha1({RESPONSE_HEAD})")} END
            AS block_digest,
        upper(sha1(block)) AS block_sha1, {octets('block')} AS size, {octets('block')} AS content_length
        FROM (SELECT *, CASE WHEN first = page_id THEN {RESPONSE_HEAD}||html ELSE {RESPONSE_HEAD} END AS block
            FROM (SELECT *, min(page_id) OVER (PARTITION BY page_id % 2, html) AS first FROM pages))""",
    "writer_load": over(
        "records",
        f"""SELECT collection_id||'#'||sub_collection AS writer_key, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes
        FROM ({DNS_SESSIONS}) GROUP BY ALL""",
    ),
    "bucket_counts": over(
        "plain",
        f"""SELECT policy, {bucket('fetch_ts', 'policy')} AS bucket, count(*) AS n FROM ({POLICY_ROWS}) GROUP BY ALL""",
    ),
    "bucket_histogram": _histogram(),
    "stream_sessions": ASSEMBLED_CONVERSATIONS,
    "stream_outcomes": over("outcomes", "SELECT request_id, status FROM outcomes"),
    "stream_archive": f"""SELECT request_id, record_num, record_type, warc_id, block_digest, payload_digest,
        collection_final_name FROM ({_message_index()})""",
    "stream_revisit": DECISIONS,
    "stream_revisit_state": DECISIONS,
    "stream_config_refresh": JOINED_CONFIG,
}
