"""Query op3_fixity: an audit of all pages, as archive records, against a replica with bit rot.

The tables hold one copy of the pages, so the second replica is made from it: a hash of the page's identifier picks
records whose payload is changed, cut by a character, or lost. Both replicas are read whole and audited whole.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixity import PAGES_PER_FILE, audit, digest_of, file_of, laid_out, warc_record
from .shared import Scratch, table, text_or_empty

#: Of so many records about one suffers each kind of rot.
ROT = 499


def op3_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    html = text_or_empty(pages["html"])
    rot = F.conv(F.substring(F.md5(F.concat(F.lit("rot:"), text_or_empty(pages["page_id"])).cast("binary")), 1, 8), 16, 10).cast("long") % ROT
    spoilt = F.when(rot == 0, F.concat(F.lit("?"), F.substring(html, 2, 2**31 - 1))).when(rot == 1, F.substring(html, 1, F.length(html) - 1))
    record = warc_record(pages["page_id"], pages["url"], html)
    stored = F.when(rot < 2, warc_record(pages["page_id"], pages["url"], spoilt)).when(rot > 2, record)
    rows = pages.select(
        "page_id", file_of(pages["page_id"], record).alias("file"), F.octet_length(record).cast("long").alias("length"),
        digest_of(record).alias("digest"), digest_of(stored).alias("stored"),
    )
    slots = Scratch(spark, "fixity-slots").save(laid_out(rows, ["page_id", "digest"]), "slots")
    original = slots.drop("stored")
    replica = slots.filter("stored IS NOT NULL").select("file", "offset", "length", F.col("stored").alias("digest"))
    found, _ = audit(original, replica)
    return found.select("page_id", "file", "offset", "length", "digest", "replica_digest", "state")


QUERIES = {"op3_fixity": op3_fixity}

ORACLE_SQL = {
    "op3_fixity": f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, coalesce(page_id::VARCHAR, '') AS id,
             ('0x' || substr(md5('rot:' || coalesce(page_id::VARCHAR, '')), 1, 8))::BIGINT % {ROT} AS rot FROM pages),
q AS (SELECT *, CASE rot WHEN 0 THEN '?' || substr(html, 2) WHEN 1 THEN substr(html, 1, length(html) - 1) ELSE html END AS spoilt FROM p),
r AS (SELECT page_id, rot,
        'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || id || '>' || chr(13) || chr(10)
          || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' AS head,
        chr(13) || chr(10) || chr(13) || chr(10) AS gap, html, spoilt FROM q),
s AS (SELECT page_id, rot, head || octet_length(encode(html))::VARCHAR || gap || html || gap AS record,
        head || octet_length(encode(spoilt))::VARCHAR || gap || spoilt || gap AS stored FROM r),
t AS (SELECT page_id, coalesce(floor(page_id / {PAGES_PER_FILE})::BIGINT, -1 - ('0x' || substr(md5(record), 1, 2))::BIGINT % 64) AS file,
        octet_length(encode(record))::BIGINT AS length, sha256(record) AS digest, CASE WHEN rot = 2 THEN NULL ELSE sha256(stored) END AS stored FROM s)
SELECT page_id, file, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
       length, digest, stored AS replica_digest,
       CASE WHEN stored IS NULL THEN 'missing' WHEN stored <> digest THEN 'corrupt' ELSE 'ok' END AS state
FROM t
""",
}
