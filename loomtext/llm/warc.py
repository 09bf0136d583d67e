"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing. A record is one string that ends with the CRLF CRLF which the writer puts between lines; records of equal
payloads of at least `least` bytes refer to the one with the smallest page_id (a revisit without payload).

Reading. Files are split anywhere. Each piece from one magic line to the next is a candidate record, with the
offset of its successor from its Content-Length. A payload may hold the magic itself, so candidates count only if
the chain from the file's start reaches them: chains are first contracted inside a split, then pointers between
splits are doubled until nothing new is reached, and each split walks from its entry. The walk also gives every piece
its owner, the last reached record before it: a record whose payload holds magic lines, whole records even, is put
together from its pieces. What may lie in an earlier candidate is kept with the piece; archives are scanned again
only for pieces that turn out to be owned without that (a payload over splits, or of over LONGEST bytes).

Defined results. Null html is an empty payload. A null page_id is written without an id and read as null. Line
breaks in a url become spaces; a null url is left out. Rows with one page_id and payload are separate records;
the first is the response only by page_id, so rows that share the smallest page_id are all responses.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import batches_by_bytes, goes_with_session, released, scratch, settled, small_batches

VERSION = "WARC/1.0"
END = "\r\n\r\n"
#: Repeated payloads of one broadcast (about 100 bytes each).
MOST_BROADCAST = 200_000
MAGIC = len(VERSION) + 1
DELIMITER = f"\n{VERSION}\r"  # no proper prefix of it is a suffix, so it is found alike from any split


def records(pages: DataFrame, least: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(value): a record for each page, without the CRLF CRLF at its end."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    first = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = settled(first)
    if first.count() <= MOST_BROADCAST:  # payloads that occur more than once; beyond it pages are shuffled
        first = F.broadcast(first)
    rows = rows.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & F.coalesce(F.col("page_id") != F.col("first"), F.lit(True))

    def line(name: str, value) -> F.Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))

    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:>"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Refers-To", F.when(revisit, urn(F.col("first")))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.col("html"))).alias("value"))


def write(pages: DataFrame, path: str, least: int = 100) -> None:
    records(pages, least).write.option("lineSep", END).text(path)


#: Claimed lengths up to which what follows is kept, as it may be part of the claimant.
LONGEST = 16 << 20

_HEAD = re.compile(rb"(?im)^([A-Za-z-]+):[ \t]*(.*?)[ \t]*\r$")
_PIECE = "file long, block long, rel long, size long, head int, length long, kind string, page long, refers long, digest string, payload long, whole boolean, content binary"


def _number(urn: bytes | None) -> int | None:
    m = re.search(rb"<urn:page:(-?\d+)>", urn or b"")
    return int(m[1]) if m else None


def _parse(body: bytes) -> dict:
    """What a piece's header says; body starts behind the magic's carriage return."""
    at = body.find(b"\r\n\r\n")
    head = {k.lower(): v for k, v in _HEAD.findall(body[: at + 2])} if at >= 0 else {}
    n = head.get(b"content-length", b"")
    return {"head": at + 4 if at >= 0 else 0, "length": int(n) if n.isdigit() and len(n) < 18 else None, "kind": head.get(b"warc-type", b"").decode("latin-1"), "page": _number(head.get(b"warc-record-id")), "refers": _number(head.get(b"warc-refers-to"))} | {
        "digest": head.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:")
    }


def _payload(block: bytes) -> tuple[int, bytes]:
    """The length that the HTTP header states, and the payload behind it."""
    at = block.find(b"\r\n\r\n")
    m = re.search(rb"(?im)^content-length:[ \t]*(\d+)", block[: max(0, at)])
    return int(m[1]) if m else 0, block[at + 4 :]


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Every piece between magic lines with its offset in its split; files are named by a hash of their path. Whole
    records are digested at once; the content of others, and of what an earlier candidate claims, comes along."""
    return _scan(spark, path, lambda body, p, claimed: body if claimed or not p["whole"] else None, _PIECE)


def _scan(spark: SparkSession, path: str, content, schema: str) -> DataFrame:
    rows = spark.read.option("lineSep", DELIMITER).text(path)
    rows = rows.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))

    def run(batches):
        split, rel, claimed = None, 0, 0
        for b in batches_by_bytes(batches, "value", 4 << 20):
            out = []
            for file, block, body in zip(*(c.to_pylist() for c in b.columns)):
                if (file, block) != split:
                    split, rel, claimed = (file, block), 0, 0
                    if block == 0:
                        own = f"{VERSION}\r".encode()
                        if not body.startswith(own):
                            raise ValueError("an archive does not start with a record")
                        body, rel = body[len(own) :], len(own)
                p = _parse(body)
                row = {"file": file, "block": block, "rel": rel, "size": len(body) + len(DELIMITER), "payload": None} | p
                # a whole record is followed by CRLF CRLF, whose last \n begins the delimiter; at a file's end it is there
                rest = body[p["head"] + p["length"] :] if p["length"] is not None else None
                row["whole"] = rest in (b"\r\n\r", b"\r\n\r\n")
                if row["whole"]:
                    stated, payload = _payload(body[p["head"] : p["head"] + p["length"]])
                    row["payload"] = stated if p["kind"] == "revisit" else len(payload)
                    if p["kind"] != "revisit":
                        row["digest"] = hashlib.sha256(payload).hexdigest()
                row["content"] = content(body, row, rel - MAGIC < claimed)
                out.append(row)
                if p["length"] is not None and p["length"] <= LONGEST:
                    claimed = max(claimed, rel + p["head"] + p["length"] + len(END))
                rel += row["size"]
            yield pa.RecordBatch.from_pylist(out, schema=_schema)

    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    _schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in schema.split(", ")])
    return rows.mapInArrow(released(run), schema)


def _offsets(rows: list[tuple], *names: str) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, cols)})


def chain(pieces: DataFrame) -> DataFrame:
    """(file, block, at, reached, owner, owner_end) of pieces (file, block, at, next): whether the chain from offset 0
    of the file reaches it, and the last reached piece of its split up to it, with where that one ends."""
    candidates = pieces.where("next IS NOT NULL")

    def contract(key, table):
        leaves: dict[int, int] = {}
        for at, after in sorted(zip(table["at"].to_pylist(), table["next"].to_pylist()), reverse=True):
            leaves[at] = leaves.get(after, after)
        return _offsets([(key[0].as_py(), at, after) for at, after in leaves.items()], "file", "at", "next")

    jump = settled(candidates.groupBy("file", "block").applyInArrow(contract, "file long, at long, next long"))
    reached = settled(jump.where("at = 0").select("file", "at"))
    n = reached.count()
    while True:
        step = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        more = step.join(jump.select("file", "at"), ["file", "at"], "left_semi")
        reached = settled(reached.unionByName(more).distinct())
        now = reached.count()
        if now == n:
            break
        n = now
        on = jump.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        jump = settled(jump.join(on, ["file", "next"], "left").select("file", "at", F.coalesce("far", "next").alias("next")))

    entries = settled(reached.join(candidates.select("file", "at", "block"), ["file", "at"]).select("file", "block", F.col("at").alias("entry")))

    def walk(key, left, right):
        after = dict(zip(left["at"].to_pylist(), left["next"].to_pylist()))
        reached: set[int] = set()
        last = -1
        for at in sorted(right["entry"].to_pylist()):
            while after.get(at) is not None and at > last:
                reached.add(at)
                last, at = at, after[at]
        file, block = (k.as_py() for k in key)
        out, owner = [], None
        for at in sorted(after):
            owner = at if at in reached else owner
            out.append((file, block, at, int(at in reached), owner, after.get(owner)))
        return _offsets(out, "file", "block", "at", "reached", "owner", "owner_end")

    return pieces.groupBy("file", "block").cogroup(entries.groupBy("file", "block")).applyInArrow(walk, "file long, block long, at long, reached long, owner long, owner_end long")


_DONE = "page long, payload long, digest string, kind string, refers long"


def _mend(table):
    """One record from the pieces up to its successor."""
    parts = sorted(table.to_pylist(), key=lambda r: r["at"])
    first = parts[0]
    body = DELIMITER.encode().join(r["content"] for r in parts)
    stated, payload = _payload(body[first["head"] : first["head"] + first["length"]])
    revisit = first["kind"] == "revisit"
    size, digest = (stated, first["digest"]) if revisit else (len(payload), hashlib.sha256(payload).hexdigest())
    return pa.table({"page": pa.array([first["page"]], pa.int64()), "payload": pa.array([size], pa.int64()), "digest": [digest], "kind": [first["kind"]], "refers": pa.array([first["refers"]], pa.int64())})


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives."""
    found = settled(pieces(spark, path))
    splits = found.groupBy("file", "block").agg(F.sum("size").alias("bytes"), F.min("rel").alias("lead"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split of a file
    splits = settled(splits.select("file", "block", F.coalesce(F.sum(F.col("bytes") + F.col("lead")).over(before), F.lit(0)).alias("base")))
    at = found.join(splits, ["file", "block"]).withColumn("at", F.col("base") + F.col("rel") - MAGIC)
    at = at.withColumn("next", F.col("at") + MAGIC + F.col("head") + F.col("length") + len(END))
    owned = settled(chain(at.select("file", "block", "at", "next")))
    # pieces before the first reached one of a split belong to the last one of an earlier split
    tails = owned.groupBy("file", "block").agg(F.max(F.when(F.col("reached") == 1, F.struct("at", "owner_end"))).alias("tail"))
    tails = tails.select("file", "block", F.max("tail").over(before).alias("tail"))
    owned = owned.join(tails, ["file", "block"])
    owned = owned.select("file", "at", (F.col("reached") == 1).alias("ok"), F.coalesce("owner", "tail.at").alias("owner"), F.coalesce("owner_end", "tail.owner_end").alias("end"))
    kept = settled(at.join(owned, ["file", "at"]))
    out = kept.where("ok AND whole").select("page", "payload", "digest", "kind", "refers")
    parts = kept.where("NOT (ok AND whole) AND at < end").select("file", "block", "rel", "owner", "at", "content", "head", "length", "page", "kind", "digest", "refers")
    lost = settled(parts.where("content IS NULL").select("file", "block", "rel"))
    if not lost.isEmpty():
        again = _scan(spark, path, lambda body, p, claimed: body, _PIECE).join(lost, ["file", "block", "rel"], "left_semi").select("file", "block", "rel", F.col("content").alias("more"))
        parts = parts.join(again, ["file", "block", "rel"], "left").withColumn("content", F.coalesce("content", "more"))
    out = out.unionByName(parts.drop("block", "rel", "more").groupBy("file", "owner").applyInArrow(released(_mend), _DONE))
    return out.select(F.col("page").alias("page_id"), F.col("payload").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = scratch(spark)
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    goes_with_session(spark, path)
    return read(spark, path)


OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR first = page_id THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""
