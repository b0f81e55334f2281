"""WARC archives: written by Spark's text writer, read back in splits with boundary-chain verification.

Writing. Each page is a record `WARC/1.1`, uncompressed. Of pages with equal payloads of at least
`least` bytes, that with the largest page_id is a response; the others are revisits that refer to it
by record id and payload digest and hold no payload. A record ends in CR LF CR LF; the last LF is the
writer's line end, so archives are plain WARC files, committed by Spark's task commit protocol.

Reading. The text reader splits archives at every `WARC/1.1` CR LF, also at those inside payloads, so
tasks see candidates only. A candidate whose header parses points to its successor, the offset
behind its content. Each split first follows its own candidates to the first offset beyond the
split; pointer jumping over these exits, in as many rounds as the logarithm of the splits of a file,
then tells which candidates the chain from offset 0 reaches. Only those are records; the rest is
payload. A record's payload is hashed in its split; payloads that hold a magic, and so span several
pieces, are put together from the pieces between a record and its successor in a second pass.

Record ids hold the page_id, the payload's digest and a number that no other record of both has, so
pages that repeat a page_id keep their own payloads.

Defined cases: null html is an empty payload; with least=0, empty payloads are equal payloads like
any other; repeated rows are records of their own, revisits except one (the largest page_id, then
one of them chosen by its url); rows that repeat a page_id with another html are records with payloads
of their own; a null page_id is smaller than any other; null urls are written as `urn:null`; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peptrail.llm.common import Scratch, in_arrow, small_enough

MAGIC = "WARC/1.1\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
HEADER = re.compile(rb"((?:[A-Za-z-]+: [^\r\n]*\r\n)+)\r\n")


def base32(hex40: Column) -> Column:
    """Base32 of a SHA-1 given as 40 hexadecimal digits: five of these are four digits of 32."""
    parts = [F.lpad(F.conv(F.substring(hex40, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def record_id(page_id: Column, digest: Column, copy: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(":"), copy.cast("string"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, scratch: Scratch, least: int = 0) -> None:
    """Write pages(page_id, url, html) as WARC files under path.

    What the records need but their payloads is written first, a row per page; revisits are made from it alone. A
    response is looked up in the pages by its digest, page_id and url, and where rows repeat these too one is taken.
    """
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit("urn:null"))
    clean = F.regexp_replace(url, r"[\r\n]", "")
    rows = pages.select("page_id", clean.alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    facts = rows.select("page_id", "url", "sha1", F.octet_length("html").alias("bytes"), (F.monotonically_increasing_id() + 1).alias("n"))
    facts = scratch.keep(facts, "facts")
    groups = facts.where(F.col("bytes") >= least).groupBy("sha1").agg(F.max(F.struct("page_id", "url", "n")).alias("first"), F.count("*").alias("m")).where("m > 1")
    groups = scratch.keep(groups.select("sha1", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.n").alias("first_n")), "groups")
    few = F.broadcast(groups) if small_enough(groups, 200_000) else groups
    revisits = facts.join(few, "sha1").where("n <> first_n")
    same = (F.col("page_id").eqNullSafe(F.col("first_id"))) & (F.col("url") == F.col("first_url"))
    twice = scratch.keep(revisits.where(same).select("sha1").distinct(), "twice")
    tagged = rows.join(few, "sha1", "left")
    alone = tagged.where("first_n is null").withColumn("copy", F.monotonically_increasing_id() + 1)
    first = tagged.where(F.col("first_n").isNotNull() & same).withColumn("copy", F.lit(0).cast("long"))
    if not twice.isEmpty():
        some = F.broadcast(twice) if small_enough(twice, 200_000) else twice
        names = [c for c in first.columns if c != "sha1"]
        one = first.join(some, "sha1", "left_semi").groupBy("sha1").agg(*(F.first(c).alias(c) for c in names))
        first = first.join(some, "sha1", "left_anti").unionByName(one)
    whole = alone.unionByName(first).select("page_id", "url", "sha1", "copy", F.lit("response").alias("type"), F.concat(F.lit(HTTP), "html").alias("block"), F.lit("").alias("extra"))
    refers = record_id(F.col("first_id"), base32(F.upper("sha1")), F.lit(0))
    profile = F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")
    again = revisits.select("page_id", "url", "sha1", F.col("n").alias("copy"), F.lit("revisit").alias("type"), F.lit(HTTP).alias("block"), F.concat(profile, line("WARC-Refers-To", refers)).alias("extra"))
    digest = base32(F.upper("sha1"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.col("type")),
        line("WARC-Record-ID", record_id(F.col("page_id"), digest, F.col("copy"))),
        line("WARC-Target-URI", F.col("url")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.col("extra"),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    whole.unionByName(again).select(F.concat(head, "block", F.lit("\r\n\r")).alias("value")).write.option("lineSep", "\n").text(path)


def line(name: str, value: Column) -> Column:
    """A header line."""
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archives' pieces between magics, in no order: value (raw bytes), file and the split's start."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def parse(piece: bytes) -> dict | None:
    """Header fields of a candidate (lower-case names), `body` (where its content begins) and `size`; None if it is no header."""
    if not (m := HEADER.match(piece)):
        return None
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in m[1].decode("utf-8", "replace").split("\r\n")[:-1])}
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return fields | {"body": m.end(), "size": int(fields["content-length"])}


def facts(content: bytes) -> tuple[int, str]:
    """Payload bytes and digest of a record's content, an HTTP message."""
    _, _, payload = content.partition(b"\r\n\r\n")
    return len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()


SCHEMA = "file string, split long, place long, at long, length long, size long, body long, type string, id string, digest string, refers string, bytes long, seen string"


def scan(batches) -> Iterator:
    """Candidates: place (number of the piece in its split), at (where its bytes begin in the split), fields, and payload facts if it is whole."""
    import pyarrow as pa

    here, place, at = None, 0, 0
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for value, file, split in zip(*(batch.column(i) for i in range(3))):
            value, key = value.as_py(), (file.as_py(), split.as_py())
            if key != here:
                here, place, at = key, 0, 0
            f = parse(value) or {}
            whole = f and f["body"] + f["size"] <= len(value)
            bytes_, seen = facts(value[f["body"] : f["body"] + f["size"]]) if whole else (None, None)
            rows.append((*key, place, at, len(value), f.get("size"), f.get("body"), f.get("warc-type"), f.get("warc-record-id"), f.get("warc-payload-digest"), f.get("warc-refers-to"), bytes_, seen))
            place, at = place + 1, at + len(value) + len(MAGIC)
        if rows:
            kinds = [pa.string(), *[pa.int64()] * 6, *[pa.string()] * 4, pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)


def local_exits(rows: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a split the first offset of its chain beyond the split, by following links from the last to the first."""
    rows = rows.sort_values("offset").reset_index(drop=True)
    exits: dict[int, int] = {}
    offsets, nexts = rows["offset"].tolist(), rows["next"].tolist()
    for o, n in zip(reversed(offsets), reversed(nexts)):
        exits[o] = exits.get(n, n)
    return rows.assign(exit=[exits[o] for o in offsets])


def reach(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split that the chains from its entries reach."""
    links, good = dict(zip(rows["offset"], rows["next"])), set()
    for at in entry["entry"] if len(entry) else ():
        while at in links and at not in good:
            good.add(at)
            at = links[at]
    return rows[rows["offset"].isin(good)]


def verified(spark: SparkSession, path: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Records that the chain from each file's start reaches, with their offsets; and the offset at which each split's pieces start."""
    found = scratch.keep(in_arrow(pieces(spark, path), scan, SCHEMA), "candidates")
    spans = found.groupBy("file", "split").agg(F.sum(F.col("length") + len(MAGIC)).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.keep(spans.select("file", "split", before.alias("start")), "starts")
    # a piece's magic stands in front of it; the piece before a file's first magic has none
    known = found.where("size is not null").join(starts, ["file", "split"]).withColumn("offset", F.col("start") + F.col("at") - len(MAGIC))
    known = known.where("offset >= 0").withColumn("next", F.col("offset") + len(MAGIC) + F.col("body") + F.col("size") + 4)
    links = known.select("file", "split", "offset", "next")
    exits = scratch.keep(links.groupBy("file", "split").applyInPandas(local_exits, "file string, split long, offset long, next long, exit long"), "exits")
    jump = exits.select("file", "offset", "split", F.col("exit").alias("to"))
    reached = jump.where("offset = 0").select("file", "offset", "split")
    # the reached entries double each round: those so far, and what lies 2^round splits behind them
    while True:
        step = jump.select("file", F.col("offset").alias("offset"), "to").join(reached, ["file", "offset"], "left_semi")
        ahead = jump.select("file", "offset", "split").join(step.select("file", F.col("to").alias("offset")), ["file", "offset"], "left_semi")
        more = scratch.keep(ahead.join(reached, ["file", "offset"], "left_anti"), "reached")
        if more.isEmpty():
            break
        reached = reached.unionByName(more)
        jump = scratch.keep(jump.join(jump.select("file", F.col("offset").alias("to"), F.col("to").alias("beyond")), ["file", "to"], "left").select("file", "offset", "split", F.coalesce("beyond", "to").alias("to")), "jump")
    entries = reached.select(F.col("file").alias("of_file"), F.col("split").alias("of_split"), F.col("offset").alias("entry"))
    good = exits.groupBy("file", "split").cogroup(entries.groupBy("of_file", "of_split")).applyInPandas(lambda x, e: reach(x, e)[["file", "offset"]], "file string, offset long")
    return known.join(good, ["file", "offset"]), starts


def torn_payloads(spark: SparkSession, path: str, torn: DataFrame, starts: DataFrame) -> DataFrame:
    """Facts of records whose content spans several pieces, from the pieces between a record and its successor."""

    def cut(batches):
        import pyarrow as pa

        here, at = None, 0
        for batch in batches:
            rows = []
            for value, file, split in zip(*(batch.column(i) for i in range(3))):
                value, key = value.as_py(), (file.as_py(), split.as_py())
                if key != here:
                    here, at = key, 0
                rows.append((*key, at, value))
                at += len(value) + len(MAGIC)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["file", "split", "at", "value"])

    parts = in_arrow(pieces(spark, path), cut, "file string, split long, at long, value binary").join(F.broadcast(starts) if small_enough(starts, 100_000) else starts, ["file", "split"])
    parts = parts.select("file", (F.col("start") + F.col("at") - len(MAGIC)).alias("p"), "value").where("p >= 0")
    cell = 1 << 20  # a record meets the cells that it covers, so that the join has an equal key
    wide = torn.select("file", "offset", "next", "body", "size", F.explode(F.sequence(F.floor(F.col("offset") / cell), F.floor((F.col("next") - 1) / cell))).alias("cell"))
    hit = parts.withColumn("cell", F.floor(F.col("p") / cell)).join(wide, ["file", "cell"]).where("p >= offset and p < next")

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p")
        first = rows.iloc[0]
        content = MAGIC.encode().join(rows["value"])[first["body"] : first["body"] + first["size"]]
        n, seen = facts(content)
        return pd.DataFrame({"file": [first["file"]], "offset": [first["offset"]], "bytes": [n], "seen": [seen]})

    return hit.select("file", "offset", "p", "value", "body", "size").groupBy("file", "offset").applyInPandas(whole, "file string, offset long, bytes long, seen string")


def read_archives(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """One row per verified record: file, offset, type, id, refers, bytes and digest of its payload (of the one it refers to, for a revisit).

    A response's digest is computed from what was read; a mismatch with its header raises.
    """
    records, starts = verified(spark, path, scratch)
    records = scratch.keep(records, "records")
    torn = records.where("seen is null").select("file", "offset", "next", "body", "size")
    if not torn.isEmpty():
        joined = torn_payloads(spark, path, torn, starts)
        records = records.join(joined.withColumnsRenamed({"bytes": "b", "seen": "s"}), ["file", "offset"], "left").withColumns({"bytes": F.coalesce("bytes", "b"), "seen": F.coalesce("seen", "s")}).drop("b", "s")
    own = F.concat(F.lit("sha1:"), F.col("seen"))
    responses = records.where("type = 'response'").withColumn("digest", F.when(own == F.col("digest"), F.col("seen")).otherwise(F.raise_error(F.concat(F.lit("digest mismatch in "), F.col("id")))))
    responses = responses.select("file", "offset", "type", "id", F.lit(None).cast("string").alias("refers"), "bytes", "digest")
    origin = responses.select(F.col("id").alias("refers"), F.col("bytes").alias("origin_bytes"), F.col("digest").alias("origin_digest"))
    revisits = records.where("type = 'revisit'").select("file", "offset", "type", "id", "refers")
    used = scratch.keep(origin.join(revisits.select("refers").distinct(), "refers", "left_semi"), "origins")
    revisits = revisits.join(F.broadcast(used) if small_enough(used, 200_000) else used, "refers", "left")
    revisits = revisits.select("file", "offset", "type", "id", "refers", F.col("origin_bytes").alias("bytes"), F.col("origin_digest").alias("digest"))
    return responses.unionByName(revisits)
