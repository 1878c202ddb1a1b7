"""Document fingerprints by winnowing.

Every run of ``k`` bytes of a text is hashed with a rolling polynomial; of every ``window``
consecutive hashes the smallest is chosen, the rightmost where values tie.  Two texts
that share ``window + k - 1`` bytes share a chosen hash, and no match below ``k`` bytes is reported.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.arrays import PrefixHash, window_minima


@dataclass(frozen=True)
class WinnowParams:
    k: int = 16
    window: int = 32


def winnow(raw: bytes, params: WinnowParams) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their byte positions, in text order.

    A text shorter than ``k`` has one hash, of itself; one with fewer than ``window`` runs has their minimum;
    an empty text has none.
    """
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(params.k, len(data))
    h = PrefixHash(data).windows(k)
    at = window_minima(h, min(params.window, len(h)))
    keep = np.ones(len(at), bool)
    keep[1:] = at[1:] != at[:-1]
    at = at[keep]
    return h[at], at


def fingerprints(docs: DataFrame, params: WinnowParams | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_chars, hashes and positions (in code points) of the chosen runs, in text order.

    Null and empty texts have empty lists; equal texts have equal lists.  Repeated rows are kept.
    """
    params = params or WinnowParams()
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            chars, hashes, places = [], [], []
            for raw in texts:
                raw = raw or b""
                h, at = winnow(raw, params)
                point = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
                chars.append(int(point[-1]) + 1 if len(point) else 0)
                hashes.append(h.view(np.int64))
                places.append(point[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chars, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))],
                names=[id_column, "n_chars", "hashes", "positions"],
            )

    source = docs.select(id_column, F.col(text_column).cast("binary").alias("text"))
    return source.mapInArrow(run, f"`{id_column}` {kind}, n_chars bigint, hashes array<bigint>, positions array<bigint>")


def sketch(raw: bytes, params: WinnowParams) -> np.ndarray:
    """The chosen hashes as a sorted set of 32-bit numbers."""
    return np.unique((winnow(raw, params)[0] >> np.uint64(32)).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes of two sketches over their mean size; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    return 2.0 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


#: Cells of equal width into which ids are counted, and rows of a bucket of neighbouring ids.
CELLS, BUCKET_ROWS = 1 << 16, 1000


def _looked_up(values: list[int], index: Column) -> Column:
    """Entry of a list of numbers (0 and above) at a row's index; the list travels as one binary literal."""
    packed = F.lit(bytearray(b"".join(v.to_bytes(8) for v in values)))
    return F.conv(F.hex(F.substring(packed, (index * 8 + 1).cast("int"), F.lit(8))), 16, 10).cast("long")


def _buckets(docs: DataFrame, key: Column) -> DataFrame:
    """Rows dealt to buckets of consecutive keys (column ``bucket``), the first rows of each also to the bucket before it as guests.

    Only a histogram with a bounded number of cells and one row for each bucket reach the driver.
    """
    low, high = docs.agg(F.min(key), F.max(key)).first()
    if low is None:
        low = high = 0
    width = max(1.0, (high - low + 1) / CELLS)
    cell = F.coalesce(F.least(F.lit(CELLS - 1), F.floor((key - F.lit(low)) / F.lit(width))), F.lit(0)).cast("int")
    counts = dict(docs.groupBy(cell.alias("cell")).count().collect())
    bucket_of, last, filled = [], 0, 0
    for c in range(CELLS):
        n = counts.get(c, 0)
        if filled and filled + n > BUCKET_ROWS:
            last, filled = last + 1, 0
        bucket_of.append(last)
        filled += n
    bucket = _looked_up(bucket_of, cell)
    # Null keys lie in the first bucket, in front of all others.
    found = docs.groupBy(bucket.alias("bucket")).agg(F.min(key).alias("first"), F.max(key.isNull()).alias("nulls")).collect()
    order = sorted(r["bucket"] for r in found)
    first = {r["bucket"]: r["first"] for r in found}
    nulls = any(r["nulls"] for r in found)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    previous = _looked_up([before.get(b, 0) for b in range(last + 1)], bucket)
    least = _looked_up([(first.get(b) if first.get(b) is not None else low) - low for b in range(last + 1)], bucket) + F.lit(low)
    leads = key.isNull() | ((key == least) & (bucket != F.lit(order[0]))) if nulls else key == least
    stays = F.struct(bucket.alias("bucket"), F.lit(0).alias("guest"))
    visits = F.struct(previous.alias("bucket"), F.lit(1).alias("guest"))
    both = F.when(leads, F.array(stays, visits)).otherwise(F.array(stays))
    return docs.withColumn("_place", F.explode(both)).select("*", "_place.bucket", "_place.guest").drop("_place")


def edited_neighbours(docs: DataFrame, params: WinnowParams | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text, the same with its last quarter replaced by the start of the next text, and how alike they are.

    The order is that of ascending (integer) ids, nulls first, rows with equal ids by their texts; the first follows the last.
    One shuffle brings neighbours together: buckets of consecutive ids, read in order, with the first row of
    the next bucket as a guest.  Null texts are empty.  Repeated rows are neighbours.  An empty table gives none.
    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    import hashlib

    params = params or WinnowParams()
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    placed = _buckets(source, F.col("id")).repartition(F.col("bucket")).sortWithinPartitions("bucket", "guest", "id", "text")
    names = [id_column, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def text_of(s: np.ndarray) -> str:
        return s.astype(">u4").tobytes().hex()

    def run(batches):
        current = None  # id, text, sketch of the row that waits for its successor
        at = None
        for batch in batches:
            ids, texts, buckets, guests = (batch.column(k).to_pylist() for k in range(4))
            out = []
            for doc, text, bucket, guest in zip(ids, texts, buckets, guests, strict=True):
                if bucket != at:
                    current, at = None, bucket
                if guest and current is None:
                    continue
                own = sketch(text.encode(), params)
                if current is not None:
                    before, old, known = current
                    cut = len(old) // 4
                    edited = (old[: len(old) - cut] + text[:cut]).encode()
                    changed = sketch(edited, params)
                    out.append((before, len(old), hashlib.sha256(edited).hexdigest(), text_of(known), text_of(changed), likeness(known, changed), likeness(known, own)))
                current = None if guest else (doc, text, own)
            if out:
                kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = f"`{id_column}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return placed.select("id", "text", "bucket", "guest").mapInArrow(run, schema)
