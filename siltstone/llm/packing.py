"""Best-fit packing under conflicts.

Texts are packed into sequences (bins) of ``capacity`` length units. Bins are ordered by what is left in them; an item
goes to the tightest bin that holds it and that it does not conflict with: a bin takes one document of each duplicate
cluster and ``per_source`` documents of each source. Each bin carries bitmaps of both; the successor search walks from
the smallest sufficient residual upwards until a compatible bin is found, else a new bin is opened. Items longer than a
bin are cut into full pieces, which fill bins of their own, and a remainder, which is packed.

Only ids, lengths, sources and clusters are shuffled, to groups of about ``group_rows`` documents drawn by a hash of
the whole row, so a hot source or cluster is spread over all groups; each group is packed in decreasing order of
length by one task of bounded size, and at most its last bins stay part-empty. The number of groups follows the number of rows.

Nulls and edges: a null or empty text has length 0 and is placed in no bin (bin null, piece 0); a null source or cluster
conflicts with nothing; repeated rows are packed each, never into one bin if they share a cluster; an empty table gives
no rows. Columns of the input whose names clash with the results are not read unless they are doc_id, source or text.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, piece int, piece_length long, bin string, bin_offset long"


@dataclass(frozen=True)
class Settings:
    #: Length units of a bin. With the default length, UTF-8 bytes.
    capacity: int = 32_768
    #: Documents of one source in a bin at most.
    per_source: int = 8
    #: Documents packed by one task, about.
    group_rows: int = 20_000


class Shelf:
    """Open bins with the same full sources, by what is left in them."""

    def __init__(self):
        self.residuals: list[int] = []  # distinct, ascending
        self.bins: dict[int, list[int]] = {}  # residual -> bins, ascending

    def add(self, residual: int, b: int) -> None:
        if residual not in self.bins:
            insort(self.residuals, residual)
            self.bins[residual] = []
        insort(self.bins[residual], b)

    def remove(self, residual: int, b: int) -> None:
        here = self.bins[residual]
        del here[bisect_left(here, b)]
        if not here:
            del self.bins[residual]
            del self.residuals[bisect_left(self.residuals, residual)]


class Bins:
    """Bins ordered by residual, each with its bitmaps of clusters and of sources (one plane for each allowed document).

    Bins with the same bitmap of full sources share a shelf, and a shelf on which the item's source is full is passed over
    as a whole; so a source that fills most bins costs no walk through them. Items that are equal in length, cluster and
    source follow each other, and each one's search goes on where the one before ended: what was incompatible still is,
    and what was filled since holds the cluster."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.planes = capacity, per_source
        self.shelves: dict[int, Shelf] = {}  # bitmap of full sources -> shelf
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.left: list[int] = []
        self.bits: dict[str, dict] = {"cluster": {}, "source": {}}
        self.last, self.reached = None, {}

    def mask(self, kind: str, value) -> int:
        """The bitmap of one cluster or source; 0 for null, which conflicts with nothing."""
        known = self.bits[kind]
        return 0 if value is None else 1 << known.setdefault(value, len(known))

    def successor(self, full: int, length: int, cluster: int) -> tuple[int, int] | None:
        """On a shelf, the smallest sufficient residual with a bin that lacks the cluster, and its first such bin."""
        shelf = self.shelves[full]
        residual, after = self.reached.get(full, (length, -1))
        for at in range(bisect_left(shelf.residuals, residual), len(shelf.residuals)):
            r = shelf.residuals[at]
            here = shelf.bins[r]
            for k in range(bisect_right(here, after) if r == residual else 0, len(here)):
                if not self.clusters[here[k]] & cluster:
                    if cluster:
                        self.reached[full] = (r, here[k] - 1)
                    return r, here[k]
        if cluster:
            self.reached[full] = (self.capacity + 1, -1)
        return None

    def place(self, length: int, cluster: int, source: int) -> tuple[int, int]:
        """The bin and the offset in it; cluster and source are bitmaps of one bit or 0. Of equally tight bins the first."""
        if self.last != (length, cluster, source):
            self.last, self.reached = (length, cluster, source), {}
        found = [x for full in self.shelves if not full & source and (x := self.successor(full, length, cluster))]
        if found:
            r, b = min(found)
            full = self.sources[b][-1]
            self.shelves[full].remove(r, b)
            if not self.shelves[full].residuals:
                del self.shelves[full]
        else:
            b = len(self.left)
            self.clusters.append(0)
            self.sources.append([0] * self.planes)
            self.left.append(self.capacity)
        return b, self._fill(b, length, cluster, source)

    def _fill(self, b: int, length: int, cluster: int, source: int) -> int:
        offset = self.capacity - self.left[b]
        self.left[b] -= length
        self.clusters[b] |= cluster
        for plane in range(self.planes):
            if not self.sources[b][plane] & source:
                self.sources[b][plane] |= source
                break
        if self.left[b]:
            self.shelves.setdefault(self.sources[b][-1], Shelf()).add(self.left[b], b)
        return offset


def order(s: Settings):
    """The order of packing: remainders from long to short; copies of a cluster and source follow each other."""
    return lambda r: (-(r[2] % s.capacity), -r[2], r[3] is None, r[3] or 0, r[1] is None, r[1] or "", r[0] is None, r[0] or 0)


def pack_group(rows: list[tuple], s: Settings, name: str) -> list[tuple]:
    """rows: (doc_id, source, length, cluster). Rows of SCHEMA."""
    bins, out, full = Bins(s.capacity, s.per_source), [], 0
    rows = sorted(rows, key=order(s))
    for doc_id, source, length, cluster in rows:
        if not length:
            out.append((doc_id, source, 0, 0, None, None))
            continue
        pieces, rest = divmod(length, s.capacity)
        for p in range(pieces):
            out.append((doc_id, source, p, s.capacity, f"{name}-f{full}", 0))
            full += 1
        if rest:
            b, offset = bins.place(rest, bins.mask("cluster", cluster), bins.mask("source", source))
            out.append((doc_id, source, pieces, rest, f"{name}-{b}", offset))
    return out


def pack(docs: DataFrame, s: Settings = Settings(), length: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """``docs`` (doc_id, source, text) as pieces in bins, SCHEMA. length: of a text, default its UTF-8 bytes; cluster: of
    duplicates, default texts that are equal but for case and white space."""
    size = F.octet_length("text") if length is None else length
    kind = F.xxhash64(F.regexp_replace(F.lower("text"), r"\s+", " ")) if cluster is None else cluster
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("length"),
        F.when(F.col("text").isNotNull(), kind).cast("long").alias("cluster"),
    )
    groups = max(1, -(-docs.select(F.lit(1)).count() // s.group_rows))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "length", "cluster", "source"), F.lit(groups)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[tuple]] = {}
        for b in batches:
            for *row, g in zip(*(b.column(c).to_pylist() for c in ("doc_id", "source", "length", "cluster", "grp")), strict=True):
                own.setdefault(g, []).append(tuple(row))
        for g, members in own.items():
            packed = pack_group(members, s, f"g{g}")
            cols = list(zip(*packed, strict=True))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "source", "piece", "piece_length", "bin", "bin_offset"])

    return rows.repartition(groups, "grp").mapInArrow(run, SCHEMA)
