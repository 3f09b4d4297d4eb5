"""Keyed tables that grow by micro-batches: every batch adds a run, runs are merged in levels, reads merge what is live.

A run is the rows of one batch, cut into pages by the leading bits of the key's hash; the more rows, the more pages, so
a page stays small enough for one task. Beside each page lies a Bloom filter of its keys. Looking up keys tests the
filters of every live run and opens only pages in which a key may be; the exact join follows. Of several
rows of one key the one in the newest run counts; a row marked gone deletes the key.

A batch writes its run, now and then a merge of ``FANOUT`` runs of one level into one of the next, and a short list of the
runs that are live after it. It reads the list of the batch before and touches nothing older, so a batch that is run
again after a failure overwrites its own folders and nothing else.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows aimed at in a page, runs of a level that are merged into one, bits of a filter a key.
PAGE_ROWS, FANOUT, KEY_BITS = 1 << 18, 4, 10
HASHES = 7
LIST = "run string, level int, first bigint, last bigint, bits int, rows bigint"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The filter bits of each hash: keys x HASHES."""
    h = _mixed(hashes.astype(np.int64).view(np.uint64))
    step = _mixed(h) | np.uint64(1)
    return (h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def bloom(hashes: np.ndarray) -> bytes:
    """Filter of 64-bit key hashes, ``KEY_BITS`` bits for each."""
    bits = max(64, KEY_BITS * len(hashes))
    seen = np.zeros(bits, np.uint8)
    seen[_places(hashes, bits).ravel().astype(np.int64)] = 1
    return bits.to_bytes(8, "little") + np.packbits(seen, bitorder="little").tobytes()


def may_hold(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether each key may be among those the filter was made of; never False for one that is."""
    bits = int.from_bytes(filter_[:8], "little")
    held = np.frombuffer(filter_, np.uint8, offset=8)
    at = _places(hashes, bits)
    return ((held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _test(left: pa.Table, right: pa.Table) -> pa.Table:
    """(run, page) if the page's filter may hold one of the probes."""
    hit = False
    if left.num_rows and right.num_rows:
        probes = left["hash"].to_numpy()
        hit = any(may_hold(f, probes).any() for f in right["filter"].to_pylist())
    return left.select(["run", "page"]).slice(0, int(hit))


@dataclasses.dataclass(frozen=True)
class Run:
    """Rows of the batches ``first`` to ``last`` in pages by ``bits`` bits of the hash."""

    run: str
    level: int
    first: int
    last: int
    bits: int
    rows: int


class LeveledTable:
    """A table of ``schema`` (SQL columns) with one row a ``key``, under ``root``.

    ``once`` says that no batch sets a key again, so reads need not look for the newest row.
    """

    def __init__(
        self, spark: SparkSession, root: str, schema: str, key: str, once: bool = False, page_rows: int = PAGE_ROWS,
        fanout: int = FANOUT,
    ):
        self.once = once
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        self.page_rows, self.fanout = page_rows, fanout
        self._opened: dict[str, int] = {}

    # -- the list of live runs

    def runs(self, batch_id: int) -> list[Run]:
        """Live runs after a batch, oldest first. None before the first batch; a missing list is an error."""
        if batch_id < 0:
            return []
        rows = self._listed(batch_id).filter("NOT looked_up").drop("looked_up", "pages").collect()
        return sorted((Run(**r.asDict()) for r in rows), key=lambda r: r.first)

    def _listed(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(f"{LIST}, looked_up boolean, pages bigint").parquet(f"{self.root}/live/batch={batch_id}")

    def newest(self) -> int:
        """The last batch with a list, -1 without any."""
        try:
            ids = self.spark.read.schema(LIST + ", batch bigint").parquet(f"{self.root}/live").select("batch").distinct()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1
        return max((r["batch"] for r in ids.collect()), default=-1)

    def _list(self, batch_id: int, runs: list[Run]) -> None:
        opened = [(k, self._opened[k]) for k in sorted(self._opened)]
        rows = [(*dataclasses.astuple(r), False, None) for r in runs] + [(k, *[None] * 5, True, n) for k, n in opened]
        live = self.spark.createDataFrame(rows, f"{LIST}, looked_up boolean, pages bigint")
        live.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/live/batch={batch_id}")

    # -- reading

    def _page(self, bits: int) -> Column:
        h = F.xxhash64(F.col(self.key))
        return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("bigint")

    def _rows(self, run: Run, pages: list[int] | None = None) -> DataFrame:
        folder = f"{self.root}/run={run.run}/rows"
        paths = [folder] if pages is None else [f"{folder}/page={p}" for p in pages]
        rows = self.spark.read.schema(f"{self.schema}, gone boolean").parquet(*paths)
        return rows.select(*self._empty().columns, "gone", F.lit(run.last).cast("bigint").alias("_at"))

    def _merged(self, parts: list[DataFrame], keep_gone: bool) -> DataFrame:
        """The newest row of each key; runs of different batches only meet where they share a key."""
        names = self._empty().columns
        if not parts:
            return self._empty()
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if len(parts) > 1 and not self.once:
            newest = F.max_by(F.struct(*names, "gone"), "_at").alias("r")
            rows = rows.groupBy(F.col(self.key).alias("_key")).agg(newest).select("r.*")
        return rows.select(*names, "gone") if keep_gone else rows.filter(~F.col("gone")).select(*names)

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def read(self, batch_id: int | None = None) -> DataFrame:
        """All rows after a batch, by default the newest."""
        at = self.newest() if batch_id is None else batch_id
        return self._merged([self._rows(r) for r in self.runs(at)], keep_gone=False)

    def opened(self, batch_id: int) -> dict[str, int]:
        """Pages of older runs that the look-up of a batch opened, by run."""
        return {r["run"]: r["pages"] for r in self._listed(batch_id).filter("looked_up").collect()}

    def look_up(self, keys: DataFrame, n_keys: int, batch_id: int) -> DataFrame:
        """Rows that the keys (one column, distinct, no nulls; about ``n_keys``) have after the batch before ``batch_id``."""
        runs = self.runs(batch_id - 1)
        candidates = self._candidates(keys, n_keys, runs)
        self._opened = {r: len(p) for r, p in candidates.items()}  # listed by :meth:`append`
        parts = [self._rows(r, sorted(candidates[r.run])) for r in runs if r.run in candidates]
        asked = [p.join(keys.select(self.key), self.key, "left_semi") for p in parts]
        return self._merged(asked, keep_gone=False)

    def _candidates(self, keys: DataFrame, n_keys: int, runs: list[Run]) -> dict[str, list[int]]:
        """Pages that may hold one of the keys, by run: at most as many numbers as the table has files."""
        if not runs or not n_keys:
            return {}
        probes = None
        for r in runs:
            # a filter is copied to so many tasks that each tests a bounded number of keys
            parts = max(1, -(-n_keys // (self.page_rows << r.bits)))
            probe = keys.select(
                F.lit(r.run).alias("run"), self._page(r.bits).alias("page"), F.xxhash64(self.key).alias("hash"),
                F.lit(parts).alias("parts"),
            )
            probes = probe if probes is None else probes.unionByName(probe)
        probes = probes.withColumn("part", F.pmod("hash", F.col("parts").cast("bigint"))).drop("parts")
        filters = None
        for r in runs:
            parts = max(1, -(-n_keys // (self.page_rows << r.bits)))
            f = self.spark.read.schema("page bigint, filter binary").parquet(f"{self.root}/run={r.run}/filters")
            copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))
            f = f.select(F.lit(r.run).alias("run"), "page", "filter", copies.alias("part"))
            filters = f if filters is None else filters.unionByName(f)
        by = ["run", "page", "part"]
        hits = probes.groupBy(*by).cogroup(filters.groupBy(*by)).applyInArrow(_test, "run string, page bigint")
        out: dict[str, list[int]] = {}
        for row in hits.distinct().collect():
            out.setdefault(row["run"], []).append(row["page"])
        return out

    # -- writing

    def _write(self, run: str, rows: DataFrame, n_rows: int) -> int:
        """Pages and filters of a run of up to ``n_rows`` rows; bits of its pages."""
        bits = max(0, (n_rows - 1).bit_length() - (self.page_rows - 1).bit_length()) if n_rows else 0
        folder, page = f"{self.root}/run={run}", self._page(bits)
        paged = rows.withColumn("page", page).repartition("page")
        paged.write.mode("overwrite").partitionBy("page").parquet(f"{folder}/rows")
        written = self.spark.read.schema(f"{self.schema}, page bigint").parquet(f"{folder}/rows")

        def make(pages: pa.Table) -> pa.Table:
            made = bloom(pages["hash"].to_numpy())
            return pa.table({"page": pages["page"].slice(0, 1), "filter": pa.array([made], pa.binary())})

        hashes = written.select("page", F.xxhash64(self.key).alias("hash"))
        filters = hashes.groupBy("page").applyInArrow(make, "page bigint, filter binary")
        filters.write.mode("overwrite").parquet(f"{folder}/filters")
        return bits

    def append(self, rows: DataFrame, n_rows: int, batch_id: int) -> None:
        """Add what a batch sets: ``rows`` of the schema and ``gone``, one a key, at most ``n_rows``."""
        live = self.runs(batch_id - 1)
        if n_rows:
            run = f"{batch_id}"
            bits = self._write(run, rows, n_rows)
            live.append(Run(run, 0, batch_id, batch_id, bits, n_rows))
        self._list(batch_id, self._compacted(live, batch_id))

    def _compacted(self, live: list[Run], batch_id: int) -> list[Run]:
        """Merge the newest ``fanout`` runs of a level while there are as many; newer runs never have a higher level."""
        while True:
            level = live[-1].level if live else 0
            last = [r for r in live if r.level == level]
            if len(last) < self.fanout:
                return live
            older = live[: len(live) - len(last)]
            n = sum(r.rows for r in last)
            merged = self._merged([self._rows(r) for r in last], keep_gone=bool(older))
            if not older:  # nothing left that a deletion would have to hide
                merged = merged.withColumn("gone", F.lit(False))
            run = f"{last[0].first}-{batch_id}"
            bits = self._write(run, merged, n)
            live = [*older, Run(run, level + 1, last[0].first, batch_id, bits, n)]
