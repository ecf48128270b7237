"""Per-entity feature tables from events, worked out on dense blocks.

Events are combined within each map task, entities hashed into buckets, and each bucket is worked through in slabs of
a dense (entity x event type) block: numpy's bincount adds up counts and totals, a maximum scatter keeps the latest
time. Combining first means that an entity with a third of all events reaches its bucket as a few hundred rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a map task gathers before it combines them.
COMBINE_ROWS = 1 << 18
#: Cells of a dense slab.
SLAB_CELLS = 1 << 22

PARTIAL = "entity string, event_type string, n bigint, total bigint, last bigint"
NEVER = np.iinfo(np.int64).min


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Row codes and the distinct values, in order of the values."""
    d = column.combine_chunks()
    d = (d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d).dictionary_encode()
    order = np.argsort(np.array(d.dictionary.to_pylist(), dtype=object), kind="stable") if len(d.dictionary) else np.array([], dtype=np.int64)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank[d.indices.to_numpy(zero_copy_only=False)] if len(d) else np.array([], dtype=np.int64), d.dictionary.take(pa.array(order, pa.int64()))


def _scatter(cell: np.ndarray, size: int, t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, totals (exact below 2**53) and latest times of the cells."""
    n = np.bincount(cell, t["n"].to_numpy(), size).astype(np.int64)
    total = np.bincount(cell, t["total"].to_numpy(), size).astype(np.int64)
    last = np.full(size, NEVER)
    np.maximum.at(last, cell, t["last"].to_numpy())
    return n, total, last


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        held.clear()
        (e, entities), (k, kinds) = _codes(t["entity"]), _codes(t["event_type"])
        pairs, cell = np.unique(e * max(1, len(kinds)) + k, return_inverse=True)
        n, total, last = _scatter(cell, len(pairs), t)
        e, k = np.divmod(pairs, max(1, len(kinds)))
        yield from pa.table({"entity": entities.take(pa.array(e)), "event_type": kinds.take(pa.array(k)), "n": n, "total": total, "last": last}).to_batches()

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= COMBINE_ROWS:
            yield from flush()
    if held:
        yield from flush()


def _slabs(t: pa.Table) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Entities, types and the dense n, total, last of each slab of a bucket."""
    (e, entities), (k, kinds) = _codes(t["entity"]), _codes(t["event_type"])
    step = max(1, SLAB_CELLS // max(1, len(kinds)))
    for at in range(0, len(entities), step):
        inside = (e >= at) & (e < at + step)
        size = min(step, len(entities) - at)
        part = t.filter(pa.array(inside))
        n, total, last = _scatter((e[inside] - at) * len(kinds) + k[inside], size * len(kinds), part)
        shape = (size, len(kinds))
        yield entities.slice(at, size), kinds, n.reshape(shape), total.reshape(shape), last.reshape(shape)


def _partial(events: DataFrame, buckets: int | None) -> DataFrame:
    buckets = buckets or 4 * int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = events.where("entity is not null and event_type is not null and last is not null").select("entity", "event_type", "n", "total", "last")
    return part.mapInArrow(_combine, PARTIAL).withColumn("_bucket", F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("int"))


def feature_cells(events: DataFrame, min_count: int = 1, min_total: int = 0, min_gap: int = 0, buckets: int | None = None) -> DataFrame:
    """(entity, event_type, n, total, last, entity_last): the cells of the feature table that reach the given minima.

    events: entity, event_type, n, total, last (microseconds). min_gap is the least time from the cell's last event to
    the entity's last event of any type. Rows with a null entity, type or time are left out; a null total is an error
    of the caller. An empty table gives an empty one.
    """

    def cells(t: pa.Table) -> pa.Table:
        out = []
        for entities, kinds, n, total, last in _slabs(t.drop_columns("_bucket")):
            newest = last.max(axis=1)
            rows, cols = np.nonzero(n >= min_count)  # NEVER is only where n is 0
            keep = (total[rows, cols] >= min_total) & (newest[rows] - last[rows, cols] >= min_gap)
            rows, cols = rows[keep], cols[keep]
            out.append(
                pa.table(
                    {
                        "entity": entities.take(pa.array(rows)),
                        "event_type": kinds.take(pa.array(cols)),
                        "n": n[rows, cols],
                        "total": total[rows, cols],
                        "last": last[rows, cols],
                        "entity_last": newest[rows],
                    }
                )
            )
        return pa.concat_tables(out)

    if min_count < 1:
        raise ValueError("a cell has at least one event")
    return _partial(events, buckets).groupBy("_bucket").applyInArrow(cells, PARTIAL + ", entity_last bigint")


def feature_table(events: DataFrame, event_types: list[str], buckets: int | None = None) -> DataFrame:
    """One row per entity: arrays n, total and days_since, element i for event_types[i].

    days_since is the whole days from the last event of that type to the entity's last event of any type, null where
    there is none. Types that aren't listed count for the entity's last event only.
    """
    names = {k: i for i, k in enumerate(event_types)}
    day = 86_400_000_000

    def rows(t: pa.Table) -> pa.Table:
        out = []
        width = len(event_types)
        for entities, kinds, n, total, last in _slabs(t.drop_columns("_bucket")):
            newest = last.max(axis=1)
            counts, totals = np.zeros((len(entities), width), np.int64), np.zeros((len(entities), width), np.int64)
            since, known = np.zeros((len(entities), width), np.int64), np.zeros((len(entities), width), bool)
            here = [(j, names[k]) for j, k in enumerate(kinds.to_pylist()) if k in names]
            if here:
                src, dst = map(list, zip(*here, strict=True))
                counts[:, dst], totals[:, dst], known[:, dst] = n[:, src], total[:, src], n[:, src] > 0
                since[:, dst] = np.where(n[:, src] > 0, (newest[:, None] - np.where(n[:, src] > 0, last[:, src], 0)) // day, 0)
            ends = pa.array(np.arange(len(entities) + 1) * width, pa.int32())
            lists = lambda a, mask=None: pa.ListArray.from_arrays(ends, pa.array(a.ravel(), mask=mask))
            out.append(pa.table({"entity": entities, "n": lists(counts), "total": lists(totals), "days_since": lists(since, ~known.ravel())}))
        return pa.concat_tables(out)

    return _partial(events, buckets).groupBy("_bucket").applyInArrow(rows, "entity string, n array<bigint>, total array<bigint>, days_since array<bigint>")


#: The source roots below which a directory counts as a code area.
AREA = r"(?:^|/)src/(?:main|test)/java/[^/]+/[^/]+/([^/]+)/"


def author_events(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(entity, event_type, n, total, last) of each file change: author, kind `:` area, 1, lines, time of the commit.

    The author is trimmed and lower-cased; empty and null authors and paths without a third directory below a source
    root are left out. Repeated rows count once; null line counts are 0.
    """
    c = (
        commits.select("repo_id", "sha", F.lower(F.trim("author")).alias("entity"), F.unix_micros(F.col("ts").cast("timestamp")).alias("last"))
        .where("entity <> '' and last is not null")
        .distinct()
    )
    kind = F.when(F.col("old_path").isNotNull(), "rename").when(F.col("is_file_deletion"), "delete").otherwise("modify")
    area = F.regexp_extract("path", AREA, 1)
    f = (
        changes.where(area != "")
        .select(
            "repo_id",
            "sha",
            "file_ord",
            F.concat(kind, F.lit(":"), area).alias("event_type"),
            (F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0))).cast("bigint").alias("total"),
        )
        .distinct()
    )
    return f.join(c, ["repo_id", "sha"]).select("entity", "event_type", F.lit(1).cast("bigint").alias("n"), "total", "last")
