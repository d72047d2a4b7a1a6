"""What changed between consecutive full snapshots of a table.

Rows are shuffled once, by a hash bucket of their key, so that a bucket has its keys of all snapshots. In the bucket the
valid delivery of each key is picked and every snapshot is summarised by an invertible Bloom lookup table (IBLT) and a
digest. Subtracting the tables of two consecutive snapshots cancels every row that both hold alike; the cells that are
left are peeled into (key hash, value hash) pairs, a pair of tables that doesn't peel is built again with more cells,
the digest proves that the recovered set is whole, and the keys are classified as added, removed or changed.

Scale: one exchange, no join, nothing is staged. The tables start with FIRST_CELLS cells and grow with the difference, not
with the bucket; two snapshots of a bucket with equal digests are not subtracted at all. Keys are spread by hash, so
that a hot company has no bucket of its own, and a task holds one bucket of some ROWS_PER_BUCKET rows at a time.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.hashing import xxhash64_longs

N_HASHES = 3
#: Expected rows of all snapshots in one bucket. Bounds what a task holds.
ROWS_PER_BUCKET = 16_384
#: Cells of the first attempt; a pair of tables that doesn't peel gets GROWTH times as many. With more than MOST_CELLS
#: times the rows there is nothing left to gain, and the two snapshots are compared row by row.
FIRST_CELLS = 96
GROWTH = 3
MOST_CELLS = 6
_ABSENT = "\u0001absent"

CHANGE = "snapshot_on string, company_id string, external_id string, change_kind string"


def _fold_text(values: pd.Series) -> pd.Series:
    """Case, white space and Unicode composition removed; null stays null."""
    import unicodedata

    def one(x):
        return None if x is None else " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).casefold()).split())

    return values.map(one, na_action="ignore")


def fold_text(column: Column) -> Column:
    """The same for a column; only texts with other than ASCII letters need Python."""
    plain = F.coalesce(column.rlike(r"^[\x00-\x7f]*$"), F.lit(True))
    fold = F.pandas_udf(_fold_text, "string")
    ascii_ = F.trim(F.regexp_replace(F.lower(column), r"[\t-\r\x1c-\x1f ]+", " "))
    return F.when(plain, ascii_).otherwise(fold(F.when(~plain, column)))


def _nullable(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(_ABSENT))


def peel(cells: pd.DataFrame, n_cells: int) -> tuple[pd.DataFrame | None, int]:
    """Peel one subtracted bucket. Returns the recovered (sign, key_hash, value_hash) rows, or None if cells remain.

    ``cells`` has cell, n, key_xor, value_xor, check_xor; untouched cells may be absent.
    """
    part = n_cells // N_HASHES
    table: dict[int, list[int]] = {
        int(c): [int(n), int(k), int(v), int(h)]
        for c, n, k, v, h in zip(cells["cell"], cells["n"], cells["key_xor"], cells["value_xor"], cells["check_xor"])
    }
    found: list[tuple[int, int, int]] = []
    todo = list(table)
    while todo:
        at = np.array([c for c in todo if c in table and abs(table[c][0]) == 1], dtype=np.int64)
        todo = []
        if not len(at):
            break
        kv = np.array([table[int(c)] for c in at], dtype=np.int64)
        check = xxhash64_longs(kv[:, 1], kv[:, 2])
        spots = np.stack([i * part + np.mod(xxhash64_longs(kv[:, 1], kv[:, 2], np.full(len(kv), i)), part) for i in range(N_HASHES)], axis=1)
        for c, row, h, where in zip(at.tolist(), kv.tolist(), check.tolist(), spots.tolist()):
            if row[3] != h or c not in where or table.get(c) != row:
                continue
            sign, k, v, _ = row
            found.append((sign, k, v))
            for w in where:
                cell = table.setdefault(w, [0, 0, 0, 0])
                cell[0] -= sign
                cell[1] ^= k
                cell[2] ^= v
                cell[3] ^= h
                if cell == [0, 0, 0, 0]:
                    del table[w]
                else:
                    todo.append(w)
    left = len(table)
    return (None if left else pd.DataFrame(found, columns=["sign", "key_hash", "value_hash"])), left


def _classify(found: pd.DataFrame) -> list[tuple[int, str]]:
    signs: dict[int, set[int]] = defaultdict(set)
    for sign, key in zip(found["sign"], found["key_hash"]):
        signs[int(key)].add(int(sign))
    return [(k, "changed" if len(s) == 2 else "added" if 1 in s else "removed") for k, s in signs.items()]


def _digest(k, v) -> np.ndarray:
    return xxhash64_longs(v, k) & np.int64(0xFFFFFFFF)


def lookup_table(keys: np.ndarray, values: np.ndarray, n_cells: int) -> dict[str, np.ndarray]:
    """The IBLT of a set of (key hash, value hash): n, key_xor, value_xor, check_xor of each of ``n_cells`` cells."""
    part = n_cells // N_HASHES
    check = xxhash64_longs(keys, values)
    out = {name: np.zeros(part * N_HASHES, np.int64) for name in ("n", "key_xor", "value_xor", "check_xor")}
    for i in range(N_HASHES):
        at = i * part + np.mod(xxhash64_longs(keys, values, np.full(len(keys), i)), part)
        np.add.at(out["n"], at, 1)
        for name, x in (("key_xor", keys), ("value_xor", values), ("check_xor", check)):
            np.bitwise_xor.at(out[name], at, x)
    return out


def _sum_digest(keys: np.ndarray, values: np.ndarray) -> int:
    return int(_digest(keys, values).sum())


def differences(old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray], first_cells: int = FIRST_CELLS) -> list[tuple[int, str]]:
    """(key hash, kind) of the keys that differ between two sets of (key hashes, value hashes)."""
    wanted = _sum_digest(*new) - _sum_digest(*old)
    if not wanted and len(old[0]) == len(new[0]) and np.bitwise_xor.reduce(xxhash64_longs(*old), initial=0) == np.bitwise_xor.reduce(xxhash64_longs(*new), initial=0):
        return []
    n_cells = int(max(first_cells, N_HASHES * 8)) // N_HASHES * N_HASHES
    while n_cells <= MOST_CELLS * max(len(old[0]), len(new[0]), N_HASHES * 8):
        a, b = lookup_table(*old, n_cells), lookup_table(*new, n_cells)
        cells = pd.DataFrame({"n": b["n"] - a["n"], **{x: a[x] ^ b[x] for x in ("key_xor", "value_xor", "check_xor")}})
        live = cells[cells.any(axis=1)]
        found, _ = peel(live.assign(cell=live.index), n_cells)
        if found is not None:
            sign, k, v = (found[x].to_numpy(np.int64) for x in ("sign", "key_hash", "value_hash"))
            if int((sign * _digest(k, v)).sum()) == wanted:
                return _classify(found)
        n_cells *= GROWTH
    before, after = set(zip(*map(np.ndarray.tolist, old))), set(zip(*map(np.ndarray.tolist, new)))
    rest = [(-1, *x) for x in before - after] + [(1, *x) for x in after - before]
    return _classify(pd.DataFrame(rest, columns=["sign", "key_hash", "value_hash"]))


def snapshot_changes(snapshots: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET, first_cells: int = FIRST_CELLS) -> DataFrame:
    """Posts added, removed or changed in each snapshot against the snapshot of the preceding date.

    Input: snapshot_on, company_id, external_id, title, location, first_seen_at, delivered_at; other columns are
    ignored. Output: snapshot_on, company_id, external_id, change_kind.

    Defined cases: a null or blank external_id, or a null snapshot_on, is no post. A null company_id is a company
    of its own. Of several rows for a post in a snapshot the one with the greatest delivered_at (null first)
    holds, and among equals the greatest (first_seen_at, title, location). Repeated rows count once. Null equals
    null only. An empty table, or a single snapshot, gives no row. Texts may be of any length.
    """
    trimmed = F.lower(F.regexp_replace("external_id", r"^[\s ]+|[\s ]+$", ""))
    posts = snapshots.select("snapshot_on", "company_id", trimmed.alias("external_id"), "title", "location", "first_seen_at", "delivered_at").filter((F.length("external_id") > 0) & F.col("snapshot_on").isNotNull())
    dates = {r["snapshot_on"]: r["n"] for r in posts.groupBy("snapshot_on").agg(F.count(F.lit(1)).alias("n")).collect()}
    days = sorted(dates)
    n_buckets = max(1, round(sum(dates.values()) / rows_per_bucket))
    bucket = F.pmod(F.hash("external_id", _nullable(F.col("company_id"))), F.lit(n_buckets))
    value = F.xxhash64(_nullable(fold_text(F.col("title"))), _nullable(fold_text(F.col("location"))), _nullable(F.date_trunc("second", "first_seen_at")))
    # The exchange by bucket also serves the two groupings below, which are by the bucket and more.
    clustered = posts.withColumn("bucket", bucket).withColumn("value_hash", value).repartition("bucket")
    valid = clustered.groupBy("bucket", "snapshot_on", "company_id", "external_id").agg(F.max(F.struct("delivered_at", "first_seen_at", "title", "location", "value_hash")).alias("row"))
    number = F.create_map(*[F.lit(x) for i, d in enumerate(days) for x in (d, i)]) if days else F.create_map().cast("map<date,int>")
    hashed = valid.select(
        "bucket", number[F.col("snapshot_on")].alias("snapshot_no"), "company_id", "external_id", F.xxhash64(_nullable(F.col("company_id")), "external_id").alias("key_hash"),
        F.col("row.value_hash").alias("value_hash"),
    )
    names = [str(d) for d in days]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        parts = {int(no): part for no, part in rows.groupby("snapshot_no")}
        none = rows.iloc[:0]
        pair_of = lambda part: (part["key_hash"].to_numpy(np.int64), part["value_hash"].to_numpy(np.int64))
        for no in range(1, len(names)):
            old, new = parts.get(no - 1, none), parts.get(no, none)
            changes = differences(pair_of(old), pair_of(new), first_cells)
            if changes:
                # an added or changed post is spelt out by its row in the later snapshot, a removed one by the earlier
                spelt = {s: dict(zip(part["key_hash"].tolist(), zip(part["company_id"], part["external_id"]))) for s, part in ((0, old), (1, new))}
                out += [(names[no], *spelt[kind != "removed"][k], kind) for k, kind in changes]
        return pd.DataFrame(out, columns=["snapshot_on", "company_id", "external_id", "change_kind"])

    return hashed.groupBy("bucket").applyInPandas(run, CHANGE)
