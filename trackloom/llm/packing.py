"""Items of varying length put into containers of fixed capacity.

Lengths are whole numbers up to the capacity, so all that packing depends on is how many items have
each length: a histogram of at most capacity rows, which is all that reaches the driver. There a plan
is made of patterns (lengths that share a container) and how often each repeats:

* a container opens with the longest length left;
* its gap is looked up in the indexes of single lengths, sums of pairs and sums of triples, under
  the counts that are left; a combination that fills it exactly is taken;
* if there is none, the longest length that fits goes in (best fit), and the gap is looked up anew;
* the pattern is used as often as the counts allow, so each pattern uses up at least one length.

The executors then number the items of each length, salted so that a length with a third of all
items is numbered by many tasks, and look their numbers up in the plan. No item is moved to the
driver, none is dropped, and only items beyond the capacity are split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, sized
from .tokens import TOKENIZERS, encode_column

#: Parts into which the items of one length are split to be numbered, at least, and texts per part where there are many.
SALTS, PER_SALT = 64, 200_000


def _exact(gap: int, left: np.ndarray) -> list[int] | None:
    """One, two or three lengths that sum to gap and of which enough are left, the longest first."""
    if gap <= 0 or gap >= len(left) + 2 * (len(left) - 1):
        return None
    top = len(left) - 1
    if gap <= top and left[gap] > 0:
        return [gap]
    has = left > 0
    # pairs: a + b = gap with a >= b
    a = np.arange(max(1, gap - top), min(top, gap - 1) + 1)
    if len(a):
        fit = has[a] & has[gap - a] & ((a != gap - a) | (left[a] > 1))
        if fit.any():
            x = int(a[fit][-1])
            return [x, gap - x]
    # triples: the index of pair sums, each as often as an ordered pair of lengths makes it
    low = np.flatnonzero(has[: min(top, gap - 2) + 1])
    if len(low) < 1:
        return None
    signal = np.zeros(min(gap, 2 * top) + 1)
    size = 1 << int(np.ceil(np.log2(2 * len(signal))))
    signal[low[low < len(signal)]] = 1
    pairs = np.rint(np.fft.irfft(np.fft.rfft(signal, size) ** 2, size)[: len(signal)]).astype(np.int64)
    # a length that is left once is no pair with itself
    once = low[(left[low] < 2) & (2 * low < len(pairs))]
    pairs[2 * once] -= 1
    # for each longest length the pairs of the rest, without those that need it more often than it is left
    rest = gap - low
    inside = rest < len(pairs)
    low, rest = low[inside], rest[inside]
    other = rest - low
    partner = (other > 0) & (other <= top)
    partner &= has[np.clip(other, 0, top)]
    taken = np.where(partner & (other != low) & (left[low] < 2), 2, 0) + np.where(partner & (other == low) & (left[low] == 2), 1, 0)
    good = low[pairs[rest] - taken > 0]
    if not len(good):
        return None
    x = int(good[-1])
    r = gap - x
    a = np.arange(max(1, r - top), min(top, r - 1) + 1)
    b = r - a
    fit = (left[a] >= 1 + (a == b) + (a == x)) & (left[b] >= 1 + (a == b) + (b == x)) & (left[x] >= 1 + (a == x) + (b == x))
    y = int(a[fit][-1])
    return [x, y, r - y]


def plan_patterns(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in a container, how often) for counts[length] items of 1 .. capacity."""
    left = counts.copy().astype(np.int64)
    left[0] = 0
    out: list[tuple[list[int], int]] = []
    present = np.flatnonzero(left)
    while len(present):
        first = int(present[-1])
        content = [first]
        left[first] -= 1
        used = {first: 1}
        gap = capacity - first
        while gap > 0:
            fits = np.searchsorted(present, gap, "right")
            cands = present[:fits][left[present[:fits]] > 0]
            if not len(cands):
                break
            found = _exact(gap, left) if gap <= 3 * int(cands[-1]) else None
            if found is None:
                # best fit, in one go as far as the gap stays beyond an exact filling
                best = int(cands[-1])
                n = min(int(left[best]), max(1, (gap - 1) // best - 2))
                found = [best] * n
            for x in found:
                left[x] -= 1
                used[x] = used.get(x, 0) + 1
                content.append(x)
                gap -= x
        more = min(int(left[x]) // k for x, k in used.items())
        for x, k in used.items():
            left[x] -= k * more
        out.append((content, 1 + more))
        present = present[left[present] > 0]
    return out


def _plan_arrays(plans: dict[int, list[tuple[list[int], int]]]) -> dict[str, np.ndarray]:
    """The plan as rows sorted by (pack, length, first rank): which ranks of a length go to which containers, at which offset."""
    rows = []
    for pack, patterns in plans.items():
        rank: dict[int, int] = {}
        container = 0
        for content, times in patterns:
            at = 0
            k = 0
            while k < len(content):
                n = k
                while n < len(content) and content[n] == content[k]:
                    n += 1
                length, each = content[k], n - k
                start = rank.get(length, 0)
                rows.append((pack, length, start, each, container, at))
                rank[length] = start + each * times
                at += length * each
                k = n
            container += times
    names = ("pack", "length", "start", "each", "container", "at")
    m = np.array(sorted(rows), np.int64).reshape(-1, len(names))
    return {n: m[:, k] for k, n in enumerate(names)}


def pack_items(items: DataFrame, capacities: dict[int, int], salts: int = SALTS) -> DataFrame:
    """pack_id, item columns, container_id, start of items(pack_id, key, piece, length) with 0 <= length <= capacity.

    key and piece tell items apart. Items of length 0 take no room and lie at the start of container 0.
    """
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("key", "piece"), F.lit(salts)).cast("int"))
    counts = cut_lineage(salted.where("length > 0").groupBy("pack_id", "length", "_salt").agg(F.count("*").alias("n")))
    plans: dict[int, list[tuple[list[int], int]]] = {}
    # at most the sum of all capacities rows
    histogram = counts.groupBy("pack_id", "length").agg(F.sum("n").alias("n")).toPandas()
    for pack, capacity in capacities.items():
        mine = histogram[histogram["pack_id"] == pack]
        have = np.zeros(capacity + 1, np.int64)
        have[mine["length"].to_numpy(np.int64)] = mine["n"].to_numpy(np.int64)
        plans[pack] = plan_patterns(have, capacity)
    plan = _plan_arrays(plans)
    before = Window.partitionBy("pack_id", "length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pack_id", "length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("pack_id", "length", "_salt").orderBy("key", "piece")
    ranked = salted.where("length > 0").withColumn("_rank", F.row_number().over(within) - 1).join(sized(offsets), ["pack_id", "length", "_salt"])
    ranked = ranked.select("pack_id", "key", "piece", "length", (F.col("_rank") + F.col("_before")).cast("long").alias("rank"))

    # groups of (pack, length) in the order of the plan; a rank is looked up within its group
    packs_, lengths_ = np.unique(plan["pack"]), int(plan["length"].max(initial=0)) + 1
    code = np.searchsorted(packs_, plan["pack"]) * lengths_ + plan["length"]
    groups, group = np.unique(code, return_inverse=True)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            pack, length, rank = (b.column(k).to_numpy() for k in ("pack_id", "length", "rank"))
            most = int(max(rank.max(), plan["start"].max())) + 1
            g = np.searchsorted(groups, np.searchsorted(packs_, pack) * lengths_ + length)
            row = np.searchsorted(group * most + plan["start"], g * most + rank, "right") - 1
            j = rank - plan["start"][row]
            each = plan["each"][row]
            yield pa.RecordBatch.from_arrays([b.column("pack_id"), b.column("key"), b.column("piece"), b.column("length"), pa.array(plan["container"][row] + j // each), pa.array(plan["at"][row] + (j % each) * length)], names=["pack_id", "key", "piece", "length", "container_id", "start"])

    placed = ranked.mapInArrow(place, "pack_id int, key long, piece long, length long, container_id long, start long")
    empty = items.where("length = 0").select("pack_id", "key", "piece", "length", F.lit(0).cast("long").alias("container_id"), F.lit(0).cast("long").alias("start"))
    return placed.unionByName(empty)


def document_lengths(documents: DataFrame, tokenizer: str, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, length in tokens."""
    ids = encode_column(documents.select(F.col("doc_id").cast("long"), F.col("text")), "text", ["doc_id"], tokenizer, folder)
    return ids.select("doc_id", F.size("ids").cast("long").alias("length"))


def packed_documents(documents: DataFrame, pack_sizes: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """pack_id, doc_id, piece, container_id, start, length, doc_start of every document for every pack size.

    length tokens of the document, from its token doc_start on, lie in the container from start on.
    Only a document longer than the capacity has more than one piece: pieces of the whole capacity
    and a rest. Null and empty texts have length 0 and lie at the start of container 0. Rows that
    repeat a doc_id are packed each. Pack sizes without a positive capacity are left out. An empty
    table gives no rows.
    """
    packs = [(r["pack_id"], r["tokenizer"], r["capacity_tokens"]) for r in pack_sizes.where("capacity_tokens > 0 and pack_id is not null").select("pack_id", "tokenizer", "capacity_tokens").distinct().collect()]
    out = None
    for tokenizer in sorted({t for _, t, _ in packs}):
        sizes = cut_lineage(document_lengths(documents, tokenizer, folder))
        mine = {p: c for p, t, c in packs if t == tokenizer}
        table = F.array(*[F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("long").alias("capacity")) for p, c in sorted(mine.items())])
        each = sizes.select(F.col("doc_id").alias("key"), F.col("length").alias("total"), F.inline(table))
        cut = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("total") / F.col("capacity")).cast("long") - 1, F.lit(0).cast("long")))))
        items = cut.select("pack_id", "key", "piece", F.least(F.col("total") - F.col("piece") * F.col("capacity"), F.col("capacity")).alias("length"))
        placed = pack_items(items, mine, max(SALTS, sizes.count() // PER_SALT))
        capacity = F.lit(0).cast("long")
        for p, c in mine.items():
            capacity = F.when(F.col("pack_id") == p, c).otherwise(capacity)
        part = placed.select("pack_id", F.col("key").alias("doc_id"), "piece", "container_id", "start", "length", (F.col("piece") * capacity).alias("doc_start"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return documents.sparkSession.createDataFrame([], "pack_id int, doc_id long, piece long, container_id long, start long, length long, doc_start long")
    return out
