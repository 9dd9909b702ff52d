"""Problem 7: containers of fixed capacity filled along a space-filling curve."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithocube.llm.tokens import VOCABULARY, token_counts
from lithocube.session import cut, settings

#: Dimensions of a document's place, bits of each in the Hilbert key, documents of a stretch of the curve that are
#: packed together, stretches for which a container stays open, and documents of a partition.
DIMS, BITS, STRETCH, KEEP, PER_TASK = 3, 10, 500, 4, 40_000


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of whole numbers below 2**bits (Skilling's transpose form)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _keyed(mean: list[float], spread: list[float]):
    m, s = np.array(mean), np.maximum(np.array(spread), 1e-12)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            z = (np.stack(pdf["place"].to_numpy()) - m) / s
            cells = np.clip((1 / (1 + np.exp(-1.7 * z)) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": pdf["n_tokens"], "key": hilbert(cells)})

    return run


class Packer:
    """Best fit into the open containers of one capacity: a piece goes where it leaves the least room.

    With `keep`, a container that was opened `keep` calls of `walk` ago takes nothing more.
    """

    def __init__(self, capacity: int, keep: int = 0) -> None:
        self.capacity, self.keep, self.made = capacity, keep, 0
        self.open: list[tuple[int, int]] = []  # (room, container), ordered
        self.first: list[int] = []  # first container made in each stretch still open

    def put(self, size: int) -> int:
        at = bisect.bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, where = self.open.pop(at)
        else:
            room, where, self.made = self.capacity, self.made, self.made + 1
        if room > size:
            bisect.insort(self.open, (room - size, where))
        return where

    def walk(self) -> None:
        """The next stretch of the curve begins: containers opened too long ago are closed."""
        self.first.append(self.made)
        if self.keep and len(self.first) > self.keep:
            self.first.pop(0)
            self.open = [(room, where) for room, where in self.open if where >= self.first[0]]


def _packing(capacities: list[tuple[int, int]], stretch: int, keep: int):
    def run(batches):
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 36
        packers = {pack: Packer(capacity, keep) for pack, capacity in capacities}
        held: list[pd.DataFrame] = []

        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            docs, sizes, keys = pdf["doc_id"].to_numpy(), pdf["n_tokens"].to_numpy(), pdf["key"].to_numpy()
            out: list[tuple] = []
            for pack, capacity in capacities:
                packers[pack].walk()
                put = packers[pack].put
                # A text above the capacity fills containers of its own; what is left over is packed with the others.
                for i in np.flatnonzero(sizes > capacity):
                    out += [(pack, base + put(capacity), docs[i], k, k * capacity, capacity, keys[i]) for k in range(sizes[i] // capacity)]
                rest = np.where(sizes > capacity, sizes % capacity, sizes)
                for i in np.argsort(-rest, kind="stable"):
                    if rest[i]:
                        whole = sizes[i] // capacity if sizes[i] > capacity else 0
                        out.append((pack, base + put(int(rest[i])), docs[i], whole, whole * capacity, rest[i], keys[i]))
            return pd.DataFrame(out, columns=["pack_id", "container", "doc_id", "piece", "first_token", "n_tokens", "curve_key"])

        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= stretch:
                both = pd.concat(held, ignore_index=True)
                whole = rows - rows % stretch
                for at in range(0, whole, stretch):
                    yield work(both[at : at + stretch])
                held, rows = [both[whole:]], rows - whole
        if rows:
            yield work(pd.concat(held, ignore_index=True))

    return run


def pack_documents(documents: DataFrame, packs: DataFrame, vocabulary: str = VOCABULARY, per_task: int = PER_TASK, stretch: int = STRETCH, keep: int = KEEP) -> DataFrame:
    """pack_id, container, doc_id, piece, first_token, n_tokens, curve_key: every document in containers of every capacity.

    `packs`: pack_id, capacity_tokens (a small table of settings; rows with a null or a capacity below 1 are left out).
    Documents lie along a Hilbert curve through their places (hashed token vectors, three dimensions), are sorted by
    range, and stretches of `stretch` neighbours are packed by best fit, largest first, into containers still open. A
    container is closed `keep` stretches after it was opened, so what it holds lies together on the curve. A text is cut only where it alone exceeds the capacity: full containers and one rest.
    - Null and empty texts take no room and are in no container; null doc_ids are packed like others. Rows of one
      doc_id are packed one by one. Containers are unique within a pack_id. Empty tables give empty results.
    """
    sorts = [(r[0], r[1]) for r in settings(packs.where("pack_id is not null and capacity_tokens >= 1").select("pack_id", "capacity_tokens").distinct())]
    sizes = cut(token_counts(documents, "doc_id", vocabulary=vocabulary, dims=DIMS).where("n_tokens > 0"))
    at = [F.element_at("place", i + 1) for i in range(DIMS)]
    stats = sizes.agg(F.count(F.lit(1)), *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    n = stats[0]
    mean, spread = [v or 0.0 for v in stats[1 : DIMS + 1]], [v or 0.0 for v in stats[DIMS + 1 :]]
    key_type = sizes.schema["doc_id"].dataType.simpleString()
    keyed = sizes.mapInPandas(_keyed(mean, spread), f"doc_id {key_type}, n_tokens long, key long")
    lying = keyed.repartitionByRange(max(1, -(-n // per_task)), "key", F.xxhash64("doc_id")).sortWithinPartitions("key", F.xxhash64("doc_id"))
    kinds = f"pack_id long, container long, doc_id {key_type}, piece long, first_token long, n_tokens long, curve_key long"
    return lying.mapInPandas(_packing(sorted(sorts), stretch, keep), kinds)


def fill_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """Per pack_id: capacity_tokens, containers, tokens, used (share of the room), documents, cut (documents in more
    than one piece) and apart: the mean distance of a container's pieces from its mean key, against that of all pieces
    from the mean of all (1 for containers filled in any order, 0 for containers of one place on the curve).
    """
    key = F.col("curve_key").cast("double")
    by = packed.groupBy("pack_id", "container").agg(
        F.sum("n_tokens").alias("n"), F.sum((F.col("piece") == 1).cast("long")).alias("cut"), F.sum((F.col("piece") == 0).cast("long")).alias("documents"),
        F.count(F.lit(1)).alias("k"), F.sum(key).alias("s"), F.sum(key * key).alias("q"),
    )
    inner = F.sum(F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("k")))
    outer = F.sum("q") - F.sum("s") * F.sum("s") / F.sum("k")
    by = by.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.sum("documents").alias("documents"), F.sum("cut").alias("cut"),
        F.sqrt(F.try_divide(inner, outer)).alias("apart"),
    )
    by = by.join(packs.select("pack_id", "capacity_tokens"), "pack_id")
    return by.withColumn("used", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
