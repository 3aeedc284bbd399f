"""Near-duplicate detection: 64-bit SimHash fingerprints, searched by the generalised pigeonhole principle.

Fingerprints of 3-word shingles are compared bit by bit; those at a Hamming distance of at most `distance` are linked,
and linked documents form components. The search runs on distinct fingerprints only, so copies cost one row.

Bits that are correlated over the whole corpus are grouped into the same partition. Partition i gets a threshold t_i
of its own; if the t_i + 1 add up to distance + 1, two fingerprints within `distance` agree within t_i on at least one
partition. A dynamic programme chooses the t_i (-1 leaves a partition out) so that the estimated number of candidate
pairs and probes is least. Rows meet by partition value, are verified, and each bucket returns a spanning forest of
its links instead of all its pairs. Buckets that hold many fingerprints are split again on the bits that are left, by
the same principle, so no bucket is compared all against all.

Defined results: null or blank text has the fingerprint zero and is linked like any other; texts of any length are
taken whole; repeated rows are kept; null ids count as larger than all others for the choice of the component's id;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestar.llm.common import map_batches, materialise, small, spread, text_column, without
from lodestar.llm.components import components

BITS = 64
DISTANCE = 3
SHINGLE = 3
SEED = 42
#: A bucket of more fingerprints is split on its remaining bits.
DENSE = 256
#: A bucket of more fingerprints is dealt to several tasks.
HOT = 50_000
_BLOCK = 1 << 15
#: How often a bucket may be dealt again.
_LEVELS = 3


def fingerprint(text: str) -> int:
    """A-Z is lower-cased, words are runs of other than space and tab to carriage return; a bit is 1 if it is set in
    over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    size = min(SHINGLE, len(words))
    starts = [0, *(e + 1 for e in ends[: len(ends) - size])]
    stops = ends[size - 1 :]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(stops), _BLOCK):
        h = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(stops), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")), make, "doc_id long, fp long")


# ---------------------------------------------------------------- the plan: partitions and thresholds


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]
    threshold: int


def _bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits how many have both; over all of them."""

    def count(batches):
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False)).astype("<i8").view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(x), _BLOCK):
                part = x[at : at + _BLOCK]
                both += part.T @ part
                total += len(part)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([both.ravel().astype(np.int64).tolist()], pa.list_(pa.int64()))], names=["n", "both"])

    parts = fps.select("fp").mapInArrow(count, "n long, both array<long>")
    cells = parts.select("n", F.posexplode("both").alias("at", "c")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect()
    both = np.zeros(BITS * BITS)
    for r in cells:
        both[r["at"]] = r["c"]
    return (cells[0]["n"] if cells else 0), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, groups: int) -> list[tuple[int, ...]]:
    """Greedy grouping: the bit of most correlation with a group's bits joins it, groups taking turns."""
    p = both.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, made = set(range(BITS)), []
    for g in range(groups):
        size = (BITS - sum(map(len, made))) // (groups - g)
        rest = sorted(free)
        chosen = [rest[int(np.argmax(corr[np.ix_(rest, rest)].sum(axis=1)))]]
        while len(chosen) < size:
            rest = [b for b in rest if b not in chosen]
            chosen.append(rest[int(np.argmax(corr[np.ix_(rest, chosen)].sum(axis=1)))])
        free -= set(chosen)
        made.append(tuple(sorted(chosen)))
    return made


def allocate(cost: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost with sum(t_i + 1) = distance + 1; cost[i][t + 1] is that of threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t, c in enumerate(row):
                if used + t <= distance + 1 and (used + t not in step or total + c < step[used + t][0]):
                    step[used + t] = (total + c, [*chosen, t - 1])
        best = step
    return best[distance + 1]


def make_plan(n: int, both: np.ndarray, distance: int = DISTANCE, widths: tuple[int, ...] = (2, 3, 4), probe_cost: float = 20.0) -> list[Partition]:
    """The cheapest plan over several numbers of partitions. Estimated candidates of a partition at threshold t: all
    pairs, times the chance that two fingerprints differ in at most t of its bits, from the bits' frequencies."""
    p = both.diagonal() / max(n, 1)
    differ = 2 * p * (1 - p)
    found: tuple[float, list[Partition]] | None = None
    for groups in widths:
        parts = group_bits(n, both, groups)
        cost = []
        for bits in parts:
            chance = np.zeros(distance + 2)
            chance[0] = 1.0
            for b in bits:
                chance[1:] = chance[1:] * (1 - differ[b]) + chance[:-1] * differ[b]
                chance[0] *= 1 - differ[b]
            probes = [0, 1, 1 + len(bits), 1 + len(bits) + len(bits) * (len(bits) - 1) // 2]
            row = [0.0]
            for t in range(distance + 1):
                if t + 1 < len(probes):
                    row.append(float(n) * n / 2 * chance[: t + 1].sum() + probe_cost * n * probes[t + 1])
            cost.append(row)
        total, chosen = allocate(cost, distance)
        if found is None or total < found[0]:
            found = (total, [Partition(bits, t) for bits, t in zip(parts, chosen) if t >= 0])
    return found[1]


# ---------------------------------------------------------------- search


def _mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _keyed(fps: DataFrame, plan: list[Partition]) -> DataFrame:
    """fp, part, key, probe: each fingerprint under its own value in every partition, and under the values that
    differ from it in up to the partition's threshold of bits. Only 0 bits are flipped for one bit, as the other
    fingerprint of such a pair flips none."""
    out = None
    for i, part in enumerate(plan):
        own = F.col("fp").bitwiseAND(F.lit(_mask(part.bits)))
        rows = fps.select("fp", F.lit(i).alias("part"), own.alias("key"), F.lit(False).alias("probe"))
        flips = []
        if part.threshold >= 1:
            flips += [(b,) for b in part.bits]
        if part.threshold >= 2:
            flips += [(a, b) for k, a in enumerate(part.bits) for b in part.bits[:k]]
        if flips:
            # the lowest bit comes as a literal: the mask of bit 63 is the least long, which has no negative
            masks = F.array(*[F.struct(F.lit(_mask(f)).cast("long").alias("all"), F.lit(_mask([min(f)])).cast("long").alias("low")) for f in flips])
            probes = fps.select("fp", F.lit(i).alias("part"), own.alias("own"), F.explode(masks).alias("m"))
            # of the pairs that differ in the bits of m, the one without the lowest of them probes
            probes = probes.where(F.col("fp").bitwiseAND(F.col("m.low")) == 0)
            rows = rows.union(probes.select("fp", "part", F.col("own").bitwiseXOR(F.col("m.all")).alias("key"), F.lit(True).alias("probe")))
        out = rows if out is None else out.union(rows)
    return out


def _close(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def _forest(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each component of the pairs: member and smallest member."""
    if not pairs:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def linked(own: np.ndarray, probe: np.ndarray, free: tuple[int, ...], distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among `own` and between `probe` and `own`, which agree outside `free` bits up to the probes' flips, as
    spanning forests. Sets that are too dense are split on the free bits by the pigeonhole principle."""
    every = np.unique(np.concatenate([own, probe]))
    if len(every) < 2 or not len(own):
        return []
    if len(every) <= DENSE or len(free) <= 4 * distance:
        found = []
        for at in range(0, len(every), DENSE):
            part = every[at : at + DENSE]
            i, j = np.nonzero(_close(part[:, None], every[None, :], distance) & (part[:, None] < every[None, :]))
            if len(i):
                found.append(_forest([(part[i], every[j])]))
        return found
    found, groups = [], distance + 1
    for g in range(groups):
        bits = free[g::groups]
        key = every & np.uint64(sum(1 << b for b in bits))
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        rest = tuple(b for b in free if b not in bits)
        for run in np.split(order, cuts):
            if len(run) > 1:
                found += linked(every[run], every[:0], rest, distance)
    return [_forest(found)] if found else []


def _search(keyed: DataFrame, plan: list[Partition], distance: int) -> DataFrame:
    """u, v: a forest of the links that each bucket has. keyed must hold each (part, key, sub) in one partition, sorted."""
    frees = [tuple(b for b in range(BITS) if b not in set(p.bits)) if p.threshold == 0 else tuple(range(BITS)) for p in plan]
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def out(pairs):
        u, v = _forest(pairs)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

    def flush(tag, fp, probe):
        """All complete buckets: tag numbers them in order."""
        pairs = []
        starts = np.concatenate([[0], np.flatnonzero(np.any(tag[1:] != tag[:-1], axis=1)) + 1, [len(fp)]])
        sizes = np.diff(starts)
        # small buckets all at once: row against the k-th row after it
        small = np.repeat(sizes <= DENSE, sizes)
        end = np.repeat(starts[1:], sizes)
        for k in range(1, int(min(DENSE, sizes.max()))):
            i = np.flatnonzero(small[:-k] & (np.arange(len(fp) - k) + k < end[:-k]))
            if not len(i):
                break
            i = i[~(probe[i] & probe[i + k]) & (fp[i] != fp[i + k])]
            i = i[_close(fp[i], fp[i + k], distance)]
            if len(i):
                pairs.append((fp[i], fp[i + k]))
        for s in np.flatnonzero(sizes > DENSE):
            a, b = starts[s], starts[s + 1]
            pairs += linked(fp[a:b][~probe[a:b]], fp[a:b][probe[a:b]], frees[int(tag[a, 0])], distance)
        return out(pairs)

    def run(batches):
        tags, fps, probes, held = [], [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "key", "sub")]
            tag = np.stack([c.astype(np.int64) for c in cols], axis=1)
            tags.append(tag)
            fps.append(batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            probes.append(batch.column("probe").to_numpy(zero_copy_only=False).astype(bool))
            held += len(tag)
            if held >= 1 << 18:
                tag, fp, probe = np.concatenate(tags), np.concatenate(fps), np.concatenate(probes)
                last = np.flatnonzero(np.any(tag != tag[-1], axis=1))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield flush(tag[:cut], fp[:cut], probe[:cut])
                tags, fps, probes, held = [tag[cut:]], [fp[cut:]], [probe[cut:]], len(tag) - cut
        if held:
            yield flush(np.concatenate(tags), np.concatenate(fps), np.concatenate(probes))

    return keyed.mapInArrow(run, "u long, v long")


def _split_hot(keyed: DataFrame, plan: list[Partition], distance: int, hot: int) -> DataFrame:
    """keyed with a column sub: rows of buckets with more than `hot` rows go to sub-buckets by parts of their remaining
    bits, so that close fingerprints share one at least, and those of sub-buckets that are still that large again, up to
    _LEVELS times. The large buckets are a table that is joined; nothing is collected."""
    groups = distance + 1
    now, done = keyed.withColumns({"sub": F.lit(0).cast("long"), "path": F.lit(0)}), None
    frees = {(i, 0): [b for b in range(BITS) if p.threshold or b not in p.bits] for i, p in enumerate(plan)}
    for _ in range(_LEVELS):
        large = materialise(now.groupBy("part", "key", "sub").count().where(F.col("count") > hot).select("part", "key", "sub", F.lit(True).alias("hot")), "hot")
        if large.isEmpty():
            break
        marked = now.join(small(large), ["part", "key", "sub"], "left")
        cool = marked.where(F.col("hot").isNull()).drop("hot")
        done = cool if done is None else done.unionByName(cool)
        # masks of the parts of the bits that are left, by the path of parts taken so far
        masks, after = [], {}
        for (i, path), free in frees.items():
            masks.append((i * 1000 + path, [_mask(free[g::groups]) for g in range(groups)]))
            for g in range(groups):
                after[i, path * groups + g + 1] = [b for b in free if b not in free[g::groups]]
        table = F.create_map(*[x for k, m in masks for x in (F.lit(k), F.array(*[F.lit(v).cast("long") for v in m]))])
        mine = F.element_at(table, F.col("part") * 1000 + F.col("path"))
        # the number of the part tells parts with equal values from one another
        to = F.transform(mine, lambda m, g: F.struct(F.xxhash64("sub", g, F.col("fp").bitwiseAND(m)).alias("sub"), (F.col("path") * groups + g + 1).alias("path")))
        split = marked.where(F.col("hot").isNotNull()).select("fp", "part", "key", "probe", F.explode(to).alias("to"))
        now, frees = materialise(split.select("fp", "part", "key", "probe", "to.sub", "to.path"), "split"), after
    return (now if done is None else done.unionByName(now)).drop("path")


def near_components(fps: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """fp, root for every distinct fingerprint of column fp; root is the smallest (signed) fingerprint reachable."""
    distinct = materialise(fps.select("fp").distinct(), "fingerprints")
    n, both = _bit_counts(distinct)
    if n == 0:
        return distinct.withColumn("root", F.col("fp"))
    plan = make_plan(n, both, distance)
    keyed = _split_hot(_keyed(distinct, plan), plan, distance, hot)
    dealt = keyed.repartition("part", "key", "sub").sortWithinPartitions("part", "key", "sub")
    links = components(_search(dealt, plan, distance))
    return distinct.join(links, distinct["fp"] == links["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links."""
    rows = materialise(fingerprints(docs), "simhash")
    roots = near_components(rows, distance, hot)
    least = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("__n")).join(roots, "fp"), "roots")
    lows = least.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("__members"))
    # a component of many fingerprints, and a fingerprint of many rows, are spread over several tasks
    left, right = spread(least, materialise(lows, "lows"), ["root"], "__members", F.col("fp"))
    ids = materialise(left.join(right, ["root", "__salt"]).select("fp", "component_id", "__n"), "classes")
    left, right = spread(rows, ids, ["fp"], "__n", F.col("doc_id"))
    return left.join(right, ["fp", "__salt"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the smallest id; all columns stay. Rows that repeat a
    kept id stay together. Texts do not move while the ids that go are few enough to broadcast."""
    found = simhash_components(docs)
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = found.groupBy("doc_id").agg(stays.alias("stays")).where(~F.col("stays")).select("doc_id")
    return without(docs, materialise(gone, "dropped"))
