"""MinHash near-dedup with SuperMinHash signatures.

1. Each text becomes its set of ``words``-word shingles (64-bit hashes) and the
   SuperMinHash signature of the set.  Texts with equal word sequences are one
   node.
2. Signatures are cut into ``bands`` of ``rows`` values; nodes that agree on a
   band share a bucket.  At the defaults a pair with a similarity of 0.85 shares
   none with a probability of 1.6e-7, and of 0.8 with 4.4e-5.  A pair in a
   bucket is a candidate unless the sizes of its sets or the signatures (5.5
   standard deviations) rule out a link.
3. Nearest first: each node of a bucket names its ``nearest`` candidates there
   by the signatures; the best of each node are verified on the full sets, and
   the links are grouped by a distributed union-find.  Nearly all links that
   matter are found so, by a few pairs a node however large its bucket.
4. The rest: in every bucket with nodes of more than one group, all candidate
   pairs of different groups are verified on the full sets inside the task that
   holds the bucket.  Nothing is emitted for a pair that is not linked, and of
   the links only those that unite groups.  Large buckets are cut into cells of
   ``cell`` nodes; the nodes of a bucket's largest group meet only those of
   other groups, as they are linked among themselves already.

Steps 3 and 4 together verify every candidate pair whose groups are not united
otherwise.  Nothing that grows with the input is collected or broadcast
unchecked, no join pairs the nodes of a bucket, and every stage starts from
tables in the shared folder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import keep, release, ship, text_of, tidy
from pathloom.llm.components import components

_UPPER = {c: c + 32 for c in range(65, 91)}
_SPLIT = re.compile(r"[\x20\x09-\x0D]+")
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Rows up to this number (some 32 bytes each) are broadcast to select texts; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Shingles whose permutations are held at a time.
SLICE = 40_000
#: Set elements that are compared at a time.
_HELD = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _WordHashes()


def words_of(text: str) -> list[str]:
    """Words between ASCII blanks, A-Z in lower case."""
    words = _SPLIT.split(text.translate(_UPPER) if not text.isascii() else text.lower())
    return [w for w in words if w]


def shingles(words: list[str], size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of fewer than ``size`` words the sequence is the only one."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = _mix(out * _GOLD + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures of sets of 64-bit hashes: row i, m values.

    Step j gives each element its j-th rank: a uniform number plus j, at the
    j-th place of the element's own random permutation of 0..m-1.  A signature
    holds the least value at each place.  As values of step j are at least j, a
    set is finished (early stopping) when every place holds a value below the
    next step; a set much larger than m needs a step or two.  All elements of
    all sets of a batch take a step together.
    """
    out = np.full((len(sets), m), np.inf)
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1)) if len(elements) and m > 1 else np.zeros((len(elements), m), np.uint16)
    with np.errstate(over="ignore"):
        for j in range(m):
            draw = _mix(elements + _GOLD * np.uint64(2 * j + 1))
            value = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + j
            pick = j + (_mix(draw ^ _GOLD) % np.uint64(m - j)).astype(np.int64)
            rows = np.arange(len(elements))
            place = order[rows, pick]
            order[rows, pick] = order[:, j]
            order[:, j] = place
            np.minimum.at(out.reshape(-1), owner * m + place.astype(np.int64), value)
            busy = out.max(axis=1) >= j + 1
            live = busy[owner]
            if not live.any():
                break
            if not live.all():
                elements, owner, order = elements[live], owner[live], order[live]
    return out


def signatures_of(sets: list[np.ndarray], m: int) -> np.ndarray:
    """:func:`super_minhash` in slices of bounded memory: a set larger than ``SLICE`` is the least of its parts."""
    out, held, n = np.full((len(sets), m), np.inf), [], 0

    def flush() -> None:
        for (i, _), row in zip(held, super_minhash([s for _, s in held], m), strict=True):
            np.minimum(out[i], row, out=out[i])
        held.clear()

    for i, s in enumerate(sets):
        for part in np.split(s, range(SLICE, len(s), SLICE)):
            if held and n + len(part) > SLICE:
                flush()
                n = 0
            held.append((i, part))
            n += len(part)
    flush()
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band's number is part of it."""
    bits = signatures[:, : bands * rows].view(np.uint64).reshape(len(signatures), bands, rows)
    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(signatures), 1))
    with np.errstate(over="ignore"):
        for r in range(rows):
            keys = _mix(keys * _GOLD + bits[:, :, r])
    return keys


def _sign(size: int, bands: int, rows: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                words = [words_of(t.as_py()) for t in part.column(2)]
                sets = [shingles(w, size) for w in words]
                digests = [xxhash.xxh3_128_digest("\n".join(w).encode("utf-8", "surrogatepass")) if w else None for w in words]
                signatures = signatures_of(sets, m)
                keys = band_keys(signatures, bands, rows).view(np.int64)
                lanes = _mix(signatures.view(np.uint64)).astype(np.uint8)  # equal values stay equal; one in 256 others agrees too
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(digests, pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(list(keys), pa.list_(pa.int64())),
                        pa.array([x.tobytes() for x in lanes], pa.binary()),
                    ],
                    names=["doc_id", "mark", "digest", "n", "keys", "lanes"],
                )
        _hashes.clear()
        tidy()

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                found = [shingles(words_of(t.as_py()), size).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["node", "set"])
        _hashes.clear()
        tidy()

    return run


def _linked(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sorted sets ``others`` are linked with the sorted set ``one``."""
    sizes = np.array([len(s) for s in others])
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * common >= percent * (len(one) + sizes - common)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links = [bool(_linked(np.frombuffer(x.as_buffer(), np.uint64), [np.frombuffer(y.as_buffer(), np.uint64)], percent)[0]) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(links, pa.bool_()))

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of rows with equal (key, cell), the first two columns, of a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key, cell = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            now = (key[start], cell[start])
            if held and now != last:
                yield pa.concat_batches(held)
                held = []
            held.append(b.slice(start, end - start))
            last = now
    if held:
        yield pa.concat_batches(held)


def _matrix(column: pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), m)


def _candidates(labels: np.ndarray, n: np.ndarray, lanes: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, rows that are its candidates, equal signature values of each) for the rows of a cell that have any.

    The share of equal values estimates the similarity j with a standard
    deviation of at most sqrt(j (1 - j) / m).
    """
    k, m = lanes.shape
    j = percent / 100
    least = (j - 5.5 * (j * (1 - j) / m) ** 0.5) * m
    step = max(1, (4 << 20) // (k * m))
    for i in range(0, k, step):
        part = slice(i, i + step)
        fits = (labels[part, None] != labels[None, :]) & (100 * np.minimum(n[part, None], n[None, :]) >= percent * np.maximum(n[part, None], n[None, :]))
        equal = np.count_nonzero(lanes[part, None, :] == lanes[None, :, :], axis=2)
        fits &= equal >= least
        for row in np.flatnonzero(fits.any(axis=1)):
            others = np.flatnonzero(fits[row])
            yield i + int(row), others, equal[row, others]


def _nearest(percent: int, m: int, most: int):
    """(key, cell, node, n, lanes) -> a, b, near: the ``most`` nearest candidates b of each node a of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        near: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            arrays = [pa.array(np.concatenate(x)) for x in (a, b, near)]
            for x in (a, b, near):
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "near"])

        for cell in _cells(batches):
            if cell.num_rows < 2:
                continue
            node, n = cell.column(2).to_numpy(), cell.column(3).to_numpy()
            for row, others, equal in _candidates(node, n, _matrix(cell.column(4), m), percent):
                best = np.lexsort((node[others], -equal))[:most]
                a.append(np.full(len(best), node[row]))
                b.append(node[others[best]])
                near.append(equal[best].astype(np.int64))
                held += len(best)
            if held >= 50_000:
                yield out()
                held = 0
        if held:
            yield out()
        tidy()

    return run


def _open_rows(percent: int, m: int):
    """(key, cell, node, label, n, lanes, keys) -> key, cell, node: the nodes with a candidate of another group that first meets them in this bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            label = cell.column(3).to_numpy()
            if (label == label[0]).all():
                continue
            keys = np.asarray(cell.column(6).flatten()).reshape(cell.num_rows, -1)
            here = cell.column(0)[0].as_py()
            take = np.zeros(cell.num_rows, bool)
            for row, others, _ in _candidates(label, cell.column(4).to_numpy(), _matrix(cell.column(5), m), percent):
                common = (keys[others] == keys[row]).argmax(axis=1)
                first = keys[row][common] == here
                if first.any():
                    take[row] = True
                    take[others[first]] = True
            if take.any():
                yield pa.RecordBatch.from_arrays(cell.columns[:3], names=["key", "cell", "node"]).filter(pa.array(take))
        tidy()

    return run


def _last_links(percent: int, m: int):
    """(key, cell, node, label, n, lanes, set) -> a, b: links that unite the groups of a cell, all of its candidates verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            node, label = cell.column(2).to_numpy(), cell.column(3).to_numpy()
            group = np.unique(label, return_inverse=True)[1]  # groups that are united here get one number
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in cell.column(6)]
            found: list[tuple[int, int]] = []
            for row, others, _ in _candidates(label, cell.column(4).to_numpy(), _matrix(cell.column(5), m), percent):
                others = others[others > row]
                while len(others := others[group[others] != group[row]]):
                    cut = int(np.searchsorted(np.cumsum([len(sets[o]) for o in others]), _HELD)) + 1
                    part, others = others[:cut], others[cut:]
                    for o in part[_linked(sets[row], [sets[o] for o in part], percent)]:
                        if group[o] != group[row]:
                            found.append((int(node[row]), int(node[o])))
                            group[group == group[o]] = group[row]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def _share(node: Column | str, parts: Column) -> Column:
    """A node's part of a bucket that is cut into ``parts``."""
    return F.pmod(F.xxhash64(node, F.lit(17)), parts).cast("long")


def near_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = 33,
    rows: int = 6,
    nearest: int = 3,
    cell: int = 512,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words lie between ASCII blanks; A-Z count as a-z.  A text of fewer than
    ``words`` words has its whole sequence as its one shingle.  Texts whose
    shingle sets have ``100 * |intersection| >= percent * |union|`` are linked;
    ``component_id`` is the smallest id that links reach and ``kept`` marks the
    document that bears it.  Null, empty and blank texts have 0 shingles, are
    linked with nothing and stay.  A row with a null id is linked with nothing,
    has a null component and stays.  Rows that share an id and a text are one
    document; with different texts each goes by its own text.  Other columns of
    the input are not looked at.  An empty table gives an empty result.
    """
    spark, m = df.sparkSession, bands * rows
    ship(spark)
    kind = dict(df.dtypes)[id_col]
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("mark"), text_of(text_col).alias("text"))
    signed = docs.mapInArrow(_sign(words, bands, rows), f"doc_id {kind}, mark long, digest binary, n long, keys array<long>, lanes binary")
    signed = keep(signed.withColumn("row", F.monotonically_increasing_id()))

    # copies: one node for each word sequence, known by the number of one of its rows
    usable = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    texts = keep(usable.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")))

    # buckets with more than one node
    single = texts.select(F.col("node").alias("row"))
    spread = signed.select("row", "keys").join(single, "row", "left_semi").select(F.col("row").alias("node"), F.explode("keys").alias("key"))
    shared = keep(spread.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1))
    buckets = keep(spread.join(shared, "key").select("key", "node", "members"))
    nodes = keep(signed.join(buckets.select(F.col("node").alias("row")).distinct(), "row", "left_semi").select(F.col("row").alias("node"), "doc_id", "mark", "n", "lanes", "keys"))
    release(shared)

    # full sets of the nodes in such buckets
    wanted = nodes.select("node", "doc_id", "mark")
    few = wanted.count() <= BROADCAST_ROWS
    own = docs.join(F.broadcast(wanted) if few else wanted, ["doc_id", "mark"]).select("node", "text")
    own = own.groupBy("node").agg(F.first("text").alias("text"))  # (rows repeated with id and text)
    sets = keep(own.mapInArrow(_sets(words), "node long, set binary"))

    # nearest first
    laid = buckets.join(nodes.select("node", "n", "lanes"), "node")
    laid = laid.select("key", _share("node", F.ceil(F.col("members") / (2 * cell))).alias("cell"), "node", "n", "lanes")
    laid = laid.repartition("key", "cell").sortWithinPartitions("key", "cell")
    near = laid.mapInArrow(_nearest(percent, m, nearest), "a long, b long, near long")
    best = near.groupBy("a").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("near")).alias("far"), "b"))), 1, nearest).alias("best"))  # at most bands * nearest of a node
    pairs = best.select("a", F.explode("best.b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = sets.withColumnsRenamed({"node": "a", "set": "x"}), sets.withColumnsRenamed({"node": "b", "set": "y"})
    links = keep(keep(pairs).join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long"))
    label = components(links)

    # the rest: buckets whose nodes are in several groups
    grouped = keep(buckets.select("key", "node").join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    sizes = grouped.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    several = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("top")).where(F.col("labels") > 1)
    several = keep(several.select("key", "all", F.col("top.c").alias("largest"), F.col("top.label").alias("major")))
    tall, wide = F.ceil((F.col("all") - F.col("largest")) / cell), F.ceil(F.col("largest") / cell)
    i, j = _share("node", F.col("tall")), _share("node", F.col("wide"))
    places = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)
    among = places(F.col("tall"), lambda k: F.least(i, k) * F.col("tall") + F.greatest(i, k))
    across = places(F.col("wide"), lambda k: F.col("tall") * F.col("tall") + i * F.col("wide") + k)
    down = places(F.col("tall"), lambda k: F.col("tall") * F.col("tall") + k * F.col("wide") + j)
    whole = F.array(F.lit(0).cast("long"))
    where = F.when(F.col("all") <= 2 * cell, whole).when(F.col("label") == F.col("major"), down).otherwise(F.concat(among, across))
    open_ = grouped.join(several, "key").withColumns({"tall": tall, "wide": wide}).select("key", F.explode(where).alias("cell"), "node", "label")
    open_ = open_.join(nodes.select("node", "n", "lanes", "keys"), "node").select("key", "cell", "node", "label", "n", "lanes", "keys")
    flagged = keep(open_.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_open_rows(percent, m), "key long, cell long, node long"))
    full = flagged.join(label, "node", "left").join(nodes.select("node", "n", "lanes"), "node").join(sets, "node")
    full = full.select("key", "cell", "node", F.coalesce("label", "node").alias("label"), "n", "lanes", "set").repartition("key", "cell").sortWithinPartitions("key", "cell")
    more = keep(full.mapInArrow(_last_links(percent, m), "a long, b long"))
    label = keep(components(links.union(more)))
    release(buckets, grouped, several, flagged, sets, nodes, links, more)

    # the smallest id of each group, for the texts that are not the only one of theirs
    grouped = keep(texts.join(label, "node", "left").where(F.col("label").isNotNull() | (F.col("copies") > 1)).select("digest", "first", F.coalesce("label", "node").alias("label")))
    lowest = keep(grouped.groupBy("label").agg(F.min("first").alias("lowest")))
    named = keep(grouped.join(lowest, "label").select("digest", "lowest"))
    release(texts, label, grouped, lowest)
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


#: All pairs that share a shingle, by an exact join; fit for small tables only.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS s FROM g),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM i JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b WHERE 100 * c >= 85 * (len(x.s) + len(y.s) - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT g.doc_id, CAST(len(any_value(g.s)) AS BIGINT) AS n_shingles, min(r.b) AS component_id, g.doc_id = min(r.b) AS kept
FROM g JOIN r ON r.a = g.doc_id GROUP BY g.doc_id
"""
