"""N-gram Jaccard join (operator 4): grouped prefix join over word shingles, exact.

1. One pass gives each document its set's size and identity (a 128-bit hash of the set) and counts all shingles in a
   sketch of fixed size. The sketch only orders shingles, rare ones first; any order gives right results.
2. A second pass takes each set's prefix in that order. Sets with identical prefix and size are one group. Groups that
   share a prefix shingle and pass the size and position filters are candidates; members are expanded and verified.
3. Candidates are taken in two rounds. First each group meets one head for each of its shingles, which makes no more pairs
   than postings and joins cohesive groups at once; then exactly those pairs are expanded whose sides are not yet
   connected and not yet tested. No link that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, Rolling, buffer, mixed, slices, stored, words
from tidemark.llm.sketch import CountSketch, cell

SHINGLE = 5
#: Two sets link when 7 * common >= 3 * (sizes' sum): a Jaccard similarity of 0.75.
#: A shingle this many half doublings above the mean cell is known to be shared and needs no counting; its postings stay spread out.
HOT_LEVEL = 12
#: The order's sketch has a cell for so many characters, between these bounds: the upper one bounds what is broadcast (64 MB).
#: Past it the order gets coarser, which makes more candidates but no other result.
CHARACTERS_PER_CELL, LEAST_CELLS, MOST_CELLS = 128, 1 << 18, 1 << 26
SLICE = 4_000_000
#: Parts in which candidate pairs are verified.
SLICES = 4

_letters, _order = Rolling(303), Rolling(404)
_seeds = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)]


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and n + 1 offsets by row; a row with fewer words has its whole sequence as one, without words none."""
    starts, ends, first = words(raw, offsets)
    prefix = _order.prefix(_letters.between(_letters.prefix(LOWER[raw]), starts, ends))
    counts = np.diff(first)
    made = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(made)])
    begin = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], made)
    return _order.between(prefix, begin, np.minimum(begin + size, np.repeat(first[1:], made))), at


def set_identity(found: np.ndarray) -> bytes:
    """128 bits of a set of distinct hashes, whatever their order."""
    return np.array([mixed(found ^ s).sum(dtype=np.uint64) for s in _seeds], np.uint64).tobytes()


def binaries(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


#: By this one text of each set is found again: the document's id, without one a hash of its text.
KEY = "coalesce(cast(doc_id as bigint), xxhash64(text)) as key"


def _profile(docs: DataFrame, size: int, cells: int) -> DataFrame:
    """Rows doc_id, key, text_key, n_shingles, gid for documents; and rows part, counts (compressed) of the task's sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = CountSketch(1, cells)
        names = ["doc_id", "key", "text_key", "n_shingles", "gid", "part", "counts"]
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            raw, offsets = buffer(batch.column(1))
            sizes, ids = [], []
            for a, b in slices(offsets, SLICE):
                hashes, at = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                sets = [np.unique(hashes[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                sizes += map(len, sets)
                ids += map(set_identity, sets)
                if sets:
                    sketch.add(0, np.concatenate(sets))
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), binaries(ids), none.cast(pa.int32()), none.cast(pa.binary())], names)
        if kind is not None:
            parts = sketch.parts()
            none = pa.nulls(len(parts))
            yield pa.RecordBatch.from_arrays([none.cast(kind), *[none.cast(pa.int64())] * 3, none.cast(pa.binary()), pa.array([p[0] for p in parts], pa.int32()), binaries([p[1] for p in parts])], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", "text", KEY, "xxhash64(text) as text_key").mapInArrow(work, f"doc_id {kind}, key long, text_key long, n_shingles long, gid binary, part int, counts binary")


def _prefixes(docs: DataFrame, levels, cells: int, size: int, buckets: int) -> DataFrame:
    """Postings (token, grp, n, pos) of prefix shingles that several groups share, and members (grp, gid, n) without a token.

    Within a slice a group is written once. Common shingles go on as single rows; the others are packed by hash range and
    compared where they meet, so those of one group only are never written.
    """
    names = ["bucket", "blob", "token", "grp", "gid", "n", "pos"]

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        seen_members: set[bytes] = set()
        for batch in batches:
            raw, offsets = buffer(batch.column(1))
            for a, b in slices(offsets, SLICE):
                hashes, at = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                groups: dict[bytes, int] = {}
                tokens, sizes, member = [], [], []
                for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if x == y:
                        continue
                    found = np.unique(hashes[x:y])
                    gid, n = set_identity(found), len(found)
                    if gid in seen_members:
                        continue
                    if len(seen_members) < 200_000:
                        seen_members.add(gid)
                    rank = level[0][cell(found, 0, cells)].astype(np.uint64)
                    prefix = np.sort((rank << np.uint64(56)) | (found >> np.uint64(8)))[: n - (3 * n + 3) // 4 + 1]
                    grp = set_identity(np.append(prefix, np.uint64(n)))
                    member.append((grp, gid, n))
                    if grp not in groups:
                        groups[grp] = len(groups)
                        tokens.append(prefix)
                        sizes.append(n)
                yield _rows([(k % buckets, None, None, g, i, n, None) for k, (g, i, n) in enumerate(member)])
                if not tokens:
                    continue
                token = np.concatenate(tokens)
                length = np.fromiter(map(len, tokens), np.int64, len(tokens))
                owner = np.repeat(np.arange(len(tokens)), length)
                pos = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
                ids, own_sizes = [*groups], np.array(sizes)
                hot = (token >> np.uint64(56)) >= HOT_LEVEL
                if hot.any():
                    yield _rows([(int(k) % buckets, None, t, ids[o], None, sizes[o], p) for k, t, o, p in zip(owner[hot] + pos[hot], token[hot].view(np.int64).tolist(), owner[hot].tolist(), pos[hot].tolist(), strict=True)])
                cold = np.flatnonzero(~hot)
                goal = (mixed(token[cold]) % np.uint64(buckets)).astype(np.int64)
                cold = cold[order := np.argsort(goal, kind="stable")]
                bounds = np.searchsorted(goal[order], np.arange(buckets + 1))
                table = np.frombuffer(b"".join(ids), np.uint64).reshape(-1, 2)
                out = []
                for k in range(buckets):
                    if bounds[k] < bounds[k + 1]:
                        some = cold[bounds[k] : bounds[k + 1]]
                        used, local = np.unique(owner[some], return_inverse=True)
                        blob = np.array([len(some), len(used)], np.int64).tobytes() + token[some].tobytes() + local.astype(np.uint32).tobytes() + pos[some].astype(np.uint32).tobytes() + table[used].tobytes() + own_sizes[used].astype(np.int64).tobytes()
                        out.append((k, blob, None, None, None, None, None))
                yield _rows(out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple] = []
        out_names = ["token", "grp", "gid", "n", "pos"]
        for batch in batches:
            packed = np.array(batch.column(1).is_valid())
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(~packed)) for c in batch.columns[2:]], out_names)
            for blob in batch.column(1).drop_null():
                data = blob.as_buffer()
                n, m = np.frombuffer(data, np.int64, 2).tolist()
                cuts = np.cumsum([16, 8 * n, 4 * n, 4 * n, 16 * m, 8 * m])
                token, owner, pos, ids, sizes = (np.frombuffer(data, kind, count, int(at)) for kind, count, at in zip((np.uint64, np.uint32, np.uint32, np.uint64, np.int64), (n, n, n, 2 * m, m), cuts, strict=False))
                ids = ids.reshape(-1, 2)[owner]
                pieces.append((token, ids[:, 0], ids[:, 1], sizes[owner], pos))
        if not pieces:
            return
        token, high, low, n, pos = (np.concatenate(c) for c in zip(*pieces, strict=True))
        order = np.lexsort((low, high, token))
        token, high, low, n, pos = (c[order] for c in (token, high, low, n, pos))
        same_token = token[1:] == token[:-1]
        fresh = np.ones(len(token), bool)
        fresh[1:] = ~(same_token & (high[1:] == high[:-1]) & (low[1:] == low[:-1]))
        token, high, low, n, pos = (c[fresh] for c in (token, high, low, n, pos))
        same = token[1:] == token[:-1]
        shared = np.append(same, False) | np.append(False, same)
        ids = np.stack([high[shared], low[shared]], 1).tobytes()
        count = int(shared.sum())
        for a in range(0, count, 50_000):
            b = min(count, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(token[shared][a:b].view(np.int64)), binaries([ids[16 * k : 16 * k + 16] for k in range(a, b)]), pa.nulls(b - a).cast(pa.binary()), pa.array(n[shared][a:b]), pa.array(pos[shared][a:b].astype(np.int64))], out_names)

    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    spread = docs.select("doc_id", "text").mapInArrow(collect, "bucket int, blob binary, token long, grp binary, gid binary, n long, pos long")
    return spread.repartition(buckets, "bucket").mapInArrow(meet, "token long, grp binary, gid binary, n long, pos long")


def _sets(docs: DataFrame, wanted: DataFrame, size: int, name: str) -> DataFrame:
    """gid and sorted hashes (binary) of the wanted sets; wanted: gid, key of a document that has it, whether several rows have that key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffer(batch.column(1))
            kept, ids, found_sets = [], [], []
            for a, b in slices(offsets, SLICE):
                hashes, at = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                for i, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    found = np.unique(hashes[x:y])
                    if (own := set_identity(found)) == batch.column(0)[a + i].as_py():  # a repeated key may have another text
                        kept.append(a + i)
                        ids.append(own)
                        found_sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([binaries(ids), binaries(found_sets), batch.column(2).take(pa.array(kept, pa.int64()))], ["gid", "hashes", "again"])

    joined = docs.selectExpr("text", KEY).join(wanted, "key").select("gid", "text", "again")
    found = stored(joined.mapInArrow(work, "gid binary, hashes binary, again boolean"), name)
    return found.where("not again").drop("again").unionByName(found.where("again").drop("again").dropDuplicates(["gid"]))


def _verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of sets that link. A slice of the pairs at a time, so that few copies of sets are on disk together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]), kind="stable")
                keep.append(7 * int((both[1:] == both[:-1]).sum()) >= 3 * (len(p) + len(q)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    found = None
    for k in range(SLICES):
        mine = lambda c, k=k: F.pmod(F.xxhash64(c), F.lit(SLICES)) == k
        left = pairs.where(mine("a")).join(sets.select(F.col("gid").alias("a"), F.col("hashes").alias("left")).where(mine("a")), "a")
        both = left.join(sets.select(F.col("gid").alias("b"), F.col("hashes").alias("right")), "b")
        part = stored(both.select("a", "b", "left", "right").mapInArrow(work, "a binary, b binary"), f"{name}{k}")
        found = part if found is None else found.unionByName(part)
    return found


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, label: the smallest node of its component, by large-star and small-star steps until nothing changes.

    A node of very many neighbours is aggregated with map-side minima and joined as a skewed side.
    """
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for step in range(most):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        current = stored(small, f"stars{step}")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def _expanded(pairs: DataFrame, members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs of groups (x, y) to pairs of member sets (a, b) that are not yet connected; (x, x) pairs members of one group."""
    of = members.select("grp", "gid") if labels is None else members.select("grp", "gid").join(labels, F.col("gid") == F.col("node"), "left").select("grp", "gid", F.coalesce("label", "gid").alias("label"))
    left = pairs.join(of.withColumnsRenamed({"grp": "x", "gid": "a", "label": "la"}), "x")
    both = left.join(of.withColumnsRenamed({"grp": "y", "gid": "b", "label": "lb"}), "y").where("a <> b" if labels is None else "la <> lb")
    return both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


FITS = "7 * least({x}.n - {x}.pos, {y}.n - {y}.pos) >= 3 * ({x}.n + {y}.n)"


def linked(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, n_shingles and label of every row: rows with equal labels and a shingle are one component."""
    spark = docs.sparkSession
    wanted = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // CHARACTERS_PER_CELL
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << int(wanted).bit_length()))
    profile = stored(_profile(docs, size, cells), "profile")
    levels = spark.sparkContext.broadcast(CountSketch.levels(profile.where("part is not null").select("part", "counts"), 1, cells))  # MOST_CELLS bytes at most
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    prefixes = stored(_prefixes(docs, levels, cells, size, buckets), "prefixes")
    people = profile.where("part is null").select("doc_id", "key", "text_key", "n_shingles", "gid")
    members = prefixes.where("token is null").groupBy("grp", "gid").agg(F.first("n").alias("n"))
    several = members.groupBy("grp").agg(F.count("*").alias("k"), F.min("gid").alias("head")).where("k > 1")
    postings = prefixes.where("token is not null").select("token", "grp", "n", "pos").withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(4 / 3))))
    touched = postings.select("grp").unionByName(several.select("grp")).distinct()
    live = stored(members.join(touched, "grp"), "members")
    keys = people.groupBy("key").agg((F.count("*") > 1).alias("again"))
    where = stored(people.where("n_shingles > 0").groupBy("gid").agg(F.min("key").alias("key")).join(keys, "key"), "where")

    def links_of(candidates: DataFrame, name: str) -> DataFrame:
        """The candidates that link; only their sets are read."""
        pairs = stored(candidates, f"pairs_{name}")
        wanted = pairs.select(F.col("a").alias("gid")).unionByName(pairs.select(F.col("b").alias("gid"))).distinct().join(where, "gid")
        return _verified(pairs, _sets(docs, wanted, size, f"sets_{name}"), f"links_{name}")

    # Each group meets the heads of its shingles, and the members of a group meet its smallest. The head is the group with
    # the fewest rarer shingles: among near copies the least edited one, which links to all that any of them links to.
    heads = postings.groupBy("token", "band").agg(F.min_by(F.struct("grp", "n", "pos"), F.struct(F.col("pos") / F.col("n"), "grp")).alias("h")).select("token", "band", "h.*")
    near = heads.unionByName(heads.withColumn("band", F.col("band") + 1))
    pairs = postings.alias("p").join(near.alias("q"), ["token", "band"]).where("p.grp <> q.grp").where(FITS.format(x="p", y="q")).select(F.greatest("p.grp", "q.grp").alias("x"), F.least("p.grp", "q.grp").alias("y")).distinct()
    inside = several.select(F.col("grp").alias("x"), "head").join(live.select(F.col("grp").alias("x"), F.col("gid").alias("a")), "x").where("a <> head")
    links = links_of(_expanded(pairs, live, None).unionByName(inside.select("a", F.col("head").alias("b"))).distinct(), "heads")
    labels = components(links)

    # What is not connected yet: of each shingle, all groups outside its largest component against all others.
    known = live.join(labels, F.col("gid") == F.col("node"), "left").select("grp", F.coalesce("label", "gid").alias("label"))
    at = postings.join(known, "grp")
    sizes = at.groupBy("token", "label").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("token").agg(F.max_by("label", F.struct("k", "label")).alias("largest"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    open_ = stored(at.join(largest, "token"), "open")
    small = open_.where("label <> largest")
    # The other side's band is the same or a neighbour.
    near = small.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    rest = near.alias("p").join(open_.alias("q"), ["token", "band"]).where("p.label <> q.label").where(FITS.format(x="p", y="q")).select(F.greatest("p.grp", "q.grp").alias("x"), F.least("p.grp", "q.grp").alias("y")).distinct()
    inside = several.select(F.col("grp").alias("x"), F.col("grp").alias("y"))
    tested = _expanded(pairs, live, None)
    last = links_of(_expanded(rest.unionByName(inside), live, labels).join(tested, ["a", "b"], "left_anti"), "rest")
    final = components(links.unionByName(last))

    return people.join(final, F.col("gid") == F.col("node"), "left").select("doc_id", "text_key", "n_shingles", F.coalesce("label", "gid").alias("label"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id for every document: the smallest doc_id that links lead to.

    Null and empty texts and texts without words have an empty set and stay alone. Copies of one set share a component by
    its identity and make no pairs. Null doc_ids are linked like others and never name a component unless all of its
    ids are null. Rows with one doc_id are each judged by their own text. An empty table gives no rows.
    """
    named = linked(docs, size)
    smallest = named.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("least_id"))
    return named.join(smallest, "label", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs, all columns, with one row of each component: that of the smallest doc_id (null last, then by a hash of the text).

    Rows without a word link with nothing and all stay. Of rows equal in doc_id and text one stays.
    """
    named = stored(linked(docs, size), "linked")
    first = named.where("n_shingles > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")).alias("k"))
    chosen = first.select("k.doc_id", "k.text_key")
    rows = named.where("n_shingles > 0").groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"))
    empty = named.where("n_shingles = 0").select("doc_id", "text_key").distinct().withColumn("rows", F.lit(1))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    kept = chosen.join(rows, same(chosen, rows)).select(chosen["doc_id"], chosen["text_key"], "rows").unionByName(empty).alias("k")
    keyed = docs.withColumn("__text_key", F.xxhash64("text")).alias("d")
    joined = keyed.join(kept, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.__text_key") == F.col("k.text_key"))).select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col("k.rows").alias("__rows"), "__text_key")
    once = joined.where("__rows = 1")
    again = joined.where("__rows > 1").dropDuplicates(["doc_id", "__text_key"])
    return once.unionByName(again).drop("__rows", "__text_key")
