"""Document fingerprints (operator 8): randomised edit embedding, sampled, banded and verified.

All texts share one random walk: at step j a text shows the character under its pointer, and a random bit of (j, character)
says whether the pointer moves on. Two texts whose edit distance is small fall back into step soon after each edit, so
their shown strings have a small Hamming distance. A fingerprint keeps samples of the shown string at fixed steps, the
same number in each octave of steps, four bits each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.jaccard import components

#: Samples in each octave of steps, and rows of the random table (steps use it in turn).
SAMPLES = 48
PERIOD = 4096
BLOCK = 1 << 20
#: Cells of the id range that are counted to deal documents out in order.
CELLS = 65_536
#: Samples of one band of the near-duplicate search.
BAND = 8

_rng = np.random.default_rng(20240811)
_moves = _rng.integers(0, 2, size=(PERIOD, 256), dtype=np.int64)
_moves[:, 0] = 0  # at its end a text stands still
_steps = np.unique(np.concatenate([np.unique(_rng.integers(1 << o, 2 << o, size=SAMPLES)) for o in range(40)]))
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte (1 to 255) per character, four zeros after each text; the digit of the four characters from each place; starts.

    Wide arrays exist for BLOCK characters at a time only.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 4) - sizes - 4
    total = int((sizes + 4).sum())
    small, digit = np.zeros(total + 4, np.uint8), np.empty(total, np.uint8)
    for own, begin in zip(texts, starts.tolist(), strict=True):
        for a in range(0, len(own), BLOCK):
            code = np.frombuffer(own[a : a + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
            small[begin + a : begin + a + len(code)] = ((code * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(255) + np.uint32(1)
    for a in range(0, total, BLOCK):
        b = min(total, a + BLOCK)
        mix = np.zeros(b - a, np.uint32)
        for k in range(4):
            mix = mix * np.uint32(0x01000193) + small[a + k : b + k]
            mix ^= mix >> np.uint32(15)
        digit[a:b] = (mix * np.uint32(0x85EBCA6B)) >> np.uint32(28)
    return small, digit, starts


def fingerprints(texts: list[str]) -> list[str]:
    """All texts walk in step, the longest first; texts that have ended drop out."""
    if not texts:
        return []
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    small, digit, starts = symbols(texts)
    order = np.argsort(-sizes, kind="stable")
    at, end = starts[order].copy(), (starts + sizes)[order]
    most = int(sizes.max())
    steps = _steps[: np.searchsorted(_steps, 4 * most + 64)]
    shown = np.full((len(steps), len(texts)), 255, np.uint8)
    active, step = int((sizes > 0).sum()), 0
    symbol, move = np.empty(len(texts), np.uint8), np.empty(len(texts), np.int64)
    for row, goal in enumerate(steps.tolist()):
        while step < goal and active:
            for _ in range(min(goal - step, 256)):
                np.take(small, at[:active], out=symbol[:active], mode="clip")
                np.take(_moves[step % PERIOD], symbol[:active], out=move[:active], mode="clip")
                at[:active] += move[:active]
                step += 1
            running = np.flatnonzero(at[:active] < end[:active])
            active = int(running[-1]) + 1 if len(running) else 0
        if not active:
            break
        here = at[:active]
        shown[row, :active] = np.where(here < end[:active], digit[here], 255)
    found = [""] * len(texts)
    lengths = (shown != 255).sum(0)
    for column, own in enumerate(order.tolist()):
        found[own] = HEX[shown[: lengths[column], column]].tobytes().decode()
    return found


def likeness(a: str, b: str) -> float:
    """Estimated share of steps at which two fingerprints agree, freed of chance agreement; 0 to 1.

    A sample stands for the steps between it and the next, so an octave counts by its length. Steps that only the
    longer walk has count against it. Two empty texts are alike.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    longest, shared = max(n, m), min(n, m)
    weight = np.diff(_steps[: longest + 1]).astype(float)
    same = np.frombuffer(a[:shared].encode(), np.uint8) == np.frombuffer(b[:shared].encode(), np.uint8)
    agreed = float(weight[:shared][same].sum() / weight.sum())
    return min(1.0, max(0.0, (agreed - 1 / 16) / (1 - 1 / 16)))


def _deal(docs: DataFrame, parts: int) -> DataFrame:
    """Adds `bucket`: consecutive ids, about equally many rows each. Cells of equal id ranges are counted and put together."""
    spark = docs.sparkSession
    low, high, rows = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high = low or 0, high or 0
    width = (high - low) // CELLS + 1
    # A null id comes first, so it is in the first cell.
    cell = F.coalesce(F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)), F.lit(0)).cast("int")
    counts = {r["cell"]: r["count"] for r in docs.select(cell.alias("cell")).groupBy("cell").count().collect()}  # at most CELLS rows
    dealt, done = [], 0
    for c in sorted(counts):
        dealt.append((c, done * parts // max(1, rows)))
        done += counts[c]
    cells = spark.createDataFrame(dealt, "cell int, bucket int")
    return docs.withColumn("cell", cell).join(F.broadcast(cells), "cell").drop("cell")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows bucket, tail, doc_id, text in order within buckets; each bucket ends with a tail row, the first document of the next one.

    One shuffle of the texts. Equal ids are ordered by a hash of their text.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = _deal(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), parts).withColumn("tie", F.xxhash64("text"))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")
    heads = dealt.groupBy("bucket").agg(F.min(order).alias("head"))
    # One row per bucket; before the first comes the last.
    ring = Window.orderBy("bucket")
    last = F.max("bucket").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("head", F.coalesce(F.lag("bucket").over(ring), last).alias("bucket"))
    tails = dealt.drop("bucket").join(F.broadcast(heads), dealt["doc_id"].eqNullSafe(F.col("head.doc_id")) & (dealt["tie"] == F.col("head.tie"))).dropDuplicates(["bucket"])
    rows = dealt.select("bucket", F.lit(False).alias("tail"), "doc_id", "tie", "text").unionByName(tails.select("bucket", F.lit(True).alias("tail"), "doc_id", "tie", "text"))
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", F.asc_nulls_first("doc_id"), "tie").drop("tie")


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how like they are.

    Edited: the last quarter of the characters (rounded down) replaced by the first as many of the next document in
    ascending doc_id, after the last the first. Null texts are empty; null ids come first; a table of one row has
    itself as the next document; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None
        for batch in batches:
            if pending is not None:
                batch = pa.Table.from_batches([pending, batch]).combine_chunks().to_batches()[0]
            pending = batch.slice(batch.num_rows - 1, 1)
            if batch.num_rows < 2:
                continue
            texts = batch.column(3).to_pylist()
            own = np.flatnonzero(~np.asarray(batch.column(1)[:-1]))
            prints = fingerprints(texts)
            changed = []
            for i in own.tolist():
                k = len(texts[i]) // 4
                changed.append(texts[i][: len(texts[i]) - k] + texts[i + 1][:k])
            edited = fingerprints(changed)
            columns = [
                batch.column(2).take(pa.array(own)),
                pa.array([len(texts[i]) for i in own.tolist()], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array([prints[i] for i in own.tolist()], pa.string()),
                pa.array(edited, pa.string()),
                pa.array([likeness(prints[i], e) for i, e in zip(own.tolist(), edited, strict=True)], pa.float64()),
                pa.array([likeness(prints[i], prints[i + 1]) for i in own.tolist()], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_next(docs).mapInArrow(work, f"doc_id {kind}, {RESULT}")


def near_fingerprints(prints: DataFrame, least: float = 0.75) -> DataFrame:
    """Links (fingerprint, head, likeness) of at least `least`: bit-sampled bands propose, all samples verify.

    A band is a run of samples, named by its place; the last may be shorter. Within a band's group every fingerprint is first
    compared with the group's smallest, its head, so a group of any size makes one link per member. Then those outside a
    group's largest component are compared with all members of other components, so fingerprints that share a band and
    are alike are always connected. Equal fingerprints are one class, and copies make no links. Empty and null
    fingerprints have no bands.
    """
    classes = prints.select("fingerprint").where("fingerprint <> ''").distinct()
    places = F.sequence(F.lit(0), F.ceil(F.length("fingerprint") / BAND).cast("int") - 1)
    bands = classes.select("fingerprint", F.explode(places).alias("band")).withColumn("bits", F.substring(F.col("fingerprint"), F.col("band") * BAND + 1, F.lit(BAND)))
    heads = bands.groupBy("band", "bits").agg(F.min("fingerprint").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = bands.join(heads, ["band", "bits"]).where("fingerprint <> head").select("fingerprint", "head").distinct()

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        return stored(pairs.withColumn("likeness", alike("fingerprint", "head")).where(F.col("likeness") >= least), name)

    first = verified(links, "print_heads")
    labels = components(first.select(F.col("fingerprint").alias("a"), F.col("head").alias("b")))
    known = bands.join(labels, F.col("fingerprint") == F.col("node"), "left").select("band", "bits", "fingerprint", F.coalesce("label", "fingerprint").alias("label"))
    sizes = known.groupBy("band", "bits", "label").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("band", "bits").agg(F.max_by("label", F.struct("k", "label")).alias("largest"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    open_ = stored(known.join(largest, ["band", "bits"]), "print_bands")
    rest = open_.where("label <> largest").alias("p").join(open_.alias("q"), ["band", "bits"]).where("p.label <> q.label").select(
        F.greatest("p.fingerprint", "q.fingerprint").alias("fingerprint"), F.least("p.fingerprint", "q.fingerprint").alias("head")
    ).distinct()
    return first.unionByName(verified(rest.join(links, ["fingerprint", "head"], "left_anti"), "print_rest"))
