"""Personal data (operator 7): fixed kinds by pattern, then bootstrapped contextual extraction of identifiers they miss.

Native: DataFrame and SQL functions only. The words before a seed entity are a lexical pattern; patterns and instances form
a graph whose scores are passed to and fro; patterns of high confidence then name the identifiers that no fixed pattern
finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: The kinds in their order of listing. Each pattern finds what the plain form in the comment finds, in linear
#: time and without recursion: possessive runs, a start that is not inside a run (or is where the last match ended), and
#: an end told by what follows.
KINDS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"(?<![0-9])[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?[0-9](?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every match of a kind contains; texts without it skip the search.
MARKS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+"}
#: Words that may be an identifier: with a digit, an at sign or a spelled-out one.
INSTANCE = r"(?<!\S)(?:[^\s0-9@]*+[0-9@]\S*+|[^\s(\[]*+[(\[]at[)\]]\S*+)"
INSTANCE_MARK = r"[0-9@]|[(\[]at[)\]]"
LEAST_LENGTH = 6
#: Characters before an instance that are read for its pattern: the last two words of them.
CONTEXT = 60
ROUNDS = 3
#: A pattern is believed with this share of known instances, of at least so many different values.
CONFIDENT = 0.75
LEAST_SEEDS = 3

#: Matches that one inner walk takes: appending copies an array, so a text's matches are walked block by block.
BLOCK = 256

SPANS = "array<struct<start:bigint,end:bigint,value:string,before:string>>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _walk(items: Column, kind: str, step) -> Column:
    """(at, done): items walked in order, block by block, by step((at, nothing done), block, at), which gives such a pair; done is of type `kind`.

    Time is in proportion to the items: at most BLOCK are appended one by one, then the blocks.
    """
    last = F.greatest(F.floor((F.size(items) - 1) / BLOCK).cast("int"), F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))

    def whole(acc: Column, block: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("done"))
        return _let(step(start, block, acc["at"]), lambda own: F.struct(own["at"].alias("at"), F.array_append(acc["blocks"], own["done"]).alias("blocks")))

    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{kind}>").alias("blocks"))
    return F.aggregate(blocks, empty, whole, lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["blocks"]).alias("done")))


def spans_of(text: Column, pattern: str, mark: str) -> Column:
    """All matches as (start, end, value, before): places in code points, `before` the text up to CONTEXT characters ahead.

    The pieces between matches and the matches themselves are walked together, which gives the places.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        own = F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), x["m"].alias("value"), F.substring(x["p"], -CONTEXT, CONTEXT).alias("before"))
        return F.struct(end.cast("bigint").alias("at"), F.array_append(acc["done"], own).alias("done"))

    spans = _let(steps, lambda s: _walk(s, SPANS, lambda zero, block, _: F.aggregate(block, zero, place))["done"])
    return F.when(text.rlike(mark), spans).otherwise(F.array().cast(SPANS))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    digits = F.reverse(_digits(c))
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.length(digits).between(12, 19) & (F.aggregate(places, F.lit(0), add) % 10 == 0)


def _valid(kind: str, c: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(c, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(c)).between(12, 19), _luhn(c)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(c)).between(9, 15)
    return F.lit(True)


# Spark counts a lambda's parameters, so these bind the kind outside.
def _valid_of(kind: str):
    return lambda s: _valid(kind, s["value"])


def _ranked_as(rank: int, kind: str):
    return lambda s: F.struct(s["start"], F.lit(rank).alias("rank"), s["end"], F.lit(kind).alias("kind"))


def _touching(rank: int, kind: str, spans: Column, ends: Column, s: Column) -> Column:
    """(start, rank, kind) of the first of a kind's spans that touches s, else null; a binary search, as spans of a kind do not overlap."""
    halvings = F.sequence(F.lit(1), F.length(F.bin(F.size(ends))))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        after = F.get(ends, middle) > s["start"]
        low, high = F.when(after, acc["low"]).otherwise(middle + 1), F.when(after, middle).otherwise(acc["high"])
        return F.when(acc["low"] < acc["high"], F.struct(low.alias("low"), high.alias("high"))).otherwise(acc)

    found = F.aggregate(halvings, F.struct(F.lit(0).alias("low"), F.size(ends).alias("high")), halve, lambda acc: F.get(spans, acc["low"]))
    return F.when(F.size(ends) > 0, _let(found, lambda b: F.when(b["start"] < s["end"], F.struct(b["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")))))


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with `base`: (start, end, kind, place in the list of kinds), sorted; and `instances`: the same with value and pattern.

    An instance is the longest word-like identifier at its place, trimmed of marks; `kind` is that of the base span which it
    touches, else null.
    """
    with_text = docs.withColumn("text", F.coalesce("text", F.lit("")))
    found = with_text.withColumns({f"_{k}": F.filter(spans_of(F.col("text"), p, MARKS[k]), _valid_of(k)) for k, p in KINDS.items()} | {"_instance": spans_of(F.col("text"), INSTANCE, INSTANCE_MARK)})
    each = [F.transform(f"_{k}", _ranked_as(i, k)) for i, k in enumerate(KINDS)]
    base = F.array_sort(F.concat(*each))
    trimmed = F.transform("_instance", lambda s: F.struct((s["start"] + F.length(s["value"]) - F.length(F.regexp_replace(s["value"], r"""^["'(<\[{.,;:!?]+""", ""))).alias("start"), F.regexp_replace(F.regexp_replace(s["value"], r"""^["'(<\[{.,;:!?]+""", ""), r"""[.,;:!?"')>\]}]+$""", "").alias("value"), s["before"].alias("before")))
    placed = F.transform(F.filter(trimmed, lambda s: F.length(s["value"]) >= LEAST_LENGTH), lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"), s["value"].alias("value"), F.lower(F.regexp_replace(F.regexp_extract(s["before"], r"(\S+\s+\S+)\s*$", 1), r"[0-9]+|\s+", " ")).alias("pattern")))
    ends = F.struct(*[F.transform(f"_{k}", lambda b: b["end"]).alias(k) for k in KINDS])

    def kind_of(e: Column):
        return lambda s: s.withField("kind", F.array_min(F.array_compact(F.array(*[_touching(i, k, F.col(f"_{k}"), e[k], s) for i, k in enumerate(KINDS)])))["kind"])

    known = F.when(F.size("base") > 0, _let(ends, lambda e: F.transform("_placed", kind_of(e)))).otherwise(F.transform("_placed", lambda s: s.withField("kind", F.lit(None).cast("string"))))
    listed = found.withColumn("base", base).withColumn("_placed", placed).withColumn("instances", known)
    return listed.drop(*(f"_{k}" for k in [*KINDS, "instance", "placed"]))


def confident_patterns(instances: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind, confidence of believed patterns, from rows (pattern, value, kind).

    Edges are distinct pairs of pattern and value, counted with map-side sums. A pattern's score for a kind is the mean of
    its instances' scores; an instance that is no seed has the mean score of its patterns. A pattern needs LEAST_SEEDS
    different seed values, so copies of a document prove nothing.
    """
    edges = stored(instances.where("pattern <> ''").groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "edges")
    seeds = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("n_seeds"))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n_values"))
    # Only patterns with enough seeds can ever be believed; the graph is cut to what touches them.
    live = seeds.where(F.col("n_seeds") >= LEAST_SEEDS).join(sizes, "pattern")
    graph = stored(edges.withColumnRenamed("kind", "seed_kind").join(live, "pattern"), "graph")
    scored = graph.withColumn("score", F.when(F.col("seed_kind") == F.col("kind"), 1.0).otherwise(0.0))
    for _ in range(rounds):
        patterns = scored.groupBy("pattern", "kind").agg(F.avg("score").alias("confidence"), F.first("n_seeds").alias("n_seeds"))
        values = graph.join(patterns.drop("n_seeds"), ["pattern", "kind"]).groupBy("value", "kind").agg(F.avg("confidence").alias("mean"))
        scored = graph.join(values, ["value", "kind"]).withColumn("score", F.when(F.col("seed_kind") == F.col("kind"), 1.0).when(F.col("seed_kind").isNotNull(), 0.0).otherwise(F.col("mean")))
    final = scored.groupBy("pattern", "kind").agg(F.avg("score").alias("confidence")).where(F.col("confidence") >= CONFIDENT)
    return final.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("confidence").alias("confidence"))


def personal_data(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs' key columns with base (array), spans (array of start, rank, end, kind) and the counts of base kinds.

    One pass over the texts, in time about proportional to their length and matches; what follows handles identifiers only. Null texts are empty. Rows with equal doc_id and text
    get the same spans; null ids are kept. Added spans never overlap base spans and carry the kind of their pattern.
    """
    keep = keep or ["doc_id"]
    keyed = docs.select(*keep, "text").withColumns({"__h1": F.xxhash64("text"), "__h2": F.xxhash64("text", F.lit(1))})
    first = stored(base_spans(keyed).drop("text"), "spans")
    rows = first.where(F.size("instances") > 0).select("doc_id", "__h1", "__h2", F.explode("instances").alias("i")).select("doc_id", "__h1", "__h2", "i.*")
    patterns = confident_patterns(rows)
    ranks = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    new = rows.where("kind is null").drop("kind").join(patterns, "pattern")
    added = new.groupBy("doc_id", "__h1", "__h2").agg(F.collect_set(F.struct("start", ranks[F.col("kind")].alias("rank"), "end", "kind")).alias("added"))
    a, b = first.alias("a"), added.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.__h1") == F.col("b.__h1")) & (F.col("a.__h2") == F.col("b.__h2")), "left").select("a.*", "b.added")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>"))))
    return joined.select(*keep, "__h1", "__h2", "base", spans.alias("spans"))


def _listed(c: str) -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans and the list of all spans for every row."""
    found = personal_data(docs)
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by `<KIND>` (of overlapping spans the first); n_chars follows, other columns stay."""
    found = personal_data(docs).where(F.size("spans") > 0).select("doc_id", "__h1", "__h2", "spans").dropDuplicates(["doc_id", "__h1", "__h2"])
    keyed = docs.withColumns({"__h1": F.xxhash64("text"), "__h2": F.xxhash64("text", F.lit(1))}).alias("d")
    joined = keyed.join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.__h1") == F.col("f.__h1")) & (F.col("d.__h2") == F.col("f.__h2")), "left")
    def hide(start: Column, block: Column, first: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(block, lambda s: s["end"])), first)
        # Places in a string are counted from its start, so a block looks into its own part of the text only.
        return _let(F.substring(F.col("d.text"), first.cast("int") + 1, (last - first).cast("int")), lambda part: F.aggregate(block, start, cover(part, first)))

    def cover(part: Column, first: Column):
        def one(acc: Column, s: Column) -> Column:
            piece = F.concat(F.substring(part, (acc["at"] - first).cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.array_append(acc["done"], piece).alias("done")))

        return one

    def rest(w: Column) -> Column:
        return F.concat(F.array_join(w["done"], ""), F.substring(F.col("d.text"), w["at"].cast("int") + 1, F.length(F.col("d.text"))))

    text = F.when(F.col("f.spans").isNull(), F.col("d.text")).otherwise(_let(_walk(F.col("f.spans"), "array<string>", hide), rest))
    length = F.when(F.col("f.spans").isNull(), F.col("d.n_chars")).otherwise(F.length(text)) if "n_chars" in docs.columns else None
    return joined.select(*(text.alias("text") if c == "text" else length.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"d.`{c}`") for c in docs.columns))
