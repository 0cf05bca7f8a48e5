"""Operators 11 to 13 against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from fixtures import WORDS, empty_documents, odd_documents, sentence

from tidemark.llm import divergence, infill, quality

MARKED = ["with <P> inside", "<S>", "a <M", "<" * 9, "<P", "ab<S<S> cd", "x" * 40_000, "é" * 30_000 + "zz 11", "a1" * 25_000]


def marked_documents(spark):
    docs, rows = odd_documents(spark)
    more = [(1000 + i, t, "en", "s", len(t), 1, "x", 0.5, 7) for i, t in enumerate(MARKED * 6)]
    return docs.unionByName(spark.createDataFrame(more, docs.schema).repartition(2)), rows + [(r[0], r[1]) for r in more]


def plain_infill(doc_id, text, seed=1):
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(p) for p in (units[:low], units[low:high], units[high:]))
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk", [7, 16_384])
def test_infill_matches_plain_python(spark, chunk):
    docs, rows = marked_documents(spark)
    if chunk < 100:
        docs, rows = odd_documents(spark)
    found = infill.infill_digests(docs, chunk=chunk)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = [(i, *(r := plain_infill(i, t))[:4], sha(r[4]), sha(t)) for i, t in rows]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_infill_texts_are_the_outputs(spark):
    docs, rows = odd_documents(spark)
    got = sorted(map(tuple, infill.infill_texts(docs, seed=3).collect()), key=str)
    assert got == sorted(((i, (r := plain_infill(i, t, 3))[1], r[4]) for i, t in rows), key=str)
    assert infill.infill_texts(empty_documents(spark)).count() == 0


def test_infill_of_an_empty_table(spark):
    assert infill.infill_digests(empty_documents(spark)).count() == 0


def test_infill_sql_says_the_same(spark):
    docs, rows = marked_documents(spark)
    frame = docs.select("doc_id", "text").toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    db = duckdb.connect()
    db.register("documents", frame)
    assert sorted(db.execute(infill.SQL).fetchall(), key=str) == sorted(map(tuple, infill.infill_digests(docs).collect()), key=str)


def test_chunks_hold_whole_units(spark):
    docs, _ = odd_documents(spark)
    by_document = defaultdict(list)
    for r in infill.infill_chunks(docs, chunk=50).collect():
        by_document[r["doc_id"], r["tie"], r["part"], r["seq"]].append((r["pos"], bytes(r["chunk"]).decode()))
    for chunks in by_document.values():
        assert [p for p, _ in chunks] == [*range(len(chunks))]
        for _, text in chunks:
            body = re.sub(r"^<[PSM]>", "", text)
            assert len(body.encode()) <= 50 or re.fullmatch(r"[A-Za-z]+|[^A-Za-z]", body)


def labelled(spark, n=900, seed=4):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = "\n".join(sentence(rng, rng.randint(4, 30)).capitalize() + "." for _ in range(rng.randint(1, 9)))
        if not good:
            kind = rng.randrange(3)
            text = text.upper().replace(" ", "!! ") if kind == 0 else " | ".join(text.split()) if kind == 1 else (sentence(rng, 6) + "\n") * 9
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_is_learned_and_held_out_rows_are_not_read(spark):
    docs, labels = labelled(spark)
    found = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in found.items() if r["held_out"]} == set(held) and 100 < len(held) < 300
    assert sum(found[i]["predicted"] == truth[i] for i in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())
    # Other labels on the held-out rows, and other columns, change no score.
    wrong = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 5 = 0, 1 - quality, quality) AS quality", "toxic")
    again = quality.quality(docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "0L AS n_chars"), wrong)
    assert {r["doc_id"]: r["score"] for r in again.collect()} == {i: r["score"] for i, r in found.items()}


def test_quality_of_odd_rows(spark):
    docs, labels = labelled(spark, 200)
    odd, rows = odd_documents(spark)
    model = quality.fit(docs, labels)
    got = quality.scored(odd, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    want = model.score(np.concatenate([quality.statistics(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])) for _, t in rows]))
    assert sorted((r["score"] for r in got)) == pytest.approx(sorted(want))
    assert quality.quality(empty_documents(spark), labels).count() == 0
    none = labels.where("false")
    assert {r["score"] for r in quality.quality(odd, none).collect()} == {0.5}
    nulls = spark.createDataFrame([(None, 1, 0), (7, None, 0), (9, 1, 1), (9, 0, 0)], labels.schema)
    assert quality.quality(odd, nulls).count() == len(rows)


def test_trees_walk_as_a_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    x[:, 3] = rng.integers(0, 3, 400)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] == 1)).astype(float)
    model = quality.fit_trees(x, y, trees=30)
    plain = []
    for row in x:
        total = model.start
        for t in range(30):
            node = 0
            while node < model.statistic.shape[1]:
                node = 2 * node + 1 + int(row[model.statistic[t, node]] > model.limit[t, node])
            total += model.leaf[t, node - model.statistic.shape[1]]
        plain.append(1 / (1 + np.exp(-total)))
    np.testing.assert_allclose(model.score(x), plain)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 6, (120, 3)).astype(float)
    y = (x[:, 1] + rng.normal(size=120) > 3).astype(float)
    model = quality.fit_trees(x, y, trees=1, depth=1)
    p = (y.sum() + 0.5) / 121
    g, h = y - p, np.full(120, p * (1 - p))

    def gain(k, edge):
        left = x[:, k] <= edge
        return sum(g[s].sum() ** 2 / (h[s].sum() + quality.PULL) for s in (left, ~left))

    best = max(((k, e) for k in range(3) for e in range(6) if min(h[x[:, k] <= e].sum(), h[x[:, k] > e].sum()) >= quality.LEAST_WEIGHT), key=lambda s: gain(*s))
    assert gain(int(model.statistic[0, 0]), model.limit[0, 0]) == pytest.approx(gain(*best))


def plain_divergence(rows, least=10):
    """Rows (text, lang, source) to the result, in whole numbers throughout."""
    counts, within, everywhere = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        counts[lang, source].update(terms)
        within[lang].update(set(terms))
        everywhere[lang].update(terms)
    out = []
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in within[lang].items() if n >= least]

        def shares(found, kept=kept):
            total = sum(found[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (found[t] + 2) // total for t in kept}

        base, sources = shares(everywhere[lang]), sorted(s for g, s in counts if g == lang)
        own = {s: shares(counts[lang, s]) for s in sources}

        def price(p, q):
            return (p - q) ** 2 // (p + q)

        for s in sources:
            pairs = sorted(((-sum(price(own[s][t], own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            terms = sorted((-price(own[s][t], base[t]), t.encode(), t) for t in kept if counts[lang, s][t] and own[s][t] > base[t])[:10]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return out


def divergence_rows(seed=6, n=260):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "fr", None, "x"])
        source = rng.choice(["s1", "s2", "S3", "é", None, "hot", "hot", "hot", "😀", "～"])
        words = rng.sample(WORDS, 12) + (["Été", "ÉTÉ", "näh"] if i % 2 else ["the2the", "A_b"])
        rows.append(("".join(w + rng.choice([" ", "\n", "1", "-", "\x00", "\x7f"]) for w in rng.choices(words, k=rng.randint(1, 40))), lang, source))
    return [*rows, (None, "en", "silent"), ("", "en", "s1"), ("123 ...", "lonely", "a"), ("one two", "lonely", "b"), *rows[:5], ("", "alone", "only")]


@pytest.mark.parametrize(("least", "block", "bin_"), [(10, 32_768, 8), (3, 4, 2), (10_000, 16, 3)])
def test_divergence_matches_plain_python(spark, least, block, bin_):
    rows = divergence_rows()
    docs = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term long").repartition(3)
    found = divergence.source_divergence(docs, least=least, block=block, groups_in_bin=bin_)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == sorted(plain_divergence(rows, least))


def test_divergence_sql_says_the_same(spark):
    rows = divergence_rows(9)
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows) if "\x00" not in (r[0] or "")], schema)
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    assert sorted(db.execute(divergence.SQL).fetchall()) == sorted(map(tuple, divergence.source_divergence(docs).collect()))
    assert divergence.source_divergence(empty_documents(spark)).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 0, 1), (10**15, 8 * 10**15, 10**9), (123456789012, 999999999999, 54321), (5, 5, 1)]
    exact = [1 + 10**9 * (n + 2) // (total + 2 * terms) for n, total, terms in cases]
    df = spark.createDataFrame(cases, "n long, total long, terms long")
    assert [r[0] for r in df.select(divergence.share(*(divergence.F.col(c) for c in ("n", "total", "terms")))).collect()] == exact
    assert [int(divergence.shares(np.array([n]), total, terms)[0]) for n, total, terms in cases] == exact
