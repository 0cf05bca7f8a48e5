"""Operators 2, 3, 4 and 8 against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from fixtures import empty_documents, odd_documents, odd_texts

from tidemark.llm import fingerprints, jaccard, repeats, suffix_array, suffix_tree
from tidemark.llm.common import Rolling, buffer, words

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_removal(rows, units, size):
    """Per row: covered flags, by comparing every window with all rows of smaller ids."""
    where = defaultdict(list)
    split = [units(t or "") for _, t in rows]
    for (i, _), u in zip(rows, split, strict=True):
        if i is not None:
            for s in range(len(u) - size + 1):
                where[u[s : s + size]].append(i)
    first = {w: min(ids) for w, ids in where.items()}
    out = []
    for (i, _), u in zip(rows, split, strict=True):
        covered = [False] * len(u)
        for s in range(len(u) - size + 1):
            if i is not None and first[u[s : s + size]] < i:
                covered[s : s + size] = [True] * size
        out.append((u, covered))
    return out


def spans(covered):
    return sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))


def test_suffix_array_against_brute_force(spark):
    docs, rows = odd_documents(spark)
    got = Counter(suffix_array.dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").toPandas().astype(object).where(lambda f: f.notna(), None).itertuples(index=False, name=None))
    want = Counter()
    for (i, _), (u, c) in zip(rows, brute_removal(rows, lambda t: t.encode(), 50), strict=True):
        want[(i, len(u), sum(c), spans(c), hashlib.sha256(bytes(b for b, x in zip(u, c, strict=True) if not x)).hexdigest())] += 1
    assert got == want


def test_suffix_tree_against_brute_force(spark):
    docs, rows = odd_documents(spark)
    got = Counter(suffix_tree.dedup_words(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").toPandas().astype(object).where(lambda f: f.notna(), None).itertuples(index=False, name=None))
    want = Counter()
    for (i, _), (u, c) in zip(rows, brute_removal(rows, lambda t: tuple(SPACE.findall(t)), 13), strict=True):
        want[(i, len(u), sum(c), hashlib.sha256(" ".join(b for b, x in zip(u, c, strict=True) if not x).encode()).hexdigest())] += 1
    assert got == want


def test_kept_text_is_the_input_without_what_is_removed(spark):
    docs, _ = odd_documents(spark, repeated=False)
    for row in suffix_array.dedup_bytes(docs).collect():
        assert len(row["kept"]) == row["n_bytes"] - row["n_removed"] and hashlib.sha256(row["kept"]).hexdigest() == row["kept_sha256"]


def test_long_prefixes_are_used_for_frequent_ones():
    symbols = np.arange(40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    starts = np.arange(20)
    columns = suffix_tree.codes(symbols, starts)
    rare, often = np.zeros((2, 1 << 20), np.uint8), np.full((2, 1 << 20), 19, np.uint8)
    routes = {level: suffix_tree.prefix_route(symbols, starts, columns, table) for level, table in (("rare", rare), ("often", often))}
    assert len(set(routes["rare"].tolist())) == len(set(routes["often"].tolist())) == 20
    assert not set(routes["rare"].tolist()) & set(routes["often"].tolist())


def test_radix_and_tree_agree_with_a_dictionary():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 2, 3000).astype(np.uint64)
    starts = np.arange(2900)
    ids = rng.integers(0, 40, 2900)
    least, most = {}, {}
    keys = [tuple(symbols[s : s + 13].tolist()) for s in starts]
    for k, i in zip(keys, ids.tolist(), strict=True):
        least[k], most[k] = min(least.get(k, i), i), max(most.get(k, i), i)
    want = [2 if i > least[k] else int(most[k] > least[k]) for k, i in zip(keys, ids.tolist(), strict=True)]
    assert suffix_tree.tree_repeats(suffix_tree.codes(symbols, starts), ids).tolist() == want
    columns = suffix_tree.codes(symbols, starts)[:, :3]
    assert suffix_array.radix_groups(columns, ids).tolist() == want


def test_anchors_own_every_window_once():
    text = " ".join(t or "" for t in odd_texts()).encode()
    raw = np.frombuffer(text, np.uint8)
    _, _, document, begin, count = repeats.anchors(raw, np.array([0, 5000, 5000, len(raw)]), suffix_array.BYTES)
    covered = [s for b, c in zip(begin.tolist(), count.tolist(), strict=True) for s in range(b, b + c)]
    assert covered == [s for s in range(len(raw) - 49) if s + 50 <= 5000 or s >= 5000]
    assert set(document.tolist()) == {0, 2}


def brute_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = SPACE.findall((t or "").translate(low))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    return sets, [find(k) for k in range(len(rows))]


def test_jaccard_join_against_all_pairs(spark):
    docs, rows = odd_documents(spark)
    sets, roots = brute_components(rows)
    least = {}
    for (i, _), root in zip(rows, roots, strict=True):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    want = Counter((i, len(s), least.get(root) if s else i) for (i, _), s, root in zip(rows, sets, roots, strict=True))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect())
    assert got == want


def test_one_row_of_each_component_stays(spark):
    docs, rows = odd_documents(spark)
    sets, roots = brute_components(rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r for r, s in zip(roots, sets, strict=True) if s}) + sum(not s for s in sets)


def test_empty_tables(spark):
    docs = empty_documents(spark)
    for found in (suffix_array.dedup_bytes(docs), suffix_tree.dedup_words(docs), jaccard.near_duplicates(docs), jaccard.one_of_each(docs), fingerprints.edited_fingerprints(docs)):
        assert found.count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)]
    found = jaccard.components(spark.createDataFrame(edges, "a long, b long"))
    got = {r["node"]: r["label"] for r in found.collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    texts = [t or "" for t in odd_texts()]
    raw, offsets = buffer(pa.array(texts))
    starts, ends, first = words(raw, offsets)
    for k, t in enumerate(texts):
        assert [raw[a:b].tobytes().decode() for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)] == SPACE.findall(t)


def test_rolling_hash_depends_on_content_only():
    raw = np.frombuffer(b"abcabcabdabc", np.uint8)
    rolling = Rolling(1)
    prefix = rolling.prefix(raw)
    at = np.arange(10)
    found = rolling.between(prefix, at, at + 3).tolist()
    assert found[0] == found[3] == found[9] != found[6] and len(set(found)) == len({bytes(raw[k : k + 3]) for k in range(10)})


def test_fingerprints_of_edited_texts(spark):
    docs, rows = odd_documents(spark, repeated=False)
    found = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(found) == len(rows)
    by_text = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        quarter = len(t) // 4
        changed = t[: len(t) - quarter] + after[:quarter]
        r = found[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprints([t])[0] and r["edited_fingerprint"] == fingerprints.fingerprints([changed])[0]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    repeated, _ = odd_documents(spark)
    assert fingerprints.edited_fingerprints(repeated).count() == len(rows) + 5


def test_one_document_is_its_own_next(spark):
    row = fingerprints.edited_fingerprints(spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")).collect()[0]
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and row["near_next"] == 1.0


def test_edit_embedding_keeps_near_texts_near():
    import random

    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    edited = text[:1000] + "zz" + text[1000:2500] + text[2510:]
    other = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    a, b, c = fingerprints.fingerprints([text, edited, other])
    assert fingerprints.likeness(a, b) > 0.6 > 0.2 > fingerprints.likeness(a, c)


def test_bands_find_near_fingerprints(spark):
    import random

    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(3000))
    texts = [text, text[:2900] + "qqqqq" + text[2900:], "".join(rng.choice("abcdefghij klmnop") for _ in range(3000)), ""]
    prints = fingerprints.fingerprints(texts)
    links = fingerprints.near_fingerprints(spark.createDataFrame([(p,) for p in prints], "fingerprint string")).collect()
    assert {frozenset((r["fingerprint"], r["head"])) for r in links} == {frozenset(prints[:2])}


def test_bands_connect_what_shares_a_band_and_is_alike(spark):
    import random

    rng = random.Random(4)
    draw = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    prints = []
    for _ in range(12):
        own = draw(600)
        # One sample of each band but the first differs, so the pair meets only where all others are too.
        prints += ["00000000" + own, "00000000" + "".join("f0"[c == "f"] if k % 8 == 3 else c for k, c in enumerate(own))]
    prints += ["00000000" + draw(700), "5a5a5", "5a5a5"]
    links = fingerprints.near_fingerprints(spark.createDataFrame([(p,) for p in prints], "fingerprint string")).collect()
    group = {p: p for p in prints}

    def find(x):
        return x if group[x] == x else find(group[x])

    for r in links:
        assert fingerprints.likeness(r["fingerprint"], r["head"]) >= 0.75
        group[find(r["fingerprint"])] = find(r["head"])
    for a in prints:
        for b in prints:
            if any(a[k : k + 8] == b[k : k + 8] for k in range(0, min(len(a), len(b)), 8)) and fingerprints.likeness(a, b) >= 0.75:
                assert find(a) == find(b)
    assert len({find(p) for p in prints}) == 14
