"""Operators 1, 5, 6, 7, 9 and 10 and the pipeline against plain Python."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from fixtures import WORDS, empty_documents, odd_documents, sentence
from pyspark.sql import functions as F

from tidemark.llm import decontamination, packing, pii, tokens, toxicity, urls
from tidemark.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(vocabulary())


def library_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_counts_match_the_library(spark, tokenizer):
    docs, rows = odd_documents(spark)
    got = sorted(map(tuple, tokens.token_counts(docs, vocabulary()).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(library_ids(tokenizer, t)), n > 2048) for i, t in rows), key=str)
    assert got == want
    assert tokens.token_counts(empty_documents(spark), vocabulary()).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|startoftext|>b <|endoftext", "I'LL don't x'S", "ΑΣ ΣΑΣ", "é ́a", "a b　c\u0085d", "12345 ½ ⅷ", "İ ǅ ß ﬁ", "\x00\x1f", "👨‍👩‍👧", "supercalifragilistic" * 20])
def test_odd_strings_count_as_in_the_library(tokenizer, text):
    assert tokens.counter(vocabulary()).count(text) == len(library_ids(tokenizer, text))


def test_many_special_strings_in_one_word(tokenizer):
    counter = tokens.counter(vocabulary())
    for special in counter.special:
        for text in (special * 5000, f"ab{special}" * 5000 + "c", special + "x" + special):
            assert counter.count(text) == len(library_ids(tokenizer, text))


def test_merging_of_other_vocabularies_with_byte_level_words():
    path = vocabulary("byte_bpe_50k.json")
    library, own = tokenizers.Tokenizer.from_file(path), tokens.MergeCounter(path)
    for text in ["hello world", "  two  spaces", "naïve café 123", ""]:
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def check_packing(rows, found, tokenizer, window=2048):
    """Every identifier in one piece, checksums right, sequences gapless and full but for powers of two."""
    ids = [(i, np.array([*library_ids(tokenizer, t), 1], "<u4")) for i, t in rows]
    pool = sorted((i is None, i or 0, s, min(window, len(x) - s)) for i, x in ids for s in [0])
    assert len(pool) == len(rows) and sum(len(x) for _, x in ids) == sum(r["length"] for r in found)
    by_document = {}
    for r in found:
        by_document.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for (key, n), pieces in by_document.items():
        texts = [x for i, x in ids if i == key and len(x) == n]
        wanted = sorted(s for s in range(n) for _ in texts)
        assert sorted(s for p in pieces for s in range(p["start"], p["start"] + p["length"])) == wanted
        for p in pieces:
            assert p["ids_crc32"] in {zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) for x in texts}
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)


def test_packing_is_whole_and_without_padding(spark, tokenizer):
    docs, rows = odd_documents(spark)
    check_packing(rows, packing.packed(docs, vocabulary()).collect(), tokenizer)
    rng = random.Random(4)
    many = [(k, sentence(rng, rng.choice([3, 40, 40, 300, 900, 3000]))) for k in range(400)]
    check_packing(many, packing.packed(spark.createDataFrame(many, "doc_id long, text string"), vocabulary()).collect(), tokenizer)
    assert packing.packed(empty_documents(spark), vocabulary()).count() == 0


def test_least_squares_use_most_pieces():
    rng = np.random.default_rng(0)
    counts = np.zeros(2049, np.int64)
    np.add.at(counts, np.clip(rng.lognormal(6, 0.8, 300_000).astype(int), 1, 2047), 1)
    plan = packing.packing_plan({int(k): int(counts[k]) for k in np.flatnonzero(counts)})
    placed = sum((high - low) * part for _, low, high, _, part, _, _ in plan)
    whole = sum((high - low) for length, low, high, begin, part, _, _ in plan if high - low > 1)
    assert placed == (np.arange(2049) * counts).sum() and whole > 0.5 * counts.sum()
    combos = packing.combinations(counts, 2048)
    assert (combos.sum(1) == 2048).all() and ((combos > 0).sum(1) <= packing.DEPTH).all()
    assert (packing.repeats(combos, counts) >= 0).all()


def check_plan(plan, histogram, window=2048):
    """Every piece once and whole, every sequence full but for the last ones, which are powers of two."""
    cover, parts = {}, {}
    for length, low, high, begin, part, sequence, offset in plan:
        for nth in range(high - low):
            at = offset + nth * length if sequence < 0 else offset
            s, at = (-1 - sequence + at // window, at % window) if sequence < 0 else (sequence + nth, at)
            cuts = [(begin, min(part, window - at), s, at)] + ([(window - at, at + part - window, s + 1, 0)] if at + part > window else [])
            for b, n, s, o in cuts:
                cover.setdefault(s, []).append((o, n))
                parts.setdefault((length, low + nth), []).append((b, n))
    for spans, size in [*((v, None) for v in cover.values()), *((v, k[0]) for k, v in parts.items())]:
        end = 0
        for o, n in sorted(spans):
            assert o == end and n > 0
            end += n
        assert end == size if size else end & (end - 1) == 0
    assert sum(sum(n for _, n in v) != window for v in cover.values()) <= 11 and sorted(cover) == [*range(len(cover))]
    assert sorted(parts) == sorted((k, r) for k, n in histogram.items() for r in range(n))


@pytest.mark.parametrize("case", ["one length", "a third", "long ones", "few"])
def test_plans_do_not_grow_with_the_input(case):
    rng = np.random.default_rng(6)
    sizes = []
    for scale in (1, 8):
        own = np.clip(rng.lognormal(6, 0.8, 4000 * scale).astype(int), 1, 2047)
        lengths = {"one length": np.full(4000 * scale, 1500), "a third": np.append(own, np.full(2000 * scale, 1501)), "long ones": 1025 + own // 100 * 50, "few": own[: 3 * scale]}[case]
        histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        plan = packing.packing_plan(histogram)
        check_plan(plan, histogram)
        sizes.append((len(plan), len(histogram)))
    if case in ("one length", "long ones"):
        assert sizes[1][0] <= 40 * sizes[1][1]
    if case == "a third":
        assert sizes[1][0] < 16000  # of 48,000 pieces
    assert len(packing.packing_plan({700: 10, 1500: 10_000_000, 548: 9})) < 200


def test_runs_of_one_length_are_packed(spark, tokenizer):
    rng = random.Random(12)
    rows = [(k if k % 3 else None, sentence(rng, 700)) for k in range(60)]
    rows = [(k, " ".join(t.split()[:700])) for k, t in rows] + [rows[1], (7, "one more text")]
    check_packing(rows, packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary()).collect(), tokenizer)
    same = [(k, "river stone " * 300) for k in range(80)]
    found = packing.packed(spark.createDataFrame(same, "doc_id long, text string"), vocabulary()).collect()
    check_packing(same, found, tokenizer)


ITEM = "A farmer in Lower Dale has 12 apples and gives 5 kg of them to his neighbour Maria before selling the rest for 40 dollars at the market."
OTHER = "How many litres of paint does Tom need to cover a wall of 18 m by 3 m if one litre covers 6 m of wall and he paints twice?"


def test_reparameterised_items_are_found(spark):
    rng = random.Random(3)
    around = lambda: sentence(rng, 40)
    docs = [
        (1, around() + " " + ITEM + " " + around()),
        (2, around() + " " + ITEM.replace("12", "31").replace(" 5 ", " 9 ").replace("40", "77").replace("Maria", "Helena") + " " + around()),
        (3, around()), (4, None), (5, ""), (6, " ".join(ITEM.split()[:6]) + " " + around()), (None, around() + OTHER), (8, "12 5 kg 40 dollars 12 5 kg 40 dollars 12 5 kg"),
        (9, OTHER.lower()), (2, around()), (10, " ".join(str(k) for k in range(3000))),
    ]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, hash string, pos int")
    items = spark.createDataFrame([(0, ITEM), (1, OTHER), (2, "two words"), (3, None), (4, "short but real question here"), (0, ITEM)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.leaks(frame, items).collect()}
    assert set(found) == {(1, 0), (2, 0), (None, 1), (9, 1)}
    assert found[(2, 0)]["slots"] > 0 and found[(2, 0)]["consistency"] == 1.0
    kept = decontamination.without_leaks(frame, items)
    assert kept.columns == frame.columns and sorted((r["doc_id"] for r in kept.collect())) == [3, 4, 5, 6, 8, 10]
    assert decontamination.leaks(empty_documents(spark), items).count() == 0
    assert decontamination.leaks(frame, items.where("false")).count() == 0


def test_inconsistent_parameters_are_no_leak(spark):
    item = "add 3 to the sum of 3 and 3 then take 3 from the total of 3 and 3 and write 3 at the end of the line after 3 more"
    n = iter("41 52 63 74 85 96 17 28 39".split())
    changed = re.sub("3", lambda _: next(n), item)
    frame = spark.createDataFrame([(1, item), (2, changed), (3, item.replace("3", "8"))], "doc_id long, text string")
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontamination.leaks(frame, items).collect()} == {1, 3}


def found_leaks(spark, docs, items):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_exact_copies_of_items_made_of_placeholders_are_found(spark):
    rng = random.Random(8)
    items = [(0, "Compute 12 + 34 * 56 - 78 / 9"), (1, "The Treaty Of New Hampton Was Signed By Lord Amber And Lady Stone"), (2, "17 4 23 9 88"), (3, "1 2 3 4 5 6 7 8 9 10 11 12")]
    docs = [(k, sentence(rng, 30) + " " + text + " " + sentence(rng, 30)) for k, text in items]
    docs += [(10, sentence(rng, 30) + " Compute 12 - 34 / 56 + 78 * 9 " + sentence(rng, 30)), (11, "17 4 23 9 87"), (12, sentence(rng, 60))]
    assert found_leaks(spark, docs, items) == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_variants_beside_an_exact_copy_do_not_hide_it(spark):
    rng = random.Random(9)
    variants = [ITEM]
    for k in range(1, 4):
        variants.append(ITEM.replace("12", str(30 + k)).replace(" 5 ", f" {60 + k} ").replace("40", str(70 + k)).replace("Maria", ["Helena", "Tom", "Ida"][k - 1]))
    longer = [v.replace("to his neighbour", "to his very old neighbour") for v in variants[1:]]
    docs = [(1, " ".join(variants)), (2, (" " + sentence(rng, 9) + " ").join(variants[1:])), (3, " ".join(longer)), *[(4, sentence(rng, 7) + " " + v) for v in variants], (5, sentence(rng, 90))]
    docs += [(6, " ".join(ITEM.split()[:13]) + " " + sentence(rng, 50) + " " + " ".join(ITEM.split()[13:]))]
    assert found_leaks(spark, docs, [(0, ITEM)]) == {(k, 0) for k in (1, 2, 3, 4, 6)}


def test_items_are_found_whatever_stands_before_them(spark):
    items = [(0, "What is the capital of France"), (1, "Miles from Rome to Oslo"), (2, "Give the sum of 3 and 4")]
    before = ["so I asked, ", 'he said "no." ', "(and then) ", "A Title Without A Mark ", "it took 5 ", '"', "\u201c", "first line\n", "he said: ", "\u00bf"]
    docs = [(100 * i + k, text + item + after) for i, item in items for k, text in enumerate(before) for after in [[", then", "?\u201d he said"][k % 2]]]
    docs += [(1000, "so I asked, What is the capital of Spain, then"), (1001, "so I asked, Give the sum of 8 and 9"), (1002, "What is the price of bread")]
    expected = {(100 * i + k, i) for i, _ in items for k in range(len(before))} | {(1000, 0), (1001, 2)}
    assert found_leaks(spark, docs, items) == expected


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_base(text):
    found = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [f[2] for f in sorted(found)]


ODD_PII = [
    "mail a.b+c@d-e.co.uk, x@y..z a@b.c_d@e.f @x.y a@b a@b.c.d@e.f.", "éé😀 1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111",
    "+1 (415) 555-0100 +49-30-1234567, +1 23 +1 2345678901234567", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2", "5" * 40000, "a" * 40000 + "@", "a." * 9000 + "x@" + "b." * 9000 + "c", "1." * 9000, "", None, "no data",
    "4" + " 1" * 9000, "12 -34 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "+" * 5000, "+1" + "(" * 5000,
]


def test_base_spans_match_the_plain_patterns(spark):
    docs = spark.createDataFrame([(k, t, 1, "b") for k, t in enumerate(ODD_PII)] + [(0, ODD_PII[0], 2, "c"), (None, "me@here.org", 3, "d")], "doc_id long, text string, rank int, base string")
    for r in pii.pii_digest(docs).collect():
        text = ODD_PII[r["doc_id"]] if r["doc_id"] is not None else "me@here.org"
        base = brute_base(text)
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"], r["doc_id"]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(b.startswith(k) for b in base) for k in PLAIN]
        assert set(base) <= set(filter(None, r["spans"].split(",")))
    assert pii.pii_digest(docs).count() == len(ODD_PII) + 2
    assert pii.pii_digest(empty_documents(spark)).count() == 0


def test_patterns_find_unseen_identifiers(spark):
    rng = random.Random(8)
    rows = [(k, sentence(rng, 5) + f" write to me user{k}@mail.org {sentence(rng, 5)}") for k in range(6)]
    rows += [(50, "please write to me jane.doe(at)example"), (51, "write to me k4711-hidden now"), (52, "unrelated serial k9999-visible"), (53, "write to me soon")]
    found = {r["doc_id"]: r["spans"] for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[50] == f"email:{rows[6][1].index('jane')}:{len(rows[6][1])}" and found[51] == "email:12:24" and not found[52] and not found[53]


def test_masking_replaces_spans(spark):
    docs = spark.createDataFrame([(1, "é a@b.co, +1 415 555 0100!", 5, "s"), (2, None, None, "s"), (None, "x 1.2.3.4", 9, "s"), (1, "é a@b.co, +1 415 555 0100!", 5, "s")], "doc_id long, text string, n_chars long, spans string")
    got = pii.masked(docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"], r["n_chars"]) for r in got.collect()) == [("1", "é <EMAIL>, <PHONE>!", 19)] * 2 + [("2", None, None), ("None", "x <IP>", 6)]


PLAIN_INSTANCE = r"(?<!\S)(?:[^\s0-9@]*+[0-9@]\S*+|[^\s(\[]*+[(\[]at[)\]]\S*+)"


def brute_all_spans(texts):
    kinds, instances = list(PLAIN), []
    base = [[(int(b.split(":")[1]), kinds.index(b.split(":")[0]), int(b.split(":")[2]), b.split(":")[0]) for b in brute_base(t)] for t in texts]
    for k, text in enumerate(texts):
        end = 0
        for m in re.finditer(PLAIN_INSTANCE, text or "", re.ASCII):
            before, end = text[end : m.start()][-pii.CONTEXT :], m.end()
            value = re.sub(r"""^["'(<\[{.,;:!?]+""", "", m.group())
            start = m.end() - len(value)
            value = re.sub(r"""[.,;:!?"')>\]}]+$""", "", value)
            if len(value) >= pii.LEAST_LENGTH:
                words = re.search(r"(\S+\s+\S+)\s*$", before, re.ASCII)
                touched = [b for b in base[k] if b[0] < start + len(value) and start < b[2]]
                pattern = re.sub(r"[0-9]+|\s+", " ", words.group(1), flags=re.ASCII).lower() if words else ""
                instances.append((k, start, start + len(value), value, pattern, touched[0][3] if touched else None))
    edges = {}
    for *_, value, pattern, kind in instances:
        if pattern:
            edges[pattern, value] = max(edges.get((pattern, value), ""), kind or "")
    seeds = Counter((p, kind) for (p, _), kind in edges.items() if kind)
    live = [(p, v, kind, seed) for (p, v), seed in edges.items() for (q, kind), n in seeds.items() if q == p and n >= pii.LEAST_SEEDS]
    score = {x: float(x[3] == x[2]) for x in live}

    def mean(at):
        held = {}
        for x in live:
            held.setdefault(at(x), []).append(x)
        return held

    for _ in range(pii.ROUNDS):
        confidence = {key: sum(score[x] for x in xs) / len(xs) for key, xs in mean(lambda x: (x[0], x[2])).items()}
        values = {key: sum(confidence[x[0], x[2]] for x in xs) / len(xs) for key, xs in mean(lambda x: (x[1], x[2])).items()}
        score = {x: float(x[3] == x[2]) if x[3] else values[x[1], x[2]] for x in live}
    best = {}
    for (pattern, kind), xs in mean(lambda x: (x[0], x[2])).items():
        confidence = sum(score[x] for x in xs) / len(xs)
        if confidence >= pii.CONFIDENT - 1e-12:
            best[pattern] = max(best.get(pattern, (0.0, "")), (confidence, kind))
    for k, start, end, _, pattern, kind in instances:
        if kind is None and pattern in best:
            base[k].append((start, kinds.index(best[pattern][1]), end, best[pattern][1]))
    return [",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans)) for spans in base]


def test_all_spans_match_a_plain_bootstrap(spark):
    rng = random.Random(21)
    contexts = ["write to", "call me", "server at", "card no", "ref. 12 code", "see the"]

    def identifier():
        n = rng.randrange(100000, 999999)
        return rng.choice([f"u{n}@mail.org", f"(u{n}@mail.org)", f"+1 415 {n} 77", f"10.{n % 250}.3.{n % 99}", "4111 1111 1111 1111", f"user{n}(at)mail", f"id-{n},", f"+{n}", f"x{n}@@y"])

    favourite = {c: [identifier() for _ in range(3)] for c in contexts}
    texts = [" ".join(f"{sentence(rng, 2)} {c} {rng.choice(favourite[c]) if rng.random() < 0.3 else identifier()}{rng.choice(['.', ' and', ''])}" for c in rng.choices(contexts, [9, 3, 3, 2, 1, 1], k=6)) for _ in range(120)]
    texts += [f"please write to u{k}@mail.org" for k in range(100000, 100400)] + [f"do write to name{k}(at)mail" for k in range(40)] + [None, "", *texts[:3]]
    expected = brute_all_spans(texts)
    got = {r["doc_id"]: r["spans"] for r in pii.pii_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert got == dict(enumerate(expected))
    assert any("name" in (t or "") and e for t, e in zip(texts, expected, strict=True))  # some are added ones


def test_a_long_list_of_addresses_takes_time_in_proportion(spark):
    text = " ".join(f"é u{k}@mail.org" + (", +49 30 1234567" if k % 3 == 0 else "") for k in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = pii.pii_digest(docs).first()
    masked = pii.masked(docs).first()["text"]
    took = time.time() - began
    base = brute_base(text)
    assert row["n_email"] == 20_000 and row["n_phone"] == 6_667 and row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert masked.count("<EMAIL>") == 20_000 and masked.count("<PHONE>") == 6_667 and "@" not in masked
    assert took < 60, took


def toxic_corpus(n=600):
    rng = random.Random(6)
    bad = ["zogwit", "blarnard", "skumfrosh", "drekkelin", "drekkeloo", "drekkelum"]
    rows, labels = [], []
    for k in range(n):
        text = sentence(rng, 40).split()
        toxic = k % 5 == 0
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(40), rng.choice(bad))
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_rows_it_did_not_learn_from(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame([*rows, (None, "zogwit blarnard"), (9000, None), (9001, ""), (9002, "A ZOGWIT! drekkelorn drekkelash"), (5, rows[5][1])], "doc_id long, text string").withColumns({"score": F.lit("x"), "toxic": F.lit(1)})
    known = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (9001, 1, None), (12345, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(docs, known).collect()
    assert len(found) == len(rows) + 5
    truth = {k: t for k, _, t in labels}
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r["predicted"] for r in found}
    assert by[None] == 1 and by[9000] == by[9001] == 0 and by[9002] == 1
    kept = toxicity.without_toxic(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in found)


def test_toxicity_without_labels_or_documents(spark):
    docs, rows = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, none).where("predicted = 0").count() == len(rows)
    assert toxicity.toxicity(empty_documents(spark), none).count() == 0


def test_grammar_weighs_clauses():
    grammar = toxicity.Grammar({"zogwit": 1.0, "drekk*": 0.5})
    plain = grammar.weight("a zogwit went by")
    assert plain == 1.0 and grammar.weight("you zogwit") > plain > grammar.weight("she is not a zogwit".replace("she", "it"))
    assert grammar.weight("it was reported a zogwit went by") < plain
    assert grammar.weight("i will kill you") > 0 and grammar.weight("kill the light") == 0
    assert grammar.weight("drekkish. Zogwits, prezogwit") == 0.5 and grammar.weight("zogwit. zogwit! zogwit") == 3.0
    assert grammar.weight("") == 0


PAGES = [
    (1, "http://a.net/x", None), (2, "https://EXAMPLE.net/en/1", ""), (3, "http://de.example.com/de/1?q#f", '<a href="http://bad.test/1">x</a>'), (4, "http://de.example.com/fr/", "<a href='//bad.test/y'>"), (5, None, None), (6, "no scheme", "x"),
    (7, "http://bad.test/1", '<a href=http://other.test/>'), (8, "http://b.org/fr/2", '<a href="http://good.test">'), (9, "http://good.test?x", "<a href='/self'>"), (10, "http://other.test", ""), (11, "http://net/", ""), (12, "http://anet/", ""),
    (13, "ftp://u@x.net:80?y", ""), (14, "http://example.net/en", ""), (14, "http://example.net/en", ""), (15, "://", ""), (16, "http://example.com/de/", '<a href="http://bad.test/2">'), (None, "http://b.org/de/", ""),
]


def test_url_verdicts_match_sql(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, rule string")
    got = sorted(str(tuple(r)) for r in urls.page_verdicts(pages).select("page_id", "host", "path", "rule", "verdict").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    want = sorted(map(str, con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.SQL})").fetchall()))
    assert got == want
    verdict = {r["page_id"]: r["verdict"] for r in urls.page_verdicts(pages).collect()}
    assert verdict[4] == "block" and verdict[5] == "allow" and verdict[9] == "allow" and verdict[12] == "allow" and verdict[13] == "allow"
    assert urls.page_verdicts(pages.where("false")).count() == 0


def test_distrust_flows_against_links(spark):
    edges = spark.createDataFrame([("block", "b", "a", 1.0), ("allow", "t", "u", 1.0)], "kind string, src string, dst string, share double")
    seeds = spark.createDataFrame([("block", "b", 1.0), ("allow", "t", 1.0)], "kind string, host string, weight double")
    got = {(r["kind"], r["host"]): r["score"] for r in urls.spread(edges, seeds).collect()}
    assert got[("block", "a")] > 0 and got[("allow", "u")] > 0 and set(got) == {("block", "a"), ("block", "b"), ("allow", "t"), ("allow", "u")}


def test_pipeline_stages_filter_and_keep_columns(spark, tokenizer, tmp_path):
    import corpus_pipeline

    rows, labels = toxic_corpus(200)
    rng = random.Random(11)
    clean = " ".join(rng.choice(WORDS) for _ in range(80))
    rows += [(700, clean), (701, clean), (702, clean + " end"), (703, sentence(rng, 20) + " " + ITEM), (704, "call me at +1 415 555 0100 or a@b.co " + sentence(rng, 30)), (705, None), (706, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, [{r["doc_id"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        seen.append({r["doc_id"] for r in docs.collect()})
    toxic = {k for k, _, t in labels if t}
    assert len(toxic & seen[1]) <= 2 and seen[1] >= {700, 701, 702, 703, 704, 705, 706} and len(seen[0] - seen[1] - toxic) <= 4
    assert seen[1] - seen[2] == {701, 702} and seen[2] - seen[3] == {703} and seen[3] == seen[4]
    masked = {r["doc_id"]: r for r in docs.collect()}
    assert masked[704]["text"].startswith("call me at <PHONE> or <EMAIL> ") and masked[704]["n_chars"] == len(masked[704]["text"])
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], found, tokenizer)


def test_each_text_of_a_repeated_item_and_very_short_items_are_found(spark):
    rng = random.Random(12)
    long, short = sentence(rng, 13), sentence(rng, 7)
    items = [(0, long), (0, short), (1, "Paris"), (2, "blue  whale"), (3, sentence(rng, 30)), (4, ""), (5, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    filler = lambda: " ".join(rng.choices(["zebra", "quartz", "violin", "harbour", "saddle"], k=20))
    rows = [(0, f"{filler()} {short} {filler()}"), (1, f"{filler()} {long} {filler()}"), (2, " paris\n"), (3, "Blue whale"), (4, f"paris {filler()}"), (5, "a blue whale"), (6, "blue"), (7, ""), (8, None), (9, filler())]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, item_id string")
    found = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontamination.leaks(docs, benchmark).collect()}
    assert found == {(0, 0): 1.0, (1, 0): 1.0, (2, 1): 1.0, (3, 2): 1.0}
    kept = decontamination.without_leaks(docs, benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, 8, 9} and kept.columns == docs.columns
