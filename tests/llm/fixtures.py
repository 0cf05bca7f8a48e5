"""Small tables with the odd cases that every operator has to bear."""

import random

WORDS = "the of and river stone cloud glass amber field night water north seven paper light green winter horse apple door music train window garden silver mountain letter bridge shadow summer".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_texts():
    rng = random.Random(5)
    base = sentence(rng, 120)
    changed = base.split()
    changed[60] = "CHANGED"
    passage = sentence(rng, 40)
    texts = [
        base, base, " ".join(changed), base + " " + sentence(rng, 4), "", None, "   \n\t ", "one", "one two three", "One TWO three",
        sentence(rng, 30) + " " + passage + " " + sentence(rng, 30), sentence(rng, 25) + " " + passage + "\n" + sentence(rng, 20),
        "be " * 400, "be " * 300 + "x", sentence(rng, 5000), "äöü ñandú ÉTÉ été 日本語 😀 " * 12, "a" * 3000, passage,
        "tab\tvertical\x0bform\x0cfeed\rreturn\nline" * 9,
    ]
    near = base.split()
    for k in range(12):
        own = near[:]
        for _ in range(k % 4):
            own[rng.randrange(len(own))] = rng.choice(WORDS)
        texts.append(" ".join(own))
    return texts


def odd_documents(spark, repeated=True):
    """doc_id, text and extra columns whose names the operators use inside; ids out of order, two null ids, repeated rows."""
    texts = odd_texts()
    ids = list(range(len(texts)))
    random.Random(9).shuffle(ids)
    rows = [(i * 7 - 5, t) for i, t in zip(ids, texts, strict=True)]
    if repeated:
        rows += [rows[0], rows[3], (rows[2][0], "another text under an id that is taken " * 5), (None, texts[0]), (None, "a text without an id, and long enough to hold a window of thirteen words or fifty bytes")]
    full = [(i, t, None if k % 5 == 0 else "en", "s", None if t is None else len(t), 1, "x", 0.5, 7) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, bucket int, key string, score double, length long").repartition(3), rows


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
