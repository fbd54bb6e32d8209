"""SimHash components and piecewise hashing against brute force."""
import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from tierflow.llm import components as cc
from tierflow.llm import piecewise_hash as ph
from tierflow.llm import simhash as sh


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def texts(rnd, n):
    words = [f"w{i}" for i in range(50)] + ["Über", "ÉA", "X\u00a0y"]
    out = [None, "", " \n\t", "One", "one", "A  b", "a b\nC", "a b c"]
    while len(out) < n:
        base = [rnd.choice(words) for _ in range(rnd.randint(1, 400))]
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 3)):
            base[rnd.randrange(len(base))] = rnd.choice(words)
            out.append("\n".join(base))
    return out


def test_components_match_brute_force(frame):
    rnd = random.Random(3)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts(rnd, 300))] + [(None, "one"), (None, "lonely row"), (5, "one"), (5, "one")]
    got = sh.components(frame(rows)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip([str(r[0]) for r in rows], [f"{f:016x}" for f in fps], map(str, brute_components([r[0] for r in rows], fps))))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert len({r[2] for r in want}) < len(rows) - 50


def test_crowded_keys_give_the_same_components(spark):
    rnd = random.Random(4)
    centre = rnd.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(400)} | {rnd.getrandbits(64) for _ in range(50)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for hot in (2, 10**6):
        roots = {r.node: r.root for r in cc.connected(sh.links(df, hot)).collect()}
        groups = {}
        for i, f in enumerate(signed):
            groups.setdefault(roots.get(f, f), []).append(i)
        want = brute_components(list(range(len(fps))), fps)
        assert sorted(map(sorted, groups.values())) == sorted([i for i, w in enumerate(want) if w == k] for k in set(want))


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in cc.connected(edges).collect()} == {0}


def test_no_rows(frame):
    assert sh.components(frame([])).count() == 0 and ph.with_next(frame([])).count() == 0


def plain_edit(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        e = t[:len(t) - cut] + nxt[:cut]
        out.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), ph.fingerprint(t.encode()), ph.fingerprint(e.encode()), ph.fingerprint(nxt.encode())))
    return sorted(out)


def test_next_document_and_edit_match_plain_order(frame):
    rnd = random.Random(5)
    rows = [(i * 13 % 997, t) for i, t in enumerate(texts(rnd, 200))] + [(None, "no id"), (None, None), (7, "tie a"), (7, "tie b"), (7, "tie a"), (900, "x" * 300_000)]
    for ranges in (1, 5, 40):
        got = ph.with_next(frame(rows), ranges=ranges).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == [w[:5] for w in plain_edit(rows)]
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    alone = ph.with_next(frame([(1, "just one text")])).first()
    assert alone.near_next == 1.0


def test_likeness_separates_edits_from_other_texts():
    rnd = random.Random(6)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    docs = [" ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(rnd.randint(50, 3000))) for _ in range(60)]
    near, far = [], []
    for a, b in zip(docs, docs[1:]):
        cut = len(a) // 3
        near.append(ph.likeness(ph.fingerprint(a.encode()), ph.fingerprint((a[:len(a) - cut] + b[:cut]).encode())))
        far.append(ph.likeness(ph.fingerprint(a.encode()), ph.fingerprint(b.encode())))
    assert min(near) > 0.4 and max(far) < 0.3


def test_repetitive_texts_have_signatures(frame):
    rnd = random.Random(7)
    prose = lambda k: "".join(rnd.choices("abcdefghijklmnop   ", k=k))
    for size, times in ((400, 10), (400, 100), (50, 800), (7, 3000)):
        passage = prose(size)
        assert len(ph.fingerprint((passage * times).encode()).split(":")[1]) >= ph.MOST // 2
        got = {r.doc_id: r for r in ph.with_next(frame([(2, passage * times), (1, prose(size * times))])).collect()}
        assert got[2].near_edited > 0.25 and got[2].near_next == 0
    assert ph.likeness(ph.fingerprint(prose(400).encode() * 100), ph.fingerprint(prose(400).encode() * 100)) < 0.3


def test_common_subsequence_matches_plain_table():
    rnd = random.Random(8)
    for _ in range(300):
        a, b = ("".join(rnd.choices("abc", k=rnd.randint(0, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for c in a:
            last = row[:]
            for j, d in enumerate(b):
                row[j + 1] = last[j] + 1 if c == d else max(last[j + 1], row[j])
        assert ph._common(a, b) == row[-1]
