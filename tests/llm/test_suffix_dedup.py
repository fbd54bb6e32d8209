"""Suffix-array deduplication against brute force."""
import hashlib
import random

import numpy as np
import pytest

from tierflow.llm import suffix_dedup as sd

N = sd.LENGTH


def plain(rows):
    """Rows (id, text) -> (id, n_bytes, n_removed, n_spans, sha, kept)."""
    least = {}
    raws = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for p in range(len(raw) - N + 1):
            w = raw[p:p + N]
            least[w] = min(least.get(w, float("inf")), i)
    out = []
    for (own, _), (i, raw) in zip(rows, raws):
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - N + 1):
            if least[raw[p:p + N]] < i:
                gone[p:p + N] = True
        gone = gone[:len(raw)]
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((str(own), len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out)


def corpus(rnd, n):
    syllables = ["th", "er", "on", "an", "ré", "he", "in", "ed", " the ", " "]
    prose = lambda k: "".join(rnd.choices(syllables, k=k))
    passages = [prose(rnd.randint(20, 120)) for _ in range(8)] + ["ab" * 80, "x" * 200]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 51, "x" * 500, "ab" * 300, "é" * 200]
    while len(texts) < n:
        parts = [prose(rnd.randint(0, 200))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 30)
            parts += [p[a:], prose(rnd.randint(0, 60))]
        texts.append("".join(parts))
        if rnd.random() < 0.3:  # near copy
            t = texts[-1]
            a = rnd.randint(0, len(t))
            texts.append(t[:a] + "!" + t[a + 1:])
        if rnd.random() < 0.1:
            texts += [texts[-1]] * 3
    return texts


@pytest.mark.parametrize("batch, segment, gather", [(2 << 20, 1 << 17, 1 << 15), (700, 1 << 17, 20), (3000, 97, 5)])
def test_matches_brute_force(spark, frame, monkeypatch, batch, segment, gather):
    rnd = random.Random(batch)
    texts = corpus(rnd, 150)
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    rows = list(zip(ids, texts)) + [(None, texts[20]), (None, texts[21]), (None, "passage of a null row " * 9), (3, texts[30]), (3, texts[30]), (-5, texts[40]), (10**12, texts[41])]
    monkeypatch.setattr(sd, "BATCH_BYTES", batch)
    monkeypatch.setattr(sd, "SEGMENT", segment)
    monkeypatch.setattr(sd, "_GATHER", gather)
    sd._powers.cache_clear()
    want = plain(rows)
    got = run_plain(rows, batch, shards=3)
    assert got == want
    assert sum(w[2] for w in want) > 1000


def run_plain(rows, batch_bytes, shards):
    """The three passes without Spark, in one process, so that patched constants hold."""
    packs, now = [], []
    for i, t in rows:
        now.append((sd._NO_ID if i is None else i, (t or "").encode()))
        if sum(len(r) for _, r in now) > batch_bytes:
            packs.append(now)
            now = []
    packs.append(now)
    packs = [p for p in packs if p]
    make = lambda p: sd._Batch(sd._PRESS.compress(b"".join(r for _, r in p)), [len(r) for _, r in p], [i for i, _ in p], shards)

    def ask(arrays, wide):
        by, out = {}, {}
        for b, found in enumerate(arrays):
            for shard, n, blob in found:
                by.setdefault(shard, []).append((b, n, blob))
        for shard, items in by.items():
            for b, bits in sd._answer(items, wide):
                out.setdefault(b, []).append({"shard": shard, "bits": bits})
        return out
    batches = [make(p) for p in packs]
    first = ask([list(b.first_arrays()) for b in batches], True)
    for i, b in enumerate(batches):
        b.first_answers(first.get(i))
    second = ask([list(b.second_arrays()) for b in batches], False)
    out, k = [], 0
    for i, b in enumerate(batches):
        gone, at = b.covered(second.get(i)), 0
        for _, raw in packs[i]:
            g = gone[at:at + len(raw)]
            at += len(raw)
            kept = np.frombuffer(raw, np.uint8)[~g].tobytes()
            spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
            out.append((str(rows[k][0]), len(raw), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            k += 1
    return sorted(out)


@pytest.mark.parametrize("own", [5, None])
@pytest.mark.parametrize("gather", [1 << 15, 1])
def test_rows_of_one_id_in_different_batches(monkeypatch, own, gather):
    rnd = random.Random(12)
    text = lambda k: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=k))
    passage, twin = text(60), text(300)
    twin = twin[:150] + passage + twin[150:]
    rows = [(1, text(300) + passage + text(300)), (own, twin), (own, twin), (own, twin)]
    monkeypatch.setattr(sd, "_GATHER", gather)
    sd._powers.cache_clear()
    want = plain(rows)
    assert [w[2] for w in want if w[0] == str(own)] == [60] * 3
    for order in (rows, rows[::-1]):
        assert run_plain(order, 100, shards=2) == want


def test_job(frame):
    rnd = random.Random(9)
    texts = corpus(rnd, 200)
    rows = [(i * 37 % 1009, t) for i, t in enumerate(texts)] + [(None, texts[20]), (None, None), (3, texts[30]), (3, texts[30])]
    got = sd.deduplicate(frame(rows).repartition(5), keep=["doc_id", "score"], kept_as="binary").collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == plain(rows)
    assert {r.score for r in got} == {"x"}


def test_no_rows(frame):
    assert sd.deduplicate(frame([])).count() == 0
    assert [tuple(r) for r in sd.deduplicate(frame([(1, None)])).collect()] == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_levels_stay_logarithmic():
    family, rnd = sd.Levels(), np.random.default_rng(1)
    for i in range(200):
        key = np.unique(rnd.integers(0, 1 << 60, 50).astype(np.uint64))
        family.scan(key, np.zeros(len(key), np.uint64), np.full(len(key), i), np.arange(len(key)))
    assert len(family.levels) <= 9
