"""Collocations, periodic runs and exact deduplication: odd rows with their values, and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from versolane.llm import collocations, common, exact_dedup, periodic_runs, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n long, kept boolean, key string, digest string, runs string, w1 string, row long, bucket long"


def frame(spark, rows):
    """Rows of (doc_id, text, lang), with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(*r, "s", -1, False, "k", "d", "r", "w", -2, -3) for r in rows], SCHEMA)


# --- exact deduplication


def told(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=str)


def test_exact_dedup_of_odd_rows(spark):
    long = "x" * 300_000
    rows = [(1, None, None), (2, "", "a"), (3, "a", "a"), (4, "a ", "a"), (5, "a", "b"), (5, "a", "b"), (None, "a", "b"), (None, "é", "b"), (None, "é", "b"), (6, long, "b"), (9, long, "a"), (-(2**63), "low", "a"), (2**63 - 1, "low", "a")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = told(exact_dedup.deduplicated(frame(spark, rows)))
    want = [
        (1, 2, 2, False, sha("")), (2, 2, 2, True, sha("")), (3, 5, 4, False, sha("a")), (4, 4, 1, True, sha("a ")), (5, 5, 4, False, sha("a")), (5, 5, 4, True, sha("a")), (None, 5, 4, False, sha("a")),
        (None, None, 2, False, sha("é")), (None, None, 2, True, sha("é")), (6, 9, 2, False, sha(long)), (9, 9, 2, True, sha(long)), (-(2**63), 2**63 - 1, 2, False, sha("low")), (2**63 - 1, 2**63 - 1, 2, True, sha("low")),
    ]
    assert got == sorted(want, key=str)
    assert exact_dedup.deduplicated(frame(spark, [])).collect() == []


@pytest.mark.parametrize("historical", [None, "true", "false", "cast(null as boolean)", "doc_id % 3 = 0", "doc_id < 0"])
def test_exact_dedup_is_the_same_for_any_history(spark, historical):
    draw = random.Random(3)
    rows = [(i, draw.choice(["hot"] * 20 + [f"t{draw.randrange(60)}", None]), "a") for i in draw.sample(range(-100, 400), 300)]
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = sorted(((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows), key=str)
    assert told(exact_dedup.deduplicated(frame(spark, rows), historical=F.expr(historical) if historical else None, bucket=16)) == want


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 20_000])
def test_the_hash_is_perfect_and_minimal(n):
    digests = np.frombuffer(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    sizes, bits, slot = exact_dedup.perfect_hash(digests)
    assert sorted(slot.tolist()) == list(range(n))
    assert exact_dedup.slots(sizes, bits, digests).tolist() == slot.tolist()
    assert sum(sizes) <= 64 * 12 + 8 * n  # bits of all levels


def test_strangers_reach_slots_but_not_by_their_bytes(spark):
    """Digests that aren't in the index reach slots of others; only the comparison of bytes tells them apart."""
    digests = np.frombuffer(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(4000)), np.uint8).reshape(-1, 32)
    sizes, bits, _ = exact_dedup.perfect_hash(digests[:2000])
    assert (exact_dedup.slots(sizes, bits, digests[2000:]) >= 0).mean() > 0.5
    groups = lambda a, b: spark.createDataFrame([(bytearray(digests[i].tobytes()), i, 0, 1) for i in range(a, b)], exact_dedup.GROUP)
    index = exact_dedup.build(groups(0, 2000), 3)
    got = {bytes(r["digest"]): (r["win_key"], r["n"]) for r in exact_dedup.look_up(index, groups(1000, 4000), 3).collect()}
    assert got == {digests[i].tobytes(): (i, 2 if 1000 <= i < 2000 else 1) for i in range(4000)}
    assert sum(len(x) // 32 for (x,) in index.select("digests").collect()) == 2000  # no slot is empty


# --- periodic runs


def brute_lyndon(ranks):
    n = len(ranks)
    return [max(j - i for j in range(i + 1, n + 1) if all(ranks[i:j] < ranks[k:j] for k in range(i + 1, j))) for i in range(n)]


def test_lyndon_arrays_as_brute_force():
    draw = random.Random(1)
    for _ in range(600):
        raw = [draw.randrange(draw.choice([1, 2, 3, 5])) for _ in range(draw.randrange(14))]
        kinds = sorted(set(raw))
        ranks = [kinds.index(x) for x in raw]
        assert periodic_runs.lyndon_array(ranks, len(kinds)) == brute_lyndon(ranks)


def brute_runs(words, least=6, times=4):
    n, found = len(words), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                own = words[i : j + q]
                if not any(own[p:] == own[:-p] for p in range(1, q)):
                    found.add((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found)


def texts_with_loops(seed, n=400):
    draw, out = random.Random(seed), []
    for _ in range(n):
        kinds = draw.choice([1, 2, 2, 3, 8, 60])
        own = [f"w{draw.randrange(kinds)}" for _ in range(draw.randrange(90))]
        for _ in range(draw.randrange(4)):
            if len(own) > 12:
                a, p, m = draw.randrange(len(own) - 6), draw.randrange(1, 9), draw.randrange(6, 45)
                for x in range(a + p, min(len(own), a + m)):
                    own[x] = own[x - p]
        out.append(own)
    return out


def test_runs_as_brute_force():
    some = 0
    for own in texts_with_loops(2, 2500):
        got = periodic_runs.runs(periodic_runs.numbered([w.encode() for w in own]))
        assert got == brute_runs(own)
        some += len(got) > 1
    assert some > 100


def test_runs_of_long_texts():
    draw = random.Random(7)
    own = [f"w{draw.randrange(300)}" for _ in range(3000)]
    looped = own + own[-700:] * 4 + [f"x{i}" for i in range(500)] + ["a"] * 5000 + ["b", "a"] * 2000
    got = periodic_runs.runs(periodic_runs.numbered([w.encode() for w in looped]))
    assert (2300, 3500, 700) in got and (6300, 5000, 1) in got and (11299, 4001, 2) in got and len(got) == 3


def test_collapsed_texts(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "a a a a a a b", "a"), (4, "x  y\nx y x y\tx y z", "a"), (None, "a a a a a", "a"), (5, "A a A a a a", "b"), (5, "A a A a a a", "b"), (6, "é é é é é é é", "b")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_runs"], r["start"], r["length"], r["period"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(frame(spark, rows)).collect()), key=str)
    want = [
        (1, 0, 0, None, None, None, [], ""), (2, 0, 0, None, None, None, [], ""), (3, 7, 1, 0, 6, 1, [(0, 6, 1)], "a b"), (4, 9, 1, 0, 8, 2, [(0, 8, 2)], "x y z"), (None, 5, 0, None, None, None, [], "a a a a a"),
        (5, 6, 0, None, None, None, [], "A a A a a a"), (5, 6, 0, None, None, None, [], "A a A a a a"), (6, 7, 1, 0, 7, 1, [(0, 7, 1)], "é"),
    ]
    assert got == sorted(want, key=str)
    assert periodic_runs.periodic_runs(frame(spark, [])).collect() == []


def test_op12_as_brute_force(spark, tmp_path):
    """The query with its planted loops, over documents whose ids are put into the rule by hand."""
    rows = [(i, " \n".join(own) if own else None, "a") for i, own in enumerate(texts_with_loops(11, 300))]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for i, text, _ in rows:
        own = re.findall("[^\x20\x09-\x0d]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(own)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            own = own[:a] + [own[a + (x - a) % p] for x in range(a, n)]
            planted += 1
        runs = brute_runs(own)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        gone = {x for s, length, p in runs for x in range(s + p, s + length)}
        want = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, "".join(f"{s},{length},{p}\n" for s, length, p in runs), " ".join(w for x, w in enumerate(own) if x not in gone))
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == want[:5]
        assert (r["runs_sha256"], r["collapsed_sha256"]) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in want[5:])
    assert planted > 15


# --- collocations


def brute_collocations(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            own = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(own)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
    out = []
    for lang, counts in f.items():
        some = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = {}
        for g, a in some.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside.get(g[i : i + k], 0), a)
        rows_ = []
        for g, a in some.items():
            if inside.get(g, 0) >= a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            rows_.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i + 1, g.decode(), -a, x, y, n[lang], -s) for i, (s, a, g, x, y) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


def mined(df, **how):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.collocations(df, **how).collect())


@pytest.mark.parametrize(("least", "top"), [(2, 2000), (5, 7), (100, 2000)])
def test_collocations_as_brute_force(spark, least, top):
    draw = random.Random(least)
    letters = ["a", "B", "b", "ß", "日", "new", "York", " "]
    rows = [(i, "".join(draw.choice(letters) + draw.choice([" ", " ", " ", "\t", ", ", "\n", "! "]) for _ in range(draw.randrange(40))), draw.choice(["en", "fr", None])) for i in range(120)]
    rows += [(200 + i, "the quick brown fox jumps. the quick brown fox", "en") for i in range(6)] + [(300, None, "en"), (301, "", None), (302, " .,; ", "de"), (303, "a " * 3000, "es")]
    assert mined(frame(spark, rows), least=least, top=top) == brute_collocations(rows, least, top)


def test_collocations_of_no_rows(spark):
    assert mined(frame(spark, [])) == [] and mined(frame(spark, [(1, None, None), (2, "one", "en")])) == []


def test_scores_are_exact(spark):
    rows = [(10**9, 10**13 + 7, 10**9 + 1, 10**9 + 3), (3, 7, 2, 5), (10**12, 10**14, 10**12, 10**12)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, n long, l long, r long").select(collocations.score(*map(F.col, ("a", "n", "l", "r")))).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """With a filter that lets all pairs through, windows are longer and the result is the same."""
    docs = common.read(spark, DATA, "documents")
    want = mined(docs, least=20)
    monkeypatch.setattr(collocations, "pair_filter", lambda texts, least: np.full(1 << collocations.FILTER_BITS - 3, 255, np.uint8))
    assert mined(docs, least=20) == want and len(want) > 50
