"""Each operator on odd rows (nulls, empty and long texts, ties, repeats, clashing columns, no rows) and against brute force."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from versolane.llm import common, decontaminate, langid, line_dedup, near_dedup, packing, quality, queries, sharding, suffix_dedup, token_output, tokens, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard int, component_id long, key string, n_lines long, size long, k long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source), with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(*r, 7, False, 99, -1, "x", -5, -6, -7) for r in rows], SCHEMA)


def odd_rows(long=30_000):
    text = " ".join(f"w{i % 997}" for i in range(long // 5))
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, text, "en", "a"), (5, text, "en", None), (6, "same words in a row here", "en", "a"), (6, "same words in a row here", "en", "a"), (7, "same words in a row here", None, "b"), (None, "same words in a row here", "fr", "b"), (8, "ééé 日本語 🙂", "fr", "b"), (9, "0123 !!", "en", "a")]


def documents(spark):
    return common.read(spark, DATA, "documents")


OPERATORS = {
    "shard": lambda d, s: sharding.shard(d),
    "near": lambda d, s: near_dedup.near_duplicates(d),
    "lines": lambda d, s: line_dedup.drop_boilerplate(d),
    "quality": lambda d, s: quality.quality(d),
    "decontaminate": lambda d, s: decontaminate.contaminated(d, s.createDataFrame([(1, "same words in a row here"), (2, None), (3, ""), (3, "same words in a row here")], "item_id long, text string")),
    "toxicity": lambda d, s: toxicity.score(d, toxicity.train(d, s.createDataFrame([(4, 1), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int"))),
    "langid": lambda d, s: langid.identify(d, langid.train(d)),
    "pack": lambda d, s: packing.pack(d, queries.tokenizer()),
    "suffix": lambda d, s: suffix_dedup.remove_repeats(d),
    "tokens": lambda d, s: token_output.materialise(d, common.shared_dir(s) + "/odd", queries.tokenizer(), length=64, records=8),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](frame(spark, odd_rows()), spark).collect()
    if name not in ("pack", "tokens"):
        assert len(got) == len(odd_rows())
    assert {r["doc_id"] for r in got} == {r[0] for r in odd_rows()}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](frame(spark, []), spark).collect() == []


def test_word_hashes_tell_words_apart():
    texts = ["the cat", "THE cat", "cat the", "", None, "x" * 300_000, "a\x0bb c"]
    h, off = common.words(*common.offsets(pa.array(texts)))
    assert np.diff(off).tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert h[0] == h[2] == h[5] and h[1] == h[3] == h[4] and len(set(h.tolist())) == 2 + 1 + 3
    many = [f"w{i}" for i in range(50_000)]
    assert len(set(common.words(*common.offsets(pa.array([" ".join(many)])))[0].tolist())) == 50_000


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 8, 40])
def test_jump(spark, n):
    keys = [0, 1, 2, -1, 2**62, -(2**63), *range(5000, 5300)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump(F.col("k"), n).alias("at")).collect()
    assert all((r["at"]["shard"], r["at"]["grown"]) == (jump(r["k"], n), jump(r["k"], n + 1)) for r in rows)
    assert all(r["at"]["grown"] in (r["at"]["shard"], n) for r in rows)


def test_slots_are_gapless(spark):
    got = sharding.shard(frame(spark, odd_rows() * 3), buckets=4).collect()
    for s in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    texts = dict((r[0], r[1]) for r in odd_rows())
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) and r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 for r in got)


def test_rows_are_written_to_their_shards(spark, tmp_path):
    df = frame(spark, odd_rows() * 3)
    sharding.write(df, str(tmp_path / "out"), shards=3)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["kept"]) for r in got))) == sorted(map(repr, ((r["doc_id"], r["text"], r["kept"]) for r in df.collect())))
    want = {(r["doc_id"], r["slot"]): r["shard"] for r in sharding.shard(df, shards=3).collect()}
    assert {r["shard"] for r in got} == set(want.values()) and len({(r["shard"], r["slot"]) for r in got}) == len(got)
    assert {(r["doc_id"], r["shard"]) for r in got} == {(k, v) for (k, _), v in want.items()}
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def shingles(text, k=5):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_as_brute_force(spark, percent):
    draw = random.Random(percent)
    base = [[f"v{draw.randrange(400)}" for _ in range(draw.choice([3, 8, 40, 120, 400]))] for _ in range(12)]
    rows = []
    for i in range(160):
        w = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 5])):
            w[draw.randrange(len(w))] = f"v{draw.randrange(400)}"
        rows.append((i, draw.choice([" ", "\n"]).join(w).title() if i % 3 else " ".join(w), "en", "a"))
    own = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in own}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in own:
        for b in own:
            if a < b and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b]) > 0:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(frame(spark, rows), percent=percent).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == {i: top(i) for i in own}
    assert all(r["n_shingles"] == len(own[i]) and r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_of_odd_rows(spark):
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frame(spark, odd_rows())).collect() if r["doc_id"] is not None)
    by = {r[1]: r[2:] for r in got}
    assert by[1] == by[2][:0] + (0, 1, True) and by[5][1:] == (4, False) and by[7] == (2, 6, False) and by[6] == (2, 6, True)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 70), (70, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 70: 70, 100: 70, 101: 70}


def test_estimate_is_corrected(spark):
    draw = random.Random(3)
    w = [f"x{draw.randrange(10**6)}" for _ in range(3000)]
    a, b = " ".join(w), " ".join(w[:2700] + [f"y{i}" for i in range(300)])
    h = [near_dedup.sets(pa.array([t]), 5) for t in (a, b)]
    low = [near_dedup.minima(*x)[0] & 15 for x in h]
    s = len(set(h[0][0].tolist()) & set(h[1][0].tolist())) / len(set(h[0][0].tolist()) | set(h[1][0].tolist()))
    assert abs(((low[0] == low[1]).mean() - 1 / 16) / (15 / 16) - s) < 0.1


def test_boilerplate(spark):
    rows = [(i, f"own line {i}\n  menu  \n\nmenu", "en", "a") for i in range(10)] + [(100 + i, "menu\nx", "en", "b") for i in range(4)] + [(200, None, "en", "a"), (201, "menu", "en", "a"), (202, "", "en", "a")]
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(frame(spark, rows)).collect()}
    assert (got[3]["text"], got[3]["n_lines"], got[3]["n_dropped"]) == ("own line 3\n", 4, 2)
    assert (got[101]["text"], got[101]["n_dropped"]) == ("menu\nx", 0)  # four pages are too few
    assert (got[200]["text"], got[200]["n_lines"]) == (None, 0) and (got[201]["text"], got[202]["text"]) == ("", "")
    assert got[3]["kept"] is False and got[3]["shard"] == 99  # other columns pass through


def test_quality_rules(spark):
    own = " ".join(f"u{i}" for i in range(60))
    rows = [(1, own, "en", "a"), (2, "a b c " * 30, "en", "a"), (3, "few words", "en", "a"), (4, "x # $\nx # $\n\ny", "en", "a")] + [(100 + i, "\n".join([" ".join(f"m{j}" for j in range(70)), f"only {i}"]), "en", "z") for i in range(12)]
    got = {r["doc_id"]: r for r in quality.quality(frame(spark, rows)).collect()}
    assert got[1]["kept"] and not got[1]["base_failed"] and got[1]["n_repeat_words"] == 0 and got[1]["word_chars"] == len(own.replace(" ", ""))
    assert got[2]["base_failed"] and got[2]["n_repeat_words"] == 90 and got[3]["base_failed"]
    assert (got[4]["n_symbols"], got[4]["n_dup_lines"], got[4]["n_words"]) == (4, 1, 7)
    assert not got[105]["base_failed"] and not got[105]["kept"] and got[105]["n_lost_words"] == 70


def test_frequent_lines_are_cut_from_kept_texts(spark):
    own = " ".join(f"u{i}" for i in range(60))
    rows = [(i, f"Menu  of the\n\n{own} v{i}\n menu of THE \nlast {i}", "en", "z") for i in range(12)] + [(50, own, "en", "y"), (51, None, "en", "z"), (52, "few", "en", "z")]
    got = {r["doc_id"]: r for r in quality.cleaned(frame(spark, rows)).collect()}
    assert all(got[i]["cleaned"] == f"\n{own} v{i}\nlast {i}" and got[i]["n_lost_words"] == 6 for i in range(12))
    assert got[50]["cleaned"] == own and got[51]["cleaned"] is None and got[52]["cleaned"] is None


def test_copies_of_a_text_keep_their_lines(spark):
    body = "\n".join(" ".join(f"b{i}x{j}" for j in range(20)) for i in range(5))
    rows = [(i, body, "en", "a") for i in range(40)] + [(100 + i, f"menu of the site\nown line {i} " + " ".join(f"o{i}x{j}" for j in range(60)), "en", "a") for i in range(40)]
    cut = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(frame(spark, rows)).collect()}
    assert all((cut[i]["text"], cut[i]["n_dropped"]) == (body, 0) for i in range(40))
    assert all(cut[100 + i]["n_dropped"] == 1 and cut[100 + i]["text"].startswith("own line") for i in range(40))
    good = {r["doc_id"]: r for r in quality.quality(frame(spark, rows)).collect()}
    assert all(good[i]["kept"] and good[i]["n_lost_words"] == 0 for i in range(40)) and all(good[100 + i]["n_lost_words"] == 4 for i in range(40))


def test_leaks(spark):
    draw = random.Random(5)
    word = lambda: f"q{draw.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(draw.choice([4, 13, 30, 60])))) for i in range(30)]
    rows, want = [], {}
    for i in range(120):
        text = [word() for _ in range(draw.randrange(300))]
        if i % 3 == 0:
            k, passage = draw.choice(items)
            passage = passage.split()
            if i % 2 and len(passage) >= 13:
                for p in range(5, len(passage), 7):
                    passage[p] = "changed"
            text[len(text) // 2 : len(text) // 2] = passage
            want[i] = k
        rows.append((i, " ".join(text).upper(), "en", "a"))
    got = {r["doc_id"]: r for r in decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {i for i, r in got.items() if r["contaminated"]} == set(want)
    assert all(want[i] in got[i]["items"] and got[i]["kept"] is False for i in want)
    blocks = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_items=7)
    assert {(r["doc_id"], tuple(r["items"])) for r in blocks.collect()} == {(i, tuple(r["items"])) for i, r in got.items()}


def test_masks_fit_any_substitutions():
    for size in range(1, 13):
        own = decontaminate.masks(size, 80, size == 12)
        for gone in itertools.combinations(range(size), size // 5):
            assert any(all(m == "0" or at + i not in gone for i, m in enumerate(mask)) for mask in own for at in range(size - len(mask) + 1)), (size, gone)


@pytest.mark.parametrize(("window", "percent"), [(12, 80), (20, 75), (7, 60)])
def test_overlaps_as_brute_force(window, percent):
    draw = random.Random(window)
    word = lambda: f"q{draw.randrange(40)}"
    items = [[word() for _ in range(draw.choice([1, 3, *range(5, 18), 30]))] for _ in range(60)] + [[]]
    texts = [[], [word()]]
    for _ in range(300):
        own = list(draw.choice(items))
        cut = draw.randrange(3)
        own = own[draw.randrange(len(own) // 2 + 1) :] if cut == 1 and own else own[: len(own) - 1] if cut == 2 else own
        for p in draw.sample(range(len(own)), min(len(own), draw.choice([0, 1, 2, 2, 3, 4, 5]))):
            own[p] = "changed"
        texts.append([word() for _ in range(draw.randrange(9))] + own + [word() for _ in range(draw.randrange(9))])
    want = {}
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            size = min(window, len(item))
            for start in range(-len(item), len(text)):
                same = [text[start + p] == item[p] for p in range(len(item)) if 0 <= start + p < len(text)]
                if size and any(100 * sum(same[a : a + size]) >= percent * size for a in range(len(same) - size + 1)):
                    want[t, i] = max(want.get((t, i), (0, 0)), (sum(same), len(same)))
    flat = lambda rows: pa.array([" ".join(r) for r in rows])
    block = decontaminate.Block(flat(items).to_pylist(), window, percent)
    got = {(t, i): tuple(v) for t, i, *v in decontaminate.overlaps(*common.words(*common.offsets(flat(texts))), block, window, percent)}
    assert got == want


def test_changed_short_items_are_found(spark):
    items = [(n, " ".join(f"i{n}w{j}" for j in range(n))) for n in (5, 9, 10, 11, 12, 15)]
    rows = [(100 * n + 10 * a + b, " ".join("changed" if j in (a, b if n > 9 else a) else w for j, w in enumerate(t.split())), "en", "a") for n, t in items for a in range(n) for b in range(a + 1, n)]
    got = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r["contaminated"] for r in got)


def test_exact_benchmark_passages_are_found(spark):
    docs, bench = documents(spark), common.read(spark, DATA, "benchmark")
    inside = docs.join(bench.select(F.col("text").alias("b")), F.expr("instr(text, b) > 0")).select("doc_id").distinct()
    got = decontaminate.contaminated(docs, bench).where("contaminated").select("doc_id")
    assert inside.count() > 0 and inside.join(got, "doc_id", "left_anti").count() == 0


def test_ordinal_model_learns_grades():
    draw = random.Random(1)
    texts, grade = [], []
    for i in range(1500):
        g = i % 3
        texts.append(" ".join([f"c{draw.randrange(300)}" for _ in range(40)] + ["bad"] * (g >= 1) + ["worse"] * (g == 2)))
        grade.append(g)
    idx, off = toxicity.features(pa.array(texts), 16)
    m = toxicity.fit(idx[: off[1000]], off[:1001], np.array(grade[:1000]), bits=16)
    p = m.at_least(idx, off)[1000:]
    assert (np.diff(m.thresholds) > 0).all() and (p[:, 0] >= p[:, 1]).all()
    expected = p.sum(axis=1)
    means = [expected[np.array(grade[1000:]) == g].mean() for g in range(3)]
    assert means[0] < 0.3 and 0.6 < means[1] < 1.4 and means[2] > 1.6


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = common.read(spark, d, "documents"), common.read(spark, d, "labels")
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    r = toxicity.score(docs, model).withColumnRenamed("toxic", "said").join(labels.where("doc_id % 3 = 0"), "doc_id").groupBy("toxic").agg(F.avg(F.col("said").cast("int"))).collect()
    r = dict(map(tuple, r))
    assert r[1] > 0.75 and r[0] < 0.01  # from 270 toxic texts; 8,000 labels reach 0.98
    kept = toxicity.drop_toxic(docs, model)
    assert kept.schema == docs.schema and 0 < docs.count() - kept.count() < 1500


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_language_on_held_out_documents(spark, sf):
    docs = common.read(spark, f"/root/testdata/{sf}", "documents")
    got = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in own) >= 0.98 * len(own) and all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(spark):
    odd = {r["doc_id"]: r for r in langid.identify(frame(spark, odd_rows()), langid.train(common.read(spark, "/root/testdata/sf0.01", "documents"))).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 and odd[i]["rejected"] for i in (1, 2, 3, 9)) and odd[8]["lang_pred"] != "und"


ODD = ["", None, " \n", "don't <|endoftext|> X<|ENDOFTEXT|>y 12,3a²b — “quoted”… ≠ x́y É.È ßÜ× ÷a\x00b\x1cc d e f ΑΣ. ΑΣΑ", "a1b22 c's 'S it's", "日本語 テスト。abc,日本", "tab\tnew\nline\x85x", "İstanbul I.", "<<>>||", "é" * 3000, "É'é"]


def test_ids_are_the_tokenizers(spark):
    own = tokens.Encoder(queries.tokenizer())
    texts = ODD + [r[0] for r in documents(spark).select("text").limit(100).collect()]
    for _ in range(2):
        ids, off, _ = own.encode(pa.array(texts, pa.string()))
        want = [e.ids for e in own.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want


def ids_of(spark, text):
    return [*tokens.encoder(queries.tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(spark, got, texts, length):
    for i, text in texts.items():
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        ids, at = ids_of(spark, text), 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length and (at == length or s == max(r["sequence_id"] for r in got))


def test_packing(spark):
    rows = [(r["doc_id"], r["text"], "en", "a") for r in documents(spark).select("doc_id", "text").collect()] + [(9001, None, None, None), (9002, "", None, None), (9003, ODD[3], None, None)]
    got = packing.pack(frame(spark, rows).repartition(3), queries.tokenizer(), length=256).collect()
    check_pieces(spark, got, {r[0]: r[1] for r in rows}, 256)
    assert all(r["doc_tokens"] == len(ids_of(spark, t)) for r in got[:50] for t in [dict((x[0], x[1]) for x in rows)[r["doc_id"]]])


def test_packed_sequences_hold_their_ids(spark):
    rows = [(r["doc_id"], r["text"], "en", "a") for r in documents(spark).select("doc_id", "text").limit(80).collect()] + [(9001, None, None, None), (9002, "", None, None)]
    df = frame(spark, rows).repartition(3)
    want = {i: ids_of(spark, t) for i, t, *_ in rows}
    got = packing.sequences(df, queries.tokenizer(), length=64).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got))) and len(got) > packing.RANGE // 100
    seen = dict.fromkeys(want, 0)
    for r in got:
        ids, at = np.frombuffer(r["ids"], "<u4").tolist(), 0
        assert len(ids) == 64 or r["sequence_id"] == len(got) - 1
        for p in r["pieces"]:
            assert p["offset"] == at and ids[at : at + p["length"]] == want[p["key"]][p["start"] : p["start"] + p["length"]]
            at, seen[p["key"]] = at + p["length"], seen[p["key"]] + p["length"]
        assert at == len(ids)
    assert seen == {i: len(x) for i, x in want.items()}
    for r in packing.pack(df, queries.tokenizer(), length=64).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]][r["start"] : r["start"] + r["length"]] and zlib.crc32(r["ids"]) == r["ids_crc32"]


def test_hilbert_neighbours_are_neighbours():
    bits = packing.CELLS
    grid = np.array([(a, b, c, d) for a in range(4) for b in range(4) for c in range(4) for d in range(4)], np.int64)
    key = packing.hilbert(grid)
    assert len(set(key.tolist())) == len(grid) and bits == 12
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    x = np.arange(n)
    a, b = token_output.feistel(x, n, 1), token_output.feistel(x, n, 2)
    assert sorted(a.tolist()) == x.tolist() == sorted(b.tolist())
    assert n < 50 or (a != b).any()


def test_token_shards_round_trip(spark):
    rows = [(r["doc_id"], r["text"], "en", "a") for r in documents(spark).select("doc_id", "text").limit(60).collect()] + [(9001, None, None, None), (9002, "", None, None)]
    out = common.shared_dir(spark) + "/round"
    got = token_output.materialise(frame(spark, rows).repartition(4), out, queries.tokenizer(), length=64, records=16).collect()
    check_pieces(spark, got, {r[0]: r[1] for r in rows}, 64)
    held = {(r["shard"], r["record"]): r["ids"] for r in token_output.records(spark, out, 64, queries.tokenizer()).collect()}
    slots = {r["slot"] for r in got}
    assert slots == set(range(len(slots))) == {s * 16 + k for s, k in held}
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert held[r["shard"], r["slot"] % 16][r["offset"] : r["offset"] + r["length"]] == ids_of(spark, texts[r["doc_id"]])[r["start"] : r["start"] + r["length"]]


def removed_brute(rows):
    low = {}
    last = 1 << 63
    data = [(last if k is None else k, (t or "").encode()) for k, t in rows]
    for k, b in data:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            low[w] = min(low.get(w, last), k)
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if low[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((None if k == last else k, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "block"), [(512, 1 << 22), (2, 4000), (0, 900)])
def test_suffix_dedup_as_brute_force(spark, hot, block):
    draw = random.Random(hot)
    word = lambda: draw.choice(["alpha", "beta", "é", "日本", "x", "\n", "gamma delta"]) + str(draw.randrange(50))
    shared = [" ".join(word() for _ in range(draw.choice([6, 12, 40, 200]))) for _ in range(6)]
    rows = [(draw.randrange(200), " ".join(draw.choice(shared)[draw.randrange(20) :] if draw.random() < 0.4 else word() for _ in range(draw.randrange(40)))) for _ in range(80)]
    rows += [(300, "a" * 400), (301, "a" * 60 + "b" + "a" * 49), (302, "a" * 49), (None, "a" * 50), (None, rows[3][1]), (303, None), (304, ""), (305, "ab" * 200), (306, "ba" * 90), rows[5]]
    df = frame(spark, [(k, t, "en", "a") for k, t in rows]).repartition(3)
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(df, hot=hot, block=block).collect()), key=str)
    assert got == removed_brute(rows)


def test_loser_tree_merges_in_order():
    draw = random.Random(9)
    runs = []
    for _ in range(7):
        own = sorted(bytes(draw.choice(b"ab") for _ in range(12)) for _ in range(draw.randrange(40)))
        lcp = [0] + [next((i for i in range(12) if a[i] != b[i]), 12) for a, b in zip(own, own[1:])]
        runs.append((own, lcp))
    out = [(runs[s][0][k], h) for s, k, h in suffix_dedup.merged(runs)]
    strings = [x for x, _ in out]
    assert strings == sorted(x for own, _ in runs for x in own)
    assert all(h == next((i for i in range(12) if a[i] != b[i]), 12) for a, (b, h) in zip(strings, out[1:]))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = queries.queries()[name](spark, DATA)
    res = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, res.fetchall()))


def test_many_texts_under_the_threshold(spark, monkeypatch):
    """A group of texts alike by about 82 per cent, their origin not among them: hardly any pair is a link, and pairs that are none are no rows."""
    draw = random.Random(11)
    base = [f"b{i}" for i in range(600)]
    rows = []
    for i in range(400):
        w = list(base)
        for p in draw.sample(range(2, 600, 5), 6):
            w[p] = f"own{i}x{p}"
        rows.append((i, " ".join(w), "en", "a"))
    own = {r[0]: shingles(r[1]) for r in rows}
    links = [(a, b) for a, b in itertools.combinations(own, 2) if 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])]
    near = sum(100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]) for a, b in itertools.combinations(range(0, 400, 10), 2))
    assert near > 700 and 20 < len(links) < 600
    root = {i: i for i in own}
    for _ in own:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    counts = {}

    def saved(df, tag):
        out = common.saved(df, tag)
        counts[tag] = counts.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "saved", saved)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == root
    close = sum(100 * len(own[a] & own[b]) >= 84 * len(own[a] | own[b]) for a, b in itertools.combinations(own, 2))
    assert counts["cross"] <= close < 4000  # of 79,800 pairs those within a hundredth of the threshold, at most


def test_toxicity_scores_as_brute_force():
    texts = ["the bad cat", "BAD, bad! worse2worst", "", None, "ééa " * 50, "x " * 9000]
    draw = np.random.default_rng(3)
    model = toxicity.Model(draw.normal(size=1 << 10).astype(np.float32), np.array([0.5, 1.5]))
    severity, p = toxicity.scorer(model)(pa.array(texts))
    for i, text in enumerate(texts):
        found = set()
        for word in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
            word = bytes(c + 32 if 65 <= c <= 90 else c for c in word)
            for own in (None, 4, 5, 6):
                h = common.words(np.frombuffer(word[:own], np.uint8), np.array([0, len(word[:own])]), letters=True)[0][0]
                found.add(int((h ^ np.uint64(own or 0)) >> np.uint64(54)))
        at_least = 1 / (1 + np.exp(-(sum(float(model.weights[c]) for c in found) - model.thresholds))) if found else np.zeros(2)
        assert abs(severity[i] - at_least.sum()) < 1e-6 and abs(p[i] - at_least[0]) < 1e-6


def test_language_scores_as_brute_force():
    texts = ["the cat sat", "Der Hund", "", "a", "été 12 là-bas", "x" * 3000]
    draw = np.random.default_rng(5)
    model = langid.Model(["a", "b", "c"], draw.normal(size=(1 << 12, 3)), draw.normal(size=3), 0.7, 0.0)
    got = model.probabilities(*langid.subwords(pa.array(texts), 12))
    for text, p in zip(texts, got):
        plain = re.sub(rb"[^A-Za-z\x80-\xff]", b" ", text.encode()).lower()
        grams = plain.split()
        for g in (2, 3, 4):
            grams += [plain[i : i + g] + bytes([g]) for i in range(len(plain) - g + 1) if (plain[i + 1] != 32 if g > 2 else plain[i : i + 2] != b"  ")]
        assert len(grams) == len(langid.subwords(pa.array([text]), 12)[0])
        alone = model.probabilities(*langid.subwords(pa.array([text]), 12))[0]
        assert np.allclose(p, alone) and abs(p.sum() - 1) < 1e-9


def test_repeated_and_null_keys_are_judged_by_their_own_text(spark):
    menu, body = " ".join(f"m{i}" for i in range(20)), lambda k: " ".join(f"b{k}x{i}" for i in range(60))
    rows = [(i, f"{menu}\n{body(i)}", "en", "h") for i in range(12)]  # 20 of 80 words stand in a frequent line
    rows += [(100, f"{menu}\n{body(100)}", "en", "h")] * 3 + [(None, f"{menu}\n{body(k)}", "en", "h") for k in (200, 201, 202)] + [(300, f"{menu}\n{body(300)}", "en", "h"), (300, f"{menu}\n{menu}\n{menu}\n{body(301)}", "en", "h")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_lost_words"], r["kept"], r["cleaned"]) for r in quality.cleaned(frame(spark, rows)).collect()), key=str)
    want = [(k, len(t.split()), 20 if t.count(menu) == 1 else 60, True, t.split("\n")[-1]) for k, t, _, _ in rows]
    assert got == sorted(want, key=str)


def test_quality_of_odd_rows(spark):
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in quality.quality(frame(spark, odd_rows())).collect())
    text = odd_rows()[3][1]
    long = (len(text.split()), len(text.replace(" ", "")), 0, 0, len(text.split()), True, False)
    same = (6, 19, 0, 0, 0, True, False)
    want = [("1", *[0] * 5, True, False), ("2", *[0] * 5, True, False), ("3", *[0] * 5, True, False), ("4", *long), ("5", *long), ("6", *same), ("6", *same), ("7", *same), ("None", *same), ("8", 3, 7, 0, 0, 0, True, False), ("9", 2, 6, 0, 0, 0, True, False)]
    assert got == sorted(want)


def test_boilerplate_of_odd_rows(spark):
    rows = [(i, f"menu\n own {i} ", "en", "h") for i in range(5)] + [(7, "menu\nx", "en", "h"), (7, " menu \ny", "en", "h"), (None, "menu\nz", "en", "h"), (None, "menu\nz", "en", "h"), (8, None, "en", "h"), (9, "", "en", None)]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.drop_boilerplate(frame(spark, rows)).collect()), key=str)
    want = [(i, 2, 1, f" own {i} ") for i in range(5)] + [(7, 2, 1, "x"), (7, 2, 1, "y"), (None, 2, 0, "menu\nz"), (None, 2, 0, "menu\nz"), (8, 0, 0, None), (9, 1, 0, "")]
    assert got == sorted(want, key=str)


def test_samples_of_very_large_tables(spark):
    """A share under a millionth still takes rows; of a table with rows an empty sample is an error."""
    rows = spark.range(20_000_000)
    for share in (4e-7, 1e-6, 1e-5):
        assert 0.2 * 2e7 * share < rows.where(common.sampled("id", share)).count() < 5 * 2e7 * share
    assert spark.range(100).where(common.sampled("id", 1.0)).count() == 100
    docs = spark.createDataFrame([(i, "some text", "en") for i in range(1, 9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="sampled"):
        langid.train(docs, fit_rows=1e-12)


def test_pieces_are_packed_or_raw():
    draw = np.random.default_rng(4)
    n = np.array([0, 700, 3, 0, 1, 2000, 5])
    values, packed = draw.integers(0, 1 << 40, n.sum()), np.array([False, True, False, True, False, True, False])
    for flags in (packed, np.zeros(7, bool), np.ones(7, bool)):
        cells = suffix_dedup._cells(values, n, flags, suffix_dedup._squeeze)
        got, counts = suffix_dedup._values(cells, flags, np.int64, lambda x: suffix_dedup._loose(x, np.int64))
        order = suffix_dedup._order(flags)
        pieces = np.split(values, np.cumsum(n)[:-1])
        assert counts.tolist() == n[order].tolist() and got.tolist() == np.concatenate([pieces[i] for i in order]).tolist()


def test_a_block_costs_the_same_however_many_parts_there_are(monkeypatch):
    """What a block sends grows with its text alone: not with the radixes and parts that a larger input is dealt into."""
    import time

    draw = np.random.default_rng(1)
    letters = draw.integers(97, 123, 1 << 21, dtype=np.uint8).tobytes().decode()
    texts = [letters[i : i + 3000] for i in range(0, len(letters), 3000)]
    monkeypatch.setattr(suffix_dedup.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()))
    block = next(suffix_dedup._blocks(1 << 22)([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["key", "text"])]))

    def stage(radixes, parts):
        """CPU seconds, and rows, of a block of which every seventh anchor is found twice."""
        t = time.process_time()
        prints = pa.Table.from_batches(suffix_dedup._send_prints(radixes)([block]))
        spent = time.process_time() - t
        packed = suffix_dedup._flags(prints["packed"])
        low, n = suffix_dedup._values(prints["low"], packed, np.uint32, lambda x: np.cumsum(suffix_dedup._loose(x, np.uint32), dtype=np.uint32))
        order = suffix_dedup._order(packed)
        cells = suffix_dedup._cells((low % 7 == 0).astype(np.uint8), n, packed[order], suffix_dedup._plain)
        told = pa.StructArray.from_arrays([pa.array(np.asarray(prints["radix"])[order]), pa.array(packed[order]), cells], ["radix", "packed", "verdict"])
        told = pa.ListArray.from_arrays(pa.array([0, len(told)], pa.int32()), told)
        t = time.process_time()
        runs = pa.Table.from_batches(suffix_dedup._runs(radixes, parts)([pa.RecordBatch.from_arrays([*block.columns[:1], *block.columns[2:], told], ["bid", "keys", "off", "data", "verdicts"])]))
        firsts, _ = suffix_dedup._values(runs["firsts"].combine_chunks(), suffix_dedup._flags(runs["packed"]), np.uint32, lambda x: suffix_dedup._loose(x, np.uint32))
        return spent + time.process_time() - t, prints.num_rows + runs.num_rows, sorted(firsts.tolist())

    small = min((stage(64, 64) for _ in range(3)), key=lambda x: x[0])
    anchors = len(suffix_dedup.units(*common.offsets(pa.array(texts)))[0])
    for radixes, parts in ((1_920, 3_840), (64_000, 128_000), (6_000_000, 12_000_000)):  # 30 GB, 1 TB, 100 TB
        large = min((stage(radixes, parts) for _ in range(3)), key=lambda x: x[0])
        assert large[0] < 1.5 * small[0] and large[1] <= 2 * anchors and large[2] == small[2]


def test_what_goes_to_a_worker_follows_the_seeds():
    import pickle

    draw = random.Random(2)
    texts = [" ".join(f"w{draw.randrange(5000)}" for _ in range(draw.randrange(1, 31))) for _ in range(2000)]
    assert len(pickle.dumps(decontaminate.Block(texts))) < 16 << 20  # 144 MB with filters of one size


def test_sequences_follow_the_curve(spark):
    """Documents stand in order of place, then key; and neighbours in the sequences share a language more often than documents at random do."""
    docs = documents(spark).where("text IS NOT NULL AND lang IS NOT NULL")
    place = {r["key"]: r["place"] for r in packing.tokenized(docs, "doc_id", "text", queries.tokenizer(), 1).select("key", "place").collect()}
    got = packing.pack(docs.repartition(3), queries.tokenizer(), length=256).orderBy("sequence_id", "offset").collect()
    order = list(dict.fromkeys(r["doc_id"] for r in got))
    assert order == sorted(place, key=lambda k: (place[k], k)) and len(set(place.values())) > len(place) // 2
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    near = np.mean([lang[a] == lang[b] for a, b in itertools.pairwise(order)])
    shares = np.unique(list(lang.values()), return_counts=True)[1] / len(lang)
    assert near > 1.5 * (shares**2).sum()
