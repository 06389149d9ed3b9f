"""The pipeline's stages, each against its own input, by brute force."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from versolane.llm import common

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = common.read(spark, DATA, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(common.saved(stage(spark, frames[-1], DATA), name))
    assert all(f.columns == docs.columns and f.dtypes == docs.dtypes for f in frames[:-1])
    rows = [{r["doc_id"]: r for r in f.collect()} for f in frames[:-1]]

    # line dedup: lines of over 5 per cent and 5 pages of a source go
    held, pages = defaultdict(set), Counter(r["source"] for r in rows[1].values())
    for i, r in rows[1].items():
        for line in r["text"].split("\n"):
            held[r["source"], line.strip(" \t\n\x0b\x0c\r")].add(i)
    for i, r in rows[1].items():
        stay = [x for x in r["text"].split("\n") if not x.strip(" \t\n\x0b\x0c\r") or len(held[r["source"], x.strip(" \t\n\x0b\x0c\r")]) < 5 or 100 * len(held[r["source"], x.strip(" \t\n\x0b\x0c\r")]) <= 5 * pages[r["source"]]]
        assert rows[2][i]["text"] == "\n".join(stay) and rows[2][i]["n_chars"] == len(rows[2][i]["text"])

    # near-duplicates at 80 per cent: the smallest of each group stays
    sets = {}
    for i, r in rows[2].items():
        w = WORD.findall(r["text"].translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert set(rows[3]) == {i for i in sets if top(i) == i}

    # decontamination: every text that holds an item's words in a row goes, and what goes shares half an item's words in order
    bench = [WORD.findall(r["text"].lower()) for r in common.read(spark, DATA, "benchmark").collect()]
    for i, r in rows[3].items():
        text = " " + " ".join(WORD.findall(r["text"].lower())) + " "
        whole = any(" " + " ".join(b) + " " in text for b in bench)
        assert not (whole and i in rows[4])
        if i not in rows[4]:
            known = Counter(text.split())
            assert any(sum(w in known for w in b) >= min(12, len(b)) * 0.8 for b in bench)

    packed = frames[-1].collect()
    assert {r["doc_id"] for r in packed} == set(rows[4])


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_short_items_drop_no_documents(spark, tmp_path):
    spark.createDataFrame([(1, "yes"), (2, "one two three four five")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "they said yes to it"), (2, "so one two three four five it is")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.leaks_out(spark, docs, str(tmp_path)).collect()] == [1]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, k long, size long, n_lines long, kept boolean"
ODD = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (4, "same words in a row here", "en", "a", 24), (5, "Same words in a row here", "en", None, 24), (5, "Same words in a row here", "en", None, 24), (6, "0123 !!", None, "b", 7), (7, "word " * 20_000, "en", "b", 100_000)]


def odd(spark, rows):
    return spark.createDataFrame([(*r, "x", -1, -2, -3, False) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(4, 0), (None, 1), (7, None), (99, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "word word word word word word"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


#: What each stage leaves of the odd rows: all where nothing is toxic or boilerplate; one of equal word sequences, wordless rows each; none that holds the item.
LEFT = {"toxicity": [1, 2, 3, 4, 5, 5, 6, 7], "line_dedup": [1, 2, 3, 4, 5, 5, 6, 7], "near_dedup": [1, 2, 3, 4, 6, 7], "decontamination": [1, 2, 3, 4, 5, 5, 6]}


@pytest.mark.parametrize("name", LEFT)
def test_stages_on_odd_rows(spark, tables, name):
    docs = odd(spark, ODD)
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, tables)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == LEFT[name]
    before = {r[0]: r for r in ODD}
    assert all((r["text"], r["lang"], r["source"], r["n_chars"], r["key"], r["n_lines"], r["kept"]) == (*before[r["doc_id"]][1:], "x", -2 - 1, False) for r in rows)


def test_packing_of_odd_rows(spark, tables):
    rows = dict(corpus_pipeline.STAGES)["packing"](spark, odd(spark, ODD), tables).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ODD}
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert [sum(r["length"] for r in rows if r["doc_id"] == i) for i in (1, 2, 3)] == [1, 1, 1]  # the end id alone


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_no_rows(spark, tables, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, odd(spark, []), tables).collect() == []
