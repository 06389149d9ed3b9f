"""Queries of the job service: states, batches to backends, detection, uploads, publication; and the SQL that says the same."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import sql
from ..functions import text as T
from ..operators import analyze, batches, detection, jobs, language, profiles, translate
from ..sources import books, catalog, epub, epub_source, views
from ..streaming import jobs as live
from ..streaming import machine, progress, uploads
from . import oracle as O
from .oracle import q


def _horizon(events: DataFrame) -> int | None:
    """Where the watermark stands once all events are there, in milliseconds."""
    latest = events.agg(F.unix_millis(F.max("ts"))).first()[0]
    return None if latest is None else latest - 3_600_000


def job_machine(s: SparkSession, d: str) -> DataFrame:
    events = views.job_events(s, d)
    return machine.folded(events, _horizon(events))


def job_machine_stream(s: SparkSession, d: str) -> DataFrame:
    """The same rows by a stream with state, timers and a watermark. Files of the table arrive together, so none is late for another."""
    out = live.shared(s, "moves")
    rows = machine.transitions(live.event_stream(s, d, 10_000))
    start = lambda: rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", live.shared(s, "offsets")).trigger(availableNow=True).start()
    machine.with_timers(s, start).awaitTermination()
    return s.read.schema(machine.ROWS).parquet(out)


def echo_batch(requests: list[tuple[str, str]]) -> list[str]:
    return [translate.echo(*r) for r in requests]


def translate_batches(s: SparkSession, d: str) -> DataFrame:
    return batches.run_batches(views.units(s, d), echo_batch).select("seq_key", "pos", "translated")


def translate_stored(s: SparkSession, d: str) -> DataFrame:
    """The first two turns of each conversation translated and kept, then all turns: what was answered isn't asked again."""
    store, units = live.shared(s, "translations"), views.units(s, d)
    translate.stored(units.where("pos <= 1"), store, translate.echo, batch=echo_batch)
    return translate.stored(units, store, translate.echo, batch=echo_batch).select("seq_key", "pos", "translated", "reused")


def _detector(provider: str, model: str, prompt: str) -> str | None:
    """A stand-in: what it answers hangs on the prompt's digest."""
    kind = hashlib.md5(prompt.encode()).hexdigest()[0]
    if kind == "0":
        raise RuntimeError(f"{provider} is busy")
    return {"1": None, "2": "French\nas it seems", "3": "Unknown"}.get(kind, ' "German." ')


def lang_ask(s: SparkSession, d: str) -> DataFrame:
    asked = views.manifest(s, d)
    samples = language.page_sample(views.paged(s, d)).withColumnRenamed("book_id", "job_id")
    requests = language.detection_requests(samples, asked.select("job_id", "provider", F.lit("").alias("model")), catalog.providers(s), catalog.DETECTION)
    return detection.detected(asked, requests, _detector)


def lang_detect(s: SparkSession, d: str) -> DataFrame:
    """Profiles learnt from two thirds of the documents, held against all of them."""
    docs = views.read(s, d, "documents")
    return profiles.nearest(docs, profiles.learn(docs.where("doc_id % 3 <> 1")))


def _encode(text: str) -> list[str]:
    """A stand-in for a tokenizer: letters by six, anything else alone."""
    return re.findall("[A-Za-z]{1,6}|[^A-Za-z]", text)


def token_estimate_encoded(s: SparkSession, d: str) -> DataFrame:
    count = T.token_counter(_encode)
    html = analyze.encoded_estimate(analyze.chapter_pieces(views.chapters(s, d)), count).withColumn("file_type", F.lit("epub"))
    pages = views.read(s, d, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("page_no"), "text")
    return html.unionByName(analyze.encoded_estimate(analyze.page_pieces(pages), count).withColumn("file_type", F.lit("pdf")))


def analyze_requested(s: SparkSession, d: str) -> DataFrame:
    """The analysis of the books that were asked for, one of which has no chapter."""
    chapters = views.chapters(s, d)
    asked = chapters.select("book_id").where(F.length("book_id") % 2 == 0).union(s.createDataFrame([("nothing",)], "book_id string"))
    return analyze.books(chapters.join(asked.distinct(), "book_id", "left_semi"), asked)


def _volumes(s: SparkSession, d: str, folder: str, pages: int = 8) -> int:
    """Each book as archives of eight chapters, written where a stream finds them; of every third volume a second delivery under another name. Returns how many files there are."""
    import pandas as pd

    def pack(parts):
        for part in parts:
            done = []
            for book, volume, own in zip(part["book_id"], part["volume"], part["own"]):
                content = epub.archive([x["name"] for x in own], [x["html"] for x in own])
                for name in [f"{book}.vol-{volume}.epub"] + [f"{book}.vol-{volume}.again.epub"] * (volume % 3 == 0):
                    epub.put(folder, name, content)
                    done.append(name)
            yield pd.DataFrame({"name": done})

    own = views.chapters(s, d).groupBy("book_id", F.floor(F.col("doc_idx") / pages).alias("volume")).agg(F.sort_array(F.collect_list(F.struct("doc_idx", "name", "html"))).alias("own"))
    return own.mapInPandas(pack, "name string").count()


def upload_books_stream(s: SparkSession, d: str) -> DataFrame:
    """Books that arrive in volumes, some twice, in several micro-batches; analysed as they come, and merged."""
    folder, store = live.shared(s, "inbox"), live.shared(s, "analyses")
    files = _volumes(s, d, folder)
    uploads.arrive(s, folder, store, files_per_batch=max(1, -(-files // 3)))
    return uploads.analysed(s, store)


def publish_versions(s: SparkSession, d: str) -> DataFrame:
    """All books published in Italian, then in their own languages: those that change are replaced, the others stay as they are."""
    out, chapters = live.shared(s, "shelf"), views.chapters(s, d)
    books.publish(chapters.withColumn("target_lang", F.lit("Italian")), out)
    first = books.manifest(s, out).select("book_id", F.col("data").alias("before"))
    target = F.element_at(F.array(*map(F.lit, ("Italian", "English", "Spanish"))), (F.length("book_id") % 3 + 1).cast("int"))
    books.publish(chapters.withColumn("target_lang", target), out)
    now = books.manifest(s, out).join(first, "book_id").select("book_id", (F.col("data") != F.col("before")).alias("renewed"), "n_chapters")
    return books.published(s, out).join(now, "book_id").select("book_id", F.col("doc_idx").cast("long").alias("doc_idx"), "name", "language", F.md5("html").alias("html_md5"), "renewed", "n_chapters")


def _answers(s: SparkSession, d: str) -> DataFrame:
    """A block for each text node with a letter, in order; every fifth chapter is skipped, every seventh fails."""
    rows = views.chapters(s, d).select("book_id", "doc_idx", F.filter(H.pieces(F.col("html"), H.SKIP), lambda x: T.translatable(x)).alias("p"))
    whole = (F.col("doc_idx") % 5 == 4) | (F.col("doc_idx") % 7 == 3)
    rows = rows.withColumn("p", F.when(whole, F.array().cast("array<string>")).otherwise(F.col("p")))
    error = F.when(F.col("doc_idx") % 7 == 3, F.concat(F.lit("no answer for "), F.col("book_id"), F.lit(" in any of three attempts, the last of them too late")))
    return rows.select("book_id", "doc_idx", F.posexplode_outer("p").alias("block_no", "t"), error.alias("error")).select("book_id", "doc_idx", "block_no", "error")


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("book_id", F.col("doc_idx").cast("long").alias("doc_idx"), F.col("block_no").cast("long").alias("block_no"), "step", F.round("progress", 9).alias("progress"), "message")


def progress_books(s: SparkSession, d: str) -> DataFrame:
    """Where each book stands after each unit, its closing rows, and a book without any chapter."""
    of = views.chapters(s, d).select("book_id").union(s.createDataFrame([("nothing",)], "book_id string"))
    return _shown(jobs.book_progress(_answers(s, d), of))


def progress_stream(s: SparkSession, d: str) -> DataFrame:
    """The rows of `progress_books` as answers are stored, in three micro-batches."""
    folder, held, out = (live.shared(s, tag) for tag in ("answers", "totals", "bars"))
    answers = _answers(s, d).withColumn("part", F.pmod(F.xxhash64("book_id", "doc_idx", "block_no"), F.lit(3)).cast("int"))
    # pages are read once: what arrives and what the books hold both come from these files
    answers.write.partitionBy("part").parquet(folder)
    stored = s.read.schema(answers.schema).parquet(folder)
    jobs.totals(stored).write.parquet(held)
    files = len(stored.inputFiles())
    stream = s.readStream.schema(answers.schema).option("maxFilesPerTrigger", max(1, -(-files // 3))).parquet(folder)
    rows = progress.bars(stream, s.read.parquet(held))
    start = lambda: rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", live.shared(s, "offsets")).trigger(availableNow=True).start()
    machine.with_timers(s, start).awaitTermination()
    return _shown(s.read.schema(progress.ROWS).parquet(out))


def epub_source_heads(s: SparkSession, d: str) -> DataFrame:
    """The first three chapters of every volume, read by the data source with its filter pushed down, from archives on disk."""
    folder = live.shared(s, "archives")
    _volumes(s, d, folder)
    rows = epub_source.read(s, folder).where("doc_idx < 3")
    return rows.select(F.regexp_extract("path", "([^/]*)\\.epub$", 1).alias("file"), F.col("doc_idx").cast("long").alias("doc_idx"), "name", F.md5("html").alias("html_md5"))


def html_blocks_sql(s: SparkSession, d: str) -> DataFrame:
    """Blocks and functions named in SQL."""
    sql.register(s)
    return s.sql("""SELECT p.page_id, CAST(b.block_no AS BIGINT) AS block_no, b.tag, b.pre, b.post, b.inner_html, word_count(b.inner_html) AS words, token_estimate(b.inner_html) AS tokens, sendable(b.inner_html) AS sendable
        FROM {pages} p, LATERAL html_blocks(p.html) b WHERE translatable(b.inner_html)""", pages=views.read(s, d, "pages"))


QUERIES = (analyze_requested, progress_books, progress_stream, epub_source_heads, html_blocks_sql, job_machine, job_machine_stream, translate_batches, translate_stored, lang_ask, lang_detect, token_estimate_encoded, upload_books_stream, publish_versions)

MACHINE = """WITH RECURSIVE ev AS (
  SELECT event_id, user_id AS job_id, epoch_us(ts) // 1000 AS at_ms, CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' END AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
walk AS (
  SELECT 0::BIGINT AS k, job_id, NULL::BIGINT AS event_id, NULL::BIGINT AS at_ms, NULL::VARCHAR AS kind, NULL::VARCHAR AS was, 'pending' AS state, NULL::BIGINT AS last, NULL::BIGINT AS forgotten, NULL::VARCHAR AS forgotten_state, false AS late, false AS legal FROM (SELECT DISTINCT job_id FROM ev)
  UNION ALL
  SELECT e.k, e.job_id, e.event_id, e.at_ms, e.kind, b.now, CASE WHEN l.late THEN w.state WHEN m.next IS NOT NULL THEN m.next ELSE b.now END, CASE WHEN l.late THEN w.last ELSE e.at_ms END, CASE WHEN b.gone THEN w.last + 21600000 END, CASE WHEN b.gone THEN w.state END, l.late, m.next IS NOT NULL
  FROM walk w JOIN ev e ON e.job_id = w.job_id AND e.k = w.k + 1,
    LATERAL (SELECT w.last IS NOT NULL AND e.at_ms < w.last AS late) l, LATERAL (SELECT coalesce(e.at_ms >= w.last + 21600000, false) AS gone, CASE WHEN coalesce(e.at_ms >= w.last + 21600000, false) THEN 'pending' ELSE w.state END AS now) b,
    LATERAL (SELECT CASE WHEN b.now = 'pending' AND e.kind = 'started' OR b.now = 'processing' AND e.kind = 'progress' THEN 'processing' WHEN b.now = 'processing' AND e.kind IN ('completed', 'error') THEN e.kind END AS next) m),
ended AS (SELECT job_id, arg_max(state, k) AS state, arg_max(last, k) AS last FROM walk WHERE k > 0 GROUP BY job_id)
SELECT job_id, event_id, at_ms, kind, was AS from_state, state AS to_state, CASE WHEN late THEN 'late' WHEN legal THEN 'moved' ELSE 'illegal' END AS verdict FROM walk WHERE k > 0
UNION ALL SELECT job_id, NULL, forgotten, NULL, forgotten_state, NULL, 'evicted' FROM walk WHERE forgotten IS NOT NULL
UNION ALL SELECT job_id, NULL, last + 21600000, NULL, state, NULL, 'evicted' FROM ended WHERE last + 21600000 < (SELECT max(at_ms) - 3600000 FROM ev)"""

PROFILES = r"""WITH t AS (SELECT doc_id, lang, string_split(regexp_replace(' ' || translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' ', '[^\p{L}]+', ' ', 'g'), '') AS c FROM documents),
g AS (
  SELECT doc_id, lang, unnest(list_concat(list_filter(c, lambda x: x <> ' '), list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]),
    list_transform(list_filter(range(1, len(c) - 1), lambda i: c[i + 1] <> ' '), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS g FROM t),
n AS (SELECT doc_id, lang, g, count(*) AS n FROM g GROUP BY ALL),
own AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS rank FROM n QUALIFY rank < 300),
learnt AS (SELECT lang, g, sum(n) AS n FROM n WHERE doc_id % 3 <> 1 AND lang IS NOT NULL GROUP BY lang, g),
known AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) - 1 AS rank FROM learnt QUALIFY rank < 300),
langs AS (SELECT DISTINCT lang FROM known),
far AS (SELECT doc_id, langs.lang, sum(CASE WHEN known.rank IS NULL THEN 300 ELSE abs(known.rank - own.rank) END)::BIGINT AS distance FROM own CROSS JOIN langs LEFT JOIN known ON known.lang = langs.lang AND known.g = own.g GROUP BY ALL),
best AS (SELECT doc_id, lang, distance FROM far QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) = 1)
SELECT d.doc_id, coalesce(best.lang, 'Unknown') AS language, best.distance FROM documents d LEFT JOIN best USING (doc_id)"""

PROGRESS = f"""WITH RECURSIVE {O.NODES}, {O.shown()}, {O.CHAPTERS}, c AS (SELECT book_id, doc_idx, doc_idx % 7 = 3 AS bad, CASE WHEN doc_idx % 5 = 4 OR doc_idx % 7 = 3 THEN 0 ELSE n END AS n, count(*) OVER (PARTITION BY book_id) AS d FROM chapters JOIN shown USING (page_id)),
u AS (SELECT *, unnest(CASE WHEN n = 0 THEN [NULL] ELSE range(n) END) AS block_no, 'Chapter ' || (doc_idx + 1) || '/' || d AS chapter FROM c)
SELECT book_id, doc_idx, block_no, CASE WHEN bad THEN 'failed' WHEN block_no IS NULL THEN 'skipped' ELSE 'block' END AS step,
  round(CASE WHEN block_no IS NULL THEN (doc_idx + 1) / d ELSE least(doc_idx / d + (block_no + 1) / n / d, 0.99::DOUBLE) END, 9) AS progress,
  chapter || CASE WHEN bad THEN ' - failed: ' || left('no answer for ' || book_id || ' in any of three attempts, the last of them too late', 60) WHEN block_no IS NULL THEN ' - skipped, no text' ELSE ' - block ' || (block_no + 1) || '/' || n END AS message FROM u
UNION ALL SELECT book_id, NULL, NULL, step, progress, message FROM (SELECT DISTINCT book_id FROM chapters) CROSS JOIN (VALUES ('saving', 0.99::DOUBLE, 'Saving the book'), ('done', 1.0::DOUBLE, 'Done')) v(step, progress, message)"""

_HEAD = "CASE WHEN length(t) > 50000 THEN floor(len(regexp_extract_all(left(t, 50000), '[A-Za-z]{1,6}|[^A-Za-z]')) * (length(t) / 50000.0::DOUBLE))::BIGINT ELSE len(regexp_extract_all(t, '[A-Za-z]{1,6}|[^A-Za-z]'))::BIGINT END"

ORACLE: dict[str, str] = {
    "job_machine": MACHINE,
    "job_machine_stream": MACHINE,
    "translate_batches": O.ORACLE["translate_units"],
    "translate_stored": f"WITH RECURSIVE {O.CHAIN} SELECT seq_key, pos, translated, pos <= 1 AND {O.sendable('text')} AS reused FROM chain JOIN (SELECT seq_key, pos, text FROM u) USING (seq_key, pos)",
    "lang_ask": f"""WITH {O.PAGED}, s AS (SELECT book_id AS job_id, left(md5({q(language.ASK)} || left(text, 1000)), 1) AS kind FROM paged WHERE page_no = 0 AND length({O.trim('left(text, 1000)')}) >= 20)
SELECT doc_id AS job_id, CASE WHEN kind = '2' THEN 'French' WHEN kind IS NULL OR kind IN ('0', '1', '3') THEN 'Unknown' ELSE 'German' END AS language,
  CASE WHEN kind IS NULL THEN 'not asked' WHEN kind = '0' THEN 'failed: ' || CASE WHEN doc_id % 2 = 0 THEN 'openai' ELSE 'anthropic' END || ' is busy' WHEN kind IN ('1', '3') THEN 'not recognised' ELSE 'answered' END AS outcome FROM documents LEFT JOIN s ON job_id = doc_id""",
    "lang_detect": PROFILES,
    "token_estimate_encoded": f"""WITH RECURSIVE {O.NODES}, {O.shown()}, {O.CHAPTERS}, x AS (SELECT book_id, doc_idx, text FROM chapters JOIN shown USING (page_id)), b AS (SELECT book_id, string_agg(text || chr(10), '' ORDER BY doc_idx) AS t FROM x WHERE length({O.trim('text')}) > 10 GROUP BY book_id),
books AS (SELECT source AS book_id, string_agg(text || chr(10), '' ORDER BY doc_id) AS t FROM documents WHERE length(text) > 0 GROUP BY source)
SELECT book_id, {_HEAD} AS estimated_tokens, 'epub' AS file_type FROM b UNION ALL SELECT book_id, {_HEAD}, 'pdf' FROM books""",
    "analyze_requested": f"WITH RECURSIVE {O.BOOKS} SELECT * FROM analysis WHERE length(book_id) % 2 = 0 UNION ALL SELECT 'nothing', 0, 0, 0, [], 0",
    "progress_books": f"{PROGRESS} UNION ALL SELECT 'nothing', NULL, NULL, 'done', 1.0, 'Done: nothing to translate'",
    "progress_stream": PROGRESS,
    "epub_source_heads": f"""WITH {O.CHAPTERS}, v AS (SELECT *, doc_idx // 8 AS volume, doc_idx % 8 AS i FROM chapters), f AS (SELECT *, book_id || '.vol-' || volume AS file FROM v UNION ALL SELECT *, book_id || '.vol-' || volume || '.again' FROM v WHERE volume % 3 = 0)
SELECT file, i AS doc_idx, name, md5(html) AS html_md5 FROM f WHERE i < 3""",
    "html_blocks_sql": f"WITH RECURSIVE {O.TREE} SELECT page_id, block_no, tag, pre, post, inner_html, {O.words('inner_html')} AS words, ({O.tokens('length(inner_html)')})::BIGINT AS tokens, {O.sendable('inner_html')} AS sendable FROM blk",
    "upload_books_stream": O.ORACLE["analyze_books"],
    "publish_versions": f"WITH {O.CHAPTERS} SELECT book_id, doc_idx, name, ['it', 'en', 'sp'][length(book_id) % 3 + 1] AS language, md5(html) AS html_md5, length(book_id) % 3 <> 0 AS renewed, count(*) OVER (PARTITION BY book_id) AS n_chapters FROM chapters",
}
