import gzip
import hashlib
import io
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from helpers import SF_ORACLE, SF_SMALL, docs, frame, multiset, nothing, rows, sentence, words  # noqa: F401
from pyspark.sql import functions as F
from test_text_operators import slow_bands, slow_components_in_order

from cohortlens.llm import decontaminate, fair_queue, range_coder, warc
from cohortlens.llm.queries import ORACLES, QUERIES
from cohortlens.llm.shared import new_folder, open_fs

# op6

PAGES = [(0, "http://a/\r\nx", "<p>" + "a" * 2000), (1, "http://b/", "<p>" + "a" * 2000), (2, None, "short"), (3, "http://c", "short"),
         (4, "http://d", None), (5, "http://e", ""), (None, "http://f", "<p>" + "a" * 2000), (7, "http://g", "é😀" * 900),
         (8, "http://h", "é😀" * 900), (8, "http://h", "é😀" * 900), (9, "http://i", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 50),
         (11, "http://j", "x" * 999), (12, "http://k", "x" * 999)]


def slow_archive(pages):
    groups = defaultdict(list)
    for i, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            groups[b].append(i)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        top = max(groups.get(b, [-1])) if len(b) >= 1000 else None
        revisit = top is not None and top >= 0 and i != top
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return multiset(out)


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, payload string, at int")
    folder, index = warc.archive_pages(spark, pages.repartition(3))
    got = warc.read_archives(index, folder).collect()
    assert multiset(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got) == slow_archive(PAGES)
    of = {(i, (h or "").encode()): None for i, _, h in PAGES}
    for r in got:
        if r["record_type"] == "response":
            assert (r["page_id"], bytes(r["payload"])) in of
        assert r["url"] is None or "\r" not in r["url"]
    # every record is a gzip member of its own and the sidecar has its place
    for row in index.collect():
        fs, path = open_fs(f"{folder}/{row['file']}")
        with fs.open_input_file(path) as f:
            raw = gzip.decompress(f.read_at(row["length"], row["at"]))
        (headers, record, _), = warc.records(io.BytesIO(raw))
        assert record == raw and headers["warc-type"] == row["record_type"]
    empty, index = warc.archive_pages(spark, pages.limit(0))
    assert warc.read_archives(index, empty).count() == 0


def test_truncated_stream_is_refused():
    record = warc.render(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(record[:-20])))


# op7

ITEM = "In the small town near the old river Tom Miller buys 12 apples and 30 pears for 5 dollars while Tom Miller eats 12 of them every single day until nothing is left"
OTHER = "why does the light of the moon seem so much brighter when clouds are thin and the wind is low over sea and land alike"


def again(text, pairs):
    return " ".join(dict(pairs).get(w, w) for w in text.split())


def test_items_are_found_with_other_parameters(spark, nothing):
    rng = random.Random(1)
    pad = lambda: sentence(rng, 30)
    swapped = again(ITEM, [("Tom", "Anna"), ("Miller", "Jones"), ("12", "77"), ("30", "4"), ("dollars", "euros")])
    mixed = ITEM.split()
    for k, w in enumerate(mixed):  # the template with a new value at each place: no consistent slots
        if w[0].isdigit() or w[0].isupper():
            mixed[k] = f"{k}" if w[0].isdigit() else f"N{'abcdefgh'[k % 8]}{k}"
    rows = [(1, f"{pad()} {ITEM} {pad()}", "a"), (2, f"{pad()} {swapped}! {pad()}", "a"), (3, f"{pad()}\n{pad()}", "a"),
            (4, " | ".join(f"{w}###" for w in OTHER.upper().lower().split()), "a"), (5, " ".join(OTHER.split()[:9]), "a"),
            (6, None, "a"), (None, OTHER, "a"), (1, f"{pad()} {ITEM}", "a"), (8, f"{pad()} {' '.join(mixed)} {pad()}", "a"),
            (9, OTHER + " " + OTHER, "a"), (9, OTHER + " " + OTHER, "a")]
    items = spark.createDataFrame([(10, ITEM, "x"), (11, OTHER, "x"), (12, None, "x"), (13, "too short", "x"), (11, OTHER, "x")],
                                  "item_id long, text string, code string")
    got = {(r["id"], r["item"], r["n_changed"] > 0) for r in decontaminate.contamination(frame(spark, rows), items).collect()}
    assert got == {(1, 10, False), (2, 10, True), (4, 11, False), (None, 11, False), (9, 11, False)}
    clean = decontaminate.decontaminate(frame(spark, rows), items)
    assert clean.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 5, 6, 8]
    assert decontaminate.contamination(nothing, items).count() == 0
    assert decontaminate.decontaminate(frame(spark, rows), items.limit(0)).count() == len(rows)


def test_copies_in_capitals_and_of_short_items_are_found(spark):
    rng = random.Random(2)
    pad = lambda: sentence(rng, 30)
    short, title = "what is the boiling point?", "The Old Man And The Sea By Ernest Hemingway"
    rows = [(1, f"{pad()} {ITEM.upper()} {pad()}", "a"), (2, f"{pad()} {OTHER.title()}.", "a"), (3, f"{pad()} What is the BOILING point {pad()}", "a"),
            (4, f"{pad()} {title.lower()} {pad()}", "a"), (5, f"{pad()} what is the {pad()}", "a"), (6, f"{pad()} why not {pad()}", "a"),
            (7, "Why, not?", "a"), (None, title, "a")]
    items = spark.createDataFrame([(10, ITEM), (11, OTHER), (12, short), (13, title), (14, "why not"), (15, "")], "item_id long, text string")
    got = {(r["id"], r["item"], r["n_changed"]) for r in decontaminate.contamination(frame(spark, rows), items).collect()}
    assert got == {(1, 10, 0), (2, 11, 0), (3, 12, 0), (4, 13, 0), (7, 14, 0), (None, 13, 0)}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(frame(spark, rows), items).collect()) == [5, 6]


def test_both_kinds_of_window_equal_the_sql(spark, nothing, tmp_path):
    """Template and plain windows, short items, long texts, nulls and repeats against the oracle's own steps."""
    rng = random.Random(5)
    pad = lambda n: sentence(rng, n)
    items = [(10, ITEM), (11, OTHER), (12, "what is the boiling point?"), (13, "The Old Man And The Sea By Ernest Hemingway"),
             (14, "why not"), (15, ""), (16, None), (10, OTHER + " and more of it"), (17, "a b c d e f g"), (11, OTHER)]
    rows = [(1, f"{pad(30)} {ITEM.upper()} {pad(20)}"), (2, f"{OTHER.title()}."), (3, f"{pad(9)} What is the BOILING point {pad(9)}"),
            (4, f"{pad(5)} the old man and the sea by ernest hemingway"), (5, "why NOT"), (6, "why not now"), (None, ITEM), (8, None), (9, ""),
            (10, " ".join([again(ITEM, [("12", "13"), ("Tom", "Ann")]), pad(40)] * 300)), (11, "a b c d e f g " * 3), (11, "A B C D E F G"),
            (12, OTHER[:60] + OTHER), (12, OTHER[:60] + OTHER), (13, " ".join(ITEM.split()[:20])), (14, " ".join(ITEM.split()[15:]))]
    extra = [("x",) * 3] * len(rows)
    docs = spark.createDataFrame([r + e for r, e in zip(rows, extra, strict=True)], "doc_id long, text string, words string, code string, t string")
    tests = spark.createDataFrame([r + ("y",) for r in items], "item_id long, text string, pos string")
    got = multiset(decontaminate.contamination(docs, tests).select("id", "item", "n_windows", F.round("coverage", 9), "n_slots", "n_changed").collect())
    con = duckdb.connect()
    for name, key, data in (("documents", "doc_id", rows), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", data)
    want = con.execute("SELECT doc_id, item_id, n_windows, round(coverage, 9), n_slots, n_changed FROM "
                       f"({ORACLES['op7_template_decontamination']})").fetchall()
    assert len(want) > 10 and any(r[4] == 0 for r in want) and any(r[5] > 0 for r in want)
    assert got == multiset(want)
    assert decontaminate.contamination(docs, tests.limit(0)).count() == 0
    assert decontaminate.contamination(nothing, tests).count() == 0


def test_the_bitmap_lets_every_item_window_pass(spark, monkeypatch):
    """A bitmap too small for the items only lets more through."""
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = multiset(decontaminate.contamination(docs, items).collect())
    monkeypatch.setattr(decontaminate, "MAX_BITS", 64)
    assert want and multiset(decontaminate.contamination(docs, items).collect()) == want


def test_shuffled_join_equals_broadcast(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = multiset(decontaminate.contamination(docs, items).collect())
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", 0)
    assert want and multiset(decontaminate.contamination(docs, items).collect()) == want


def test_long_punctuation_runs(spark):
    df = spark.createDataFrame([("*" * 60_000 + " a" + "-" * 60_000 + "b  " + "!" * 9,), ("",), (None,), (" a  |b. ",)], "t string").coalesce(1)
    got = [r["w"] for r in df.select(decontaminate.bare_words(F.col("t")).alias("w")).collect()]
    assert got == [["a" + "-" * 60_000 + "b"], [], [], ["a", "b"]]


# op8

@pytest.fixture(scope="module")
def definition():
    P = pytest.importorskip("public_tokenizers")
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def slow_tokens(rows, definition):
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(definition)
    out, at = [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, docs, rows, nothing, definition):
    unique = [(i, t) for i, t, _ in rows if i is not None and i not in (6 + 48, 7 + 48)]
    unique = list({i: (i, t) for i, t in unique}.values()) + [(None, "no id here"), (-5, "negative ids come first")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in unique], "doc_id long, text string, tie string").repartition(4)
    for block in (range_coder.BLOCK_TOKENS, 300):
        folder = range_coder.write_tokens(df, definition, 1, block_tokens=block, lanes=16)
        got = range_coder.read_documents(range_coder.read_index(spark, folder), folder, with_ids=True).collect()
        assert multiset(r[:4] for r in got) == multiset(slow_tokens(unique, definition))
        assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    # repeated and null ids: every row is there, ids without gaps or overlaps, in order
    folder = range_coder.write_tokens(docs, definition, 1)
    got = sorted(range_coder.read_documents(range_coder.read_index(spark, folder), folder).collect(), key=lambda r: r["start"])
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in rows)
    ends = np.cumsum([r["n_tokens"] for r in got])
    assert [r["start"] for r in got] == [0, *ends[:-1].tolist()]
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert ids == sorted(ids) and got[0]["doc_id"] is None
    folder = range_coder.write_tokens(nothing, definition, 1)
    assert os.path.basename(folder) and range_coder.read_documents(range_coder.read_index(spark, folder), folder).count() == 0


# op9

def slow_mix(rows, weights=(5, 2, 1), epochs=3, seed="mix-1"):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(words(t))
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, free = sum(size.values()), {}, set(names)
    while free:
        unit = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if epochs * size[s] <= unit * weight[s]}
        if not over:
            target |= {s: unit * weight[s] for s in free}
            break
        target |= {s: float(epochs * size[s]) for s in over}
        free -= over
    return size, target, total


def test_mix(spark, docs, rows, nothing):
    size, target, total = slow_mix(rows)
    for cell in (20_000, 5):
        got = fair_queue.mix_plan(docs, cell_rows=cell).collect()
        assert Counter((r["id"], r["source"], r["size"]) for r in got) == Counter((i, s, len(words(t))) for i, t, s in rows)
        taken = defaultdict(int)
        for r in got:
            assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, total)
            assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
            taken[r["source"]] += r["taken"]
        assert sum(taken.values()) <= total
        for s in size:
            assert abs(target[s] - taken[s]) <= max(len(words(t)) for _, t, x in rows if x == s) + 1e-6
        key = multiset((r["id"], r["source"], r["size"], r["taken"]) for r in got)
        assert cell == 20_000 or key == first
        first = key
    assert fair_queue.mix_plan(nothing).count() == 0
    mixed = fair_queue.mix_documents(docs)
    assert mixed.columns == docs.columns
    n = Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
    want = Counter()
    for r in got:
        want[r["id"], r["source"], r["size"]] += r["copies"]
    have = Counter()
    for (i, t, s), k in n.items():
        have[i, s, len(words(t))] += k
    assert have == +want


def served(rows, cut=True):
    """Taken words by (id, text, source): one copy after another, always of the queue whose next copy ends first."""
    size, target, total = slow_mix(rows)
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    line = {s: sorted((hashlib.md5(f"mix-1:{'' if i is None else i}:{t or ''}".encode()).hexdigest(), i, t) for i, t, x in rows if x == s)
            for s in names}
    sent, at, out, left = dict.fromkeys(names, 0), dict.fromkeys(names, 0), Counter(), total
    while True:
        ready = []
        for k, s in enumerate(names):
            epoch, turn = divmod(at[s], len(line[s]))
            if target[s] > 0 and epoch < 3 and sent[s] / target[s] < 1:
                key, i, t = line[s][turn]
                ready.append(((sent[s] + len(words(t))) / target[s], k, key, i, t, s))
        if not ready:
            return out
        _, _, _, i, t, s = min(ready, key=lambda x: x[:3])
        n = len(words(t))
        if cut and n > left:
            return out
        sent[s], at[s], left = sent[s] + n, at[s] + 1, left - n
        out[i, t, s] += n


def test_the_cut_at_the_budget_decides(spark):
    rng = random.Random(11)
    decided = 0
    for trial in range(3):
        rows = [(k, sentence(rng, rng.choice([1, 5, 20, 90, 400])), rng.choice("abcde")) for k in range(60)] + [(90, None, "a"), (91, "", "f")]
        want = served(rows)
        got = fair_queue.mix_plan(frame(spark, rows), cell_rows=7)
        text = {i: t for i, t, _ in rows}
        assert {(r["id"], text[r["id"]], r["source"]): r["taken"] for r in got.collect() if r["taken"]} == {k: n for k, n in want.items() if n}
        total = sum(len(words(t)) for _, t, _ in rows)
        assert total - max(len(words(t)) for _, t, _ in rows) <= sum(want.values()) <= total
        decided += served(rows, cut=False) != want
    assert decided == 3


def test_targets_spill_over(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 0), ("d", 500), (None, 3)]
    t = spark.createDataFrame(sizes, "source string, source_size long")
    got = {r["source"]: r["target"] for r in fair_queue.source_targets(t).collect()}
    _, want, total = slow_mix([(k, "w " * n, s) for k, (s, n) in enumerate(sizes)])
    assert {s: round(v, 6) for s, v in got.items()} == {s: round(v, 6) for s, v in want.items()}
    assert abs(sum(got.values()) - total) < 1e-6


# queries with SQL, and the pipeline

@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, name):
    df = QUERIES[name](spark, SF_ORACLE)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_ORACLE}/{t}.parquet')")
    cur = con.execute(ORACLES[name])
    at = {d[0]: k for k, d in enumerate(cur.description)}
    assert sorted(at) == cols
    assert multiset(df.select(*cols).collect()) == multiset([r[at[c]] for c in cols] for r in cur.fetchall())


def test_pipeline_equals_the_plain_version(spark, definition):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    rows = [r for r in rows if slow_bands(r[1])[-1]]
    least = slow_components_in_order(rows)
    rows = [r for r, c in zip(rows, least, strict=True) if c[2] == r[0]]
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    found = {r["id"] for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string, source string"), items).collect()}
    marked = [r for r in rows if r[0] in found]
    # an item's first and last words, without punctuation, are all there
    bare = [" ".join(w.strip("*&%$#!|.,").lower() for w in words(t) if w.strip("*&%$#!|.,")) for _, t, _ in rows]
    for (i, _, _), text in zip(rows, bare, strict=True):
        whole = any(" ".join(w.strip("*&%$#!|.,").lower() for w in words(x["text"])) in text for x in items.collect())
        assert whole <= (i in found)
    assert len(marked) < 0.1 * len(rows)
    rows = [r for r in rows if r[0] not in found]
    # the mix
    mixed = [(i, t) for (i, t, _), n in served(rows).items() for _ in range(n // len(words(t)))]
    assert multiset(r[:4] for r in corpus_pipeline.run(spark, SF_SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) \
        == multiset(slow_tokens(mixed, definition))


def test_stage_interface(spark):
    import corpus_pipeline
    import __spark_entry__ as entry

    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and "pipeline" in entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}


def test_new_folders_lie_in_the_shared_folder(spark):
    assert new_folder(spark, "x").split("//")[-1].startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))
