"""Substring dedup by repeated-phrase automata.

A window is ``WINDOW`` consecutive words.  A word is removed when a window over
it starts a word sequence that also starts earlier (smaller id, or the same id
and an earlier word); windows are judged on the input.

1. Every window picks the ``GRAM``-word run of least hash in it (its anchor), so
   equal windows pick equal anchors, and about one run in eight is an anchor.
   Anchors are counted over all documents; a window whose anchor occurs once
   cannot recur and is done with.
2. What is left, a few words around each recurring anchor, goes by anchor to
   shards.  A shard confirms the word sequences it holds at two places or more,
   compiles them with pyahocorasick into automata of at most ``MAX_PATTERNS``,
   and streams its passages through them: each hit but a sequence's first is
   covered.  Words are coded by 64-bit hash, so hits are as exact as the hashes.
3. The covered places of each document meet its text once more.

The same step runs on each chunk of texts first, as a combiner: places that an
earlier one of the chunk covers are settled there and not sent.  Windows of very
common anchors go by their own hash, salted, then unsalted, so neither a common
passage nor its many different neighbourhoods meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.shared import ship_package
from cohortlens.llm.words import Words, mix, text_chunks

WINDOW = 20
GRAM = 6
#: occurrences of an anchor from which its windows go by their own hash
HOT = 5_000
SALTS = 64
#: passages that a shard works on at a time, and patterns of one automaton (small ones stay in the processor cache)
SHARD_ROWS = 1_000
MAX_PATTERNS = 50_000

#: a passage (words, the window starts in it to judge) or, without words, settled starts of a document
PASSAGE = ("route bigint, salt int, hot boolean, id bigint, row_code bigint, at int, starts array<int>, words binary")
_PASSAGE = pa.schema([("route", pa.int64()), ("salt", pa.int32()), ("hot", pa.bool_()), ("id", pa.int64()),
                      ("row_code", pa.int64()), ("at", pa.int32()), ("starts", pa.list_(pa.int32())), ("words", pa.binary())])


def anchors_of(w: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, place of each one's anchor, all run hashes by place) of a chunk."""
    runs = np.full(len(w.hash) + 1, np.iinfo(np.uint64).max, np.uint64)
    where, h = w.grams(gram)
    runs[where] = h
    last = np.repeat(w.first[1:], w.count)
    starts = np.flatnonzero(np.arange(len(w.hash)) + window <= last)
    place, best = starts.copy(), runs[starts]
    for j in range(1, window - gram + 1):
        other = runs[starts + j]
        less = other < best
        best[less] = other[less]
        place[less] = starts[less] + j
    return starts, place, runs


def window_hashes(w: Words, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Hashes of the windows at ``starts``; they depend on the words only."""
    runs = w.hash[:max(0, len(w.hash) - window + 1)].copy()
    for j in range(1, window):
        runs *= np.uint64(0xD1342543DE82EF95)
        runs += w.hash[j:j + len(runs)]
    return mix(runs[starts])


def _characters(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def settle(w: Words, starts: np.ndarray, null: np.ndarray, key: np.ndarray, at: np.ndarray,
           window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``starts`` another of them precedes, hashes of the windows).

    Text i lies at word ``at[i]`` of the document ``key[i]`` (``null``: without
    id, last in the order); a place counts once however often it is there.
    Sequences at two places or more are compiled into automata, and the passages
    that hold them are streamed through.
    """
    import ahocorasick

    out = np.zeros(len(starts), bool)
    name = window_hashes(w, starts, window)
    row = w.row()[starts]
    place = at[row] + starts - w.first[row]
    twice = pd.Series(name).duplicated(keep=False).to_numpy()
    if not twice.any():
        return out, name
    some = starts[twice]
    patterns = some[~pd.Series(name[twice]).duplicated().to_numpy()]
    code, words = pd.factorize(w.hash)
    # neighbouring windows are one passage
    cut = np.flatnonzero(np.diff(some) > window) + 1
    passages = list(zip(some[np.append(0, cut)].tolist(), (some[np.append(cut - 1, len(some) - 1)] + window).tolist(), strict=True))
    index = np.full(len(w.hash), -1, np.int64)  # which of starts a word is
    index[starts] = np.arange(len(starts))
    for lo in range(0, len(patterns), MAX_PATTERNS):
        own = patterns[lo:lo + MAX_PATTERNS]
        # the automaton's words are characters, all others one that no pattern has
        used, _ = pd.factorize(code[(own[:, None] + np.arange(window)).ravel()])
        small = np.zeros(len(words), np.int64)
        small[code[(own[:, None] + np.arange(window)).ravel()]] = used + 1
        text = _characters(small[code])
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, s in enumerate(own.tolist()):
            automaton.add_word(text[s:s + window], i)
        automaton.make_automaton()
        ends, which = [], []
        for a, b in passages:
            for end, i in automaton.iter(text[a:b]):
                ends.append(a + end)
                which.append(i)
        hit = index[np.array(ends, np.int64) - window + 1]
        which = np.array(which, np.int64)
        hit, which = hit[hit >= 0], which[hit >= 0]
        order = np.lexsort((place[hit], key[row[hit]], null[row[hit]], which))
        hit, which = hit[order], which[order]
        new = np.ones(len(hit), bool)
        new[1:] = which[1:] != which[:-1]
        first = hit[new][np.cumsum(new) - 1]
        same = (null[row[hit]] == null[row[first]]) & (key[row[hit]] == key[row[first]]) & (place[hit] == place[first])
        out[hit[~same]] = True
    return out, name


def _id_order(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)


def _bounds(*changes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups of neighbours begin and end; each array says where the next one differs."""
    n = len(changes[0]) + 1
    cut = np.flatnonzero(np.logical_or.reduce(changes)) + 1
    return np.append(0, cut), np.append(cut, n)


def _passages(route, salt, hot, ids: pa.Array, codes, at, starts: np.ndarray, lo: np.ndarray, words: list) -> pa.RecordBatch:
    """A batch of PASSAGE rows; ``starts`` is their starts in a row, ``lo`` where each one's begin."""
    offsets = pa.array(np.append(lo, len(starts)).astype(np.int32))
    return pa.RecordBatch.from_arrays([
        pa.array(route, pa.int64()), pa.array(salt, pa.int32()), pa.array(hot, pa.bool_()), ids, pa.array(codes, pa.int64()),
        pa.array(at, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(starts.astype(np.int32))),
        pa.array(words, pa.binary())], schema=_PASSAGE)


def _settled(ids: pa.Array, codes: np.ndarray, row: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Rows of settled starts: ``place`` in the document of text ``row`` (sorted)."""
    lo, _ = _bounds(np.diff(row) != 0)
    of, zero = row[lo], np.zeros(len(lo), np.int64)
    return _passages(codes[of], zero, zero.astype(bool), ids.take(pa.array(of)), codes[of], zero, place, lo, [None] * len(lo))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, row_code, n): the anchors of each document, with how often each is picked at another place."""
    for batch in batches:
        codes = batch.column("row_code").to_numpy(zero_copy_only=False)
        for at, texts in text_chunks(batch.column("text")):
            w = Words(texts)
            _, place, runs = anchors_of(w)
            place = np.unique(place)
            if not len(place):
                continue
            of = pd.DataFrame({"anchor": runs[place].view(np.int64), "row_code": codes[at + w.row()[place]]})
            of = of.groupby(["anchor", "row_code"], sort=False).size().reset_index(name="n")
            yield pa.RecordBatch.from_pandas(of, preserve_index=False)


def _passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their recurring anchors -> passages to settle elsewhere, and starts settled here."""
    for batch in batches:
        all_codes = batch.column("row_code").to_numpy(zero_copy_only=False)
        for at, texts in text_chunks(batch.column("text")):
            w = Words(texts)
            starts, place, runs = anchors_of(w)
            n = len(texts)
            ids, codes = batch.column("id").slice(at, n), all_codes[at:at + n]
            mark, hot = batch.column("anchors").slice(at, n), batch.column("hot").slice(at, n)
            of = np.repeat(np.arange(n, dtype=np.uint64), np.diff(mark.offsets.to_numpy()))
            value = mark.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            is_hot = hot.flatten().to_numpy(zero_copy_only=False).astype(bool)
            salt = lambda row: (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
            known, mine = mix(value ^ salt(of)), mix(runs[place] ^ salt(w.row()[starts]))
            keep = np.isin(mine, known)
            starts, place, mine = starts[keep], place[keep], mine[keep]
            if not len(starts):
                continue
            gone, name = settle(w, starts, *_id_order(ids), np.zeros(n, np.int64))
            row = w.row()[starts]
            if gone.any():
                yield _settled(ids, codes, row[gone], (starts - w.first[row])[gone])
            left = ~gone
            starts, place, row, name = starts[left], place[left], row[left], name[left]
            if not len(starts):
                continue
            # a passage: the windows of one place of an anchor, or one window of a common anchor
            alone = np.isin(mine[left], known[is_hot])
            lo, hi = _bounds(np.diff(place) != 0, np.diff(row) != 0, alone[1:] | alone[:-1])
            a, of, common = starts[lo], row[lo], alone[lo]
            raw = w.buf.tobytes()
            words = [raw[x:y] for x, y in zip(w.start[a].tolist(), w.end[starts[hi - 1] + WINDOW - 1].tolist(), strict=True)]
            yield _passages(np.where(common, name[lo], runs[place[lo]]).view(np.int64),
                            np.where(common, codes[of] % SALTS, 0), common, ids.take(pa.array(of)), codes[of], a - w.first[of],
                            starts - np.repeat(a, hi - lo), lo, words)


def _work(table: pa.Table, salted: bool) -> Iterator[pa.RecordBatch]:
    """Settle the passages of a shard; in the salted round what is left of common anchors goes on."""
    batch = table.combine_chunks().to_batches()[0]
    ids, codes = batch.column("id"), batch.column("row_code").to_numpy()
    first, hot = batch.column("at").to_numpy().astype(np.int64), batch.column("hot").to_numpy(zero_copy_only=False)
    salt = batch.column("salt").to_numpy().astype(np.int64) if salted else np.zeros(len(first), np.int64)
    words = batch.column("words").to_pylist()
    each = batch.column("starts")
    inner, count = each.flatten().to_numpy().astype(np.int64), np.diff(each.offsets.to_numpy())
    w = Words(words)
    of = np.repeat(np.arange(len(words)), count)
    starts = w.first[of] + inner
    null, key = _id_order(ids)
    gone = np.zeros(len(starts), bool)
    for one in np.unique(salt).tolist():  # salts apart
        own = salt[of] == one
        gone[own], _ = settle(w, starts[own], null, key, first)
    if gone.any():
        order = np.argsort(codes[of[gone]], kind="stable")
        # one row for each document
        row = of[gone][order]
        place = (first[of] + inner)[gone][order]
        head = np.flatnonzero(np.diff(codes[row], prepend=codes[row[:1]] - 1))
        row = np.repeat(row[head], np.diff(np.append(head, len(row))))
        yield _settled(ids, codes, row, place)
    if salted:
        left = ~gone & hot[of]
        row = of[left]
        if len(row):
            lo, _ = _bounds(np.diff(row) != 0)
            some = row[lo]
            yield _passages(batch.column("route").to_numpy()[some], np.zeros(len(some)), np.ones(len(some), bool),
                            ids.take(pa.array(some)), codes[some], first[some], inner[left], lo, [words[i] for i in some.tolist()])


def _shards(salted: bool):
    """Passages sorted by route (and salt) -> settled starts; in the salted round, common ones left over go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            is_done = batch.column("words").is_null()
            if is_done.true_count:
                yield batch.filter(is_done)
                batch = batch.filter(pc.invert(is_done))
            # a route stays together: a full shard ends where the route changes
            while batch.num_rows:
                if n < SHARD_ROWS:
                    part = batch.slice(0, SHARD_ROWS - n)
                else:
                    last = held[-1].column("route")[-1].as_py()
                    same = batch.column("route").to_numpy() == last
                    part = batch.slice(0, batch.num_rows if same.all() else int(np.argmin(same)))
                    if not part.num_rows:
                        yield from _work(pa.Table.from_batches(held), salted)
                        held, n = [], 0
                        continue
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
        if held:
            yield from _work(pa.Table.from_batches(held), salted)

    return run


RESULT = ("id bigint, n_words bigint, n_removed bigint, kept_sha256 string, n_spans bigint, kept string")


def _result_rows(with_text: bool):
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                        ("n_spans", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, removed = batch.column("id").to_pylist(), batch.column("removed")
            for at, texts in text_chunks(batch.column("text")):
                out = []
                for i, t in enumerate(texts):
                    words = (t or b"").split()
                    n, spans = len(words), 0
                    starts = [s for x in removed[at + i].as_py() or () if x["id"] == ids[at + i] for s in x["starts"]]
                    if starts:
                        edge = np.zeros(n + 1, np.int64)
                        starts = np.unique(np.array(starts, np.int64))
                        edge[starts] += 1
                        edge[starts + WINDOW] -= 1
                        gone = np.cumsum(edge)[:n] > 0
                        spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                        words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                    kept = b" ".join(words)
                    out.append({"id": ids[at + i], "n_words": n, "n_removed": n - len(words), "n_spans": spans,
                                "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode() if with_text else None})
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
                   hot: int = HOT) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, n_spans, kept) of every row of ``docs``.

    ``kept`` is the words that stay, joined by one space (null unless
    ``with_text``), ``n_spans`` the passages taken out.  A null or empty text has
    no words; null ids come last in the order and count as one id; rows alike in
    id and text have the same places, so neither precedes the other; an empty
    table gives no rows.  Other columns are not read.
    """
    ship_package()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    rows = rows.withColumn("row_code", F.xxhash64("id", "text"))
    anchors = rows.mapInArrow(_anchor_rows, "anchor bigint, row_code bigint, n bigint")
    recurring = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1") \
        .select("anchor", (F.col("n") >= hot).alias("is_hot"))
    marked = anchors.select("anchor", "row_code").join(recurring, "anchor").groupBy("row_code").agg(
        F.collect_list("anchor").alias("anchors"), F.collect_list("is_hot").alias("hot"))
    passages = rows.join(marked, "row_code").select("id", "row_code", "text", "anchors", "hot") \
        .mapInArrow(_passage_rows, PASSAGE)
    for salted, keys in ((True, ["route", "salt"]), (False, ["route"])):
        passages = passages.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_shards(salted), PASSAGE)
    removed = passages.filter("words IS NULL").groupBy("row_code").agg(
        F.collect_list(F.struct("id", "starts")).alias("removed"))
    return rows.join(removed, "row_code", "left").select("id", "text", "removed").mapInArrow(_result_rows(with_text), RESULT)
