"""Repeated passages by suffix automata: matching statistics against reference shards, maximal spans removed.

An automaton knows every run of words of its reference and the smallest document that has it. A text is streamed
through it, word by word; wherever the longest match has `window` words or more, the words of the match are covered.

For a reference of limited size, `reference_spans` broadcasts one shard of at most SHARD_WORDS words after the other.
`repeats` takes the corpus itself as the reference, which has no such limit. Its shards are therefore dealt out by
content: each window of 13 words belongs to the smallest hash among its runs of GRAM words, so equal windows belong to
the same shard wherever they occur. Hashes met in one document only are left behind; around the others the passages
are cut out, equal ones are folded with their smallest document, each shard's automaton is built from its different
passages, and these are streamed through it. Hashes only decide where words meet; the automata compare the words.
A shard of more than HOT_WORDS words is dealt out again, window by window, by the smallest hash of longer runs, first of
LONGER_GRAM words, then of whole windows; its parts, too, are shards of which automata are built.

Defined cases: a null or empty text has no words; windows of fewer words than a document has do not exist, so shorter
documents lose nothing; a document without id loses nothing and is nobody's smaller document; rows with the same id
count as the same document; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars.llm.tools import discard, map_batches, scratch, stored

WINDOW = 13
GRAM = 5
SHARD_WORDS = 200_000
# A shard of the corpus that has more words is dealt out again.
HOT_WORDS = 50_000
LONGER_GRAM = 9
# Bytes of text that are hashed at once.
CHUNK_BYTES = 1 << 20
# Stands for "no document"; no id is larger.
NOBODY = 2**63 - 1


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, unchanged."""
    return text.encode().split() if text else []


class SuffixAutomaton:
    """All runs of words of some passages; of each, the smallest document that has it."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [NOBODY]

    def _state(self, length: int, link: int, follow: dict, first: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(follow)
        self.first.append(first)
        return len(self.length) - 1

    def _extend(self, last: int, word, doc: int) -> int:
        follow, link, length = self.next, self.link, self.length
        q = follow[last].get(word)
        if q is not None and length[q] == length[last] + 1:
            self.first[q] = min(self.first[q], doc)
            return q
        cur = -1 if q is not None else self._state(length[last] + 1, 0, {}, doc)
        p = last
        while p >= 0 and word not in follow[p]:
            follow[p][word] = cur
            p = link[p]
        if p < 0:
            return cur
        q = follow[p][word]
        if length[q] == length[p] + 1:
            link[cur] = q
            return cur
        copy = self._state(length[p] + 1, link[q], dict(follow[q]), doc if cur < 0 else NOBODY)
        while p >= 0 and follow[p].get(word) == q:
            follow[p][word] = copy
            p = link[p]
        link[q] = copy
        if cur < 0:
            return copy
        link[cur] = copy
        return cur

    def add(self, passage: list, doc: int) -> None:
        last = 0
        for word in passage:
            last = self._extend(last, word, doc)

    def close(self) -> SuffixAutomaton:
        """Every run also occurs where a longer run that ends in it does."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if self.first[s] < self.first[up]:
                self.first[up] = self.first[s]
        return self

    def statistics(self, passage: list) -> Iterator[tuple[int, int]]:
        """For each word the state reached and the length of the longest match that ends here."""
        follow, link, length = self.next, self.link, self.length
        state = matched = 0
        for word in passage:
            while state and word not in follow[state]:
                state = link[state]
                matched = length[state]
            if word in follow[state]:
                state = follow[state][word]
                matched += 1
            yield state, matched

    def firsts(self, passage: list, window: int) -> list[int]:
        """For each window of the passage the smallest document that has it, or NOBODY."""
        out = []
        for at, (state, matched) in enumerate(self.statistics(passage)):
            if at >= window - 1:
                if matched < window:
                    out.append(NOBODY)
                    continue
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                out.append(self.first[state])
        return out


def covered(starts: Iterator[int] | list[int], window: int) -> list[tuple[int, int]]:
    """Windows by their sorted starts, as maximal spans."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + window)
        else:
            out.append((s, s + window))
    return out


# ---------------------------------------------------------------- where windows belong

_RANDOM = np.random.default_rng(20_240_101)
_BYTES = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


class Hashed:
    """Words of some texts one after the other, and the shard of each window."""

    def __init__(self, texts: list[bytes], window: int):
        self.data = b"\n".join(texts)
        data = np.frombuffer(self.data, np.uint8)
        inside = (data != 32) & ((data < 9) | (data > 13))
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sizes = np.array([len(t) for t in texts], np.int64)
        text_ends = np.cumsum(sizes + 1)
        self.text_words = np.searchsorted(self.begin, text_ends)  # words up to the end of each text
        n, most = len(self.begin), 0
        if n:
            lengths = self.end - self.begin
            most = int(lengths.max())
            powers = np.cumprod(np.full(most, _ODD, np.uint64))
            solid = np.flatnonzero(inside)
            firsts = np.cumsum(lengths) - lengths
            offsets = np.arange(len(solid)) - np.repeat(firsts, lengths)
            hashes = _mixed(np.add.reduceat(_BYTES[data[solid]] * powers[offsets], firsts))
        n_grams = n - GRAM + 1
        if n < window:
            self.shard, self.valid = np.empty(0, np.uint64), np.empty(0, bool)
            return
        grams = np.zeros(n_grams, np.uint64)
        for j in range(GRAM):
            grams = grams * _ODD + hashes[j : j + n_grams]
        grams = _mixed(grams)
        n_windows = n - window + 1
        least = grams[:n_windows].copy()
        for j in range(1, window - GRAM + 1):
            np.minimum(least, grams[j : j + n_windows], out=least)
        self.shard = least
        before = np.append(0, self.text_words[:-1])
        stop = np.repeat(self.text_words, self.text_words - before)[:n_windows]
        self.valid = np.arange(n_windows) + window <= stop

    def windows_of(self, i: int) -> tuple[int, np.ndarray]:
        """The first word of a text, and the shards of its windows."""
        a = int(self.text_words[i - 1]) if i else 0
        b = int(self.text_words[i])
        here = slice(a, min(b, len(self.shard)))
        return a, self.shard[here][self.valid[here]]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _check(window: int) -> None:
    if window < GRAM:
        raise ValueError(f"windows have {GRAM} words at least")


def _shards(docs: DataFrame, window: int) -> DataFrame:
    """(doc, shards): the different shards of each document's windows."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t.as_py() or "").encode() for t in batch.column(1)]
        out = []
        for a, b in _chunks(texts):
            hashed = Hashed(texts[a:b], window)
            out += [np.unique(hashed.windows_of(i)[1].view(np.int64)) for i in range(b - a)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["doc", "shards"])

    return map_batches(docs.select("doc", "text"), make, "doc bigint, shards array<bigint>")


def _passages(docs: DataFrame, window: int) -> DataFrame:
    """From rows (doc, row, text, wanted): the passages around the wanted shards, with the place of their first word."""
    most = window - GRAM + 1
    names = ["doc", "row", "place", "shard", "passage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, rows_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [(t.as_py() or "").encode() for t in batch.column(2)]
            for a, b in _chunks(texts):
                hashed = Hashed(texts[a:b], window)
                out: list[tuple] = []
                for i in range(b - a):
                    base, shards = hashed.windows_of(i)
                    shards = shards.view(np.int64)
                    wanted = np.sort(batch.column(3)[a + i].values.to_numpy())
                    if not len(shards) or not len(wanted):
                        continue
                    at = np.minimum(np.searchsorted(wanted, shards), len(wanted) - 1)
                    hit = np.flatnonzero(wanted[at] == shards)
                    if not len(hit):
                        continue
                    new = np.append(True, (np.diff(hit) > 1) | (np.diff(shards[hit]) != 0))
                    starts = np.flatnonzero(new)
                    for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(hit)]):
                        for z in range(x, y, most):
                            p, q = int(hit[z]), int(hit[min(y, z + most) - 1])
                            cut = hashed.data[hashed.begin[base + p] : hashed.end[base + q + window - 1]]
                            out.append((docs_[a + i], rows_[a + i], p, int(shards[p]), b" ".join(cut.split()).decode()))
                if out:
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return docs.mapInArrow(run, "doc bigint, row bigint, place int, shard bigint, passage string")


def _folded(passages: DataFrame) -> DataFrame:
    least = F.coalesce(F.min("doc"), F.lit(NOBODY)).alias("first")
    return passages.groupBy("shard", "passage").agg(least)


def _firsts(folded: DataFrame, window: int) -> DataFrame:
    """(shard, passage_hash, firsts): for each window of a passage the smallest document of its shard that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[int, str, int]] = []
        names = ["shard", "passage", "firsts"]

        def solved(rows: list[tuple[int, str, int]]) -> Iterator[tuple]:
            group: list[tuple[list[str], str, int]] = []
            for i, (shard, passage, first) in enumerate(rows):
                group.append((passage.split(" "), passage, first))
                if i + 1 < len(rows) and rows[i + 1][0] == shard:
                    continue
                if len(group) == 1:  # all it has is its own
                    yield shard, passage, [first] * (len(group[0][0]) - window + 1)
                else:
                    automaton = SuffixAutomaton()
                    for ws, _, doc in group:
                        automaton.add(ws, doc)
                    automaton.close()
                    for ws, text, _ in group:
                        yield shard, text, automaton.firsts(ws, window)
                group = []

        def made(rows: list[tuple[int, str, int]]) -> pa.RecordBatch:
            types = [pa.int64(), pa.string(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*solved(rows)), types)], names=names)

        for batch in batches:
            rest += zip(*(c.to_pylist() for c in batch.columns))
            cut = len(rest)
            while cut and rest[cut - 1][0] == rest[-1][0]:
                cut -= 1
            if cut:
                yield made(rest[:cut])
                rest = rest[cut:]
        if rest:
            yield made(rest)

    dealt = folded.select("shard", "passage", "first").repartition("shard").sortWithinPartitions("shard")
    found = dealt.mapInArrow(run, "shard bigint, passage string, firsts array<bigint>")
    return found.select("shard", F.xxhash64("passage").alias("passage_hash"), "firsts")


def _row(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")).withColumn(
        "row", F.xxhash64("doc", "text")
    )


def _split_windows(passages: DataFrame, window: int, gram: int) -> DataFrame:
    """Each window as a passage of its own, in the shard of the smallest hash of its runs of `gram` words."""
    ws = F.split("passage", " ")
    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - gram), lambda j: F.xxhash64(F.array_join(F.slice(ws, j + 1, gram), " ")))
    timed = passages.withColumn("hashes", hashes)
    each = F.transform(
        F.sequence(F.lit(0), F.size(ws) - window),
        lambda i: F.struct(
            (F.col("place") + i).alias("place"),
            F.array_min(F.slice("hashes", i + 1, window - gram + 1)).alias("least"),
            F.array_join(F.slice(ws, i + 1, window), " ").alias("passage"),
        ),
    )
    cut = timed.select("doc", "row", "shard", F.explode(each).alias("w"))
    return cut.select("doc", "row", F.col("w.place").alias("place"), F.xxhash64("shard", "w.least").alias("shard"), F.col("w.passage").alias("passage"))


def _without_hot(passages: DataFrame, folded: DataFrame, window: int) -> list[tuple[DataFrame, DataFrame]]:
    """Passages and the same folded, in parts, after shards of more than HOT_WORDS words were dealt out again.

    Only what such shards hold is read and written anew; the list of them is short, at most one for HOT_WORDS words.
    """
    parts = []
    for gram in sorted({min(LONGER_GRAM, window), window}):
        sizes = folded.groupBy("shard").agg(F.sum(F.size(F.split("passage", " "))).alias("n"))
        hot = stored(sizes.where(F.col("n") > HOT_WORDS).select("shard"), "hot")
        if hot.isEmpty():
            break
        parts.append((passages.join(hot, "shard", "left_anti"), folded.join(hot, "shard", "left_anti")))
        passages = stored(_split_windows(passages.join(hot, "shard", "left_semi"), window, gram), "passages")
        folded = stored(_folded(passages), "folded")
    return [*parts, (passages, folded)]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, row, windows): of each document the places and answers of windows that a smaller document has.

    `row` is the hash of id and text; `windows` is a list of (place, firsts).
    """
    _check(window)
    plain = _row(docs, id_col, text_col)
    lists = stored(_shards(plain, window), "shards")
    met = lists.select("doc", F.explode("shards").alias("shard")).where("doc is not null")
    shared = met.groupBy("shard").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("shard")
    wanted = stored(met.join(shared, "shard").groupBy("doc").agg(F.collect_set("shard").alias("wanted")), "wanted")
    discard(lists)
    passages = stored(_passages(plain.join(wanted, "doc").select("doc", "row", "text", "wanted"), window), "passages")
    discard(wanted)
    folded = stored(_folded(passages), "folded")
    with scratch(docs.sparkSession):
        parts = _without_hot(passages, folded, window)
        placed = [p.select("doc", "row", "place", "shard", F.xxhash64("passage").alias("passage_hash")) for p, _ in parts]
        firsts = stored(_firsts(reduce(DataFrame.union, [f.select("shard", "passage", "first") for _, f in parts]), window), "firsts", keep=True)
        places = stored(reduce(DataFrame.union, placed), "places", keep=True)
    discard(passages)
    discard(folded)
    found = places.join(firsts, ["shard", "passage_hash"])
    found = found.where(F.exists("firsts", lambda f: f < F.col("doc")))
    return found.groupBy("doc", "row").agg(F.collect_set(F.struct("place", "firsts")).alias("windows"))


def _without(ws: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    out, done = [], 0
    for a, b in spans:
        out += ws[done:a]
        done = b
    return b" ".join(out + ws[done:])


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_SPANS = "n_words bigint, spans array<struct<start:int,end:int>>, kept string"


def _spans_of(id_column: pa.Array, name: str, rows: list[tuple[list[bytes], list[tuple[int, int]]]]) -> pa.RecordBatch:
    """Words and spans of some texts as the columns of _SPANS."""
    n_words = pa.array([len(ws) for ws, _ in rows], pa.int64())
    spans = pa.array([[{"start": a, "end": b} for a, b in found] for _, found in rows], pa.list_(_SPAN))
    kept = pa.array([_without(ws, found).decode() for ws, found in rows], pa.string())
    return pa.RecordBatch.from_arrays([id_column, n_words, spans, kept], names=[name, "n_words", "spans", "kept"])


def repeat_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document its words, the maximal spans of them to remove (end exclusive), and what is kept, joined by spaces."""
    found = repeats(docs, id_col, text_col, window)
    joined = _row(docs, id_col, text_col).join(found, ["doc", "row"], "left").select("doc", "text", "windows")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            starts = sorted({w["place"] + j for w in found or () for j, first in enumerate(w["firsts"]) if first < doc})
            rows.append((words(text.as_py()), covered(starts, window)))
        return _spans_of(batch.column(0), "doc", rows)

    made = map_batches(joined, make, f"doc bigint, {_SPANS}")
    return made.select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "spans", "kept")


def reference_spans(
    docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """As repeat_spans, for runs of words that occur in another, small corpus; one shard of it is broadcast at a time.

    The reference is read shard by shard, and the documents once a shard.
    """
    spark, parts = docs.sparkSession, []
    id_type = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.xxhash64("id", "text"))

    def search(shard: list[list[bytes]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = SuffixAutomaton()
            for passage in shared.value:
                automaton.add(passage, 0)
            for batch in batches:
                out = []
                for text in batch.column(1):
                    ends = (at for at, (_, n) in enumerate(automaton.statistics(words(text.as_py()))) if n >= window)
                    out.append([at - window + 1 for at in ends])
                starts = pa.array(out, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), starts], names=["id", "row", "starts"])

        return plain.select("id", "text", "row").mapInArrow(run, f"id {id_type}, row bigint, starts array<int>")

    shard: list[list[bytes]] = []
    for r in reference.select(F.col(text_col).cast("string").alias("text")).toLocalIterator():
        ws = words(r["text"])
        # A text that is longer than a shard goes on in the next one, where a window can still begin in it.
        for i in range(0, max(1, len(ws) - window + 1), SHARD_WORDS):
            shard.append(ws[i : i + SHARD_WORDS + window - 1])
            if sum(map(len, shard)) >= SHARD_WORDS:
                parts.append(stored(search(shard), "reference"))
                shard = []
    if shard or not parts:
        parts.append(stored(search(shard), "reference"))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    found = found.where(F.size("starts") > 0).groupBy("row").agg(F.array_distinct(F.flatten(F.collect_set("starts"))).alias("starts"))
    joined = plain.join(found, "row", "left").select("id", "text", "starts")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = zip(batch.column(1), batch.column(2).to_pylist())
        return _spans_of(batch.column(0), "id", [(words(t.as_py()), covered(sorted(x or ()), window)) for t, x in pairs])

    return map_batches(joined, make, f"id {id_type}, {_SPANS}").withColumnRenamed("id", id_col)


def repeat_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document its words, how many are removed, and the digest of the rest."""
    found = repeat_spans(docs, window=window)
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.cast("bigint").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def oracle_sql(window: int = WINDOW) -> str:
    """The report on repeated passages in the SQL of DuckDB."""
    return rf"""
    with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
    places as (select doc_id, ws, unnest(range(1, len(ws) - {window} + 2)) as k from d where len(ws) >= {window}),
    windows as (select doc_id, k, array_to_string(ws[k:k + {window} - 1], ' ') as w from places),
    firsts as (select w, min(doc_id) as first from windows group by w),
    gone as (
      select distinct doc_id, unnest(range(k, k + {window})) as pos
      from windows join firsts using (w) where first < doc_id),
    each as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as pos from d),
    kept as (
      select e.doc_id, count(g.pos) as n_removed,
             string_agg(case when g.pos is null then word end, ' ' order by e.pos) as rest
      from each e left join gone g on e.doc_id = g.doc_id and e.pos = g.pos group by e.doc_id)
    select d.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
           sha256(coalesce(rest, '')) as kept_sha256
    from d left join kept using (doc_id)"""
