"""Benchmark decontamination by a positional inverted index that is split by documents.

`build_index` writes the postings of every token of every text. Documents are gathered into segments of bounded size;
a segment is one row with its sorted terms and, term by term, the positions at which they occur. Segments are made
and searched where they lie, so neither postings nor texts are shuffled.

`phrase_matches` takes the test items in blocks of bounded size. In each segment, the list of a phrase's rarest term
gives the candidates, shifted by its offset; they are intersected with the shifted lists of the other terms, from
rare to frequent. `proximity_matches` finds all terms of an item within a number of words.

Defined cases: a null or empty text has no words and no hits; an item without words matches nothing; repeated items
count once by item_id, and hits of an item with a null id count as hits of no item. Every row of the documents gives a
row, repeated ids and null ids too. Phrases never run from one document into the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars.llm.tools import free_name, map_batches, stored

WINDOW = 10
# Bytes of text in a segment; a longer document is a segment of its own.
SEGMENT_BYTES = 2 << 20
# Bytes of test items that are sent to the executors at once.
BLOCK_BYTES = 4 << 20

# Letters and digits of ASCII and all bytes of other characters stay; capitals become small, the rest separates.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Runs of letters and digits in UTF-8, A-Z in lower case."""
    return text.encode().translate(_FOLD).split() if text else []


INDEX = "segment string, doc_ids array<string>, n_words array<int>, terms array<binary>, term_ends array<int>, steps binary"


def _segment(ids: list[str | None], texts: list[list[bytes]]) -> dict:
    """Postings of some documents; a free position lies between two of them."""
    number: dict[bytes, int] = {}
    total = sum(map(len, texts))
    term, place, at, done = np.empty(total, np.int32), np.empty(total, np.int32), 0, 0
    for ws in texts:
        n = len(ws)
        term[done : done + n] = [number.setdefault(w, len(number)) for w in ws]
        place[done : done + n] = np.arange(at, at + n)
        done, at = done + n, at + n + 1
    order = np.argsort(term, kind="stable")
    return {
        "segment": uuid.uuid4().hex,
        "doc_ids": ids,
        "n_words": [len(ws) for ws in texts],
        "terms": list(number),
        "term_ends": np.cumsum(np.bincount(term, minlength=len(number))).astype(np.int32) if total else [],
        "steps": np.diff(place[order], prepend=np.int32(0)).astype("<i4").tobytes(),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all tokens, one row a segment, written to the shared folder."""
    schema = pa.schema(
        [
            ("segment", pa.string()),
            ("doc_ids", pa.list_(pa.string())),
            ("n_words", pa.list_(pa.int32())),
            ("terms", pa.list_(pa.binary())),
            ("term_ends", pa.list_(pa.int32())),
            ("steps", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[str | None] = []
        texts: list[list[bytes]] = []
        size = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py() or ""
                if size and size + len(text) > SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist([_segment(ids, texts)], schema)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(words(text))
                size += len(text)
        if ids:
            yield pa.RecordBatch.from_pylist([_segment(ids, texts)], schema)

    plain = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(plain.mapInArrow(run, INDEX), "postings")


class Postings:
    """A segment read back: for the asked terms the sorted pairs of term number and position."""

    def __init__(self, row: dict, asked: dict[bytes, int]):
        self.n_words = np.array(row["n_words"], np.int64)
        self.starts = np.cumsum(np.append(0, self.n_words[:-1] + 1)) if len(self.n_words) else np.empty(0, np.int64)
        places = np.cumsum(np.frombuffer(row["steps"], "<i4"), dtype=np.int64)
        ends = np.array(row["term_ends"], np.int64)
        begins = np.append(0, ends[:-1]) if len(ends) else ends
        found = [(q, i) for i, t in enumerate(row["terms"]) if (q := asked.get(t)) is not None]
        found.sort()
        self.counts = np.zeros(len(asked), np.int64)
        self.first = np.zeros(len(asked), np.int64)
        lists, done = [], 0
        for q, i in found:
            mine = places[begins[i] : ends[i]]
            self.counts[q], self.first[q] = len(mine), done
            lists.append(mine + (q << 32))
            done += len(mine)
        self.pairs = np.concatenate(lists) if lists else np.empty(0, np.int64)

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which of the terms occur at which of the places."""
        want = (terms << 32) + places
        at = np.searchsorted(self.pairs, want)
        return (at < len(self.pairs)) & (self.pairs[np.minimum(at, len(self.pairs) - 1)] == want)

    def candidates(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each term: which of the terms, and the place."""
        n = self.counts[terms]
        which = np.repeat(np.arange(len(terms)), n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return which, self.pairs[self.first[terms][which] + inside] & 0xFFFFFFFF

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1

    def phrases(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of `grid`, phrases of the same length, that occur, and where they start."""
        none = np.empty(0, np.int64)
        alive = np.flatnonzero(self.counts[grid].min(axis=1) > 0) if len(grid) else none
        if not len(alive):
            return none, none
        rarity = np.argsort(self.counts[grid[alive]], axis=1, kind="stable")
        which, place = self.candidates(grid[alive, rarity[:, 0]])
        start = place - rarity[which, 0]
        keep = start >= 0
        which, start = which[keep], start[keep]
        for step in range(1, grid.shape[1]):
            if not len(which):
                break
            offset = rarity[which, step]
            keep = self.has(grid[alive[which], offset], start + offset)
            which, start = which[keep], start[keep]
        return alive[which], start


class Block(NamedTuple):
    """Some test items: the numbers of their terms, and phrases by length with the items that have them."""

    asked: dict[bytes, int]
    phrases: dict[int, tuple[np.ndarray, list[list[str | None]]]]


def phrase_block(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Block:
    """Every run of `window` words of each item; an item of fewer words is one phrase."""
    asked: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str | None]] = {}
    for item, text in items:
        terms = [asked.setdefault(w, len(asked)) for w in words(text)]
        for i in range(max(1, len(terms) - window + 1) if terms else 0):
            owners.setdefault(tuple(terms[i : i + window]), set()).add(item)
    by_length: dict[int, list[tuple[int, ...]]] = {}
    for phrase in owners:
        by_length.setdefault(len(phrase), []).append(phrase)
    return Block(asked, {n: (np.array(p, np.int64), [list(owners[x]) for x in p]) for n, p in by_length.items()})


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple]]:
    """The items in lists of at most BLOCK_BYTES of text, or one item."""
    out: list[tuple[str | None, str | None]] = []
    size = 0
    plain = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    for row in plain.toLocalIterator():
        more = len(row["text"] or "")
        if out and size + more > BLOCK_BYTES:
            yield out
            out, size = [], 0
        out.append((row["id"], row["text"]))
        size += more
    if out:
        yield out


MATCHES = (
    "segment string, place int, doc_id string, n_words int, "
    "hits array<struct<start:int,end:int>>, item_ids array<string>"
)
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_MATCHES = pa.schema(
    [
        ("segment", pa.string()),
        ("place", pa.int32()),
        ("doc_id", pa.string()),
        ("n_words", pa.int32()),
        ("hits", _HITS),
        ("item_ids", pa.list_(pa.string())),
    ]
)
_Found = list[tuple[int, int, int, list]]


def _merged(ranges: list[tuple[int, int]]) -> list[dict]:
    """The same words in as few ranges as can be."""
    out: list[dict] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def _search(index: DataFrame, find: Callable[[dict], _Found], docs_without: bool) -> DataFrame:
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in batch.to_pylist():
            hits: dict[int, list[tuple[int, int]]] = {}
            owners: dict[int, set] = {}
            for doc, start, end, items in find(row):
                hits.setdefault(doc, []).append((start, end))
                owners.setdefault(doc, set()).update(items)
            for i, (doc_id, n) in enumerate(zip(row["doc_ids"], row["n_words"])):
                if docs_without or i in hits:
                    named = sorted(x for x in owners.get(i, ()) if x is not None)
                    mine = {"segment": row["segment"], "place": i, "doc_id": doc_id, "n_words": n}
                    out.append({**mine, "hits": _merged(hits.get(i, [])), "item_ids": named})
        return pa.RecordBatch.from_pylist(out, _MATCHES)

    return map_batches(index, make, MATCHES)


def _find_phrases(block: Block) -> Callable[[dict], _Found]:
    def find(row: dict) -> _Found:
        postings = Postings(row, block.asked)
        out: _Found = []
        for n, (grid, owners) in block.phrases.items():
            which, start = postings.phrases(grid)
            doc = postings.doc_of(start)
            begin = start - postings.starts[doc] if len(doc) else start
            out += [(d, b, b + n, owners[w]) for w, d, b in zip(which.tolist(), doc.tolist(), begin.tolist())]
        return out

    return find


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW, docs_without: bool = True) -> DataFrame:
    """Per document and block of items the hit word ranges of exact phrases and the items that they belong to."""
    spark, out = index.sparkSession, None
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(phrase_block(block, window))
        part = _search(index, _lazily(shared, _find_phrases), docs_without and out is None)
        out = part if out is None else out.unionByName(part)
    return _search(index, lambda row: [], docs_without) if out is None else out


def _lazily(shared, maker: Callable) -> Callable[[dict], _Found]:
    """Reads the broadcast where the task runs."""
    return lambda row: maker(shared.value)(row)


def proximity_matches(index: DataFrame, items: DataFrame, within: int) -> DataFrame:
    """Documents in which all terms of an item lie within so many words; a hit is the shortest range for each last word."""

    def finder(block: list[tuple[list[int], str | None]], asked: dict[bytes, int]) -> Callable[[dict], _Found]:
        def find(row: dict) -> _Found:
            postings = Postings(row, asked)
            out: _Found = []
            for terms, item in block:
                need = np.unique(terms)
                which, place = postings.candidates(need)
                if not len(need) or len(np.unique(which)) < len(need):
                    continue
                order = np.argsort(place, kind="stable")
                last: dict[int, int] = {}
                for w, p in zip(which[order].tolist(), place[order].tolist()):
                    last[w] = p
                    low = min(last.values())
                    if len(last) == len(need) and p - low < within:
                        a, b = postings.doc_of(np.array([low, p]))
                        if a == b:
                            begin = int(postings.starts[a])
                            out.append((int(a), low - begin, p + 1 - begin, [item]))
            return out

        return find

    out = None
    for rows in item_blocks(items):
        asked: dict[bytes, int] = {}
        block = [([asked.setdefault(w, len(asked)) for w in words(text)], item) for item, text in rows]
        part = _search(index, finder(block, asked), False)
        out = part if out is None else out.unionByName(part)
    return _search(index, lambda row: [], False) if out is None else out


def joined_matches(matches: DataFrame) -> DataFrame:
    """One row a document: the matches of all blocks together, with the number of words that lie in a hit."""
    whole = matches.groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
    )
    # The sorted ranges in turn: the end so far, and the words covered.
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc, hit):
        fresh = F.greatest(hit["start"], acc["end"])
        more = F.greatest(hit["end"] - fresh, F.lit(0))
        return F.struct(F.greatest(acc["end"], hit["end"]).alias("end"), (acc["n"] + more).alias("n"))

    covered = F.aggregate(F.array_sort("hits"), start, add, lambda acc: acc["n"])
    return whole.select("doc_id", "n_words", "hits", "item_ids", covered.cast("bigint").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words inside an occurring window of an item, and the items with such windows."""
    found = joined_matches(phrase_matches(build_index(docs), items, window))
    return found.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        F.col("n_words").cast("bigint").alias("n_words"),
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns."""
    key = free_name(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col))
    matches = phrase_matches(build_index(keyed, key, text_col), items, window, docs_without=False)
    hit = stored(matches.select(F.col("doc_id").cast("bigint").alias(key)).distinct(), "hit")
    return keyed.join(hit, key, "left_anti").drop(key)


def oracle_sql(window: int = WINDOW) -> str:
    """The contamination of documents by benchmark in the SQL of DuckDB."""
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def split(text: str) -> str:
        folded = f"translate(coalesce({text}, ''), '{capitals}', '{small}')"
        return rf"regexp_extract_all({folded}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    return f"""
    with d as (select doc_id, {split("text")} as ws from documents),
    i as (select item_id, {split("text")} as ws from benchmark),
    starts as (select item_id, ws, unnest(range(1, greatest(len(ws) - {window} + 1, 1) + 1)) as k from i where len(ws) > 0),
    phrases as (select distinct item_id, len(ws[k:k + {window} - 1]) as n, array_to_string(ws[k:k + {window} - 1], ' ') as w from starts),
    sizes as (select distinct n from phrases),
    places as (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as k from d, sizes where len(ws) >= n),
    hits as (
      select distinct a.doc_id, a.k, a.n, p.item_id
      from (select doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') as w from places) a join phrases p on a.n = p.n and a.w = p.w),
    covered as (
      select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + n)) as pos from hits) group by doc_id),
    named as (
      select doc_id, count(distinct item_id) as n_items,
             string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
      from hits group by doc_id)
    select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
           sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join covered using (doc_id) left join named using (doc_id)"""
