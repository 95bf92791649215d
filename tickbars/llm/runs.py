"""Periodic runs in the words of documents, found in their Re-Pair grammar.

A run is a stretch of words whose smallest period q holds from its first word to its last (words q apart are identical),
which has at least 24 words and at least three periods, and which no neighbouring word extends keeping the period.

1. Re-Pair: the most frequent pair of neighbouring symbols becomes a new nonterminal, until no pair occurs twice. Of
   pairs equally frequent the one with the shorter expansion goes first, which keeps the grammar flat. The places where
   a rule is applied are the positions of its nonterminal in the derivation.
2. A run lies within the expansion of one lowest node of the derivation, a nonterminal or the start sequence, and crosses
   the boundary between two of its children. So each nonterminal is looked at once, in one of its expansions: which
   stretches cross its boundary? The start sequence has a boundary between any two neighbours.
3. What a nonterminal was found to hold is carried to all its positions. What the ends of an expansion have cut short is
   part of a longer stretch of that period; stretches that share a whole period are merged, and the maximal ones stay.

At a boundary half of the run, 12 words and one and a half periods at least, lies on one side. There at least four words,
and half a period, are repeated one period on. A period is therefore looked for among the distances to equal stretches
of 4, 8, 16... words, the longer ones for periods in proportion only, of which there are few. How far a period holds is
found in the ranks of those stretches by halving. Time and memory grow with n times the logarithm of the longest
repeated stretch.

Defined cases: null or empty text has no words, hence no runs and the digest of nothing; a null document number counts
as the text `null` where a number is hashed. Every row is judged on its own, repeated rows alike. Columns other than
the number and the text are neither read nor returned.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 24
MIN_PERIODS = 3
# Shortest stretch that is certainly repeated at a boundary, as a power of two: see above.
_LEVEL = 2
# Start, end (exclusive), period.
Run = tuple[int, int, int]


class Grammar:
    """Re-Pair of a sequence of small whole numbers.

    Rule r makes nonterminal `terminals + r` of the pair `pairs[r]`; it covers `sizes[r]` words, `lefts[r]` of them by its
    first child, at each of `places[r]`. `root` has the starts of the symbols of the start sequence.
    """

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.terminals = int(ids.max()) + 1 if self.n else 0
        self.pairs: list[tuple[int, int]] = []
        self.sizes: list[int] = []
        self.lefts: list[int] = []
        self.places: list[list[int]] = []
        self._symbols: list[int] = []
        self.root = np.arange(self.n)
        where = self._repeated(ids)
        if where:
            self._replace(ids, where)

    def _repeated(self, ids: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """Positions of the pairs that occur twice at least."""
        if self.n < 4:
            return {}
        codes = ids[:-1].astype(np.int64) * self.terminals + ids[1:]
        order = np.argsort(codes, kind="stable")
        ranked = codes[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            return {}
        at = np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))
        cuts = np.flatnonzero(np.diff(ranked[at])) + 1
        heads = ranked[at[np.concatenate(([0], cuts))]].tolist()
        groups = [g.tolist() for g in np.split(order[at], cuts)]
        return {divmod(code, self.terminals): group for code, group in zip(heads, groups)}

    def _size(self, symbol: int) -> int:
        return 1 if symbol < self.terminals else self.sizes[symbol - self.terminals]

    def _replace(self, ids: np.ndarray, where: dict[tuple[int, int], list[int]]) -> None:
        n, size = self.n, self._size
        symbols = ids.tolist()
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        counts = {pair: len(at) for pair, at in where.items()}
        queue = [(-c, size(a) + size(b), (a, b)) for (a, b), c in counts.items()]
        heapq.heapify(queue)
        while queue:
            negative, width, pair = heapq.heappop(queue)
            count = counts.get(pair, 0)
            if count < 2:
                continue
            if count != -negative:  # neighbours have been replaced meanwhile
                heapq.heappush(queue, (-count, width, pair))
                continue
            a, b = pair
            there = [i for i in where[pair] if symbols[i] == a and (j := after[i]) < n and symbols[j] == b]
            live = there
            if a == b:
                live, last = [], -1
                for i in there:
                    if i != last:  # not overlapping the one before
                        live.append(i)
                        last = after[i]
            if len(live) < count:
                # Of a symbol beside itself: overlapping places were counted, and lost ones were not taken off.
                counts[pair], where[pair] = len(live), there
                heapq.heappush(queue, (-len(live), width, pair))
                continue
            new = self.terminals + len(self.pairs)
            self.pairs.append(pair)
            self.sizes.append(width)
            self.lefts.append(size(a))
            self.places.append(live)
            counts[pair] = 0
            del where[pair]
            fresh: dict[tuple[int, int], None] = {}
            for i in live:
                j = after[i]
                k, h = after[j], before[i]
                if h >= 0 and symbols[h] != a and (old := (symbols[h], a)) in counts:
                    counts[old] -= 1
                if k < n:
                    if symbols[k] != b and (old := (b, symbols[k])) in counts:
                        counts[old] -= 1
                    before[k] = i
                symbols[i], symbols[j], after[i] = new, -1, k
            for i in live:
                h, k = before[i], after[i]
                if h >= 0 and symbols[h] != new:
                    made = (symbols[h], new)
                    where.setdefault(made, []).append(h)
                    fresh[made] = None
                if k < n:
                    made = (new, symbols[k])
                    where.setdefault(made, []).append(i)
                    fresh[made] = None
            for made in fresh:
                counts[made] = c = len(where[made])
                if c > 1:
                    heapq.heappush(queue, (-c, size(made[0]) + size(made[1]), made))
        self._symbols = symbols
        self.root = np.flatnonzero(np.array(symbols) >= 0)

    def expand(self) -> list[int]:
        """The sequence that the grammar stands for."""
        out, stack = [], [self._symbols[i] for i in reversed(self.root.tolist())]
        while stack:
            s = stack.pop()
            if s < self.terminals:
                out.append(s)
            else:
                stack += reversed(self.pairs[s - self.terminals])
        return out


class _Stretches:
    """Equal stretches of 4, 8, 16... words, and how far two places of the sequence agree."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.ranks = [ids.astype(np.int64)]
        self.orders: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        while 2 << (len(self.ranks) - 1) <= self.n:
            ranks, half = self.ranks[-1], 1 << (len(self.ranks) - 1)
            codes = ranks[:-half] * (int(ranks.max()) + 1) + ranks[half:]
            order = np.argsort(codes, kind="stable")
            ranked = codes[order]
            starts = np.concatenate(([False], ranked[1:] != ranked[:-1]))
            if starts.sum() == len(codes) - 1:
                break  # none is repeated
            dense = np.empty(len(codes), np.int64)
            dense[order] = np.cumsum(starts)
            self.ranks.append(dense)
            if len(self.ranks) > _LEVEL:
                self.orders.append(order)
                place = np.empty(len(codes), np.int64)
                place[order] = np.arange(len(codes))
                self.places.append(place)

    def distances(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each place of the shortest stretch, the distances to the next and to the previous equal one; n if none."""
        ahead, back = np.full(self.n, self.n), np.full(self.n, self.n)
        if self.orders:
            order, ranks = self.orders[0], self.ranks[_LEVEL]
            one, two = order[:-1], order[1:]
            same = ranks[one] == ranks[two]
            one, two = one[same], two[same]
            ahead[one] = back[two] = two - one
        return ahead, back

    def forward(self, i: int, j: int, most: int) -> int:
        """Number of equal words from places i and j on, `most` at most."""
        out = 0
        for level in range(len(self.ranks) - 1, -1, -1):
            size, ranks = 1 << level, self.ranks[level]
            # Twice at the highest level and more often, where stretches of the next size are not ranked.
            while out + size <= most and ranks[i + out] == ranks[j + out]:
                out += size
        return out

    def backward(self, i: int, j: int, most: int) -> int:
        """Number of equal words before places i and j, `most` at most."""
        out = 0
        for level in range(len(self.ranks) - 1, -1, -1):
            size, ranks = 1 << level, self.ranks[level]
            while out + size <= most and ranks[i - out - size] == ranks[j - out - size]:
                out += size
        return out

    def stretch(self, i: int, period: int, low: int, high: int) -> Run:
        """The stretch of [low, high) around places i and i + period in which the period holds."""
        start = i - self.backward(i, i + period, i - low)
        return start, i + period + self.forward(i, i + period, high - i - period), period

    def around(self, m: int, low: int, high: int) -> list[Run]:
        """Runs of [low, high) that cross the boundary before m."""
        # By side as well: two stretches of one period can overlap at m by less than the period.
        found: dict[tuple[int, bool], Run] = {}
        for ahead in (True, False):
            for level, (order, place) in enumerate(zip(self.orders, self.places), _LEVEL):
                size, ranks = 1 << level, self.ranks[level]
                at = m if ahead else m - size
                if not low <= at <= high - size:
                    break
                # Half of the run is one and a half periods at least.
                room = (2 * (high - m) if ahead else 2 * (m - low)) // MIN_PERIODS
                least, most = (1, min(4 * size - 1, room)) if level == _LEVEL else (2 * size, min(4 * size - 1, room))
                if most < least:
                    break
                rank, step = ranks[at], 1 if ahead else -1
                p = int(place[at]) + step
                while 0 <= p < len(order) and ranks[other := int(order[p])] == rank:
                    q = abs(other - at)
                    if q > most:
                        break
                    if q >= least and (q, ahead) not in found:
                        run = self.stretch(min(at, other), q, low, high)
                        found[q, ahead] = run
                        # Within a stretch of a short period equal places follow each other by that period, and none of
                        # the distances among them is the smallest period of another run: go on behind it.
                        if 2 * q <= size and run[1] - run[0] >= MIN_PERIODS * q:
                            past = run[1] - size if ahead else run[0]
                            p = self._beyond(order, ranks, p, rank, past, ahead)
                            continue
                    p += step
        runs = [r for r in set(found.values()) if r[0] < m < r[1] and r[1] - r[0] >= max(MIN_WORDS, MIN_PERIODS * r[2])]
        return _of_smallest_period(runs)

    @staticmethod
    def _beyond(order: np.ndarray, ranks: np.ndarray, p: int, rank: int, past: int, ahead: bool) -> int:
        """First index after p, in this direction, whose place is past the given one."""
        step, jump = (1 if ahead else -1), 1
        best = p
        # Doubling, then halving.
        inside = lambda x: 0 <= x < len(order) and ranks[order[x]] == rank and (order[x] <= past if ahead else order[x] >= past)
        while inside(best + step * jump):
            best += step * jump
            jump *= 2
        while jump:
            if inside(best + step * jump):
                best += step * jump
            jump //= 2
        return best + step


def _of_smallest_period(runs: list[Run]) -> list[Run]:
    """Leaves out stretches that lie in one of a smaller period: their period is not the smallest."""
    kept: list[Run] = []
    for run in sorted(runs, key=lambda r: r[2]):
        if not any(r[2] < run[2] and r[0] <= run[0] and run[1] <= r[1] for r in kept):
            kept.append(run)
    return kept


def _merged(found: list[np.ndarray]) -> list[Run]:
    """Stretches, as rows of start, end and period, with those of one period that share a whole period put together."""
    if not found:
        return []
    rows = np.unique(np.concatenate(found), axis=0)
    rows = rows[np.lexsort((-rows[:, 1], rows[:, 0], rows[:, 2]))]
    out: list[list[int]] = []
    for start, end, period in rows.tolist():
        if out and out[-1][2] == period and start <= out[-1][1] - period:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, period])
    return sorted((s, e, q) for s, e, q in out)


def find_runs(words: Sequence, grammar: Grammar | None = None) -> list[Run]:
    """All runs of a sequence, as (start, end, period) by start, then period."""
    if len(words) < MIN_WORDS:
        return []
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    grammar = grammar or Grammar(ids)
    if not grammar.pairs:
        return []  # no pair of neighbours occurs twice, as it does in every run
    rules = len(grammar.pairs)
    firsts = np.fromiter((at[0] for at in grammar.places), np.int64, rules)
    sizes = np.array(grammar.sizes, np.int64)
    inner = grammar.root[1:]
    low = np.concatenate((firsts, np.zeros(len(inner), np.int64)))
    high = np.concatenate((firsts + sizes, np.full(len(inner), grammar.n)))
    middle = np.concatenate((firsts + np.array(grammar.lefts, np.int64), inner))
    # A quick look at all boundaries: expansions long enough, and an equal stretch near enough on either side.
    worth = np.flatnonzero(high - low >= MIN_WORDS)
    low, high, middle = low[worth], high[worth], middle[worth]
    stretches = _Stretches(ids)
    ahead, back = stretches.distances()
    shortest = 1 << _LEVEL
    right = MIN_PERIODS * ahead[np.minimum(middle, grammar.n - 1)] <= 2 * (high - middle)
    left = MIN_PERIODS * back[np.maximum(middle - shortest, 0)] <= 2 * (middle - low)
    left &= middle >= shortest
    found = []
    for x in np.flatnonzero(left | right).tolist():
        start, rule = int(low[x]), int(worth[x])
        runs = stretches.around(int(middle[x]), start, int(high[x]))
        if not runs:
            continue
        rows = np.array(runs, np.int64)
        if rule < rules:
            shifts = np.array(grammar.places[rule], np.int64) - start
            rows = (rows[None, :, :] + np.stack((shifts, shifts, np.zeros_like(shifts)), 1)[:, None, :]).reshape(-1, 3)
        found.append(rows)
    return _merged(found)


def with_planted_run(words: list, number: object) -> list:
    """The words, of which those of every tenth document number (by its CRC-32) repeat from some place on."""
    h = zlib.crc32(("null" if number is None else str(number)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * (-(-(n - a) // len(cycle))))[: n - a]


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, end, period in runs:
        edges[start + period] += 1
        edges[end] -= 1
    keep = np.cumsum(edges[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _strongest(runs: list[Run]) -> Run:
    """The run of the greatest length per period; of equal ones the first, then that of the smaller period."""
    best = runs[0]
    for run in runs[1:]:  # in the order of start and period already
        if (run[1] - run[0]) * best[2] > (best[1] - best[0]) * run[2]:
            best = run
    return best


_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """Runs of every document and its text without them.

    One row per row: the id, `runs` (by start, then period), `strongest` (index of the run of the greatest exponent, or
    null), `collapsed`, the kept words joined by one space. A pass over the rows, without a shuffle. `planted` repeats words in every tenth document first
    (see `with_planted_run`). For nulls and the like see the head of this module.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_pylist() if planted else [None] * batch.num_rows
            runs, best, texts = [], [], []
            for number, text in zip(numbers, batch.column(1)):
                words = (text.as_py() or b"").split()
                if planted:
                    words = with_planted_run(words, number)
                found = find_runs(words)
                runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in found])
                best.append(found.index(_strongest(found)) if found else None)
                texts.append(b" ".join(collapsed(words, found)))
            arrays = [batch.column(0), pa.array(runs, run_type), pa.array(best, pa.int32()), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "runs", "strongest", "collapsed"])

    plain = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"))
    out = plain.mapInArrow(run, f"`{id_col}` {id_type}, runs {_RUNS}, strongest int, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def run_report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the runs of every document, after every tenth was given a run."""
    found = periodic_runs(docs.select("doc_id", "text"), planted=True)
    best = F.get("runs", F.col("strongest"))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    lines = F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("(1000 * get(runs, strongest).length) div get(runs, strongest).period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
