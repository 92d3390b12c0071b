"""Clusters of bounded size at least cost: an auction between items and codes, and k-means on top of it.

Every code has a price, an item's loss at a code is its squared distance plus the price. Unplaced items bid for the code of
least loss, up to where their second best becomes as good, plus a step. A code keeps its highest bids up to its size and lets
the others go; its price is then the lowest bid it holds. When everybody is placed, nobody could do better by more than a step,
so the total is within one step per item of the least possible one for the sizes. Bids are integers, ties go by a hash of the
item: the result does not depend on the layout.

Rounds move narrow rows only: an item's best codes, listed once, and the bids held. The lowest bid a code keeps is found by
narrowing histograms, of all codes at once, not by sorting its bids. Once only a few items are left, the rounds are played on the
driver with a bounded number of each code's lowest bids, as such ends take many short rounds; they are the rounds Spark would play.
"""

from __future__ import annotations

import bisect
import collections
import heapq

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.quantize import codebook_frame, mean_vectors
from seqloom.operators.ranking import DRIVER_ROWS, HISTOGRAM_BUCKETS, portable_hash
from seqloom.operators.sampling import sample_rows
from seqloom.operators.tiles import Book, Part, book_of, minus_centroid, nearest, over_parts, row_tiles, squared_distances
from seqloom.session import collect_arrow, collect_small, discard, materialize, stored, stored_counted

LISTED_CODES = 32
GAP = 0.005  # how far the total may lie above the least possible one
STEP_UNITS, BID_BITS = 16, 40
WIDE_STEP, SHRINK = 0.1, 5
TAIL_ITEMS, TAIL_DEPTH, TAIL_BIDS = 2000, 64, 200_000
KNOWN_BIDS = 32_768  # bids fetched for the end of an auction, over all codes
HASH_BITS, HISTOGRAM_CELLS = 60, 1 << 20
STARTS, ROUNDS = 3, 100
WARM, COLD, COOLING, SETTLE = 0.1, 0.005, 0.7, 10  # temperatures of the fit as shares of the mean squared distance, rounds at the last one
FAR = 1 << 60
TOO_HIGH = "bids beyond the range of the integers they are kept in"


def size_bounds(n: int, k: int) -> tuple[int, int]:
    """Least and largest size of a cluster."""
    return max(1, n // k - 1), n // k + 1


def chosen_sizes(price: np.ndarray, n: int, lower: int, upper: int) -> np.ndarray:
    """Sizes within the bounds that add up to `n`: the dearer a code, the more it is worth to have room there."""
    if not lower * len(price) <= n <= upper * len(price):
        raise ValueError(f"{n} items do not fit {len(price)} codes of {lower} to {upper}")
    sizes = np.full(len(price), lower, np.int64)
    room = np.full(len(price), upper - lower, np.int64)
    order = np.argsort(-price, kind="stable")
    left = n - lower * len(price)
    sizes[order] += np.clip(left - (np.cumsum(room[order]) - room[order]), 0, room[order])
    return sizes


def auction(
    vectors: DataFrame, centroids: np.ndarray | Book, lower: int, upper: int, prices: np.ndarray | None = None, seed: int = 42,
    listed: int = LISTED_CODES, gap: float = GAP, tail: int = TAIL_ITEMS,
) -> tuple[DataFrame, np.ndarray]:
    """(assignment (item_id, code), final prices) with between `lower` and `upper` items per code.

    The total squared distance is within the share `gap` of the least possible one for the sizes chosen: the step starts wide
    and shrinks, with the prices kept, until a step per item is less than that share of the total. Prices tell what room is worth,
    so the sizes follow them from step to step, and at the last one until that does not lower the total any more. `prices`
    (squared distances) start the auction; good ones save rounds.
    """
    spark = vectors.sparkSession
    book = book_of(spark, centroids)
    prices = np.zeros(book.size) if prices is None else prices - prices.min()
    hashed = vectors.select("item_id", "vec", portable_hash("item_id", seed=seed).alias("h"))
    near = nearest(vectors, book).agg(F.avg(F.greatest("distance", F.lit(0.0)))).first()[0] or 0.0
    unit = max(float(near) * gap, 1e-12) / STEP_UNITS
    price = np.floor(prices / unit).astype(np.int64)
    prefs, prefs_path = stored(_listed(hashed, book, price, unit, listed), "prefs")
    # how far the listed codes lie apart, on the mean: where the step starts
    spread = (F.element_at("entries", -1)["loss"] - F.get("entries", F.lit(0))["loss"]).cast("double")
    n, apart, *_ = prefs.agg(F.count(F.lit(1)), F.avg(spread)).first()
    demand = np.zeros(book.size, np.int64)
    for r in collect_small(prefs.groupBy(F.get("entries", F.lit(0))["code"].alias("code")).count(), book.size, "codes"):
        demand[r["code"]] = r["count"]
    sizes = chosen_sizes(demand, n, lower, upper)
    step = max(STEP_UNITS, int((apart or 0.0) * WIDE_STEP))
    best, tried = None, set()
    while True:
        held, path, prefs, prefs_path, listed = _placed(hashed, book, price, unit, listed, prefs, prefs_path, sizes, n, step, tail)
        cost = F.get(F.filter("entries", lambda e: e["code"] == F.col("code")), F.lit(0))["cost"]
        total = held.join(prefs.select("item_id", "entries"), "item_id").agg(F.sum(cost.cast("double"))).first()[0] or 0.0
        improved = best is None or total < best[0]
        if best is not None:
            discard(spark, best[2] if improved else path)
        if improved:
            best = (total, held, path)
        renewed = chosen_sizes(price, n, lower, upper)
        if step == STEP_UNITS or n * step <= gap * max(total - n * step, 0):
            tried.add(tuple(sizes))
            if not improved or tuple(renewed) in tried:
                discard(spark, prefs_path)
                return best[1].select("item_id", "code"), price * unit
        else:
            step = max(STEP_UNITS, step // SHRINK)
        sizes = renewed


def _placed(hashed, book: Book, price: np.ndarray, unit: float, listed: int, prefs: DataFrame, prefs_path: str, sizes: np.ndarray, n: int,
            step: int, tail: int) -> tuple[DataFrame, str, DataFrame, str, int]:
    """Bidding from scratch at one step until everybody is placed; `price` is raised in place."""
    spark = hashed.sparkSession
    held, held_path = None, None
    while True:
        open_ = prefs if held is None else prefs.join(held.select("item_id"), "item_id", "left_anti")
        bids = _bids(open_, price, step)
        offers, offers_path = stored(bids if held is None else held.unionByName(bids), "offers")
        seen = {r["code"]: (r["n"], r["least"], r["most"]) for r in collect_small(
            offers.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("bid").alias("least"), F.max("bid").alias("most")), book.size + 1, "codes")}
        stale = seen.pop(None, None)
        if any(least >= 1 << BID_BITS for _, least, _ in seen.values()):
            raise OverflowError(TOO_HIGH)
        placed = offers.filter(F.col("code").isNotNull())
        cuts, marks, counts = _cuts(placed, seen, sizes)
        for code, (count, least, _) in seen.items():
            if count > sizes[code]:
                price[code] = cuts[0, code]
            elif count == sizes[code]:
                price[code] = max(price[code], least)
        if held_path:
            discard(spark, held_path)
        held, held_path = stored(_beside(placed, cuts, "from"), "held")
        n_held = int(counts.sum())
        if stale:  # lists too short for these prices: twice as long ones for everybody, all codes at last
            listed = min(book.size, 2 * listed)
            (prefs, prefs_path), old = stored(_listed(hashed, book, price, unit, listed), "prefs"), prefs_path
            discard(spark, old)
        discard(spark, offers_path)
        if 0 < n - n_held <= tail:
            known, done = _End(prefs, held, marks, counts, sizes, tail).played(price, step, n)
            rest = _beside(held, marks, "above").unionByName(spark.createDataFrame(known))
            (held, held_path), old = stored(rest, "held"), held_path
            discard(spark, old)
            n_held = n if done else n_held
        if n_held == n:
            return held, held_path, prefs, prefs_path, listed


class _End:
    """The last rounds of an auction, played on the driver by the rules of the rounds before.

    Of every code the lowest bids are fetched, `known_bids` of them, and the few unplaced items. What a round decides depends on
    a code's lowest bids only, so it is the same as with all bids at hand, as long as the bids looked at are not above the
    highest one fetched, the code's mark. The game stops before the first round that would have to look further.
    """

    def __init__(self, prefs: DataFrame, held: DataFrame, marks: np.ndarray, counts: np.ndarray, sizes: np.ndarray, tail: int):
        bound = len(sizes) * known_bids(len(sizes))
        near = collect_arrow(_beside(held, marks, "to").select("code", "bid", "h", "item_id"), 2 * bound, "lowest bids of an auction")
        open_ = prefs.select("item_id").join(held.select("item_id"), "item_id", "left_anti")
        wanted = _beside(held, marks, "to").select("item_id").unionByName(open_).distinct()
        rows = collect_arrow(prefs.join(F.broadcast(wanted), "item_id"), 2 * bound + tail, "the tail of an auction")
        entries = rows.column("entries").combine_chunks().flatten()
        self.codes, self.cost = (entries.field(f).to_numpy().reshape(rows.num_rows, -1) for f in ("code", "cost"))
        items, self.beyond, self.h = (rows.column(c).to_pylist() for c in ("item_id", "beyond", "h"))
        self.row = {item: i for i, item in enumerate(items)}
        self.copies = collections.Counter(items)  # ids may repeat
        self.known: list[list[tuple]] = [[] for _ in sizes]
        for code, *bid in sorted(zip(*(near.column(c).to_pylist() for c in ("code", "bid", "h", "item_id")), strict=True)):
            self.known[code].append(tuple(bid))
        self.marks = [tuple(int(x) for x in m) for m in marks.T]
        self.counts, self.sizes = counts.astype(np.int64), sizes
        self.open = self.row.keys() - near.column("item_id").to_pylist()

    def played(self, price: np.ndarray, step: int, n: int):
        """(known bids in the end as an Arrow table, whether everybody is placed)."""
        import pyarrow as pa

        done = self._tail(price, step) == n
        while not done and self._round(price, step):
            n_held = int(self.counts.sum())
            done = n_held == n or not self.open or (n_held < n and self._tail(price, step) == n)
        rows = [(item, h, code, bid) for code, bids in enumerate(self.known) for bid, h, item in bids]
        types = (("item_id", pa.int64()), ("h", pa.int64()), ("code", pa.int32()), ("bid", pa.int64()))
        return pa.table({name: pa.array([r[i] for r in rows], t) for i, (name, t) in enumerate(types)}), done

    def _tail(self, price: np.ndarray, step: int) -> int:
        """Unplaced items bid one after the other, against the `TAIL_DEPTH` lowest bids of each code; returns how many are placed.

        A code whose lowest bids do not tell its lowest one any more takes no further bids here; whoever wants it waits for the
        next round.
        """
        heaps = [[bid for bid in bids[:TAIL_DEPTH + 1] for _ in range(self.copies[bid[2]])] for bids in self.known]
        counts = self.counts.tolist()
        limit = {}  # beyond this bid a code holds others that do not take part
        for code, heap in enumerate(heaps):
            if counts[code] > len(heap) or len(heap) > TAIL_DEPTH:
                limit[code] = heap[-1]
        queue = sorted(item for item in self.open for _ in range(self.copies[item] ** 2))
        moved: dict[int, tuple | None] = {}
        for _ in range(TAIL_BIDS):
            if not queue:
                break
            item = queue.pop()
            code, bid, stale = self._bid(item, price, step)
            moved[item] = None
            if stale or (code in limit and heaps[code][0] >= limit[code]):
                continue
            heapq.heappush(heaps[code], (bid, self.h[self.row[item]], item))
            moved[item] = code, bid
            counts[code] += 1
            if counts[code] > self.sizes[code]:
                out = heapq.heappop(heaps[code])[2]
                counts[code] -= 1
                moved[out] = None
                queue.append(out)
            if counts[code] == self.sizes[code]:
                price[code] = max(int(price[code]), heaps[code][0][0])
        moved |= dict.fromkeys(queue)
        for code, bids in enumerate(self.known):
            stay = [bid for bid in bids if bid[2] not in moved]
            self.counts[code] -= len(bids) - len(stay)
            self.known[code] = stay
        self._place((code_bid[0], (code_bid[1], self.h[self.row[item]], item)) for item, code_bid in moved.items() if code_bid)
        self.open = {item for item, code_bid in moved.items() if code_bid is None}
        return sum(counts)

    def _place(self, bids) -> None:
        added = collections.Counter()
        for code, bid in bids:
            self.known[code].append(bid)
            added[code] += 1
        for code, count in added.items():
            self.known[code].sort()
            self.counts[code] += count

    def _round(self, price: np.ndarray, step: int) -> bool:
        """All unplaced items bid at once; False, and nothing has changed, where the known bids do not tell what comes of it."""
        new = collections.defaultdict(list)
        for item in self.open:
            code, bid, stale = self._bid(item, price, step)
            if stale:
                return False
            new[code] += [(bid, self.h[self.row[item]], item)] * self.copies[item]
        after = []
        for code, (bids, mark) in enumerate(zip(self.known, self.marks, strict=True)):
            bids, over = sorted(bids + new[code]), int(self.counts[code] + len(new[code]) - self.sizes[code])
            first = bisect.bisect_left(bids, bids[over]) if 0 < over < len(bids) else max(over, 0)
            whole, last = mark[0] == FAR, first + TAIL_DEPTH  # the tail looks so far
            if not whole and (last >= len(bids) or bids[last] > mark):
                return False
            after.append((bids, first, over))
        self.open = set()
        for code, (bids, first, over) in enumerate(after):
            if bids and bids[0][0] >= 1 << BID_BITS:
                raise OverflowError(TOO_HIGH)
            if over > 0:
                price[code] = bids[over][0]
            elif over == 0 and bids:
                price[code] = max(int(price[code]), bids[0][0])
            self.open |= {item for _, _, item in bids[:first]}
            self.counts[code] += len(new[code]) - first
            self.known[code] = bids[first:]
        return True

    def _bid(self, item: int, price: np.ndarray, step: int) -> tuple[int, int, bool]:
        """(code, bid, whether a code that is not listed might be better)."""
        row = self.row[item]
        loss = self.cost[row] + price[self.codes[row]]
        order = np.argsort(loss, kind="stable")
        least, code, beyond = int(loss[order[0]]), int(self.codes[row, order[0]]), self.beyond[row]
        second = min(int(loss[order[1]]) if len(order) > 1 else beyond, beyond)
        return code, int(price[code]) + max((second if second < FAR else least) - least, 0) + step, least > beyond


def known_bids(k: int) -> int:
    """How many of the lowest bids of each code the end of an auction is played with."""
    return max(TAIL_DEPTH + 2, KNOWN_BIDS // k)


def _listed(hashed: DataFrame, book: Book, price: np.ndarray, unit: float, listed: int) -> DataFrame:
    """(item_id, h, entries of (loss, code, cost), beyond): the codes of least loss, and a bound for all the others."""
    count = min(listed, book.size)
    shared = hashed.sparkSession.sparkContext.broadcast(book.slices(price))

    def make(i: int, part: Part):
        def run(batches):
            import pyarrow as pa

            for tile, x in row_tiles(batches, part.size):
                cost = np.floor(np.maximum(squared_distances(x, part.centroids.value), 0) / unit).astype(np.int64)
                loss = cost + shared.value[i]
                order = np.argsort(loss, axis=1, kind="stable")[:, :count]
                best, own = (np.take_along_axis(m, order, axis=1).ravel() for m in (loss, cost))
                entries = pa.StructArray.from_arrays([pa.array(best), pa.array((order + part.start).ravel().astype(np.int32)), pa.array(own)],
                                                     ["loss", "code", "cost"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, order.shape[1]).astype(np.int32)), entries)
                yield pa.RecordBatch.from_arrays([tile.column("item_id"), tile.column("h"), lists], ["item_id", "h", "entries"])

        return run

    found = over_parts(hashed, book, make, "item_id bigint, h bigint, entries array<struct<loss:bigint,code:int,cost:bigint>>")
    if len(book.parts) > 1:
        found = found.groupBy("item_id", "h").agg(F.slice(F.sort_array(F.flatten(F.collect_list("entries"))), 1, count).alias("entries"))
    beyond = F.lit(FAR).cast("bigint") if count == book.size else F.element_at("entries", -1)["loss"]
    return found.withColumn("beyond", beyond)


def _bids(open_: DataFrame, price: np.ndarray, step: int) -> DataFrame:
    """(item_id, h, code, bid) of unplaced items; no code where one that is not listed might be better."""
    shared = open_.sparkSession.sparkContext.broadcast(price.copy())

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            entries = b.column("entries").flatten()
            codes, cost = (entries.field(f).to_numpy().reshape(b.num_rows, -1) for f in ("code", "cost"))
            loss = cost + shared.value[codes]
            order = np.argsort(loss, axis=1, kind="stable")
            rows = np.arange(len(loss))
            best, beyond = order[:, 0], b.column("beyond").to_numpy()
            least = loss[rows, best]
            second = np.minimum(loss[rows, order[:, 1]] if loss.shape[1] > 1 else beyond, beyond)
            second = np.where(second >= FAR, least, second)  # a single code has no rival
            code = codes[rows, best]
            bid = shared.value[code] + np.maximum(second - least, 0) + step
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("h"), pa.array(code.astype(np.int32), mask=least > beyond), pa.array(bid)],
                                             ["item_id", "h", "code", "bid"])

    return open_.mapInArrow(run, "item_id bigint, h bigint, code int, bid bigint")


def _cuts(offers: DataFrame, seen: dict, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code the (bid, h, item) of the lowest offer it keeps, of the last one of its lowest `known_bids`, and how many it keeps.

    The first is below every offer where a code keeps all, the second above them (`FAR`) where it has no more than these.
    """
    cuts, marks = np.full((3, len(sizes)), -1, np.int64), np.full((3, len(sizes)), FAR, np.int64)
    counts = np.zeros(len(sizes), np.int64)
    wanted = {}
    for code, (count, _, _) in seen.items():
        counts[code] = count
        over = max(count - int(sizes[code]), 0)
        if over:
            wanted[0, code] = over
        if over + known_bids(len(sizes)) < count:
            wanted[1, code] = over + known_bids(len(sizes)) - 1
    for (kind, code), (row, before) in _offers_at(offers, seen, wanted, len(sizes)).items():
        (marks if kind else cuts)[:, code] = row
        counts[code] -= 0 if kind else before
    return cuts, marks, counts


def _offers_at(offers: DataFrame, seen: dict, wanted: dict, k: int) -> dict:
    """Per (kind, code) the (bid, h, item) at the wanted rank of the code's offers, and how many offers are below that one.

    Histograms of bids, and of hashes where bids tie, narrow all of them at once, until few enough rows are left for the driver.
    """
    spans = {key: ("bid", 0, seen[key[1]][1], seen[key[1]][2], 0, seen[key[1]][0]) for key in wanted}  # field, bid, from, to, before, rows
    small = max(16, DRIVER_ROWS // max(1, len(wanted)))
    while wide := [key for key, (field, _, lo, hi, _, rows) in spans.items() if rows > small and (lo < hi or field == "bid")]:
        for key in wide:
            field, _, lo, hi, before, rows = spans[key]
            if lo == hi:  # one bid many times
                spans[key] = "h", lo, 0, (1 << HASH_BITS) - 1, before, rows
        buckets = max(2, min(HISTOGRAM_BUCKETS, HISTOGRAM_CELLS // len(wide)))
        cells = _inside(offers, {key: spans[key] for key in wide}, k, buckets).groupBy("cell").agg(F.sum("n").alias("n"))
        found = collections.defaultdict(list)
        for r in collect_small(cells, buckets * len(wide), "histogram"):
            found[r["cell"] // buckets].append((r["cell"] % buckets, r["n"]))
        for slot, key in enumerate(wide):
            field, bid, lo, hi, before, _ = spans[key]
            width = (hi - lo) // buckets + 1
            for bucket, rows in sorted(found[slot]):
                if before + rows > wanted[key]:
                    start = lo + bucket * width
                    spans[key] = field, bid, start, min(start + width - 1, hi), before, rows
                    break
                before += rows
    if not spans:
        return {}
    left = _inside(offers, spans, k).groupBy("code", "bid", "h", "item_id").count()
    rows = collections.defaultdict(list)
    for r in left.toArrow().to_pylist():
        rows[r["code"]].append((r["bid"], r["h"], r["item_id"], r["count"]))
    out = {}
    for key, (field, bid, lo, hi, before, _) in spans.items():
        for *row, count in sorted(r for r in rows[key[1]] if (lo <= r[0] <= hi if field == "bid" else r[0] == bid and lo <= r[1] <= hi)):
            if before + count > wanted[key]:
                out[key] = tuple(row), before
                break
            before += count
    return out


def _inside(offers: DataFrame, spans: dict, k: int, buckets: int = 0) -> DataFrame:
    """The offers inside any of the spans, or, by `buckets`, how many of them each cell of each span holds: (cell, n)."""
    kinds = []
    for kind in sorted({key[0] for key in spans}):
        bid, h, slot = np.ones((2, k), np.int64), np.ones((2, k), np.int64), np.zeros(k, np.int64)
        bid[1] = h[1] = 0  # nothing is inside
        by_hash = np.zeros(k, bool)
        for i, ((own, code), (field, value, lo, hi, _, _)) in enumerate(spans.items()):
            if own == kind:
                by_hash[code] = field == "h"
                bid[:, code] = (value, value) if by_hash[code] else (lo, hi)
                h[:, code] = (lo, hi) if by_hash[code] else (np.iinfo(np.int64).min, np.iinfo(np.int64).max)
                slot[code] = i
        kinds.append((bid, h, slot, by_hash))
    shared, cells = offers.sparkSession.sparkContext.broadcast(kinds), buckets * len(spans)

    def run(batches):
        import pyarrow as pa

        total = np.zeros(cells, np.int64)
        for b in batches:
            code, value, hashed = (b.column(c).to_numpy() for c in ("code", "bid", "h"))
            stays = np.zeros(len(code), bool)
            for bid, h, slot, by_hash in shared.value:
                own = (value >= bid[0, code]) & (value <= bid[1, code]) & (hashed >= h[0, code]) & (hashed <= h[1, code])
                stays |= own
                if buckets:
                    c = code[own]
                    lo, hi = np.where(by_hash, h, bid)[:, c]
                    at = (np.where(by_hash[c], hashed[own], value[own]) - lo) // ((hi - lo) // buckets + 1)
                    total += np.bincount(slot[c] * buckets + at, minlength=cells)
            if not buckets:
                yield b.filter(pa.array(stays))
        if buckets:
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["cell", "n"])

    return offers.mapInArrow(run, "cell bigint, n bigint" if buckets else offers.schema)


def _beside(offers: DataFrame, cuts: np.ndarray, side: str) -> DataFrame:
    """The offers from each code's cut on, above it, or up to it (`side`: from, above, to)."""
    shared = offers.sparkSession.sparkContext.broadcast(cuts)  # three numbers a code

    def run(batches):
        import pyarrow as pa

        for b in batches:
            code = b.column("code").to_numpy()
            above = np.zeros(len(code), bool)
            equal = np.ones(len(code), bool)
            for name, cut in zip(("bid", "h", "item_id"), shared.value, strict=True):
                value = b.column(name).to_numpy()
                above |= equal & (value > cut[code])
                equal &= value == cut[code]
            yield b.filter(pa.array({"from": above | equal, "above": above, "to": ~above}[side]))

    return offers.mapInArrow(run, offers.schema)


def _soft_pass(vectors: DataFrame, centroids: np.ndarray, bias: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Per start and code: weight, cost and moment of the softly assigned items, [start, code, 2 + dim], from one pass for all starts."""
    starts, k, dim = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, bias, tau))

    def run(batches):
        import pyarrow as pa

        c, log_v, t = shared.value
        total = np.zeros((starts, k, 2 + dim))
        for _, x in row_tiles(batches, k):
            for s in range(starts):
                d = np.maximum(squared_distances(x, c[s]), 0)
                logits = -d / t[s] + log_v[s]
                plan = np.exp(logits - logits.max(1, keepdims=True))
                plan /= plan.sum(1, keepdims=True)
                total[s, :, 0] += plan.sum(0)
                total[s, :, 1] += (plan * d).sum(0)
                total[s, :, 2:] += plan.T @ x
        flat = total.reshape(starts * k, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(list(flat), pa.list_(pa.float64()))], ["key", "v"])

    parts = vectors.select("vec").mapInArrow(run, "key bigint, v array<double>")
    sums = parts.groupBy("key").agg(Summarizer.sum(array_to_vector("v")).alias("s")).select("key", vector_to_array("s").alias("s"))
    out = np.zeros((starts * k, 2 + dim))
    for r in collect_small(sums, starts * k, "centroids"):
        out[r["key"]] = r["s"]
    shared.destroy()
    return out.reshape(starts, k, -1)


def balanced_kmeans(
    vectors: DataFrame, k: int, max_iter: int = ROUNDS, seed: int = 42, tol: float = 1e-3, starts: int = STARTS,
    centroids: np.ndarray | None = None,
) -> tuple[np.ndarray, DataFrame, float]:
    """(centroids, assignment, total squared error) of clusters whose sizes lie within `size_bounds`.

    All starts are fitted together, one pass a round, by soft assignments whose prices even out the sizes while the temperature
    falls. The one of least cost goes on with exact rounds, an auction and new means, until the error stops falling by `tol`.
    """
    spark = vectors.sparkSession
    vectors, path, n = stored_counted(vectors.select("item_id", "vec"), "vectors")
    lower, upper = size_bounds(n, k)
    if n < k:
        raise ValueError(f"{n} items cannot start {k} codes")
    if centroids is None:
        first = [collect_small(sample_rows(vectors, ["item_id"], k, seed + s), k, "starting centroids") for s in range(starts)]
        books = np.array([[r["vec"] for r in sorted(rows, key=lambda r: r["item_id"])] for rows in first], dtype=np.float64)
        centroids, prices = _annealed(vectors, books, n, max_iter, tol)
    else:
        prices = np.zeros(k)
    best = None
    for _ in range(max_iter):
        assigned, prices = auction(vectors, centroids, lower, upper, prices, seed)
        joined = vectors.join(assigned, "item_id")
        left = minus_centroid(joined, book_of(spark, centroids))
        error = left.agg(F.sum(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x))).first()[0]
        if best is not None and error >= best[2] * (1 - tol):
            break
        best = (centroids, assigned, float(error))
        centroids = centroids.copy()
        for r in collect_small(mean_vectors(joined, "code", "vec"), k, "centroids"):
            centroids[r["code"]] = r["centroid"]
    discard(spark, path)
    return best


def _annealed(vectors: DataFrame, books: np.ndarray, n: int, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, prices) of the start whose softly balanced clusters cost least."""
    starts, k, _ = books.shape
    bias, heat, settled = np.zeros((starts, k)), WARM, 0
    scale = np.ones(starts)
    for turn in range(max_iter + 1):
        tau = np.maximum(scale * heat, 1e-12)
        total = _soft_pass(vectors, books, bias, tau if turn else np.full(starts, 1e12))
        weight, cost = np.maximum(total[:, :, 0], 1e-300), total[:, :, 1].sum(1) / n
        if not turn:  # the first pass weighs all codes alike and only measures
            scale = cost
            continue
        moved = total[:, :, 2:] / weight[:, :, None]
        shift = (((moved - books) ** 2).sum(2).max(1) / np.maximum(scale, 1e-300)).max()
        uneven = np.abs(weight * k / n - 1).max()
        books, bias = moved, bias + np.log(n / k / weight)
        bias -= bias.max(1, keepdims=True)
        if heat > COLD:
            colder = max(COLD, heat * COOLING)
            bias, heat = bias * heat / colder, colder  # prices stay, in the new unit
            continue
        settled += 1
        if settled == SETTLE or (shift <= tol and uneven < 0.05):  # the rest is the auction's
            break
    s = int(cost.argmin())
    return books[s], -tau[s] * bias[s]


def residual_balanced_kmeans(
    vectors: DataFrame, k: int, levels: int, max_iter: int = ROUNDS, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(codebooks, codes) with every level balanced."""
    spark = vectors.sparkSession
    left, path = stored(vectors.select("item_id", "vec"), "residual")
    codes, books = left.select("item_id", F.array().cast("array<int>").alias("codes")), []
    codes = materialize(codes, "codes")
    for level in range(levels):
        centroids, assigned, _ = balanced_kmeans(left, k, max_iter, seed + level)
        books.append(centroids)
        codes = materialize(codes.join(assigned, "item_id").select(
            "item_id", F.concat("codes", F.array("code")).alias("codes")), "codes")
        less, old = minus_centroid(left.join(assigned, "item_id"), book_of(spark, centroids)), path
        left, path = stored(less, "residual")
        discard(spark, old)
    discard(spark, path)
    return codebook_frame(spark, books), codes
