"""Per-key stateful processors (state API v2, ``transformWithState``).

Spark calls ``handleInputRows`` with the rows of one key in one micro-batch
(bounded by the trigger size) and the key's state variables. Rows are sorted
by the job's total order inside the batch; batches arrive in order (see
``harness``). State is kept per key in the RocksDB state store and partitioned
by the grouping key, so it scales out with the key space and survives executor
loss through the checkpoint. Records that expire have event-time timers.
"""

from __future__ import annotations

import datetime as dt
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import (INT_MAX, STATUS_COMPLETED, STATUS_FAILED, STATUS_PAYMENT_FAILED, STATUS_PENDING,
                                 STATUS_VALIDATED)
from ..operators.cart import CART_TTL_SECONDS
from ..operators.orders import SAGA_TTL_SECONDS
from ..operators.reservation import walk
from .grouped import Rows, codes, keyed

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def _change_key(r):
    return (r.ts, r.l_orderkey, r.l_linenumber, r.l_suppkey, r.chg)


def _unified_key(r):
    return (r.ts, r.kind, r.l_orderkey, r.l_linenumber, r.l_suppkey, r.amount)


STOCK_OUT = "sku string, stock long"


def _walk_keys(rows, amount: str, order: list[str], kind: str | None, kept: dict):
    """(rows by SKU and order, stock before each, SKUs, stock each is left with):
    the SKUs of a group walked side by side from the stock they have."""
    rows = rows.where(rows.pdf["sku"].notna().to_numpy() & ~rows.null(amount))
    if not len(rows.pdf):
        return None
    rows, first, skus = rows.sorted("sku", order)
    kinds = np.zeros(len(first), np.int8) if kind is None else rows.numbers(kind).astype(np.int8)
    entry = np.array([kept[k]["stock"][0] if k in kept else 0 for k in skus], np.int64)
    before, left = walk(kinds, rows.numbers(amount), first, entry)
    for k, s in zip(skus, left.tolist()):
        kept[k] = {"stock": (s,)}
    return rows, before, skus, left.tolist()


class StockFold(StatefulProcessor):
    """Clamped stock per SKU; ValueState = current stock."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stock = handle.getValueState("stock", "stock long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        cur = self.stock.get()
        s = cur[0] if cur is not None else 0
        rows = sorted((r for r in rows if r.sku is not None and r.chg is not None), key=_change_key)
        for r in rows:
            s = min(INT_MAX, max(0, s + r.chg))
        if rows:
            self.stock.update((s,))
            yield Row(sku=key[0], stock=s)

    def handleKeys(self, rows, kept: dict) -> list:
        """``handleInputRows`` for all keys of a group in one pass."""
        done = _walk_keys(rows, "chg", ["ts", "l_orderkey", "l_linenumber", "l_suppkey", "chg"], None, kept)
        return [] if done is None else [done[2], done[3]]

    def close(self) -> None:
        pass


RESERVE_OUT = ("order_number string, sku string, qty int, ts timestamp_ntz, l_orderkey long, l_linenumber int, "
               "l_suppkey long, success boolean, stock_before long, stock_after long")


class ReserveFold(StatefulProcessor):
    """J2 (with J1): one processor over the tagged union of stock changes
    (kind 0) and requests (kind 1); the same state serves both, as in the
    reference's shared store (a state store cannot be shared by two operators)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stock = handle.getValueState("stock", "stock long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        cur = self.stock.get()
        rows = sorted((r for r in rows if r.sku is not None and r.amount is not None), key=_unified_key)
        if not rows:
            return iter([])
        kind = np.array([r.kind for r in rows], np.int8)
        amount = np.array([r.amount for r in rows], np.int64)
        first = np.zeros(len(rows), bool)
        first[0] = True
        before, left = walk(kind, amount, first, np.array([cur[0] if cur is not None else 0]))
        self.stock.update((int(left[0]),))
        return iter([Row(order_number=r.order_number, sku=r.sku, qty=int(r.amount), ts=r.ts, l_orderkey=r.l_orderkey,
                         l_linenumber=r.l_linenumber, l_suppkey=r.l_suppkey, success=s >= r.amount, stock_before=s,
                         stock_after=s - r.amount if s >= r.amount else s)
                     for r, s in zip(rows, before.tolist()) if r.kind == 1])

    def handleKeys(self, rows, kept: dict) -> list:
        """``handleInputRows`` for all keys of a group in one pass."""
        done = _walk_keys(rows, "amount", ["ts", "kind", "l_orderkey", "l_linenumber", "l_suppkey", "amount"], "kind", kept)
        if done is None:
            return []
        rows, before = done[0], done[1]
        asked = rows.numbers("kind") == 1
        rows, before = rows.where(asked), before[asked]
        need = rows.numbers("amount")
        return [*[rows.values(c) for c in ("order_number", "sku", "amount", "ts", "l_orderkey", "l_linenumber", "l_suppkey")],
                before >= need, before, np.where(before >= need, before - need, before)]

    def close(self) -> None:
        pass


GATHER_OUT = "order_number string, outcome string, reason string, ts timestamp_ntz"


RECORDS = 4      # saga records of a key in one micro-batch that are gathered with those of other keys
_RESULT = ("l_linenumber", "l_partkey", "l_suppkey", "qty", "sku", "success")      # what tells results of an order apart


def _listed(values) -> list:
    return values.tolist() if isinstance(values, np.ndarray) else list(values)


def _spans(begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All of begin..stop of every span, one after the other."""
    size = stop - begin
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def _millis(ts: dt.datetime) -> int:
    return (ts.replace(tzinfo=dt.timezone.utc) - _EPOCH) // dt.timedelta(milliseconds=1)


class Gather(StatefulProcessor):
    """Gather line results into order outcomes, as events.

    The saga record is created by the placement event (side 0, with the number
    of items) and lives ``ttl`` from there in event time. A repeated delivery
    of a result is counted once (MapState of the results seen, cleared with the
    record). The order is VALIDATED when the count reaches the items, which
    clears the record; a first failing result makes it FAILED. A failing result
    that finds no live record fails the order too; such a mark lives ``ttl``
    as well. When the watermark passes a record's end its state is freed.
    """

    def __init__(self, ttl: dt.timedelta = dt.timedelta(seconds=SAGA_TTL_SECONDS)):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saga = handle.getValueState("saga", "end timestamp_ntz, total long, received long, failed boolean")
        self.seen = handle.getMapState("seen", "l_linenumber int, l_partkey long, l_suppkey long, qty int, sku string, success boolean",
                                       "at timestamp_ntz")

    def _clear(self) -> None:
        self.saga.clear()
        self.seen.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.saga.get()
        end, total, received, failed = state if state is not None else (None, None, 0, False)
        out, known = [], state is not None
        for r in sorted(rows, key=lambda r: (r.at, r.side) + ((r.l_linenumber, r.l_partkey, r.l_suppkey, r.qty) if r.side else ())):
            if known and r.at > end:      # expired, whether or not the timer has told
                known = False
                self._clear()
            if r.side == 0:
                if not known:
                    end, total, received, failed, known = r.at + self.ttl, r.total_items, 0, False, True
                    self.handle.registerTimer(_millis(end))
                    out.append(Row(order_number=key[0], outcome=STATUS_PENDING, reason=None, ts=r.at))
                continue
            result = (r.l_linenumber, r.l_partkey, r.l_suppkey, r.qty, r.sku, r.success)
            if self.seen.containsKey(result):
                continue
            if not known:
                if r.success:
                    continue              # nothing to count it for
                end, total, received, failed, known = r.at + self.ttl, None, 0, False, True
                self.handle.registerTimer(_millis(end))
            self.seen.updateValue(result, (r.at,))
            received += 1
            if failed:
                continue
            if not r.success:
                failed = True
                out.append(Row(order_number=key[0], outcome=STATUS_FAILED, reason=r.reason, ts=r.at))
            elif received == total:
                out.append(Row(order_number=key[0], outcome=STATUS_VALIDATED, reason=None, ts=r.at))
                known = False
                self._clear()
        if known:
            self.saga.update((end, total, received, failed))
        return iter(out)

    def handleGroup(self, rows: Rows, kept: list) -> tuple[list, list, Rows | None]:
        """``handleInputRows`` for all keys of a group, one saga record of every
        key at a time; what comes after a key's first ``RECORDS`` records is left
        to it. An event without a time creates no record and is in none: a
        placement is told, a first failing result fails the order."""
        untimed = self._untimed(rows.where(rows.null("at")))
        rows = rows.where(~rows.null("at"))
        code, keys = keyed(rows, "order_number", kept[0])
        same = self._results(rows, code, kept)
        same, same_kept = same[:len(code)], same[len(code):]
        side = rows.numbers("side")
        order = np.lexsort([np.where(side == 0, 0, rows.numbers(c)) for c in ("qty", "l_suppkey", "l_partkey", "l_linenumber")]
                           + [side, rows.numbers("at"), code])
        rows, code, same, side = rows.take(order), code[order], same[order], side[order]
        at, ttl, n = rows.numbers("at"), self.ttl // dt.timedelta(microseconds=1), len(code)
        fails = (side != 0) & ~((rows.numbers("success") == 1) & ~rows.null("success"))
        items = np.where(rows.null("total_items"), -1, rows.numbers("total_items"))      # -1: no number of items to reach
        count = np.arange(len(keys))
        begin, stop = np.searchsorted(code, count), np.searchsorted(code, count, "right")

        known, end, total = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.full(len(keys), -1)
        received, failed = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        saga = kept[1]
        known[saga], end[saga], total[saga] = True, kept[2], [-1 if x is None else x for x in kept[3]]
        received[saga], failed[saga] = kept[4], kept[5]
        counted = np.zeros(1 + max(same.max(initial=-1), same_kept.max(initial=-1)), bool)
        counted[same_kept] = True      # results that a live record has seen
        seen = np.zeros(n, bool)       # rows that are kept with their record
        ended = np.zeros(len(keys), bool)       # the record in the state has ended
        creates, out = np.flatnonzero((side == 0) | fails), []
        open_ = np.flatnonzero(begin < stop)
        for _ in range(RECORDS):
            # expired, whether or not the timer has told
            over = open_[known[open_] & (at[begin[open_]] > end[open_])]
            known[over], ended[over] = False, True
            new = open_[~known[open_]]
            first = np.append(creates, n)[np.searchsorted(creates, begin[new])]
            none = first >= stop[new]
            begin[new[none]] = stop[new[none]]      # nothing to count these results for
            new, first = new[~none], first[~none]
            placed = side[first] == 0
            known[new], end[new], failed[new], received[new] = True, at[first] + ttl, False, 0
            total[new] = np.where(placed, items[first], -1)
            begin[new] = first + placed      # a failing result is the first one of its mark
            out.append((first[placed], STATUS_PENDING))
            open_ = open_[known[open_]]

            row = _spans(begin[open_], stop[open_])
            key = code[row]
            within = at[row] <= end[key]
            last = begin + np.bincount(key[within], minlength=len(keys))
            row, key = row[within], key[within]
            row, key = row[side[row] != 0], key[side[row] != 0]
            new_to = ~(counted[same[row]] & ~ended[key])
            row, key = row[new_to], key[new_to]
            once = ~pd.Series(same[row]).duplicated().to_numpy()
            row, key = row[once], key[once]
            nth = np.arange(len(key)) - np.searchsorted(key, key) + received[key] + 1
            bad = np.full(len(keys), n)
            good = np.full(len(keys), n)
            hits = row[fails[row]]
            np.minimum.at(bad, code[hits], hits)
            hits = row[(nth == total[key]) & ~fails[row]]
            good[code[hits]] = hits
            bad[failed] = good[failed] = n
            done = good < bad
            out += [(good[done], STATUS_VALIDATED), (bad[~done & (bad < n)], STATUS_FAILED)]

            lives = open_[~done[open_] & (last[open_] >= stop[open_])]
            received += np.bincount(key, minlength=len(keys))
            failed |= ~done & (bad < n)
            stays = np.zeros(len(keys), bool)
            stays[lives] = True
            seen[row[stays[key]]] = True
            ends = open_[~stays[open_]]
            known[ends], ended[ends] = False, True
            begin[ends] = np.where(done[ends], good[ends] + 1, last[ends])
            begin[lives] = stop[lives]
            open_ = ends[begin[ends] < stop[ends]]
            if not len(open_):
                break
        rest = rows.take(_spans(begin[open_], stop[open_])) if len(open_) else None
        columns = self._columns(rows, untimed, out)
        return columns, self._left(rows, code, keys, kept, known, ended, end, total, received, failed, np.flatnonzero(seen)), rest

    @staticmethod
    def _untimed(rows: Rows) -> list[tuple[Rows, str]]:
        late = rows.where((rows.numbers("side") != 0) & ((rows.numbers("success") != 1) | rows.null("success")))
        code, _ = codes(late.objects("order_number"))
        order = np.lexsort([x for c in ("qty", "l_suppkey", "l_partkey", "l_linenumber") for x in (late.numbers(c), ~late.null(c))] + [code])
        first = order[np.append(True, code[order][1:] != code[order][:-1])] if len(code) else order
        return [(rows.where(rows.numbers("side") == 0), STATUS_PENDING), (late.take(first), STATUS_FAILED)]

    @staticmethod
    def _results(rows: Rows, code: np.ndarray, kept: list) -> np.ndarray:
        """A number per result, equal for its repeated deliveries to one order:
        of the rows, then of those that the group keeps."""
        same = np.concatenate([code, np.array(kept[6], np.int64)])
        for i, c in enumerate(_RESULT, 7):
            if c == "sku":
                value, _ = codes(np.concatenate([rows.objects(c), np.array(kept[i], object)]))
            else:
                value, _ = codes(np.concatenate([rows.numbers(c), np.array([0 if x is None else x for x in kept[i]], np.int64)]))
                value = value * 2 + np.concatenate([rows.null(c), np.array([x is None for x in kept[i]], bool)])
            same, _ = pd.factorize(same * (1 + value.max(initial=0)) + value)
        return same

    @staticmethod
    def _columns(rows: Rows, untimed: list, out: list) -> list:
        told = [(rows.take(at), status) for at, status in out] + untimed
        time = [t.numbers("at").astype("datetime64[us]") for t, _ in told[:len(out)]] + [np.full(len(t.pdf), "NaT", "datetime64[us]") for t, _ in untimed]
        return [np.concatenate([t.objects("order_number") for t, _ in told]), np.concatenate([np.full(len(t.pdf), s, object) for t, s in told]),
                np.concatenate([t.objects("reason") if s == STATUS_FAILED else np.full(len(t.pdf), None, object) for t, s in told]),
                np.concatenate(time)]

    @staticmethod
    def _left(rows, code, keys, kept, known, ended, end, total, received, failed, seen) -> list:
        """The arrays of the records that live on, with one timer each."""
        held = np.flatnonzero(known)
        place = np.full(len(keys), -1)
        place[held] = np.arange(len(held))
        # results of a record in the state that still lives, then those counted now
        old = [j for j, k in enumerate(kept[6]) if place[k] >= 0 and not ended[k]]
        now = rows.take(seen)
        values = [_listed(now.values(c)) for c in _RESULT]
        values[-1] = [None if x is None else bool(x) for x in values[-1]]
        results = [[kept[i][j] for j in old] + new for i, new in enumerate([*values, now.numbers("at").tolist()], 7)]
        at = list(range(len(held)))
        return [keys[held].tolist(), at, end[held].tolist(), [None if x < 0 else x for x in total[held].tolist()],
                received[held].tolist(), failed[held].tolist(), [int(place[kept[6][j]]) for j in old] + place[code[seen]].tolist(), *results,
                at, (end[held] // 1000).tolist()]

    def stillKept(self, kept: list, passed: int) -> list:
        """What a group keeps when the watermark has passed the end of records."""
        live = [j for j, end in enumerate(kept[2]) if end // 1000 >= passed]
        place = {kept[1][j]: i for i, j in enumerate(live)}
        seen = [j for j, k in enumerate(kept[6]) if k in place]
        return [[kept[0][kept[1][j]] for j in live], list(range(len(live))), *[[c[j] for j in live] for c in kept[2:6]],
                [place[kept[6][j]] for j in seen], *[[c[j] for j in seen] for c in kept[7:-2]],
                list(range(len(live))), [kept[2][j] // 1000 for j in live]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.saga.get()
        # a record that was created anew has a later end and a timer of its own
        if state is not None and _millis(state[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self._clear()
        return iter([])

    def close(self) -> None:
        pass


_NEXT = {
    ("PLACED", None): STATUS_PENDING,
    ("VALIDATED", STATUS_PENDING): STATUS_VALIDATED,
    ("FAILED", STATUS_PENDING): STATUS_FAILED,
    ("PAID", STATUS_PENDING): STATUS_COMPLETED,
    ("PAID", STATUS_VALIDATED): STATUS_COMPLETED,
    ("PAY_FAILED", STATUS_PENDING): STATUS_PAYMENT_FAILED,
    ("PAY_FAILED", STATUS_VALIDATED): STATUS_PAYMENT_FAILED,
}
# rank of events of one instant: a payment sees the status before it; an
# order's lines say whether it can be saved before it is placed
PAYMENT, LINE, PLACED, EVENT = 0, 1, 2, 3


class _Orders(StatefulProcessor):
    """Status machine per order over its raw events. The placement saves the
    order if all its lines (events of the same instant) have a known product;
    events of an order that is not saved are ignored (not found)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")

    def payment(self, key, row, status) -> Iterator[Row]:
        return iter([])

    def transition(self, key, row, status) -> Iterator[Row]:
        return iter([])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        cur = self.status.get()
        status, missing = cur[0] if cur is not None else None, None      # time of a line without product
        out, old = [], status
        for r in sorted(rows, key=lambda r: (r.at, r.rank, r.kind)):
            if r.rank == PAYMENT:
                out.extend(self.payment(key, r, status))
            elif r.rank == LINE:
                missing = missing if r.known else r.at
            elif not (r.rank == PLACED and missing == r.at):
                nxt = _NEXT.get((r.kind, status))
                if nxt is not None:
                    status = nxt
                    out.extend(self.transition(key, r, status))
        if status != old:
            self.status.update((status,))
        return iter(out)

    def handleGroup(self, rows: Rows, kept: list) -> tuple[list, list, None]:
        """``handleInputRows`` for all keys of a group in one pass: a status is
        left once, so each is one search for the next event that it answers."""
        code, keys = keyed(rows, "order_number", kept[0])
        of, kinds = codes(rows.objects("kind"))
        alphabet = np.empty(len(kinds), np.int64)
        alphabet[sorted(range(len(kinds)), key=lambda i: (kinds[i] is not None, kinds[i]))] = np.arange(len(kinds))
        order = np.lexsort([alphabet[of], rows.numbers("rank"), rows.numbers("at"), ~rows.null("at"), code])
        rows, code, of = rows.take(order), code[order], of[order]
        at, none, rank = rows.numbers("at"), rows.null("at"), rows.numbers("rank")
        n, place = len(code), np.arange(len(code))
        begin, end = np.searchsorted(code, np.arange(len(keys))), np.searchsorted(code, np.arange(len(keys)), "right")
        unknown = (rank == LINE) & ~((rows.numbers("known") == 1) & ~rows.null("known"))
        last = np.maximum.accumulate(np.where(unknown, place, -1)) if n else place
        missing = last >= begin[code]
        # an order without a time is not placed either
        blocked = np.where(missing, (at == at[last]) & (none == none[last]), none)
        acts = (rank != PAYMENT) & (rank != LINE) & ~((rank == PLACED) & blocked)

        status = np.full(len(keys), None, object)
        status[kept[1]] = kept[2]
        entry, cursor, steps = status.copy(), begin.copy(), []
        for now in (None, STATUS_PENDING, STATUS_VALIDATED):      # in the machine's order: it never goes back
            to = np.array([_NEXT.get((k, now)) for k in kinds], object)
            found = np.flatnonzero(acts & (to != None)[of]) if n else place  # noqa: E711
            mine = np.flatnonzero(status == now)
            i = np.searchsorted(found, cursor[mine])
            next_at = np.append(found, n)[i]
            mine, next_at = mine[next_at < end[mine]], next_at[next_at < end[mine]]
            status[mine], cursor[mine] = to[of[next_at]], next_at + 1
            steps.append((next_at, status[mine]))
        where, what = np.concatenate([w for w, _ in steps]), np.concatenate([s for _, s in steps])
        what, where = what[np.argsort(where)], np.sort(where)
        held = np.flatnonzero(status != None)  # noqa: E711
        left = [keys[held].tolist(), list(range(len(held))), status[held].tolist(), [], []]
        return self.columns(rows, code, rank, begin, entry, where, what), left, None

    def columns(self, rows, code, rank, begin, entry, where, what) -> list:
        """Output of a group's rows in order: ``what`` its keys become at ``where``."""
        raise NotImplementedError

    def close(self) -> None:
        pass


GATE_OUT = "order_number string, payment_id string, pay_ts timestamp_ntz, status_at_arrival string"


class PaymentGate(_Orders):
    """Stream-table join of payments with the order's status, which the
    same operator derives from the order's events."""

    def payment(self, key, row, status) -> Iterator[Row]:
        if status in (STATUS_PENDING, STATUS_VALIDATED):
            yield Row(order_number=key[0], payment_id=row.payment_id, pay_ts=row.at, status_at_arrival=status)

    def columns(self, rows, code, rank, begin, entry, where, what) -> list:
        at = np.flatnonzero(rank == PAYMENT)
        before = np.searchsorted(where, at) - 1
        changed = np.append(where, -1)[before] >= begin[code[at]]      # -1 reads the -1 at the end
        status = np.where(changed, np.append(what, None)[before], entry[code[at]])
        live = np.isin(status.astype(str), [STATUS_PENDING, STATUS_VALIDATED])
        paid = rows.take(at[live])
        return [paid.objects("order_number"), paid.objects("payment_id"), paid.values("at"), status[live]]


MACHINE_OUT = "order_number string, status string, ts timestamp_ntz"


class StatusMachine(_Orders):
    """One output row per accepted transition."""

    def transition(self, key, row, status) -> Iterator[Row]:
        yield Row(order_number=key[0], status=status, ts=row.at)

    def columns(self, rows, code, rank, begin, entry, where, what) -> list:
        moved = rows.take(where)
        return [moved.objects("order_number"), what, moved.values("at")]


class FirstWins(StatefulProcessor):
    """The first event of a key passes; later ones, however late, do not.
    The mark is kept as long as the unique key that it stands for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.mark.exists():
            return iter([])
        self.mark.update((True,))
        return iter([min(rows, key=lambda r: (r.ts, r.attempt))])

    def handleGroup(self, rows: Rows, kept: list) -> tuple[list, list, None]:
        """``handleInputRows`` for all keys of a group in one pass."""
        code, keys = keyed(rows, "order_number", kept[0])
        new = np.flatnonzero(code >= len(kept[0]))
        rows, code = rows.take(new), code[new]
        at = np.lexsort([rows.numbers("attempt"), ~rows.null("attempt"), rows.numbers("ts"), ~rows.null("ts"), code])
        first = rows.take(at[np.append(True, code[at][1:] != code[at][:-1])] if len(at) else at)
        return [first.values(f.name) for f in rows.fields], [keys.tolist(), list(range(len(keys))), [True] * len(keys), [], []], None

    def close(self) -> None:
        pass


SESSION_OUT = ("user_id long, cart_no long, session_start timestamp_ntz, session_end timestamp_ntz, checked_out boolean, "
               "n_adds long, qty long")


class CartSessions(StatefulProcessor):
    """One cart per user, from its first add until its checkout or ``ttl``
    after its last add; open carts are given out with the end they have so far
    (update mode). A timer at that end frees the cart's state."""

    def __init__(self, ttl: dt.timedelta = dt.timedelta(seconds=CART_TTL_SECONDS)):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cart = handle.getValueState("cart", "start timestamp_ntz, last timestamp_ntz, n long, qty long")
        self.carts = handle.getValueState("carts", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        numbered, cart = self.carts.get(), self.cart.get()
        no, cart = numbered[0] if numbered is not None else 0, list(cart) if cart is not None else None
        out = {}

        def row(end, checked):
            return Row(user_id=key[0], cart_no=no, session_start=cart[0], session_end=end, checked_out=checked, n_adds=cart[2], qty=cart[3])

        for r in sorted(rows, key=lambda r: (r.at, r.event_id)):
            if cart is not None and r.at > cart[1] + self.ttl:
                out[no], cart = row(cart[1] + self.ttl, False), None
            if r.kind == "checkout":
                if cart is not None:
                    out[no], cart = row(r.at, True), None
            else:
                if cart is None:
                    no, cart = no + 1, [r.at, r.at, 0, 0]
                cart = [cart[0], r.at, cart[2] + 1, cart[3] + r.qty]
        self.carts.update((no,))
        if cart is None:
            self.cart.clear()
        else:
            self.cart.update(tuple(cart))
            self.handle.registerTimer(_millis(cart[1] + self.ttl))
            out[no] = row(cart[1] + self.ttl, False)
        return iter(out.values())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        cart = self.cart.get()
        if cart is not None and _millis(cart[1] + self.ttl) <= expiredTimerInfo.getExpiryTimeInMs():
            self.cart.clear()      # its row has been given out with this end
        return iter([])

    def close(self) -> None:
        pass
