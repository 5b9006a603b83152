"""Live carts as keyed state (``transformWithState``).

A session's state is its lines by product and one small clock, in the RocksDB
store.  A trigger emits the whole cart of each session it names.  A cart expires
seven days of event time after its newest action.

Sessions are many and small, and each call of the store and each frame costs more than
a session's few actions.  So the key is a bucket of sessions, by hash: its carts are one
value, read and written in one call a trigger, and its one timer is that of the cart
due first.

Order.  Actions carry ``seq``.  Only actions on one product, and clears, depend on
each other, so an action that comes in a later trigger than one of higher
``seq`` is still applied, unless that one is on the same product or a clear:
then the cart can't be as if it had come in time.  It is not applied but emitted
with its ``late_seq`` and a reason, as are actions delivered twice.  A late clear
removes the lines last touched before it.  An action without ``seq`` is emitted
with a reason too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .._shipping import ship_by_value as _ship_by_value
from ..operators.carts import cart_step

_ship_by_value(__name__)

CART_OUT = "session_id string, product_id long, quantity int, expired boolean, late_seq long, reason string"
CART_TTL_MS = 7 * 24 * 3600 * 1000
CART_BUCKETS = 4096
_CARTS = "sessions array<string>, cleared array<long>, newest array<long>, due array<long>, " \
         "product_ids array<array<long>>, quantities array<array<int>>, seqs array<array<long>>, timer long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ACTIONS = ("add", "update", "remove", "clear")
_OUT_NAMES = [c.split()[0] for c in CART_OUT.split(", ")]
_FIELDS = ["seq", "action", "product_id", "quantity", "p_exists", "p_active", "p_stock", "ts_ms"]


class CartProcessor(StatefulProcessor):
    """State: ``lines`` products with quantity and last seq, quantity 0 for a line that
    is gone but whose order counts; ``clock`` (last clear, newest event time, timer)."""

    def __init__(self, ttl_ms: int = CART_TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.lines = handle.getValueState("lines", "product_ids array<long>, quantities array<int>, seqs array<long>")
        self.clock = handle.getValueState("clock", "cleared long, newest long, timer long")

    def handleInputRows(self, key, rows, timerValues):
        actions = (a for chunk in rows for a in zip(*(chunk[c].tolist() for c in _FIELDS)))
        yield self._frame(self._rows(key[0], False, *self._apply(actions, timerValues)))

    def _apply(self, actions, timerValues):
        """Fold the actions of one trigger; the lines that then hold something, and the actions that came too late."""
        known = self.clock.exists()
        cleared, newest, timer = self.clock.get() if known else (-1, -1, -1)
        lines, cleared, newest, late, changed = self._fold(self._load() if known else {}, cleared, newest, actions)
        if changed or not known:
            self.lines.update(self._columns(lines))
        self.clock.update((cleared, newest, self._set_timer(newest, timer, timerValues)))
        return self._held(lines), late

    @staticmethod
    def _fold(lines: dict, cleared: int, newest: int, actions):
        """A session's lines and clock after the actions of one trigger, the actions that came too late, and whether lines changed."""
        late, changed = [], False
        # Arrow chunks of a session are in no order; the actions of one trigger are folded by seq.
        # A few numbers an action are held, as many as the trigger's bound lets in.
        actions = sorted(actions, key=lambda a: -1 if a[0] is None or a[0] != a[0] else a[0])
        for seq, action, pid, q, exists, active, stock, ts in actions:
            pid, q, stock, ts = (None if v is None or v != v else int(v) for v in (pid, q, stock, ts))
            newest = newest if ts is None else max(newest, ts)
            if seq is None or seq != seq:
                late.append((None, pid, "no seq"))
                continue
            seq = int(seq)
            if action not in _ACTIONS or (pid is None and action != "clear"):
                continue
            if action == "clear":
                if seq > cleared:
                    lines = {p: line for p, line in lines.items() if line[1] >= seq}
                    cleared, changed = seq, True
                    if any(held > 0 and last > seq for held, last in lines.values()):
                        late.append((seq, None, "lines with later actions stay"))
                continue
            line = lines.get(pid)
            if seq <= cleared or (line is not None and seq <= line[1]):
                late.append((seq, pid, "after a later action or delivered twice"))
                continue
            one = {pid: line[0]} if line is not None and line[0] > 0 else {}
            cart_step(one, action, pid, q, bool(exists), bool(active), stock)
            lines[pid] = (one.get(pid, 0), seq)
            changed = True
        return lines, cleared, newest, late, changed

    @staticmethod
    def _columns(lines: dict) -> tuple:
        pids = sorted(lines)
        return pids, [lines[p][0] for p in pids], [lines[p][1] for p in pids]

    @staticmethod
    def _from_columns(pids, quantities, seqs) -> dict:
        return {pid: (q, seq) for pid, q, seq in zip(pids, quantities, seqs)}

    def _load(self) -> dict:
        return self._from_columns(*self.lines.get()) if self.lines.exists() else {}

    @staticmethod
    def _held(lines: dict) -> list:
        return sorted((pid, q) for pid, (q, _) in lines.items() if q > 0)

    def _due(self, newest: int, due: int, watermark: int) -> int:
        return due if newest < 0 else max(newest + self.ttl_ms, watermark + 1)

    def _set_timer(self, newest: int, timer: int, timerValues) -> int:
        return self._move_timer(timer, self._due(newest, timer, timerValues.getCurrentWatermarkInMs()))

    def _move_timer(self, timer: int, due: int) -> int:
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if due >= 0:
                self.handle.registerTimer(due)
        return due

    @staticmethod
    def _rows(session, expired: bool, lines, late=()) -> list:
        return [(session, pid, q, expired, None, None) for pid, q in lines or [(None, None)]] + \
            [(session, pid, None, expired, seq, reason) for seq, pid, reason in late]

    @staticmethod
    def _frame(rows: list):
        import pandas as pd
        columns = zip(("object", "Int64", "Int32", "bool", "Int64", "object"), zip(*rows))
        return pd.DataFrame({name: pd.array(values, kind) if kind.startswith("Int") else pd.Series(values, dtype=kind)
                             for name, (kind, values) in zip(_OUT_NAMES, columns)})

    def _expired(self) -> list:
        lines = self._held(self._load())
        self.lines.clear()
        self.clock.clear()
        return lines

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._frame(self._rows(key[0], True, self._expired()))

    def close(self) -> None:
        pass


def _packed() -> "F.Column":
    """The ``_FIELDS`` as one text of whole numbers: a row's values are taken over one by one,
    at more than the cost of the action."""
    number = {"action": F.nullif(F.array_position(F.array(*[F.lit(a) for a in _ACTIONS]), F.col("action")), F.lit(0))}
    return F.concat_ws(",", *[F.coalesce((number.get(c, F.col(c))).cast("long").cast("string"), F.lit("")) for c in _FIELDS])


def _unpacked(text: str) -> tuple:
    seq, action, *rest = (int(v) if v else None for v in text.split(","))
    return seq, None if action is None else _ACTIONS[action - 1], *rest


class CartBucketProcessor(CartProcessor):
    """The same for a bucket of sessions, on frames with ``session_id`` and the text ``fields``.

    State: ``carts``, the lines and clocks of the bucket's sessions as columns (``due``: when
    the cart expires, -1 for never), and the bucket's ``timer``, the least ``due``."""

    def init(self, handle) -> None:
        self.handle = handle
        self.carts = handle.getValueState("carts", _CARTS)

    def _read(self) -> tuple[dict, int]:
        """Carts by session, each (cleared, newest, due, lines as columns), and the timer."""
        value = self.carts.get() if self.carts.exists() else None
        if value is None:
            return {}, -1
        *columns, timer = value
        return {session: (cleared, newest, due, line_columns) for session, cleared, newest, due, *line_columns in zip(*columns)}, timer

    def _write(self, carts: dict, timer: int) -> None:
        timer = self._move_timer(timer, min((due for _, _, due, _ in carts.values() if due >= 0), default=-1))
        if carts:
            rows = ((session, *clock, *line_columns) for session, (*clock, line_columns) in carts.items())
            self.carts.update((*map(list, zip(*rows)), timer))
        else:
            self.carts.clear()

    def handleInputRows(self, key, rows, timerValues):
        actions = {}
        for chunk in rows:
            for session, fields in zip(chunk["session_id"].tolist(), chunk["fields"].tolist()):
                actions.setdefault(session if isinstance(session, str) else None, []).append(fields)
        (carts, timer), watermark, out = self._read(), timerValues.getCurrentWatermarkInMs(), []
        for session, texts in actions.items():
            cleared, newest, due, line_columns = carts.get(session, (-1, -1, -1, ((), (), ())))
            lines, cleared, newest, late, _ = self._fold(self._from_columns(*line_columns), cleared, newest, map(_unpacked, texts))
            carts[session] = cleared, newest, self._due(newest, due, watermark), self._columns(lines)
            out += self._rows(session, False, self._held(lines), late)
        self._write(carts, timer)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        (carts, _), watermark, fired = self._read(), timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        gone = [session for session, (_, _, due, _) in carts.items() if due == fired or 0 <= due <= watermark]
        out = [row for session in gone for row in self._rows(session, True, self._held(self._from_columns(*carts.pop(session)[3])))]
        self._write(carts, -1)      # the store drops the timer that fired
        if out:
            yield self._frame(out)


def cart_state(actions: DataFrame, products: DataFrame, event_time, delay: str = "1 hour",
               ttl_ms: int = CART_TTL_MS, buckets: int = CART_BUCKETS) -> DataFrame:
    """Carts of a stream of ``(session_id, seq, action, product_id, quantity, ts)``; ``event_time`` is a Column.

    A bucket's carts are held and rewritten as one value: ``buckets`` follows the number of
    live carts (tens to hundreds a bucket) and stays as it is for a checkpoint's life."""
    actions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    p = products.select(F.col("product_id").alias("_pid"), F.col("stock_quantity").alias("p_stock"),
                        F.col("is_active").alias("p_active"), F.lit(True).alias("p_exists"))
    ev = (actions.withColumn("ts", event_time).withWatermark("ts", delay)
          .join(p, F.col("product_id") == F.col("_pid"), "left")
          .withColumns({"ts_ms": F.unix_millis("ts"), "p_exists": F.coalesce("p_exists", F.lit(False)),
                        "p_active": F.coalesce("p_active", F.lit(False))})
          .select(F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("bucket"), "session_id", _packed().alias("fields"), "ts"))
    return ev.groupBy("bucket").transformWithStateInPandas(CartBucketProcessor(ttl_ms), CART_OUT, "Update", "EventTime")
