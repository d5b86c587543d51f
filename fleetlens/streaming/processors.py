"""State machines over keyed telemetry streams.

Each machine keeps a small state per key and steps through the rows of its key in the order of
event time, however they arrive. :class:`OrderedProcessor` holds rows back until the watermark
has passed them and then releases them sorted, so a stream gives what the batch operator
gives on the same rows, whatever the files, triggers and batches were. Rows behind the watermark come too late
for that: they go to the output flagged ``late`` and change nothing. A key that stays silent for long is closed with a
defined last event and leaves no state behind.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from fleetlens.operators.admission import admit
from fleetlens.operators.incidents import ALERT_HOLD_S, ROUTER_THRESHOLD
from fleetlens.operators.rolling import SAMPLES, interpolate
from fleetlens.operators.slo import RATE_LIMIT, RATE_WINDOW_S, SLA_P95_MS
from fleetlens.streaming.run import CLOSING_US, state_partitions

MICROS = 1_000_000
SILENT_S = 30 * 86400.0  # a key without rows for so long is closed
UNTIMED = -(1 << 63)
SHARDS = 1024  # groups that the keys of a machine are dealt to
OUT_ROWS = 1000  # transcripts that a timer gives at once


def _micros(series: pd.Series) -> list[int]:
    return series.astype("datetime64[us]").astype("int64").tolist()


def _stamp(micros: int | None) -> pd.Timestamp | None:
    return None if micros is None or micros == UNTIMED else pd.Timestamp(micros, unit="us")


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def _to_bytes(pdf: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(pdf, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _from_bytes(body: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(body)).read_pandas()


class OrderedProcessor(StatefulProcessor):
    """Releases the rows of a key in the order of ``ORDER`` once the watermark has passed their time.

    A group is a shard of the keys, as each call and each access to state has a price that a key with few rows would
    not be worth; rows carry their key as JSON in ``key``, and every key of a shard has a machine of its own.
    Rows wait in state as sorted parts, one per batch of rows received, kept by their first and
    last time; a release reads only parts that begin before the watermark, and only parts that overlap
    are held at once. A timer is set for the earliest of: the first waiting row, the time at which a machine
    wants to act if no row comes before (:meth:`wake`), and the end of the patience with a silent key.
    Rows of the closing mark (see :func:`fleetlens.streaming.run.run_to_end`) are ignored.

    A machine gives its state as one tuple of plain values, None for none, and its rows as tuples of ``COLUMNS``;
    ``late`` is added to these.
    """

    ORDER = ["at_us", "seq"]
    OUTPUT = ""
    COLUMNS: list[str] = []
    silent_us: int | None = int(SILENT_S * MICROS)
    keys: Sequence[str] = ()

    def step(self, key, rows: pd.DataFrame, state: tuple | None) -> tuple[list[tuple], tuple | None]:
        """Rows of the output and the state after ``rows``, sorted and before the watermark."""
        raise NotImplementedError

    def late(self, key, rows: pd.DataFrame) -> list[tuple]:
        """Output for rows that came too late."""
        raise NotImplementedError

    def silent(self, key, state: tuple, at_us: int) -> list[tuple]:
        """The last rows of a key that was silent until ``at_us``."""
        return []

    def wake(self, state: tuple) -> int | None:
        """When the machine acts if no row comes before."""
        return None

    def woken(self, key, state: tuple) -> tuple[list[tuple], tuple | None]:
        """What it does then."""
        return [], state

    @classmethod
    def output(cls) -> str:
        return cls.OUTPUT + ", late boolean"

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "from_us bigint, to_us bigint, part bigint", "rows binary")
        self.machine = handle.getValueState("machine", "states string")
        self.clock = handle.getValueState("clock", "due_ms bigint, parts bigint")

    def close(self) -> None:
        pass

    def _key(self, text: str) -> tuple:
        fields = json.loads(text)
        return tuple(fields.get(k) for k in self.keys)

    def _out(self, rows: list[tuple], late: bool = False) -> pd.DataFrame:
        made = _frame(rows, self.COLUMNS).assign(late=late)
        for i, (name, kind) in enumerate(f.split() for f in self.OUTPUT.split(", ")):
            if kind in ("int", "bigint"):  # missing ones would make doubles of the others
                made[name] = pd.Series([r[i] for r in rows], dtype=object)
        return made

    @staticmethod
    def _by_key(rows: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
        codes, names = pd.factorize(rows["key"])
        order = np.argsort(codes, kind="stable")
        rows = rows.iloc[order]
        ends = np.cumsum(np.bincount(codes, minlength=len(names))).tolist()
        for name, a, b in zip(names, [0, *ends], ends):
            yield name, rows.iloc[a:b]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = self._passed(timerValues)
        due, parts = self.clock.get() if self.clock.exists() else (None, 0)
        for pdf in rows:
            pdf = pdf[pdf["at_us"] < CLOSING_US]
            behind = (pdf["at_us"] < passed) | (pdf["at_us"] == UNTIMED)
            if behind.any():
                yield self._out([r for k, mine in self._by_key(pdf[behind]) for r in self.late(self._key(k), mine)], late=True)
                pdf = pdf[~behind]
            if len(pdf):
                at = pdf["at_us"].to_numpy()
                self.waiting.updateValue((int(at.min()), int(at.max()), parts), (_to_bytes(pdf),))
                parts += 1
        yield from self._advance(passed, due, parts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.clock.exists():
            due, parts = self.clock.get()
            expired = expiredTimerInfo.getExpiryTimeInMs()
            yield from self._advance(self._passed(timerValues), None if due == expired else due, parts)
        else:
            yield self._out([])

    @staticmethod
    def _passed(timerValues) -> int:
        ms = timerValues.getCurrentWatermarkInMs()
        return ms * 1000 if ms > 0 else UNTIMED

    def _released(self, passed: int, parts: int) -> Iterator[pd.DataFrame]:
        """Rows before ``passed`` in order; the rest of a part that is only partly due goes back."""
        keys = sorted(tuple(k) for k in self.waiting.keys())
        at = 0
        while at < len(keys) and keys[at][0] < passed:
            end, reach = at + 1, keys[at][1]
            while end < len(keys) and keys[end][0] <= reach:
                reach = max(reach, keys[end][1])
                end += 1
            rows = pd.concat([_from_bytes(self.waiting.getValue(k)[0]) for k in keys[at:end]], ignore_index=True)
            rows = rows.sort_values(self.ORDER, kind="stable", ignore_index=True)
            for k in keys[at:end]:
                self.waiting.removeKey(k)
            due = int(np.searchsorted(rows["at_us"].to_numpy(), passed))
            if due < len(rows):
                rest = rows.iloc[due:]
                self.waiting.updateValue((int(rest["at_us"].iloc[0]), reach, keys[at][2]), (_to_bytes(rest),))
            yield rows.iloc[:due]
            at = end

    def _advance(self, passed: int, due: int | None, parts: int) -> Iterator[pd.DataFrame]:
        states: dict[str, list] = json.loads(self.machine.get()[0]) if self.machine.exists() else {}
        for rows in self._released(passed, parts):
            out: list[tuple] = []
            for name, mine in self._by_key(rows):
                out += self._stepped(name, mine, states)
            yield self._out(out)
        out = []
        for name, (state, last) in list(states.items()):
            key = self._key(name)
            if (when := self.wake(state)) is not None and when <= passed:
                made, state = self.woken(key, state)
                out += made
            if state is not None and self.silent_us is not None and last + self.silent_us < passed:
                out, state = [*out, *self._closed(key, state, last)], None
            if state is None:
                del states[name]
            else:
                states[name] = [state, last]
        yield self._out(out)
        if states:
            self.machine.update((json.dumps(states),))
        else:
            self.machine.clear()
        self._set_timer(due, self._next(states), parts)

    def _stepped(self, name: str, rows: pd.DataFrame, states: dict[str, list]) -> list[tuple]:
        """Rows of the output for released rows of one key, whose state is replaced."""
        key = self._key(name)
        state, last = states.pop(name, (None, None))
        out: list[tuple] = []
        at = rows["at_us"].to_numpy()
        before = np.concatenate(([at[0] if last is None else last], at[:-1]))
        gaps = [] if self.silent_us is None else np.flatnonzero(at - before > self.silent_us).tolist()
        bounds = [0, *[g for g in gaps if g], len(at)]
        for a, b in zip(bounds, bounds[1:]):
            if a in gaps:
                out, state = [*out, *self._closed(key, state, int(before[a]))], None
            made, state = self.step(key, rows.iloc[a:b], state)
            out += made
        if state is not None:
            states[name] = [state, int(at[-1])]
        return out

    def _closed(self, key, state: tuple | None, last: int) -> list[tuple]:
        """What a machine does on its own until the silence ends it."""
        if state is None:
            return []
        made: list[tuple] = []
        end = last + self.silent_us
        if (when := self.wake(state)) is not None and when <= end:
            made, state = self.woken(key, state)
        return made if state is None else [*made, *self.silent(key, state, end)]

    def _next(self, states: dict[str, list]) -> int | None:
        times = [k[0] // 1000 + 1 for k in self.waiting.keys()]
        for state, last in states.values():
            if (when := self.wake(state)) is not None:
                times.append(-(-when // 1000))
            if self.silent_us is not None:
                times.append((last + self.silent_us) // 1000 + 1)
        return min(times, default=None)

    def _set_timer(self, due: int | None, now: int | None, parts: int) -> None:
        if due is not None and due != now:
            self.handle.deleteTimer(due)
        if now is None:
            self.clock.clear()
            return
        if due != now:
            self.handle.registerTimer(now)
        self.clock.update((now, parts))


def _columns(rows: pd.DataFrame, *names: str) -> Iterator[tuple]:
    return zip(*[rows[n].tolist() for n in names])


class OutageProcessor(OrderedProcessor):
    """FAILOVER at the threshold of consecutive failures, RESPAWN on the recovery after.

    An outage that a silent node leaves open ends in SILENT, with the time it lasted until then.
    """

    OUTPUT = "cluster_id int, node int, event string, ts timestamp, seq bigint, downtime_s double"
    COLUMNS = ["cluster_id", "node", "event", "ts", "seq", "downtime_s"]

    def __init__(self, threshold: int = ROUTER_THRESHOLD, silent_s: float = SILENT_S) -> None:
        self.threshold = threshold
        self.silent_us = int(silent_s * MICROS)

    def step(self, key, rows, state):
        failures, outage = state or (0, None)
        out = []
        for at, seq, healthy in _columns(rows, "at_us", "seq", "healthy"):
            if healthy:
                if outage is not None:
                    out.append((*key, "RESPAWN", _stamp(at), seq, (at - outage) / MICROS))
                failures, outage = 0, None
                continue
            failures += 1
            if failures == self.threshold:
                outage = at
                out.append((*key, "FAILOVER", _stamp(at), seq, None))
        return out, ((failures, outage) if failures else None)

    def late(self, key, rows):
        return [(*key, None, _stamp(at), seq, None) for at, seq in _columns(rows, "at_us", "seq")]

    def silent(self, key, state, at_us):
        return [] if state[1] is None else [(*key, "SILENT", _stamp(at_us), None, (at_us - state[1]) / MICROS)]


class RtoProcessor(OrderedProcessor):
    """Seconds from a pending failover to the first retry, which consumes it.

    A failover that nobody retries until its cluster has long been silent gives a row without a retrying node and time.
    """

    OUTPUT = "cluster_id int, ts timestamp, node int, failed_node int, elapsed_seconds double"
    COLUMNS = ["cluster_id", "ts", "node", "failed_node", "elapsed_seconds"]

    def __init__(self, silent_s: float = SILENT_S) -> None:
        self.silent_us = int(silent_s * MICROS)

    def step(self, key, rows, state):
        out = []
        for at, event, node in _columns(rows, "at_us", "event", "node"):
            if event == "FAILOVER":
                state = (at, node)
            elif event == "RETRY" and state is not None:
                out.append((*key, _stamp(at), node, state[1], (at - state[0]) / MICROS))
                state = None
        return out, state

    def late(self, key, rows):
        return [(*key, _stamp(at), node, None, None) for at, node in _columns(rows, "at_us", "node")]

    def silent(self, key, state, at_us):
        return [(*key, _stamp(at_us), None, state[1], None)]


class SlaProcessor(OrderedProcessor):
    """p95 of the last samples per node and whether it is within target, whenever samples are released."""

    OUTPUT = "cluster_id int, node int, seq bigint, samples int, latency_p95_ms double, sla_ok boolean"
    COLUMNS = ["cluster_id", "node", "seq", "samples", "latency_p95_ms", "sla_ok"]

    def __init__(self, target_ms: float = SLA_P95_MS, size: int = SAMPLES, silent_s: float = SILENT_S) -> None:
        self.target_ms = target_ms
        self.size = size
        self.silent_us = int(silent_s * MICROS)

    def step(self, key, rows, state):
        kept = (list(state[0]) if state else []) + rows["latency_ms"].dropna().tail(self.size).tolist()
        kept = kept[-self.size :]
        p95 = interpolate(sorted(kept), 0.95) if kept else 0.0
        ok = self.target_ms <= 0 or not kept or p95 <= self.target_ms
        return [(*key, int(rows["seq"].iloc[-1]), len(kept), p95, ok)], (kept,)

    def late(self, key, rows):
        return [(*key, seq, None, None, None) for (seq,) in _columns(rows, "seq")]


class AlertHoldProcessor(OrderedProcessor):
    """One firing event per run of zero status that lasts the hold time.

    A status holds until the next sample says otherwise, so a run fires at its start
    plus the hold, either when a later sample shows it lasted or when the watermark
    passes that time without one.
    """

    OUTPUT = "cluster_id int, node int, zero_since timestamp, firing_ts timestamp"
    COLUMNS = ["cluster_id", "node", "zero_since", "firing_ts"]

    def __init__(self, hold_s: float = ALERT_HOLD_S, silent_s: float = SILENT_S) -> None:
        self.hold_us = int(hold_s * MICROS)
        self.silent_us = int(max(silent_s, hold_s) * MICROS)

    def _event(self, key, since: int) -> tuple:
        return (*key, _stamp(since), _stamp(since + self.hold_us))

    def step(self, key, rows, state):
        since, fired = state or (None, False)
        out = []
        for at, value in _columns(rows, "at_us", "value"):
            if since is not None and not fired and at >= since + self.hold_us:
                out.append(self._event(key, since))
                fired = True
            if value != 0:
                since, fired = None, False
            elif since is None:
                since, fired = at, False
        return out, (None if since is None else (since, fired))

    def late(self, key, rows):
        return [(*key, _stamp(at), None) for (at,) in _columns(rows, "at_us")]

    def wake(self, state):
        return None if state[1] else state[0] + self.hold_us

    def woken(self, key, state):
        return [self._event(key, state[0])], (state[0], True)


class RateLimitProcessor(OrderedProcessor):
    """Accept or reject each request by the accepted ones in the trailing window.

    A key is forgotten once it has been silent for the window, when nothing counts any more.
    """

    ORDER = ["at_us", "request_id"]
    OUTPUT = "api_key_id bigint, request_id bigint, ts timestamp, accepted boolean"
    COLUMNS = ["api_key_id", "request_id", "ts", "accepted"]

    def __init__(self, limit: int = RATE_LIMIT, window_s: float = RATE_WINDOW_S) -> None:
        self.limit = limit
        self.window_us = self.silent_us = int(window_s * MICROS)

    def step(self, key, rows, state):
        accepted = deque(state[0] if state else ())
        labels = admit(rows["at_us"].to_numpy(), accepted, self.limit, self.window_us)
        out = [(*key, r, _stamp(at), bool(ok)) for (at, r), ok in zip(_columns(rows, "at_us", "request_id"), labels)]
        return out, ((list(accepted),) if accepted else None)

    def late(self, key, rows):
        return [(*key, r, _stamp(at), None) for at, r in _columns(rows, "at_us", "request_id")]


class JobStateProcessor(OrderedProcessor):
    """The newest status per job, emitted whenever a release brings one."""

    OUTPUT = "job_id bigint, status string, ts timestamp, seq bigint"
    COLUMNS = ["job_id", "status", "ts", "seq"]

    def __init__(self, silent_s: float = SILENT_S) -> None:
        self.silent_us = int(silent_s * MICROS)

    def step(self, key, rows, state):
        at, seq, status = next(_columns(rows.tail(1), "at_us", "seq", "ray_status"))
        return [(*key, status, _stamp(at), seq)], (at,)

    def late(self, key, rows):
        return [(*key, status, _stamp(at), seq) for at, seq, status in _columns(rows, "at_us", "seq", "ray_status")]


def event_delta(line: str) -> str | None:
    """Text delta of one event line, None for anything else."""
    line = line.strip()
    if not line.startswith("data: "):
        return None
    data = line[len("data: ") :].strip()
    if data == "[DONE]":
        return None
    try:
        token = json.loads(data)["choices"][0]["delta"]["content"]
    except (ValueError, LookupError, TypeError):
        return None
    return token if isinstance(token, str) and token else None


class _Response:
    """A streamed response as far as its chunks have come; ``found`` are tokens that are not in state yet."""

    def __init__(self, request: str | None, last: int, fields: Sequence | None) -> None:
        self.request, self.last, self.closed = request, last, fields is None
        self.begin, self.token, self.partial, self.parts = fields or (None, None, "", 0)
        self.found: list[str] = []
        self.seq = None
        self.done = False

    def fields(self) -> tuple | None:
        return None if self.closed else (self.begin, self.token, self.partial, self.parts)

    def read(self, seq, at: int, chunk: str) -> None:
        """The next chunk, checked to come in the order of ``seq``."""
        if seq != seq or (self.seq is not None and seq < self.seq):
            raise ValueError("rows of a key must arrive sorted by seq")
        self.seq, self.last = seq, at
        *lines, self.partial = (self.partial + chunk).split("\n")
        for line in lines:
            self.add(event_delta(line))
            self.done = self.done or line.strip() == "data: [DONE]"

    def add(self, delta: str | None) -> None:
        if delta is not None and not self.closed:
            self.found.append(delta)
            self.token = self.last if self.token is None else self.token


class TranscriptProcessor(StatefulProcessor):
    """Text and timing of each streamed response, closed by [DONE] or by silence.

    A group is a shard of the responses, as in :class:`OrderedProcessor`. ``responses`` lists those of a shard that are
    not silent yet, closed ones too, so that chunks after [DONE] start no second transcript; ``pieces`` has the text of those
    that a batch left open, one entry per batch. The timer of a shard is that of the response that is silent first.
    """

    OUTPUT = (
        "request_id string, text string, output_tokens bigint, ttft_ms double, "
        "latency_ms double, tokens_per_s double"
    )
    COLUMNS = ["request_id", "text", "output_tokens", "ttft_ms", "latency_ms", "tokens_per_s"]

    def __init__(self, timeout_s: float = 600.0) -> None:
        self.timeout_us = int(timeout_s * MICROS)

    def init(self, handle) -> None:
        self.handle = handle
        self.responses = handle.getValueState("responses", "responses string")
        self.pieces = handle.getMapState("pieces", "request_id string, part bigint", "tokens bigint, text string")

    def _known(self) -> dict[str | None, tuple]:
        """Time of the last chunk and other fields by response; closed ones have no other fields."""
        known = json.loads(self.responses.get()[0]) if self.responses.exists() else []
        return {request: (last, fields) for request, last, fields in known}

    def _keep(self, known: dict[str | None, tuple], due: int | None) -> None:
        """Put the responses back and replace the timer at ``due``."""
        now = self._due(known)
        if due is not None and due != now:
            self.handle.deleteTimer(due)
        if now is None:
            self.responses.clear()
            return
        if due != now:
            self.handle.registerTimer(now)
        self.responses.update((json.dumps([(request, *rest) for request, rest in known.items()]),))

    def _silent_ms(self, last: int) -> int:
        return -(-(last + self.timeout_us) // 1000)

    def _due(self, known: dict[str | None, tuple]) -> int | None:
        return self._silent_ms(min(last for last, _ in known.values())) if known else None

    def _finish(self, response: _Response) -> tuple:
        keys = [(response.request, part) for part in range(response.parts)]
        stored = [self.pieces.getValue(k) for k in keys]
        for k in keys:
            self.pieces.removeKey(k)
        count = sum(tokens for tokens, _ in stored) + len(response.found)
        latency = (response.last - response.begin) / 1000.0
        ttft = None if response.token is None else (response.token - response.begin) / 1000.0
        rate = count / (latency / 1000.0) if latency > 0 else 0.0
        return response.request, "".join([*(text for _, text in stored), *response.found]), count, ttft, latency, rate

    def _leave(self, response: _Response, known: dict[str | None, tuple]) -> list[tuple]:
        """Rows of the output and the state of a response after its chunks of a batch."""
        out = []
        if response.done and not response.closed:
            out.append(self._finish(response))
            response.closed = True
        elif response.found:
            self.pieces.updateValue((response.request, response.parts), (len(response.found), "".join(response.found)))
            response.parts += 1
        known[response.request] = (response.last, response.fields())
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        due = self._due(known)
        response = None
        for pdf in rows:
            out = []
            times = _micros(pdf["ts"])
            started = _micros(pdf["started_at"]) if "started_at" in pdf else times
            for request, seq, at, begin, chunk in zip(pdf["request_id"].tolist(), pdf["seq"].tolist(), times, started, pdf["chunk"].tolist()):
                if response is None or request != response.request:
                    out += [] if response is None else self._leave(response, known)
                    response = _Response(request, *known.get(request, (at, (begin, None, "", 0))))
                response.read(seq, at, chunk)
            yield _frame(out, self.COLUMNS)
        if response is not None:
            yield _frame(self._leave(response, known), self.COLUMNS)
        self._keep(known, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        due, expired = self._due(known), expiredTimerInfo.getExpiryTimeInMs()
        passed = timerValues.getCurrentWatermarkInMs()
        out: list[tuple] = []
        for request, (last, fields) in list(known.items()):
            if self._silent_ms(last) > passed:
                continue
            del known[request]
            response = _Response(request, last, fields)
            if not response.closed:
                response.add(event_delta(response.partial))
                out.append(self._finish(response))
            if len(out) == OUT_ROWS:
                yield _frame(out, self.COLUMNS)
                out = []
        yield _frame(out, self.COLUMNS)
        self._keep(known, None if due == expired else due)

    def close(self) -> None:
        pass


def shard(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).cast("int").alias("shard")


def ordered(
    stream: DataFrame, keys: Sequence[str], columns: Sequence[str], processor: OrderedProcessor, lateness: str
) -> DataFrame:
    """Run an ordered machine over a stream with ``ts``, which may be late by ``lateness``.

    The time travels as a number of its own: Spark would drop late rows by the event-time column
    before the processor could flag them.
    """
    at = F.coalesce(F.unix_micros("ts"), F.lit(UNTIMED)).alias("at_us")
    rows = stream.withWatermark("ts", lateness).select(shard(*keys), F.to_json(F.struct(*keys)).alias("key"), at, *columns)
    processor.keys = list(keys)
    return keyed(rows, ["shard"], processor, processor.ORDER, event_time=True)


def keyed(
    stream: DataFrame,
    keys: list[str],
    processor: StatefulProcessor,
    order: Sequence[str] = ("ts", "seq"),
    *,
    event_time: bool = False,
) -> DataFrame:
    """Run a processor over a stream grouped by ``keys``, rows in ``order``.

    The stateful operator needs its input partitioned and sorted by the keys. Doing both
    here with the order columns added lets Spark's external sort put the rows of a key in
    order at no extra exchange. (Keys must be real columns: Spark folds literals out of the
    first sort and would sort again.) Spark's check rejects any sort of a stream, though one
    within a partition is harmless, so such queries are started with the settings of
    :func:`fleetlens.streaming.run.stateful_settings`.
    """
    width = state_partitions(stream.sparkSession)
    by_key = stream.repartition(width, *keys).sortWithinPartitions(*keys, *order)
    schema = processor.output() if isinstance(processor, OrderedProcessor) else processor.OUTPUT
    return by_key.groupBy(*keys).transformWithStateInPandas(
        processor, schema, "Append", "EventTime" if event_time else "None"
    )
