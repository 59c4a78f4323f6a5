"""Review logs as versions: what each event changed, the state before any event, and logs of sources that have changed.

A log is folded once. Each event yields the few entries that it changed
(``changes``), and an undo yields the entries that it restored, so the changes
grow with the log and hold no copies of a state. A state at any place of the log
is then the last change of each entry before it: one aggregation.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import batched, chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions.shared import spread

ACTIONS = ("associate", "correct", "insert", "discard", "later", "remove", "replace")
CHANGES = "song_id string, n long, seq long, kind string, id long, body string"


class Session:
    """Blocks and decisions of one song; every change is an entry (kind, id) set to a value, and is undone by setting it back.

    Spans stand sorted, with counts of those without length and of neighbours that overlap, so a change costs the search
    for its place."""

    def __init__(self, blocks: dict[int, dict]):
        self.entries = {"block": {}, "decision": {}}
        self.spans: list[tuple[int, int, int]] = []
        self.flat = self.crossed = 0
        self.associated: dict[int, set[int]] = {}
        self.history: list[list[tuple[str, int, object]]] = []
        for k, b in blocks.items():
            self._set("block", k, b)

    def _over(self, i: int) -> int:
        return int(0 <= i < len(self.spans) - 1 and self.spans[i][1] > self.spans[i + 1][0])

    def _move(self, old: dict | None, new: dict | None, k: int) -> None:
        if old is not None:
            span = (old["start_ms"], old["end_ms"], k)
            i = bisect_left(self.spans, span)
            self.crossed -= self._over(i - 1) + self._over(i)
            del self.spans[i]
            self.crossed += self._over(i - 1)
            self.flat -= span[0] >= span[1]
        if new is not None:
            span = (new["start_ms"], new["end_ms"], k)
            i = bisect_left(self.spans, span)
            self.crossed -= self._over(i - 1)
            insort(self.spans, span)
            self.crossed += self._over(i - 1) + self._over(i)
            self.flat += span[0] >= span[1]

    def _set(self, kind: str, k: int, value) -> tuple[str, int, object]:
        """Sets an entry (None: takes it away) and returns what sets it back."""
        old = self.entries[kind].get(k)
        if kind == "block":
            self._move(old, value, k)
        else:
            for d, change in ((old, set.discard), (value, set.add)):
                if d is not None and d["action"] == "associate":
                    change(self.associated.setdefault(d["block"], set()), k)
        if value is None:
            self.entries[kind].pop(k, None)
        else:
            self.entries[kind][k] = value
        return kind, k, old

    def apply(self, e: dict) -> tuple[list[tuple[str, int]], str | None]:
        """The entries that an event changed, or the rule that it breaks; then nothing is changed."""
        action, block, item = e["action"], e.get("block"), e.get("item")
        if action == "undo":
            if not self.history:
                return [], "nothing_to_undo"
            back = self.history.pop()
            for kind, k, old in reversed(back):
                self._set(kind, k, old)
            return list(dict.fromkeys((kind, k) for kind, k, _ in back)), None
        if action not in ACTIONS:
            return [], "unknown_action"
        if action in ("correct", "remove", "replace", "associate") and block not in self.entries["block"]:
            return [], "unknown_block"
        done = []
        if action == "correct":
            done.append(self._set("block", block, self.entries["block"][block] | {"text": e["text"]}))
        elif action in ("insert", "replace"):
            done.append(self._set("block", block, {"start_ms": e["start_ms"], "end_ms": e["end_ms"], "text": e["text"]}))
        elif action == "remove":
            done.append(self._set("block", block, None))
            for k in sorted(self.associated.get(block, ())):
                done.append(self._set("decision", k, {"action": "later", "block": None}))
        if item is not None:
            done.append(self._set("decision", item, {"action": action, "block": block}))
        rule = "end_not_after_start" if self.flat else "overlap" if self.crossed else None
        if rule:
            for kind, k, old in reversed(done):
                self._set(kind, k, old)
            return [], rule
        self.history.append(done)
        return list(dict.fromkeys((kind, k) for kind, k, _ in done)), None


def changes(blocks: DataFrame, events: DataFrame) -> DataFrame:
    """(song_id, n, seq, kind, id, body): what each event of a log changed, n counts on within a song.

    blocks: song_id, block, start_ms, end_ms, text; events: song_id, seq, action, item, block, start_ms, end_ms, text.
    kind is block or decision (body: the new value as JSON, null: gone) or problem (id: the seq of an event that breaks a
    rule and changes nothing). Blocks that stand before the log are changes with n 0 and without seq. What is held of a
    song is its state and what undoes its log."""

    def told(song: str | None, session: Session, log: Iterator[dict]) -> Iterator[tuple]:
        for k, v in sorted(session.entries["block"].items()):
            yield song, 0, None, "block", k, _body(v)
        n = 0
        for e in log:
            changed, rule = session.apply(e)
            if rule is not None:
                n += 1
                yield song, n, e["seq"], "problem", e["seq"], json.dumps({"rule": rule})
            for kind, k in changed:
                n += 1
                value = session.entries[kind].get(k)
                yield song, n, e["seq"], kind, k, None if value is None else _body(value)

    return _replayed(blocks, events, told, CHANGES)


def final_state(blocks: DataFrame, events: DataFrame) -> DataFrame:
    """(song_id, kind, id, body): ``latest`` of ``changes``, told at the end of each log: no change leaves the task that folds it."""

    def told(song: str | None, session: Session, log: Iterator[dict]) -> Iterator[tuple]:
        broken = {}
        for e in log:
            rule = session.apply(e)[1]
            if rule is not None:
                broken[e["seq"]] = json.dumps({"rule": rule})
        for kind, entries in session.entries.items():
            for k, value in entries.items():
                yield song, kind, k, _body(value)
        for seq, body in broken.items():
            yield song, "problem", seq, body

    return _replayed(blocks, events, told, "song_id string, kind string, id long, body string")


def _body(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False)


def _replayed(blocks: DataFrame, events: DataFrame, told: Callable[[str | None, Session, Iterator[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """What ``told`` tells of each song, from a session with its blocks and its events in order.

    Blocks and events stand sorted by song in one table, and a task goes through the rows of all its songs once: a song costs
    its rows and no call of its own. Events are dear by row and small by bytes, so songs are dealt over a given number of tasks."""
    none = F.lit(None)

    def side(df: DataFrame, number: int, **given: Column) -> DataFrame:
        take = lambda c, kind: given.get(c, F.col(c) if c in df.columns else none).cast(kind).alias(c)
        return df.select(take("song_id", "string"), F.lit(number).alias("_side"), take("seq", "long"), take("action", "string"), *(take(c, "long") for c in ("item", "block", "start_ms", "end_ms")), take("text", "string"))

    rows = side(blocks, 0, seq=none, action=none, item=none).unionByName(side(events, 1))
    dealt = rows.repartition(spread(blocks.sparkSession), "song_id").sortWithinPartitions("song_id", "_side", F.col("seq").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (r for b in batches for r in b.to_pylist())
        for part in batched((x for song, own in groupby(read, lambda r: r["song_id"]) for x in _told_of(song, own, told)), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds, strict=True)], names)

    names, kinds = zip(*((name, {"long": pa.int64(), "string": pa.string()}[kind]) for name, kind in map(str.split, schema.split(", "))), strict=True)
    return dealt.mapInArrow(run, schema)


def _told_of(song: str | None, rows: Iterator[dict], told) -> Iterator[tuple]:
    first, event = {}, None
    for r in rows:
        if r["_side"]:
            event = r
            break
        first[r["block"]] = {"start_ms": r["start_ms"], "end_ms": r["end_ms"], "text": r["text"]}
    yield from told(song, Session(first), chain([event] if event else [], rows))


def latest(changed: DataFrame, more: list[str] | None = None) -> DataFrame:
    """(song_id, ..., kind, id, body): the state after all of ``changed``; problems stay as they are."""
    key = ["song_id", *(more or []), "kind", "id"]
    return changed.groupBy(*key).agg(F.max_by("body", "n").alias("body")).where(F.col("body").isNotNull())


def state_before(changed: DataFrame, points: DataFrame) -> DataFrame:
    """(song_id, at, kind, id, body): blocks and decisions of a song as they were before the event with seq ``at``.

    points: song_id, at. Any number of places of a log can be asked for at once; what is joined is the log's changes, not states."""
    some = changed.where("kind <> 'problem'").join(points.select("song_id", "at").distinct(), "song_id")
    return latest(some.where(F.col("seq").isNull() | (F.col("seq") < F.col("at"))), ["at"])


def epochs(events: DataFrame, current: DataFrame) -> DataFrame:
    """``events`` with ``live``: whether an event may be applied to the sources as they now are.

    events: song_id, epoch, sources (the identity of what they were made on), ...; current: song_id, sources. Only the last
    epoch of a song can be live, and only while its sources are the current ones. An epoch that was left stays archived,
    even if its sources come back: decisions on other sound are never applied again."""
    newest = F.max("epoch").over(W.partitionBy("song_id"))
    now = current.select("song_id", F.col("sources").alias("_now"))
    live = (F.col("epoch") == newest) & F.coalesce(F.col("sources") == F.col("_now"), F.lit(False))
    return events.join(now, "song_id", "left").withColumn("live", live).drop("_now")


def next_epochs(events: DataFrame, current: DataFrame) -> DataFrame:
    """(song_id, epoch, sources, archived): the epoch that new decisions of each current song carry, and how many events lie in the archive."""
    told = epochs(events, current).groupBy("song_id").agg(F.max("epoch").alias("last"), F.bool_or("live").alias("live"), F.count_if(~F.col("live")).alias("archived"))
    epoch = F.when(F.col("live"), F.col("last")).otherwise(F.coalesce(F.col("last") + 1, F.lit(1)))
    return current.join(told, "song_id", "left").select("song_id", epoch.cast("long").alias("epoch"), "sources", F.coalesce("archived", F.lit(0)).cast("long").alias("archived"))


def archive(events: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live, archived): the events that are applied, and those that are only kept."""
    told = epochs(events, current)
    return told.where("live").drop("live"), told.where("not live").drop("live")
