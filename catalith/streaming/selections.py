"""Selections as keyed state: requests stream in, each selection expires by an event-time timer.

A request sees a selection up to the very moment of its expiry, by the request's own time; the timer clears what the watermark
has passed. Requests of one micro-batch on a selection are taken in the order of their time, then of their number."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from catalith.session import ship

REQUESTS = (
    "request_id long, at timestamp, owner_id string, kind string, id string, instance_id string, printing_id string, "
    "is_foil boolean, language string, condition string, confidence double, allow_duplicate boolean, known boolean"
)
ANSWERS = "request_id long, at timestamp, id string, kind string, outcome string, cards int"
STATE = "owner_id string, expires_us long, cards string"
TTL = dt.timedelta(days=7)


def micros(at: pd.Timestamp) -> int:
    return int(pd.Timestamp(at).value // 1000)


def answered(state: tuple | None, requests: Iterable, ttl: dt.timedelta = TTL) -> tuple[tuple | None, list[tuple]]:
    """State (owner, expiry in microseconds, cards) and (request_id, at, kind, outcome, cards) after requests in their order.

    kind: create, get, add (known: whether the printing is; a clash without allow_duplicate is a conflict) or remove."""
    out = []
    for r in requests:
        seen = state is not None and state[0] == r.owner_id and micros(r.at) <= state[1]
        cards = state[2] if state else []
        result = "Ok" if seen else "NotFound"
        if r.kind == "create":
            result = "Conflict" if state is not None and micros(r.at) <= state[1] else "Ok"
            if result == "Ok":
                state, cards = (r.owner_id, micros(r.at) + ttl // dt.timedelta(microseconds=1), []), []
        elif seen and r.kind == "add":
            language = r.language or "en"
            same = [c for c in cards if c[1] == r.printing_id and c[2] == bool(r.is_foil) and c[3].upper() == language.upper()]
            if not r.known:
                result = "Invalid"
            elif same and not r.allow_duplicate:
                result = "Conflict"
            else:
                cards = [*cards, [r.instance_id, r.printing_id, bool(r.is_foil), language, r.condition or "NM", min(1.0, max(0.0, r.confidence or 0.0))]]
        elif seen and r.kind == "remove":
            rest = [c for c in cards if c[0] != r.instance_id]
            result, cards = ("NotFound", cards) if len(rest) == len(cards) else ("Ok", rest)
        if seen:
            state = (state[0], state[1], cards)
        out.append((r.request_id, r.at, r.kind, result, len(cards) if result == "Ok" else None))
    return state, out


def selection_stream(requests: DataFrame, delay: str = "1 hour", ttl: dt.timedelta = TTL) -> DataFrame:
    """Answers to a stream of REQUESTS, and a row of kind 'expired' without a request for each selection whose timer went off.

    The state of a selection is held until the watermark (delay behind the latest request) has passed its expiry."""
    ship(requests.sparkSession)

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        from catalith.streaming.selections import answered

        def table(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["request_id", "at", "id", "kind", "outcome", "cards"]).astype({"request_id": "Int64", "cards": "Int32"})

        def expired(until: int, cards: list) -> tuple:
            return None, pd.Timestamp(until, unit="us"), key[0], "expired", "Expired", len(cards)

        before = None
        if state.exists:
            owner, until, cards = state.get
            before = (owner, until, json.loads(cards))
        if state.hasTimedOut:
            state.remove()
            yield table([expired(*before[1:])])
            return
        rows = pd.concat(list(batches)).sort_values(["at", "request_id"]).astype(object)
        after, answers = answered(before, rows.where(rows.notna(), None).itertuples(index=False), ttl)
        out = [(i, at, key[0], kind, result, n) for i, at, kind, result, n in answers]
        if after is not None and after[1] // 1000 < state.getCurrentWatermarkMs():
            out.append(expired(*after[1:]))  # requests came in place of the timer
            if state.exists:
                state.remove()
        elif after is not None:
            state.update((after[0], after[1], json.dumps(after[2])))
            state.setTimeoutTimestamp(after[1] // 1000 + 1)
        yield table(out)

    timed = requests.withWatermark("at", delay)
    return timed.groupBy("id").applyInPandasWithState(work, ANSWERS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
