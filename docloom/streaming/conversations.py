"""Conversations as keyed state, and work that is called off while it runs.

A conversation keeps what it is about, whether its last question went unanswered, and what has come in but
not yet had its turn: rows wait until the watermark passes them, so they are taken in the order of their
times however batches cut them. Timers, not rows, make time pass; what is forgotten leaves no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How follow-ups open, and how questions and requests do. Anything else is told.
FOLLOWS = r"(?i)^\s*(?:و\s*(?:كم|ما|ماذا|متى|هل|لماذا|ليش|اين|أين|كيف|من|ايش|إيش|شو|بالنسبة)|طيب|طب|يعني|ماذا عن|وماذا عن|(?:and|what about|how about)(?:$|[^\p{L}\p{N}_]))"
ASKS = (
    r"(?i)[?؟]|^\s*(?:و\s*)?(?:what|which|who|whom|whose|when|where|why|how|is|are|was|were|do|does|did|can|could|would|will|should|shall|may|list|show|give|tell|find|compare|explain|summari[sz]e|"
    r"calculate|get|provide|send|make|export|ما|ماذا|ماهو|ماهي|كم|هل|متى|أين|اين|كيف|لماذا|لم|من|أي|اي|ايش|إيش|شو|فين|امتى|إمتى|ازاي|إزاي|ليه|هات|هاتلي|اعطني|أعطني|اذكر|عدد|عدّد|وضح|وضّح|اشرح|لخص|لخّص|"
    r"قارن|احسب|اعرض|ابحث|ابعت|اعمل|طلع|عايز|عاوز|أريد|اريد|ابغى|أبغى|ممكن|لو\s+سمحت)(?:$|[^\p{L}\p{N}_])"
)
#: How late a row may be, for how many microseconds a conversation is remembered, and how long a cancellation holds.
LATE, REMEMBERED, HOLDS = "10 minutes", 30 * 60 * 1_000_000, "1 hour"
TURN = "turn long, us long, follows boolean, tells boolean, answered boolean"
SAID = "conv_id long, turn long, kind string, subject long, clarifies boolean"


def follows(text: Column, own_words: Column) -> Column:
    """A question that leans on the one before: by its opening, or as it has no word of its own but one."""
    return text.rlike(FOLLOWS) | (own_words <= 1)


def tells(text: Column) -> Column:
    """Neither a question nor a request: what a reader adds to the question before."""
    return ~text.rlike(ASKS)


class Conversation(StatefulProcessor):
    """One conversation: each turn is fresh, a follow-up, or told in answer to an open question."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "subject long, last long, open boolean")
        self.waiting = handle.getListState("waiting", TURN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            new = [(int(r.turn), int(r.us), bool(r.follows), bool(r.tells), bool(r.answered)) for r in part.itertuples()]
            for _, us, *_ in new:
                self.handle.registerTimer(-(-us // 1000))
            if new:
                self.waiting.appendList(new)
        yield _said([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        out = []
        turns = list(self.waiting.get()) if self.waiting.exists() else []
        due, later = [t for t in turns if t[1] <= now], [t for t in turns if t[1] > now]
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        for turn, us, leans, told, answered in sorted(due, key=lambda t: (t[1], t[0])):
            out += self._forgotten(key, us)
            before = self.about.get() if self.about.exists() else None
            goes_on = before is not None and (leans or told)
            subject = before[0] if goes_on else turn
            out.append((key[0], turn, "told" if goes_on and told else "follow_up" if goes_on else "fresh", subject, bool(goes_on and told and before[2])))
            self.about.update((subject, us, not answered))
            self.handle.registerTimer((us + REMEMBERED) // 1000 + 1)
        # a timer that is over when it is set waits for the next batch: what the watermark has settled is told now
        settled = min([timerValues.getCurrentWatermarkInMs() * 1000 - 1, *[t[1] - 1 for t in later]])
        yield _said(out + self._forgotten(key, max(now, settled)))

    def _forgotten(self, key, us: int) -> list[tuple]:
        """Lets the state go if its time is over; a question that nobody came back to is told."""
        subject, last, is_open = self.about.get() if self.about.exists() else (None, us, False)
        if us <= last + REMEMBERED:
            return []
        self.about.clear()
        return [(key[0], None, "left_open", subject, False)] if is_open else []

    def close(self) -> None:
        pass


def _said(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in SAID.split(", ")])
    return out.astype({"conv_id": "Int64", "turn": "Int64", "subject": "Int64", "kind": object, "clarifies": "boolean"})


def understood(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, kind, subject, clarifies`` of a stream of questions ``conv_id, turn, ts, follows, tells,
    answered``: what each is about. A question that leans on the one before, or that tells something, keeps its
    subject, if that came within REMEMBERED; what is told clarifies a question that went unanswered. A
    conversation that is left with an open question gives a row ``left_open`` once it is forgotten.

    Needs the RocksDB state store. Rows later than the watermark are left out, by Spark's own count of them."""
    late = turns.withWatermark("ts", LATE).select("conv_id", "turn", "ts", F.unix_micros("ts").alias("us"), "follows", "tells", "answered")
    return late.groupBy("conv_id").transformWithStateInPandas(Conversation(), SAID, "append", "EventTime")


def not_cancelled(steps: DataFrame, cancels: DataFrame) -> DataFrame:
    """The steps (``doc, step, ts``) of documents that nobody has called off (``doc, ts``) in the hour before:
    an outer join of two streams by interval. Both sides' watermarks bound what is kept; a cancellation that
    comes later than the watermark finds its steps taken."""
    s = steps.withWatermark("ts", LATE)
    c = cancels.select(F.col("doc").alias("c_doc"), F.col("ts").alias("c_ts")).withWatermark("c_ts", LATE)
    held = (F.col("doc") == F.col("c_doc")) & (F.col("c_ts") <= F.col("ts")) & (F.col("c_ts") >= F.col("ts") - F.expr(f"interval {HOLDS}"))
    return s.join(c, held, "left_outer").where("c_doc is null").select("doc", "step", "ts")


#: Fixed value: suggestions that a person may have open.
MOST_OPEN = 50
EVENT = "event long, us long, act string, candidate long, actor long, manages boolean"
OUTCOME = "owner long, event long, candidate long, outcome string"


class Candidates(StatefulProcessor):
    """One person's suggestions: offered, until one of accept, dismiss or reject closes it for good. Of what waits
    only the earliest row has a timer; when it is due, all that the watermark has passed has its turn in one go,
    so that state is read and written once for a person and a batch, not once for a row."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "candidates array<long>")
        self.waiting = handle.getListState("waiting", EVENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            new += [(int(r.event), int(r.us), str(r.act), int(r.candidate), int(r.actor), bool(r.manages)) for r in part.itertuples()]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(_due_ms(min(r[1] for r in new)))
        yield _outcomes([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((r for r in rows if r[1] <= now), key=lambda r: (r[1], r[0]))
        if due:
            later = [r for r in rows if r[1] > now]
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(_due_ms(min(r[1] for r in later)))
            else:
                self.waiting.clear()
        held = set(self.open.get()[0]) if due and self.open.exists() else set()
        before = set(held)
        out = [(key[0], event, candidate, self._step(held, key[0], act, candidate, actor, manages)) for event, _, act, candidate, actor, manages in due]
        if held != before:
            self.open.update((sorted(held),)) if held else self.open.clear()
        yield _outcomes(out)

    def _step(self, held: set[int], owner: int, act: str, candidate: int, actor: int, manages: bool) -> str:
        if act == "offer":
            if len(held) >= self.most:
                return "full"
            held.add(candidate)
            return "offered"
        if actor != owner and not manages:
            return "not theirs"
        if candidate not in held:
            return "closed"
        held.remove(candidate)
        return {"accept": "accepted", "dismiss": "dismissed", "reject": "rejected"}[act]

    def close(self) -> None:
        pass


def _due_ms(us: int) -> int:
    return -(-us // 1000)


def _outcomes(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["owner", "event", "candidate", "outcome"]).astype({"owner": "int64", "event": "int64", "candidate": "int64", "outcome": object})


def resolved(events: DataFrame, most: int = MOST_OPEN) -> DataFrame:
    """``owner, event, candidate, outcome`` of a stream ``owner, event, ts, act, candidate, actor, manages``: what each
    offer, accept, dismiss or reject comes to. Only its owner, or who manages users, closes a suggestion; what is closed
    or was never taken stays so; an offer beyond ``most`` open ones is refused. State is what is open alone,
    so what was declined costs nothing. Rows have their turn by time, however batches cut them.

    Needs the RocksDB state store."""
    e = events.withWatermark("ts", LATE).select("owner", "event", "ts", F.unix_micros("ts").alias("us"), "act", "candidate", "actor", "manages")
    return e.groupBy("owner").transformWithStateInPandas(Candidates(most), OUTCOME, "append", "EventTime")


def states(outcomes: DataFrame) -> DataFrame:
    """``owner, candidate, state`` of the suggestions that were taken: the last of their outcomes."""
    kept = outcomes.where(F.col("outcome").isin("offered", "accepted", "dismissed", "rejected"))
    closed = F.max(F.when(F.col("outcome") != "offered", F.col("outcome")))
    return kept.groupBy("owner", "candidate").agg(F.coalesce(closed, F.lit("offered")).alias("state"))


def search(found: DataFrame, asker: int, manages: bool, wanted: tuple[str, ...], mine_only: bool = True, limit: int = 25, offset: int = 0) -> DataFrame:
    """The suggestions in some state that a person may see, newest (largest number) first: their own, or all
    where they manage users and ask for all."""
    rows = found.where(F.col("state").isin(*wanted))
    rows = rows.where(F.col("owner") == asker) if mine_only or not manages else rows
    return rows.orderBy(F.desc("candidate")).offset(offset).limit(limit)
