"""The rule engine over ordered tool calls: triggers, cooldowns, caps and follow-through."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weight of severities; calls between fires of a rule; fires of the mildest severity in a session; calls to look
#: back and ahead; calls after which a brief is due; words of a report; characters of a text that should say why it cites.
SEVERITY = {"blocker": 4, "warning": 3, "hint": 2, "fyi": 1}
COOLDOWN, FYI_CAP, BACK, AHEAD = 5, 3, 5, 10
BRIEF_DUE, REPORT_WORDS, CITE_CHARS = 30, 20, 40
#: Rules by id: tool that triggers (* for any), severity, tools that follow through, cooldown.
RULES = {
    "clear-without-report-detail": ("quest_fulfill", "fyi", ("quest_update", "quest_journal"), COOLDOWN),
    "inscribe-looks-like-quest": ("lore_inscribe", "hint", ("quest_post",), COOLDOWN),
    "inscribe-without-appraise": ("lore_inscribe", "fyi", ("lore_appraise",), COOLDOWN),
    "inscribe-without-transfer-reasoning": ("lore_inscribe", "fyi", ("lore_update", "lore_reforge"), COOLDOWN),
    "journal-outside-accepted": ("quest_journal", "hint", ("quest_accept",), COOLDOWN),
    "no-brief-24h": ("quest_fulfill", "hint", ("quest_brief",), COOLDOWN),
    "no-session-start": ("*", "hint", ("session_start", "quest_bounties"), COOLDOWN),
    "session-end-without-brief": ("*", "hint", ("quest_brief",), 10),
    "slug-query": ("lore_appraise", "hint", ("quest_list", "quest_scroll"), COOLDOWN),
}
BOOTSTRAP = ("session_start", "quest_bounties")
ALIASES = {"quest_clear": "quest_fulfill"}
#: Phrases of tasks; a slug, a task's id; phrases that say what a cited text changes, and phrases that say it changes nothing.
TODO = r"\btodo\b|\bneed to\b|\bshould fix\b|\bmust fix\b|\bwe should\b"
SLUG_ONLY = r"^[a-z][a-z0-9]*(-[a-z0-9]+)+$"
TASK_ID = r"^QUEST-\d+$"
TRANSFER_MARKER = r"\bbecause\b|\btransfers?\b|\brepurposed?\b|\binverts?\b|\badapts?\b|\bdelta\b|\bextends?\b|\bdeclines?\b|\breverses?\b|\bso the conditions\b|\bsame conditions\b"
TRIVIAL_TRANSFER = r"\bno delta\b|\bsame shape\b|\bsame approach\b"
#: Either of two.
SLUG, TRANSFER = f"{TASK_ID}|{SLUG_ONLY}", f"{TRANSFER_MARKER}|{TRIVIAL_TRANSFER}"
CITES = r"(ENTRY|LORE)-\d+"


def canonical(tool: Column) -> Column:
    return F.when(tool == "quest_clear", "quest_fulfill").otherwise(tool)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "blocker", 4).when(severity == "warning", 3).when(severity == "fyi", 1).otherwise(2)


def triggers(calls: DataFrame) -> DataFrame:
    """A row for each call and rule that its call triggers, before cooldowns. ``calls(id, session_id, ts, tool, arg, empty_result,
    brief_stale)``: the argument is the query, the task, the report or the text, as the tool has it."""
    order = W.partitionBy("session_id").orderBy("ts", "id")
    sofar = order.rowsBetween(W.unboundedPreceding, 0)
    ever = lambda cond, w: F.coalesce(F.max(cond).over(w), F.lit(False))
    own = calls.withColumn("tool", canonical(F.col("tool")))
    arg, tool = F.trim("arg"), F.col("tool")
    own = own.withColumns({
        "started": ever(tool.isin(*BOOTSTRAP), sofar),
        "briefed": ever(tool == "quest_brief", sofar),
        "n": F.row_number().over(order),
        "searched": ever(tool == "lore_appraise", order.rowsBetween(-BACK, -1)),
        "accepted": ever(tool == "quest_accept", W.partitionBy("session_id", F.upper(arg)).orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)),
    })
    low, words = F.lower(arg), F.when(arg == "", 0).otherwise(F.size(F.split(arg, r"\s+")))
    on = {
        "clear-without-report-detail": (tool == "quest_fulfill") & (words < REPORT_WORDS),
        "inscribe-looks-like-quest": (tool == "lore_inscribe") & low.rlike(TODO),
        "inscribe-without-appraise": (tool == "lore_inscribe") & ~F.col("searched"),
        "inscribe-without-transfer-reasoning": (tool == "lore_inscribe") & arg.rlike(CITES) & (F.length(arg) >= CITE_CHARS) & ~low.rlike(TRANSFER),
        "journal-outside-accepted": (tool == "quest_journal") & (arg != "") & ~F.col("accepted"),
        "no-brief-24h": (tool == "quest_fulfill") & F.col("brief_stale"),
        "no-session-start": ~F.col("started"),
        "session-end-without-brief": (F.col("n") >= BRIEF_DUE) & ~F.col("briefed"),
        "slug-query": (tool == "lore_appraise") & F.col("empty_result") & arg.rlike(SLUG),
    }
    rules = F.array(*(F.when(cond, F.lit(rule)) for rule, cond in on.items()))
    return own.select("id", "session_id", "tool", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule_id"))


def recently_called(calls: DataFrame, tool: str, n: int = BACK) -> DataFrame:
    order = W.partitionBy("session_id").orderBy("ts", "id").rowsBetween(-n, -1)
    return calls.select("id", "session_id", F.coalesce(F.max(canonical(F.col("tool")) == tool).over(order), F.lit(False)).alias("recent"))


def call_count(calls: DataFrame) -> DataFrame:
    return calls.select("id", "session_id", F.row_number().over(W.partitionBy("session_id").orderBy("ts", "id")).alias("n"))


class Session:
    """State of one session: what fired when, what waits for follow-through, and the last calls. Calls come in order."""

    def __init__(self, state: dict | None = None):
        state = state or {}
        self.n = state.get("n", 0)
        self.last = state.get("last", {})
        self.fyi = state.get("fyi", 0)
        self.started = state.get("started", False)
        self.briefed = state.get("briefed", False)
        self.accepted = state.get("accepted", {})
        self.recent = state.get("recent", [])
        self.pending = state.get("pending", [])

    def dump(self) -> dict:
        return vars(self)

    def _settle(self, tool: str) -> list[tuple[int, str, int, int]]:
        decided, waiting = [], []
        for at, fired, rule in self.pending:
            age = self.n - at
            if tool in RULES[rule][2]:
                decided.append((fired, rule, 1, age))
            elif age >= AHEAD:
                decided.append((fired, rule, 0, age))
            else:
                waiting.append((at, fired, rule))
        self.pending = waiting
        return decided

    def call(self, call_id: int, tool: str, arg: str, empty: bool = False, brief_stale: bool = False) -> tuple[str | None, list[tuple[int, str, int, int]]]:
        """The rule that fires, if one does, and the fires that this call decides: (call, rule, hit, offset)."""
        tool, arg = ALIASES.get(tool, tool), (arg or "").strip()
        self.n += 1
        self.started = self.started or tool in BOOTSTRAP
        self.briefed = self.briefed or tool == "quest_brief"
        if tool == "quest_accept":
            self.accepted[arg.upper()] = True
        decided, low = self._settle(tool), arg.lower()
        on = {
            "clear-without-report-detail": len(arg.split()) < REPORT_WORDS,
            "inscribe-looks-like-quest": re.search(TODO, low),
            "inscribe-without-appraise": "lore_appraise" not in self.recent,
            "inscribe-without-transfer-reasoning": re.search(CITES, arg) and len(arg) >= CITE_CHARS and not re.search(TRANSFER, low),
            "journal-outside-accepted": arg and arg.upper() not in self.accepted,
            "no-brief-24h": brief_stale,
            "no-session-start": not self.started,
            "session-end-without-brief": self.n >= BRIEF_DUE and not self.briefed,
            "slug-query": empty and re.search(SLUG, arg),
        }
        best = None
        for rule, (trigger, severity, follow, cooldown) in sorted(RULES.items()):
            if trigger not in ("*", tool) or not on[rule] or set(follow) & set(self.recent):
                continue
            if rule in self.last and self.n - self.last[rule] < cooldown or severity == "fyi" and self.fyi >= FYI_CAP:
                continue
            if best is None or SEVERITY[severity] > SEVERITY[best[1]]:
                best = rule, severity
        self.recent = (self.recent + [tool])[-BACK:]
        if best is None:
            return None, decided
        self.last = {**self.last, best[0]: self.n}
        self.fyi += best[1] == "fyi"
        self.pending = [*self.pending, (self.n, call_id, best[0])]
        return best[0], decided


def _walk(it):
    """Calls come sorted by session, time and id. Of a session only its state and the fires that wait for follow-through are held."""
    now, state, waiting = None, Session(), {}
    for batch in it:
        out = []

        def settle(decided):
            out.extend((call, now, rule, hit, offset) for call, rule, hit, offset in decided if waiting.pop(call, None))  # noqa: B023

        for row in zip(*(batch[c].to_pylist() for c in ("session_id", "id", "tool", "arg", "empty_result", "brief_stale")), strict=True):
            if row[0] != now:
                out.extend((call, now, rule, None, None) for call, rule in waiting.items())
                now, state, waiting = row[0], Session(), {}
            rule, decided = state.call(row[1], row[2], row[3], bool(row[4]), bool(row[5]))
            settle(decided)
            if rule:
                waiting[row[1]] = rule
        yield _fires(out)
    yield _fires([(call, now, rule, None, None) for call, rule in waiting.items()])


def _fires(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = ["id", "session_id", "rule_id", "followed_through", "followup_offset"], [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def evaluate(calls: DataFrame) -> DataFrame:
    """Fires ``(id, session_id, rule_id, followed_through, followup_offset)``: at most one a call, the most severe, ties by rule. A
    session's fires depend on its earlier ones, so its calls are walked in order, as a stream that Spark sorts and can spill; a call
    without a session is of none and is left out."""
    own = calls.where("session_id IS NOT NULL").select("session_id", "ts", F.col("id").cast("long").alias("id"), "tool", "arg", "empty_result", "brief_stale")
    rows = own.repartition("session_id").sortWithinPartitions("session_id", "ts", "id").drop("ts")
    return rows.mapInArrow(_walk, "id long, session_id string, rule_id string, followed_through long, followup_offset long")
