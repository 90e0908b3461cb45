"""Text reducers: JSON arrays as tables, logs, match lists and diffs cut to what matters. Pure functions of one text."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import zlib
from collections import Counter, OrderedDict

import numpy as np

#: Bounds of the reducers.
LOG_LINES, ERRORS, WARNINGS, STACKS, STACK_LINES, AROUND = 50, 10, 5, 3, 20, 3
FILES, MATCHES, PER_FILE = 15, 30, 5
DIFF_LINES, DIFF_FILES, HUNKS, DIFF_AROUND = 50, 20, 10, 2
#: Words of log levels, in order of weight.
LEVELS = [("error", ["error", "fatal", "critical"]), ("fail", ["failed", "fail"]), ("warn", ["warning", "warn"]), ("info", ["info"]), ("debug", ["debug"]), ("trace", ["trace"])]
LEVEL_SCORE = {"error": 1.0, "fail": 1.0, "warn": 0.6, "info": 0.3}
#: Lines of stack traces; lines that sum up, by their frame, their counts and their first word.
TRACE = r'^\s+(at |File "|\.\.\. \d+ more)|^Traceback|^goroutine \d+|^\s+\d+: 0x|^\s+--> '
SUMMARY_RULE, SUMMARY_COUNTS = r"^(=+|-+|\*+)\s*\w.*(=+|-+|\*+)$", r"\b\d+ (passed|failed|errors?|warnings?|tests?)\b"
SUMMARY_STARTS = ("summary", "total", "result")
_MATCH = re.compile(r"^(.+?)[:-](\d+)[:-](.*)$")
_HUNK = re.compile(r"^@@ .* @@")


def content_key(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def marker(text: str) -> str:
    return f"<<ccr:{content_key(text)}>>"


class Store:
    """Texts by content key: a bounded number, oldest out first, each for a time."""

    def __init__(self, capacity: int = 1000, seconds: float = 300.0):
        self.capacity, self.seconds, self.rows = capacity, seconds, OrderedDict()

    def put(self, text: str, now: float) -> str:
        key = content_key(text)
        self.rows[key] = (text, self.rows[key][1] if key in self.rows else now)
        while len(self.rows) > self.capacity:
            self.rows.popitem(last=False)
        return key

    def get(self, key: str, now: float) -> str | None:
        found = self.rows.get(key)
        return found[0] if found and now - found[1] <= self.seconds else None


def marked_key(text: str) -> str | None:
    found = re.search(r"<<ccr:([0-9a-f]+)|hash=([0-9a-f]+)", text)
    return (found[1] or found[2]) if found else None


def detect(text: str) -> str:
    """json, diff, search or log."""
    try:
        value = json.loads(text)
        if isinstance(value, list) and len(value) >= 2 and all(isinstance(x, dict) for x in value):
            return "json"
    except ValueError:
        pass
    lines = text.split("\n")
    if any(x.startswith(("diff --git ", "--- ", "+++ ")) or _HUNK.match(x) for x in lines):
        return "diff"
    first = [x for x in lines if x.strip()][:20]
    return "search" if first and 2 * sum(bool(_MATCH.match(x)) for x in first) >= len(first) else "log"


# JSON arrays


def _type(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "bool"
    if isinstance(x, int):
        return "int"
    if isinstance(x, float):
        return "float"
    return "string" if isinstance(x, str) else "json"


def crush(text: str) -> str | None:
    """An array of objects as a header and rows: ``[n]{name:type?,...}``, columns by how many have them. An absent value is an
    empty cell, null is ``\\N``, an empty text is quoted. None for anything else."""
    try:
        rows = json.loads(text)
    except ValueError:
        return None
    if not isinstance(rows, list) or len(rows) < 2 or not all(isinstance(r, dict) for r in rows):
        return None
    have = Counter(k for r in rows for k in r)
    names = sorted(have, key=lambda k: (-have[k], k))
    header, kinds = [], {}
    for name in names:
        types = {_type(r[name]) for r in rows if name in r} - {"null"}
        kinds[name] = types.pop() if len(types) == 1 else "null" if not types else "float" if types == {"int", "float"} else "json"
        header.append(f"{json.dumps(name)}:{kinds[name]}" + "?" * (have[name] < len(rows)))
    out = [f"[{len(rows)}]{{{','.join(header)}}}"]
    for r in rows:
        cells = []
        for name in names:
            if name not in r:
                cells.append("")
            elif r[name] is None:
                cells.append("\\N")
            elif kinds[name] == "string":
                x = r[name]
                plain = x and x != "\\N" and not re.search(r'[",\n\r]', x)
                cells.append(x if plain else '"' + x.replace('"', '""') + '"')
            else:
                x = json.dumps(r[name], ensure_ascii=False, separators=(",", ":"))
                cells.append('"' + x.replace('"', '""') + '"' if re.search(r'[",\n]', x) else x)
        out.append(",".join(cells))
    return "\n".join(out)


def _cells(text: str) -> list[list[tuple[str, bool]]]:
    """Rows of cells, each with whether it was quoted."""
    rows, row, at = [], [], 0
    while at <= len(text):
        if at < len(text) and text[at] == '"':
            end = at + 1
            value = []
            while True:
                stop = text.index('"', end)
                value.append(text[end:stop])
                if text[stop + 1 : stop + 2] == '"':
                    value.append('"')
                    end = stop + 2
                else:
                    at = stop + 1
                    break
            row.append(("".join(value), True))
        else:
            stop = next((i for i in range(at, len(text)) if text[i] in ",\n"), len(text))
            row.append((text[at:stop], False))
            at = stop
        if at >= len(text) or text[at] == "\n":
            rows.append(row)
            row = []
        at += 1
    return rows


def restore(block: str) -> str | None:
    """The array that ``crush`` wrote, as compact JSON with keys in column order; None for anything else."""
    head, _, body = block.partition("\n")
    found = re.match(r"^\[(\d+)\]\{(.*)\}$", head)
    if not found:
        return None
    columns = [(json.loads(m[1]), m[2], bool(m[3])) for m in re.finditer(r'("(?:[^"\\]|\\.)*"):(\w+)(\??)', found[2])]
    rows = _cells(body)
    if len(rows) != int(found[1]):
        return None
    out = []
    for row in rows:
        r = {}
        for (name, kind, optional), (cell, quoted) in zip(columns, row, strict=True):
            if not quoted and cell == "" and optional:
                continue
            r[name] = None if not quoted and cell == "\\N" else cell if kind == "string" else json.loads(cell)
        out.append(r)
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


# Lines


def level(line: str) -> str:
    """The level whose word comes first in a line."""
    low, best = line.lower(), (len(line) + 1, "unknown")
    for name, names in LEVELS:
        for word in names:
            if found := re.search(rf"\b{word}\b", low):
                best = min(best, (found.start(), name), key=lambda x: x[0])
                break
    return best[1]


def is_trace(line: str) -> bool:
    return bool(re.match(TRACE, line))


def is_summary(line: str) -> bool:
    low = line.lower()
    return bool(re.match(SUMMARY_RULE, line) or re.search(SUMMARY_COUNTS, low) or low.startswith(SUMMARY_STARTS))


def line_score(line: str) -> float:
    base = LEVEL_SCORE.get(level(line), 0.1) + 0.3 * is_trace(line) + 0.4 * is_summary(line)
    return min(1.0, base)


def dedupe_key(line: str) -> str:
    """Runs of digits after the first colon or equals sign as one mark."""
    cut = next((i for i, c in enumerate(line) if c in ":="), len(line))
    return line[:cut] + re.sub(r"\d+", "#", line[cut:])


def _ends_and_best(rows: list[int], most: int, score) -> list[int]:
    if len(rows) <= most:
        return rows
    kept = {rows[0], rows[-1]}
    for i in sorted(rows, key=lambda i: (-score(i), i)):
        if len(kept) >= most:
            break
        kept.add(i)
    return sorted(kept)


def compress_log(text: str, bias: float = 1.0) -> str:
    lines = text.split("\n")
    if len(lines) < LOG_LINES:
        return text
    levels, scores = [level(x) for x in lines], [line_score(x) for x in lines]
    by = lambda *names: [i for i, x in enumerate(levels) if x in names]
    keep = set(_ends_and_best(by("error"), ERRORS, scores.__getitem__)) | set(_ends_and_best(by("fail"), ERRORS, scores.__getitem__))
    seen: dict[str, int] = {}
    for i in by("warn"):
        seen.setdefault(dedupe_key(lines[i]), i)
    keep |= set(list(seen.values())[:WARNINGS])
    stacks, run = [], []
    for i, x in enumerate([*lines, ""]):
        if is_trace(x):
            run.append(i)
        elif run:
            stacks.append(run)
            run = []
    for run in stacks[:STACKS]:
        keep |= set(run[:STACK_LINES])
    keep |= {i for i, x in enumerate(lines) if is_summary(x)}
    near = {j for i in keep for j in range(max(0, i - AROUND), min(len(lines), i + AROUND + 1))}
    most = adaptive_k([lines[i] for i in sorted(near)], bias, 10, len(lines))
    order = sorted(near, key=lambda i: (i not in keep, -scores[i], i))
    chosen = sorted(order[: max(most, len(keep))])
    out = "\n".join([*(lines[i] for i in chosen), f"[{len(lines) - len(chosen)} lines omitted: {len(by('error'))} errors, {len(by('fail'))} fails, {len(by('warn'))} warnings]"])
    return f"{out}\n{marker(text)}" if len(out) < 0.5 * len(text) else out


def parse_match(line: str) -> tuple[str, int, str] | None:
    found = _MATCH.match(line)
    return (found[1], int(found[2]), found[3]) if found else None


def compress_matches(text: str, context: str = "", bias: float = 1.0) -> str:
    rows = [m for m in map(parse_match, text.split("\n")) if m]
    words = [w for w in re.findall(r"\w+", context.lower()) if len(w) > 2]

    def score(body: str) -> float:
        low = body.lower()
        boost = 0.5 if re.search(r"error|fail|exception", low) else 0.4 if "warn" in low else 0.3 if re.search(r"todo|note|fixme", low) else 0.0
        return min(1.0, boost + 0.3 * sum(w in low for w in words))

    by: dict[str, list[tuple[int, str, float]]] = {}
    for file, number, body in rows:
        by.setdefault(file, []).append((number, body, score(body)))
    files = sorted(by, key=lambda f: (-sum(x[2] for x in by[f]), f))[:FILES]
    left = min(MATCHES, adaptive_k([b for f in files for _, b, _ in by[f]], bias, 5, MATCHES))
    out = []
    for f in files:
        own = sorted(by[f])
        most = min(PER_FILE, max(left, 0))
        picked = _ends_and_best(list(range(len(own))), most, lambda i, own=own: own[i][2]) if most >= 2 else list(range(min(most, len(own))))
        left -= len(picked)
        out += [f"{f}:{own[i][0]}:{own[i][1]}" for i in picked]
        if len(own) > len(picked):
            out.append(f"[... and {len(own) - len(picked)} more in {f}]")
    return "\n".join(out)


def compress_diff(text: str, context: str = "") -> str:
    lines = text.split("\n")
    if len(lines) < DIFF_LINES:
        return text
    words = [w for w in re.findall(r"\w+", context.lower()) if len(w) > 2]
    head: list[str] = []
    files: list[tuple[list[str], list[list[str]]]] = []
    for x in lines:
        if x.startswith("diff --git ") or x.startswith("--- ") and (not files or files[-1][1]):
            files.append(([x], []))
        elif not files:
            head.append(x)
        elif _HUNK.match(x):
            files[-1][1].append([x])
        elif files[-1][1]:
            files[-1][1][-1].append(x)
        else:
            files[-1][0].append(x)
    changed = lambda h: sum(x[:1] in "+-" for x in h if x)

    def score(h: list[str]) -> float:
        low = "\n".join(h).lower()
        return min(0.3, 0.03 * changed(h)) + 0.2 * sum(w in low for w in words) + 0.3 * bool(re.search(r"error|fixme|todo|security|bug", low))

    def reduced(h: list[str]) -> list[str]:
        marks = [i for i, x in enumerate(h) if x[:1] in ("+", "-")]
        near = {j for i in marks for j in range(i - DIFF_AROUND, i + DIFF_AROUND + 1)}
        return [x for i, x in enumerate(h) if i == 0 or i in near]

    ranked = sorted(range(len(files)), key=lambda i: (-sum(map(changed, files[i][1])), i))[:DIFF_FILES]
    out, dropped = list(head), 0
    for i in sorted(ranked):
        top, hunks = files[i]
        picked = _ends_and_best(list(range(len(hunks))), HUNKS, lambda k, hunks=hunks: score(hunks[k]))
        dropped += len(hunks) - len(picked)
        out += top
        for k in picked:
            out += reduced(hunks[k])
    plus, minus = sum(x.startswith("+") and not x.startswith("+++") for x in lines), sum(x.startswith("-") and not x.startswith("---") for x in lines)
    out.append(f"[{len(files)} files, +{plus} -{minus}, {dropped} hunks omitted]")
    body = "\n".join(out)
    return f"{body}\n{marker(text)}" if len(out) < 0.8 * len(lines) else body


def compress(text: str, strategy: str | None = None, context: str = "") -> str:
    kind = strategy or detect(text)
    if kind == "json":
        return crush(text) or text
    return {"diff": lambda: compress_diff(text, context), "search": lambda: compress_matches(text, context), "log": lambda: compress_log(text)}[kind]()


# How many items are enough

_FNV, _PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Shingles whose bits are counted at a time.
SHINGLES = 1 << 15


def fnv64(data: bytes) -> int:
    h = _FNV
    for b in data:
        h = (h ^ b) * _PRIME % (1 << 64)
    return h


def _shingle_hashes(codes: np.ndarray) -> np.ndarray:
    """``fnv64`` of the UTF-8 bytes of every four characters in a row of ``codes`` (code points), all at once."""
    n = len(codes) - 3
    out, prime = np.full(n, _FNV, np.uint64), np.uint64(_PRIME)
    lead = np.where(codes < 0x80, codes, np.where(codes < 0x800, 0xC0 | codes >> 6, np.where(codes < 0x10000, 0xE0 | codes >> 12, 0xF0 | codes >> 18))).astype(np.uint64)
    size = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    longest = int(size.max())
    for k in range(4):
        out = (out ^ lead[k : k + n]) * prime
        own, length = codes[k : k + n], size[k : k + n]
        for j in range(1, longest):
            rest = np.clip(length - 1 - j, 0, None) * 6  # the bits below this byte's
            out = np.where(length > j, (out ^ (0x80 | own >> rest & 0x3F).astype(np.uint64)) * prime, out)
    return out


def simhashes(texts: list[str]) -> np.ndarray:
    """Of each text the votes of the hashes of its four-character shingles, each counted as often as it occurs; a shorter text is one."""
    low = [x.lower() for x in texts]
    sizes = np.array([len(x) for x in low], np.int64)
    votes = np.zeros((len(low), 64), np.int64)
    full = sizes >= 4
    codes = np.frombuffer("".join(x for x in low if len(x) >= 4).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends, owner = np.cumsum(sizes[full]), np.flatnonzero(full)
    for at in range(0, max(len(codes) - 3, 0), SHINGLES):
        hashes = _shingle_hashes(codes[at : at + SHINGLES + 3])
        place = np.arange(at, at + len(hashes))
        item = np.searchsorted(ends, place, "right")
        whole = place + 4 <= ends[item]  # not over the end of its text
        hashes, item = hashes[whole], item[whole]
        if len(hashes):
            starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[owner[item[starts]]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    out = np.packbits(2 * votes > np.maximum(sizes - 3, 1)[:, None], axis=1, bitorder="little").reshape(-1, 8).view("<u8").reshape(-1).astype(np.uint64)
    for i in np.flatnonzero(~full):
        out[i] = fnv64(low[i].encode("utf-8", "surrogatepass"))
    return out


def simhash64(text: str) -> int:
    """``simhashes`` of one text."""
    return int(simhashes([text])[0])


def clusters(items: list[str], radius: int = 3) -> int:
    centres, n = np.empty(len(items), np.uint64), 0
    for h in simhashes(items):
        if not n or np.bitwise_count(centres[:n] ^ h).min() > radius:
            centres[n] = h
            n += 1
    return n


def novelty(items: list[str]) -> list[int]:
    """How many different word pairs the items up to each one hold; an item of fewer than two words counts as a pair of its own."""
    seen: set[tuple[str, str]] = set()
    out = []
    for x in items:
        words = x.lower().split()
        seen.update(zip(words, words[1:], strict=False) if len(words) > 1 else [(words[0] if words else "", "")])
        out.append(len(seen))
    return out


def bend(curve: list[int]) -> int | None:
    """Where a rising curve is highest above its chord, counted from 1; 1 if it does not rise, nothing if it is nowhere well above."""
    first, rise, run = curve[0], curve[-1] - curve[0], len(curve) - 1
    if rise == 0:
        return 1
    above = [(y - first) / rise - i / run for i, y in enumerate(curve)]
    top = max(above)
    return None if top < 0.05 else above.index(top) + 1


def adaptive_k(items: list[str], bias: float = 1.0, least: int = 3, most: int = 0) -> int:
    """How many of the items, the most important first, carry most of what they say. All of eight or fewer; as many as there are
    clusters if these are three at most. Else the bend of the curve of new word pairs; without a bend a share of the items that
    rises with their diversity, which is also the floor where they are very diverse. That times ``bias``, a fifth more if the part
    compresses very unlike the whole, between ``least`` and ``most`` (0: no bound)."""
    n = len(items)
    most = most if most > 0 else n
    if n <= 8:
        return n
    groups = clusters(items)
    if groups <= 3:
        return min(max(least, groups), most)
    spread, knee = groups / n, bend(novelty(items))
    share = max(least, int(n * (0.3 + 0.7 * spread)))
    wanted = share if knee is None else max(knee, share) if spread > 0.7 else knee
    k = min(max(least, int(wanted * bias)), most)
    whole, part = ("\n".join(x).encode() for x in (items, items[:k]))
    if k < n and len(whole) >= 200:
        ratio = lambda x: len(zlib.compress(x, 1)) / len(x) if x else 1.0
        if abs(ratio(whole) - ratio(part)) > 0.15:
            k = min(int(k * 1.2), most)
    return max(least, min(k, most))


def csv_line(values: list[str]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(values)
    return out.getvalue()
