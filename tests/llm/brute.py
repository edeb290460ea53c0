"""Plain reference implementations over lists of rows, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = float("inf")


def _lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def shingle_components(rows) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id), by comparing all pairs that share a shingle."""
    sets = {}
    for doc_id, text in rows:
        words = WORD.findall(_lower(text or ""))
        n = max(1, len(words) - 4) if words else 0
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(n)}
    holders = defaultdict(list)
    for doc_id, shingles in sets.items():
        for s in shingles:
            holders[s].append(doc_id)
    overlap = Counter()
    for docs in holders.values():
        docs = sorted(docs)
        for i, a in enumerate(docs):
            for b in docs[i + 1 :]:
                overlap[a, b] += 1
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), both in overlap.items():
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def substring_removal(rows, length: int = 50) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256) for strings of bytes."""
    data = {doc_id: (text or "").encode() for doc_id, text in rows}
    first: dict[bytes, int] = {}
    for doc_id in sorted(data):
        b = data[doc_id]
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], doc_id)
    out = {}
    for doc_id, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < doc_id:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[doc_id] = (len(b), sum(gone), spans, _sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def window_removal(rows, length: int = 20) -> dict[int, tuple[int, int, str]]:
    """doc_id -> (n_words, n_removed, kept_sha256) for windows of words."""
    words = {doc_id: WORD.findall(text or "") for doc_id, text in rows}
    seen, out = set(), {}
    for doc_id in sorted(words):
        w = words[doc_id]
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            window = tuple(w[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc_id] = (len(w), sum(gone), _sha(kept.encode()))
    return out


def unigram_scores(rows) -> dict[int, tuple]:
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    tokens = {d: [*WORD.findall(_lower(t or "")), None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in tokens}
    counts = Counter(t for d, ts in tokens.items() if not held[d] for t in ts)
    total, kinds = sum(counts.values()), len(counts)
    score = lambda t: log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1)))
    return {
        d: (held[d], len(ts), sum(counts[t] > 0 for t in ts), total, sum(map(score, ts))) for d, ts in tokens.items()
    }


def ppm_code_length(rows, order: int, start: int = 0xFE, end: int = 0xFF) -> dict[int, float]:
    """doc_id -> log10 probability under a byte model with escapes and exclusion, symbol by symbol."""
    seen: dict[bytes, Counter] = defaultdict(Counter)
    coded = {d: bytes([start] * order) + (t or "").encode().lower() + bytes([end]) for d, t in rows}
    for d, b in coded.items():
        if zlib.crc32(str(d).encode()) % 10:
            for i in range(order, len(b)):
                for k in range(order + 1):
                    seen[b[i - k : i]][b[i]] += 1
    out = {}
    for d, b in coded.items():
        total = 0.0
        for i in range(order, len(b)):
            excluded: set[int] = set()
            for k in range(order, -1, -1):
                node = seen.get(b[i - k : i], {})
                left = {s: c for s, c in node.items() if s not in excluded}
                if not left:
                    continue
                weight = sum(left.values()) + len(left)
                if b[i] in left:
                    total += log10(left[b[i]] / weight)
                    break
                total += log10(len(left) / weight)
                excluded |= set(node)
            else:
                total -= log10(256 - len(excluded))
        out[d] = total
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub(r"[^0-9]", "", m)) <= 19 and _luhn(re.sub(r"[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
}


def personal_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, place of the kind, kind, end) of the base spans, ordered."""
    found = []
    for place, (kind, (pattern, valid)) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            if valid(m[0]):
                found.append((m.start(), place, kind, m.end()))
    return sorted(found)


def personal_data(rows) -> dict[int, tuple]:
    """doc_id -> (n_email, n_ip, n_card, n_phone, base_sha256)."""
    out = {}
    for d, text in rows:
        spans = personal_spans(text)
        listed = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)
        out[d] = (*(sum(s[2] == k for s in spans) for k in KINDS), _sha(listed.encode()))
    return out


def spoiled_words(rows) -> list[str]:
    """Every lower-cased run of letters, some with a letter less by their checksum; nulls as empty."""
    out = []
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = _lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out.append(run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run)
    return out


def _one_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[i:] == b[i + 1 :])


def word_forms(counts: dict[str, int], ratio: int = 10) -> dict[str, tuple]:
    """word -> (form, root, n, n_near, form_n), by comparing all pairs."""
    near = {w: sorted((-counts[v], v) for v in counts if _one_apart(w, v)) for w in counts}
    form = {w: vs[0][1] if vs and -vs[0][0] >= ratio * counts[w] else None for w, vs in near.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


_NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest_edits(codes: list[int]) -> tuple[str, int]:
    """The first of the cheapest sequences of edits, letter by letter, from exact costs of what is left."""
    n, far = len(codes), 10**9
    left = {}
    for k in range(n, -1, -1):
        for state in ("", "s", "u", "a"):
            left[k, state] = {"": 0, "a": 0, "u": 3, "s": 6}[state] if k == n else far
        if k < n:
            for _ in range(3):
                for state in ("", "s", "u", "a"):
                    left[k, state] = min((c + left[q] for _, c, q in _edits_at(codes, k, state, left)), default=far)
    out, k, state = "", 0, ""
    while k < n or left[k, state]:
        if k == n:
            out, state = out + "I", {"s": "u", "u": "a"}[state]
            continue
        cost = left[k, state]
        letter, _, (k, state) = min(e for e in _edits_at(codes, k, state, left) if e[1] + left[e[2]] == cost)
        out += letter
    return out, left[0, ""]


def _edits_at(codes, k, state, left):
    """(letter, cost, where it leads) of every edit that may come next."""
    initial, gone, cut = "sua?"[codes[k] & 3], codes[k] & 4, 3 * bool(codes[k] & 8)
    onward = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
    yield "D", 4, (k + 1, state)
    yield "I", 3, (k, onward)
    if not gone:
        yield "R", 3 + cut, (k + 1, onward)
        if initial in _NEXT[state]:
            yield "K", cut, (k + 1, _NEXT[state][initial])


def repaired_conversations(rows) -> dict:
    """conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, hash, turns) of rows (conv, turn, role, text)."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, members in groups.items():
        members.sort()
        blank = duplicate = truncated = illegal = 0
        seen, codes = set(), []
        for _, _, role, text in members:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            is_blank, is_seen = not bare, (role, text) in seen
            cut = not is_blank and not is_seen and bare[-1] not in ".!?"
            blank, duplicate, truncated = blank + is_blank, duplicate + (is_seen and not is_blank), truncated + cut
            codes.append({"s": 0, "u": 1, "a": 2}.get(role[:1], 3) | 4 * (is_blank or is_seen) | 8 * cut)
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(members, members[1:]))
        turns = {m[1] for m in members if m[0]}
        audit, cost = cheapest_edits(codes)
        repaired, k = [], 0
        for letter in audit:
            after = "assistant" if repaired and repaired[-1][0][:1] == "u" else "user"
            if letter == "I":
                repaired.append((after, ""))
                continue
            if letter != "D":
                repaired.append((members[k][2] if letter == "K" else after, members[k][3]))
            k += 1
        text = "\n".join(f"{role}:{text}" for role, text in repaired)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, _sha(text.encode()), repaired)
    return out
